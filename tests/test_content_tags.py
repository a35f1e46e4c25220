"""F1, F2, F6-F8 through DataFrames; hashes come from hashlib."""

import hashlib

from pyspark.sql import functions as F

from webloom.functions import tags as TG


def test_id_hash_and_color(spark):
    texts = ["", "web page body", "Grüße, 世界\n", "x" * 10_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", TG.id_hash(F.col("text")).alias("h"), TG.id_color(TG.id_hash(F.col("text"))).alias("c")).collect():
        want = hashlib.sha256(r.text.encode()).hexdigest()
        assert r.h == want and r.c == "#" + want[:6]


def test_color_edge_cases(spark):
    cases = [("00ff7A11", "#00ff7a"), ("0x12ab", ""), ("12345", ""), ("1234", ""), ("", ""), ("fFeEdD", "#ffeedd")]
    df = spark.createDataFrame(cases, "h string, want string")
    assert all(r.got == r.want for r in df.select(TG.id_color(F.col("h")).alias("got"), "want").collect())


def test_tags_from_string(spark):
    raw = ["kind:b,kind:a", "z:1,,z:1", "Ü,u,U", "", ",", "one"]
    df = spark.createDataFrame([(x,) for x in raw], "s string")
    for r in df.select("s", TG.tags_from_string(F.col("s")).alias("got")).collect():
        assert r.got == sorted(set(r.s.split(",")), key=lambda t: t.encode())


def test_omit_duplicates_and_to_string(spark):
    lists = [["q:2", "q:1", "q:2"], [], ["", "", "k"]]
    df = spark.createDataFrame([(x,) for x in lists], "t array<string>")
    for r in df.select("t", TG.omit_duplicates(F.col("t")).alias("o"), TG.tags_to_string(F.col("t")).alias("s")).collect():
        assert r.o == list(dict.fromkeys(r.t)) and r.s == ",".join(dict.fromkeys(r.t))


def test_source_tags_first_occurrence_order(spark):
    from webloom.operators import content as CT
    ing = spark.createDataFrame([("h1", 3, "source:b"), ("h1", 1, "source:a"), ("h1", 5, "source:a"),
                                 ("h2", 2, "source:z")], "id_hash string, seq int, tag string")
    got = {r.id_hash: r.tags for r in CT.source_tags(ing).collect()}
    assert got == {"h1": ["source:a", "source:b"], "h2": ["source:z"]}


def test_find_tagged_counts_empty_tag(spark):
    from webloom.operators import content as CT
    store = spark.createDataFrame([("a", [""]), ("b", []), ("c", ["x:1", "y:2"])], "id_hash string, tags array<string>")
    assert sorted(r.id_hash for r in CT.find_tagged(store).collect()) == ["a", "c"]
    assert [r.id_hash for r in CT.find_tagged(store, all_of=["x:1"], none_of=["z"]).collect()] == ["c"]
