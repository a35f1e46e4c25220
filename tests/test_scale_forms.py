"""Forms for hot keys and large rule sets: the same answers as the plain ones."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import cache, classify, content, cookies, crawl, store, timeline
from webloom.sources import rules

SETS = ("jar_id long, event_id long, ordinal int, ts timestamp, url string, name string, value string, domain_attr string, "
        "path_attr string, max_age int, expires timestamp, secure boolean, httponly boolean")


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def history(spark):
    """Three jars; one holds nearly all events, all on one day, many at the same instant."""
    rng = random.Random(12)
    day = dt.datetime(2024, 5, 1)
    sets, reqs = [], []
    for i in range(900):
        jar = 0 if rng.random() < 0.9 else rng.randint(1, 2)
        ts = day + dt.timedelta(seconds=rng.randrange(0, 40_000, 20))
        host = rng.choice(("a.example.com", "b.example.com", "example.com"))
        if rng.random() < 0.4:
            reqs.append((jar, i, ts, f"http{rng.choice(('', 's'))}://{host}/{rng.choice(('', 'shop', 'shop/1'))}"))
        else:
            age = rng.choice((None, None, 60, 3000, -1))
            for o in range(rng.choice((1, 1, 2))):
                sets.append((jar, i, o, ts, f"https://{host}/x", rng.choice("pq"), str(i), rng.choice((None, ".example.com")),
                             rng.choice((None, "/shop")), age, None, rng.random() < 0.3, False))
    reqs = spark.createDataFrame(reqs, "jar_id long, event_id long, ts timestamp, url string")
    return cookies.entries(spark.createDataFrame(sets, SETS)).cache(), cookies.requests_prepared(reqs).cache()


def test_buckets(spark):
    times = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 7 % 1000).alias("ts"))
    bounds = timeline.bucket_bounds(times, 60)
    assert len(bounds) == 16 and timeline.bucket_bounds(times) == []
    got = times.select(F.unix_micros("ts"), timeline.bucket_of(F.col("ts"), bounds)).collect()
    assert all(b == sum(x <= t for x in bounds) for t, b in got)
    assert max(collections.Counter(b for _, b in got).values()) <= 80


@pytest.mark.parametrize("rows", [30, 250])
def test_versions_in_buckets(history, rows):
    ents, reqs = history
    whole = cookies.versions(ents, reqs)
    assert counted(cookies.versions(ents, reqs, rows)) == counted(whole)
    assert counted(cookies.versions(ents, None, rows)) == counted(cookies.versions(ents))


def test_entries_are_worked_out_once(spark, history):
    """The buckets' summary rows do not run the plan of the entries again."""
    ents, reqs = history
    runs = spark.sparkContext.accumulator(0)

    def seen(value):
        runs.add(1)
        return value

    watched = ents.withColumn("value", F.udf(seen, "string")("value"))
    want = counted(cookies.versions(ents, reqs))
    assert counted(cookies.versions(watched, reqs, 30)) == want
    assert runs.value == ents.count()


def test_versions_agree_with_replay(history):
    """Creation times by a plain replay of the jar."""
    ents, reqs = history
    events = [(r["ts"], r["event_id"], r["ordinal"], r) for r in ents.collect()]
    events += [(r["ts"], r["event_id"], -1, r) for r in reqs.collect()]
    jar, want = {}, collections.Counter()
    for ts, eid, ordinal, r in sorted(events, key=lambda x: x[:3]):
        own = jar.setdefault(r["jar_id"], {})
        if ordinal == -1:
            for k in [k for k, (c, p, e) in own.items() if p and e <= ts]:
                del own[k]
        elif r["remove"]:
            own.pop(r["cookie_id"], None)
        else:
            made = own[r["cookie_id"]][0] if r["cookie_id"] in own else (ts, eid)
            own[r["cookie_id"]] = (made, r["persistent"], r["expires"])
            want[r["jar_id"], r["cookie_id"], ts, eid, *made] += 1
    got = cookies.versions(ents, reqs, 40).select("jar_id", "cookie_id", "valid_from", "from_eid", "creation", "seq_eid")
    assert counted(got) == want


def test_sent_cookies_is_the_interval_join(history):
    ents, reqs = history
    vers = cookies.versions(ents, reqs).cache()
    cols = ["jar_id", "req_id", "cookie_id", "value", "creation"]
    want = collections.Counter()
    rs = reqs.collect()
    for v in vers.collect():
        for r in rs:
            if r["jar_id"] != v["jar_id"] or (v["valid_from"], v["from_eid"]) >= (r["ts"], r["event_id"]):
                continue
            if v["valid_to"] is not None and (r["ts"], r["event_id"]) >= (v["valid_to"], v["to_eid"]):
                continue
            path, mine = v["path"], r["req_path"]
            if (v["persistent"] and v["expires"] <= r["ts"] or v["secure"] and not r["https"]
                    or not (v["domain"] == r["host"] or not v["host_only"] and r["host"].endswith("." + v["domain"]))
                    or not (mine == path or mine.startswith(path) and (path.endswith("/") or mine[len(path):].startswith("/")))):
                continue
            want[v["jar_id"], r["event_id"], v["cookie_id"], v["value"], v["creation"]] += 1
    assert len(want) > 300
    for rows in (25, 1 << 20):
        assert counted(cookies.sent_cookies(vers, reqs, rows).select(*cols)) == want


def test_large_rule_set(spark):
    """5,000 classes by the join of hosts and rules, against those of them that can match, compiled."""
    rng = random.Random(3)
    base = rules.default_classes_dicts()
    odd = [{"name": "bad", "class": "POST", "domain": "q.example.com", "path": [{"value": "(", "type": "REGEX"}]},
           {"name": "sub", "class": "LIST", "priority": 3, "domain": "com", "match_subdomain": True, "allow_subdomain": True,
            "path": [{"value": "x", "type": "EXACT"}, {"value": "", "type": "EXACT"}]},
           {"name": "empty", "class": "FILE", "domain": "", "match_subdomain": True, "allow_http": True, "allow_subdomain": True},
           {"name": "query", "class": "POST", "priority": 2, "domain": "k.example.net", "path": [{"value": "^a", "type": "REGEX", "default": "a b"}],
            "query": {"t": {"value": "^[0-9]+$", "type": "REGEX"}, "d": {"value": "z", "type": "EXACT", "default": "z"}}}]
    filler = [{"name": f"f{i}", "class": "POST", "priority": rng.randint(0, 9), "domain": f"h{i}.example.edu",
               "path": [{"value": f"^p{i % 50}", "type": "REGEX"}]} for i in range(5000)]
    urls = ["https://a.example.com/en/1", "http://a.example.com/en/1?x=1#f", "https://b.example.org/de/22?page=3", "https://example.org/de/22",
            "https://q.example.com/(", "https://x.y.com/x/z", "https://y.com/x", "http://host./p", "http:///p", "k.example.net/a", None, "", "http://[bad",
            "https://k.example.net/ab/c?t=1&t=22&u=5", "https://k.example.net/?t=1", "https://k.example.net/b?t=1", "http://k.example.net/a?t=x",
            "https://spam-farm.example.org/x", "https://cheap-pills.example.com:8080/en/1", "https://u@a.example.com/fr/9", "https://a.example.com/%zz/1"]
    urls += [f"https://h{i}.example.edu/p{i % 50}/{i}" for i in range(0, 5000, 500)] + [f"https://h{i}.example.edu/q" for i in (7, 8)]
    df = spark.createDataFrame(list(enumerate(urls)), "id long, url string")
    few = [rules.url_class(d, i) for i, d in enumerate(base + odd + filler[::500])]
    many = [rules.url_class(d, i) for i, d in enumerate(base + odd + filler)]
    want = classify.classify(df, few)
    assert len(few) <= classify.LITERAL_CLASSES < len(many)
    got = classify.classify(df, many)
    assert got.columns == want.columns and counted(got) == counted(want)
    assert len({r["uclass"] for r in got.collect()}) > 12
    assert counted(classify.classify_by_host(df, few)) == counted(want)


def test_latest_with_nulls_and_repeats(spark):
    rows = [("a", None, 1, "x"), ("b", 1, 1, "y"), ("b", 1, 1, "y"), ("b", None, 9, "z"), (None, 2, 2, "n"), (None, 3, None, "m"), ("c", None, None, "w")]
    df = spark.createDataFrame(rows, "k string, t int, v int, body string")
    got = {r["k"]: r["body"] for r in cache.latest(df, "k", ["t", "v"]).collect()}
    assert got == {"a": "x", "b": "y", None: "m", "c": "w"} and cache.latest(df, "k", ["t", "v"]).count() == 4


def test_bodies_with_null_and_repeated_sequences(spark):
    df = spark.createDataFrame([(None, "p"), (None, "q"), (1, "r"), (1, "s"), (1, "r"), (2, "r"), (3, None)], "seq int, body string")
    got = content.bodies(content.ingest(df), df)
    assert sorted((r["body"] or "", r["n_copies"]) for r in got.collect()) == sorted(
        (r["body"] or "", r["n"]) for r in df.groupBy("body").agg(F.count("*").alias("n")).collect())


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    import os
    path = str(tmp_path / "s")
    first = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), F.lit("old").alias("body"))
    assert store.read(spark, path) is None and store.put(first.limit(0), path, "k", ["v"]) == 0
    store.put(first, path, "k", ["v"], 16)
    stamp = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
    update = spark.createDataFrame([("3", 2, "new"), ("3", 0, "late"), ("5", 0, "late"), ("999", 1, "more")], "k string, v int, body string")
    for _ in range(2):  # an update that is run again changes nothing
        assert store.put(update, path, "k", ["v"], 16) <= 3
        got = {r["k"]: r["body"] for r in store.read(spark, path).collect()}
        assert len(got) == 201 == store.read(spark, path).count()
        assert (got["3"], got["5"], got["999"], got["7"]) == ("new", "old", "more", "old")
    same = [d for d in stamp if sorted(os.listdir(f"{path}/{d}")) == stamp[d]]
    assert len(same) >= len(stamp) - 3


def test_ancestors_of_a_long_chain(spark):
    depth = 64
    reached = spark.createDataFrame([(i, i, i - 1 if i else None) for i in range(depth + 1)], "node long, depth int, parent long")
    got = counted(crawl.ancestors(reached, depth).select("node", "anc"))
    assert got == collections.Counter((i, j) for i in range(depth + 1) for j in range(i))
    assert counted(crawl.ancestors(reached, 5).select("node", "anc")) == collections.Counter(
        (i, j) for i in range(depth + 1) for j in range(max(0, i - 5), i))
