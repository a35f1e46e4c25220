"""Each operator against brute force, with the awkward rows of every contract."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from webloom.llm import (common, decontam, graph, jaccard, langid, licenses, packing, pivots, quality, secrets, textcore,  # noqa: E402
                         tokens, toxicity)

PATH = str(P.path("word_bpe_49k.json"))
DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "token string, rep long, n int, live boolean, text_hash string, id int"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Ids, near copies of several grades, exact copies, repeated rows, nulls,
    blanks, short and very long texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = prose(rng, rng.randint(30, 90), words).split()
        for edits in (0, 0, 1, 1, 2, 5):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((n, " ".join(w).title() if n % 5 == 0 else " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "two one"),
             (n + 6, "solo"), (n + 7, prose(rng, 30_000, words)), (0, rows[0][1]), (0, rows[0][1]), (None, rows[0][1]), (None, None)]
    return [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(3)


@pytest.fixture(scope="module")
def wide(spark, docs):
    """The same with columns whose names the operators use inside."""
    return docs.select("*", F.lit("x").alias("token"), F.lit(1).alias("rep"), F.lit(2).alias("n"), F.lit(True).alias("live"),
                       F.lit("h").alias("text_hash"), F.lit(3).alias("id"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(corpus, k, num, den):
    rows = [(i, shingle_set(t, k)) for i, t, *_ in corpus]
    parent = {i: i for i, _ in rows if i is not None}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = collections.Counter()
    for x, (i, a) in enumerate(rows):
        for y, (j, b) in enumerate(rows):
            if x != y and i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                links[x] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else root(i), links[x]) for x, (i, s) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("long_list,block", [(256, 1 << 20), (2, 100)])
def test_jaccard_components(docs, corpus, monkeypatch, k, num, den, long_list, block):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    got = jaccard.jaccard_components(docs, k, num, den)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(corpus, k, num, den)


def test_jaccard_extra_columns_and_empty(wide, none, corpus):
    assert sorted(map(tuple, jaccard.jaccard_components(wide).collect()), key=repr) == brute_groups(corpus, 3, 90, 100)
    assert jaccard.jaccard_components(none).count() == 0


def test_divide_skip_matches_brute_force():
    rng = np.random.default_rng(0)
    for num in (50, 80, 90):
        base = rng.choice(500, 60, replace=False)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(1, 60), replace=False), rng.choice(500, 3)]).astype(np.uint64)
                for _ in range(60)]
        uniq, start, lists = jaccard.index_of(sets)
        sizes = np.array([len(s) for s in sets])
        for q in sets:
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= num * len(np.union1d(q, s))]
            assert sorted(jaccard.divide_skip(q, uniq, start, lists, sizes, num, 100)) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    edges += edges[:10]
    parent = {x: x for e in edges for x in e}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: root(a) for e in edges for a in e if any(a in f and f[0] != f[1] for f in edges)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


ODD = list("aAbzZ  \n\t\x0b\x0c\r\x1c\x85\xa0'<>|!.,;09éÉßÀ×÷ñÑ") + [
    "'s", "'re", " it's", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "́", "ẞ", "Σ", "İ", "中文", "٣", "½", "\x00", "😀"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "a" * 5000), (2003, "Word, " * 9000), (None, "x y"), (5, rows[5][1])]
    return rows


def test_token_counts(spark, odd):
    lib = Tokenizer.from_file(PATH)
    want = sorted(((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048)
                   for i, t in odd), key=repr)
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).repartition(3)
    got = tokens.token_counts(df, PATH)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert tokens.token_counts(df.limit(0), PATH).count() == 0


def test_worker_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 3)
    enc, lib = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ("alpha beta gamma delta", "beta epsilon zeta eta", "alpha theta"):
        u = tokens.Units(next(iter(textcore.slices(pa.array([text])))))
        k, first, inv = np.unique(u.hash, return_index=True, return_inverse=True)
        assert enc.gather(enc.places(u, first, k)[inv])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", 20_000)
    lib = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumn("part", F.lit("x")).repartition(4)
    got = packing.pack(df, PATH, 256, 1).toPandas()
    left = collections.Counter()
    for i, t in odd:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        left[i, len(ids)] += len(ids)
    texts = collections.defaultdict(list)
    for i, t in odd:
        texts[i].append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in got.itertuples():
        key = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                   for x in texts[key])
        left[key, r.doc_tokens] -= r.length
    assert not any(left.values())
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 256
    total = got.groupby("sequence_id")["length"].sum()
    assert (total < 256).sum() <= 8  # one sequence per range at most
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_hilbert_curve_is_continuous():
    cells = np.array(np.meshgrid(*[range(8)] * 3)).reshape(3, -1).T
    at = packing.hilbert_index(cells, 3)
    assert sorted(at) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_pack_keeps_neighbours_close(spark):
    """Copies of a text lie in one run of the curve."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(100 * g + c, prose(rng, 50, words)) for g in range(20) for c in range(1)]
    rows = [(i + c, t) for i, t in rows for c in range(5)]
    got = packing.ranged(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = [r["doc_id"] // 100 for r in got]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) <= 2 * 20


def brute_base(text):
    """The base kinds by the patterns as the contract has them."""
    out = []
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in
                    ("password", "passwd", "secret", "token", "api_?key"))
    for k, (p, g, n) in enumerate(((f"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
                                   ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16))):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[g]) >= n]
    return sorted(out)


def test_secret_scan(spark):
    key, live = "AKIA" + "B7QX" * 4, "zQ9xV7rT2mK4pL8wN3sY6bD1"
    texts = [None, "", f"é password = 'hunter2hunter2' {key}", 'api_key: "' + "0f" * 12 + '"', "token=short ſecret=abcdefghijklmnop",
             f"see {live} here", f"{live}", "AKIAAKIA" + "A" * 13, "deadbeef" * 3 + " x", "password=token=abc\": 'aaaaaaaaaaaaaaaa",
             "x" * 50_000 + " secret: " + "Zk3" * 10]
    wide = [f"TOKEN = {'e1f2a3b4' * 3}"] * 12
    rows = [(i, t, "en", "src1") for i, t in enumerate(texts)] + [(100 + i, t, "en", f"o{i}") for i, t in enumerate(wide)]
    rows += [(None, texts[5], None, None), (5, texts[5], "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("row", F.lit(1))
    got = collections.defaultdict(list)
    for r in secrets.secret_scan(df.repartition(3)).collect():
        got[r["doc_id"]].append(r)
    for i, t, *_ in rows:
        base = brute_base(t or "")
        r = got[i][0]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in base) for j in range(3)], t
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("token:")) == joined
    assert got[5][0]["spans"] == f"token:4:{4 + len(live)}" and len(got[5]) == 2
    assert got[100][0]["n_wide"] == 2 and got[100][0]["n_live"] == 0
    assert got[2][0]["n_live"] >= 1
    out = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert out[5] == "see [secret] here" and out[100] == wide[0] and out[0] is None and key not in out[2]
    assert secrets.secret_scan(df.limit(0)).count() == 0 and secrets.redact(df).schema == df.schema


def test_language(spark):
    rng = random.Random(4)
    parts = {"aa": ["th", "er", "on", "an"], "bb": ["ción", "ado", "que", "ñ"], "cc": ["ка", "то", "ни", "ров"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(40)), k)
            for i, k in enumerate(rng.choice(list(parts)) for _ in range(300))]
    rows += [(1000, None, "aa"), (1001, "12 ... 34", "aa"), (1002, "", None), (1003, rows[0][1], None), (None, rows[0][1], "bb"),
             (1004, "α", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(0)).repartition(3)
    got = collections.defaultdict(list)
    for r in langid.identify(df).collect():
        got[r["doc_id"]].append(r)
    for i, t, k in rows[:300]:
        r = got[i][0]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == k
    assert [got[i][0]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003][0]["lang_pred"] == rows[0][2] and got[1004][0]["lang_pred"] != "und"
    assert langid.identify(df.limit(0)).count() == 0


def test_language_prototypes_are_exact_bundles(spark):
    df = spark.createDataFrame([("aa", "ab, cd"), ("aa", "É"), ("bb", "xyz")], "lang string, text string").repartition(3)
    names, proto = langid.prototypes(df)

    def vec(ch):
        return langid._letter_vector(ord(ch) if ch != " " else 0).astype(float)

    def bundle(text):
        pad = f" {text} "
        return sum(np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c) for a, b, c in zip(pad, pad[1:], pad[2:], strict=False) if b != " ")

    want = bundle("ab  cd") + bundle("é")
    assert names == ["aa", "bb"] and np.allclose(proto[0], want / np.linalg.norm(want))


def labelled(spark, rng):
    """Clean and toxic texts; toxic words come in spellings not seen before."""
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        w = prose(rng, rng.randint(5, 80), words).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["vergox", "krampuz"]) + rng.choice("aeiou") * rng.randint(0, 3)
        rows.append((i, " ".join(w)))
        if i % 7:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled(spark, random.Random(8))
    rows += [(5000, None), (5001, ""), (None, "x"), (5002, "vergoxiiiii " + "aaa " * 20_000)]
    labels += [(None, 1), (3, None), (4, 7), (0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("use", F.lit(1)).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(df, lab).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and len(got) == len(rows)
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert got[5000]["score"] == got[5001]["score"] and got[5002]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert toxicity.toxicity_scores(df.limit(0), lab).count() == 0
    assert {r["score"] < 0.5 for r in toxicity.toxicity_scores(df, lab.limit(0)).collect()} == {True}


def test_quality(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        good = i % 3 > 0
        t = prose(rng, rng.randint(20, 120), words)
        rows.append((i, t if good else (t.upper().replace(" ", "!! ") if i % 2 else " ".join([t.split()[0]] * 60))))
        labels.append((i, int(good)))
    rows += [(5000, None), (5001, ""), (None, "x"), (5002, prose(rng, 30_000, words))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 9), (5, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(df, lab).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and len(got) == len(rows)
    assert np.mean([got[i]["predicted"] == (i % 3 > 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    kept = quality.keep_good(df, lab)
    assert kept.schema == df.schema
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(i for i, r in got.items() if r["predicted"])
    assert quality.quality_scores(df.limit(0), lab).count() == 0
    assert {r["score"] for r in quality.quality_scores(df, lab.limit(0)).collect()} == {0.5}


def test_isotonic():
    fit = quality.isotonic(np.array([1.0, 2, 1, 4]), np.array([0.0, 2, 0, 3]))
    assert np.allclose(fit, [0, 2 / 3, 2 / 3, 0.75])


def test_statistics_follow_the_document_alone():
    texts = ["A b. C\n\nd!!", "", "É é é", "x" * 3000, "a a a a"]
    alone = [quality.statistics(next(textcore.slices(pa.array([t]))))[0] for t in texts]
    joint = quality.statistics(next(textcore.slices(pa.array(texts))))
    assert np.allclose(joint, alone) and np.isfinite(joint).all() and joint.shape[1] == quality.STATS


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_benchmark_leaks(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgñé") for _ in range(4)) for _ in range(500)]
    items = [(i, prose(rng, rng.randint(20, 50), vocab)) for i in range(30)] + [(50, None), (51, "..."), (52, "tiny item here")]
    rows = []
    for i in range(120):
        w = prose(rng, rng.randint(10, 150), vocab).split()
        if i % 3 == 0:
            own = items[i % 30][1].upper().split()
            for _ in range(i % 5):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = own
        rows.append((i, ", ".join(w)))
    rows += [(500, None), (501, ""), (502, "a TINY item, here."), (0, rows[0][1]), (None, items[3][1]),
             (503, prose(rng, 20_000, vocab) + " " + items[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("words", F.lit("x")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    lists = [(i, words_of(t)) for i, t in items if words_of(t)]

    def shingles(w):
        return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])

    df_of = collections.Counter(h for _, w in lists for h in shingles(w))
    want = {}
    for d, t in rows:
        w = words_of(t)
        for i, own in lists:
            ref, best = shingles(own), 0
            for s in range(len(w)):
                if len(w[s:s + len(own)]) < min(5, len(own)):
                    continue
                win = shingles(w[s:s + len(own)]) if len(own) >= 5 else collections.Counter([tuple(w[s:s + len(own)])])
                if not (win.keys() & ref.keys()):
                    continue
                weight = {h: math.log1p(len(lists) / max(1, df_of[h])) for h in [*win, *ref]}
                both = sum(min(win[h], ref[h]) * weight[h] for h in ref)
                best = max(best, both / (sum(c * weight[h] for h, c in win.items()) + sum(c * weight[h] for h, c in ref.items()) - both))
            if best >= 0.8:
                want[d, i] = best
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.benchmark_leaks(df, bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) > 10
    clean = decontam.decontaminate(df, bench)
    assert clean.schema == df.schema
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontam.benchmark_leaks(df.limit(0), bench).count() == 0
    assert decontam.benchmark_leaks(df, bench.limit(0)).count() == 0


def test_benchmark_swapped_items(spark):
    """Items whose parts stand in another order: the best window starts at no aligned place."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    items = [(i, prose(rng, n, vocab)) for i, n in enumerate([60, 60, 80, 100, 100, 120, 60, 100])]
    rows, want = [], {}
    for d, (i, text) in enumerate(items):
        w = text.split()
        at = len(w) // 2 if d % 2 == 0 else len(w) * 85 // 100
        around = prose(rng, 40, vocab), prose(rng, 40, vocab)
        rows.append((None if d == 7 else d, f"{around[0]} {' '.join(w[at:] + w[:at])} {around[1]}"))
        doc = rows[-1][1].split()
        ref = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        wins = [{tuple(doc[s + k:s + k + 5]) for k in range(len(w) - 4)} for s in range(len(doc) - len(w) + 1)]
        want[rows[-1][0], i] = max(len(x & ref) / len(x | ref) for x in wins)  # all shingles weigh the same
    rows.append((20, rows[1][1][:len(rows[1][1]) // 2]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r["doc_id"], r["item_id"]): r["similarity"]
           for r in decontam.benchmark_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(x >= 0.8 for x in want.values())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_license_paragraphs(spark):
    lines = {"mit": "Released under the MIT License.", "apache": "licensed under the APACHE license, version 2.0",
             "proprietary": "All rights reserved.", "gpl": "This work is licensed under the GNU General Public License, version 3."}
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(200)]
    rows = [(i, "\n".join(prose(rng, 12, words) for _ in range(4))) for i in range(60)]
    for i, line in enumerate(lines.values()):
        rows.append((100 + i, f"{rows[i][1]}\n{line}\n{rows[i + 1][1]}"))
    rows += [(200, None), (201, ""), (202, "He reserved a licence for the boat on the public river."), (None, lines["mit"]),
             (100, rows[60][1]), (203, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("x")).repartition(3)
    got = licenses.license_paragraphs(df)
    found = sorted(((r["doc_id"], r["paragraph"], r["family"]) for r in got.collect()), key=repr)
    assert found == sorted([*((100 + i, 4, f) for i, f in enumerate(lines)), (100, 4, "mit"), (None, 0, "mit")], key=repr)
    assert licenses.license_paragraphs(df.limit(0)).count() == 0


def test_license_words_in_the_corpus(spark):
    """Prose that holds the words of the templates switches no family off."""
    plain = ["License", "Rights", "The version was free of charge.", "She had a license for her work at the public library.",
             "His rights were reserved for other days.", "They released the work in all public places.", "MIT", "The domain of this law.",
             "A copyright of software is no copyright of ideas.", "Apache and BSD and GNU and MIT are names."]
    lines = {"proprietary": "All rights reserved.", "cc0": "This work is released into the public domain.",
             "mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0."}
    rows = [(i, t) for i, t in enumerate(plain)] + [(1000 + i, t) for i, t in enumerate(lines.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["family"] for r in licenses.license_paragraphs(df).collect()}
    assert got == {1000 + i: f for i, f in enumerate(lines)}


def test_license_evidence_drops_nothing(spark):
    """Every line with two template words that reaches CONFIRM passes the filter."""
    def words_in(t):
        return [w for w in re.split("[^a-z0-9]+", t.lower()) if w]

    temps = [words_in(t) for ts in licenses.TEMPLATES.values() for t in ts]
    rng, known = random.Random(3), sorted({w for t in temps for w in t})
    rows = [[rng.choice(known) for _ in range(rng.randint(1, 12))] for _ in range(300)]
    for t in temps:
        for _ in range(40):
            a, b = sorted(rng.sample(range(len(t) + 1), 2))
            w = t[a:b]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w) + 1):0] = ["foreign"] * rng.randint(1, 2)
            rows.append(w)
    rows = sorted({" ".join(w) for w in rows})
    grams = [licenses._gram_set(t) for t in temps]

    def similar(t):
        g = licenses._gram_set(words_in(t))
        return len({w for w in words_in(t)} & set(known)) >= 2 and any(
            len(g & x) / min(len(g), len(x)) >= licenses.CONFIRM for x in grams)

    df = spark.createDataFrame([(t,) for t in rows], "line string")
    kept = {r["line"] for r in df.where(licenses.evidence(F.col("line"))).collect()}
    want = {t for t in rows if similar(t)}
    assert len(want) > 300 and want <= kept


def unit(rng, n):
    x = rng.standard_normal(n)
    return x / np.linalg.norm(x)


@pytest.mark.parametrize("block", [1024, 20])
def test_pivot_index(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        x = unit(rng, 32)
        for c in (1.0, 0.995, 0.97, 0.95, 0.935):
            y = unit(rng, 32)
            y -= y @ x * x
            v = (c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)).astype(np.float32).tolist()
            rows.append((len(rows), v, i % 3))
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] * 32, 1), (904, rows[0][1], None),
             (905, [], 0), (906, rows[0][1], 0), (0, rows[0][1], 0), (907, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    got = pivots.near_duplicates(df.repartition(3)).collect()
    ok = [(i, np.array(v, float), k) for i, v, k in rows if i is not None and v and k is not None
          and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = collections.Counter()
    for a, (i, u, k) in enumerate(ok):
        for b, (j, w, m) in enumerate(ok):
            if a != b and k == m and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= 0.93:
                want[i] += 1
    seen = collections.Counter()
    for r in got:
        if r["vec_id"] is not None:
            seen[r["vec_id"]] += r["n_links"]
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert all(seen[i] <= want[i] for i in seen) and sum(seen.values()) >= 0.9 * sum(want.values())
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["component_id"] == i and by[i]["kept"] for i in (900, 901, 902, 903, 904, 905, 907))
    assert by[906]["component_id"] == 0 and by[None]["component_id"] is None and len(got) == len(rows)
    assert pivots.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [32, 64])
def test_pivot_recall_in_a_large_group(spark, dim):
    """A third of the rows in one group of distinct near copies."""
    rng = np.random.default_rng(7)
    base = unit(rng, dim)
    rows = []
    for i in range(1500):
        x = unit(rng, dim)
        if i % 3 == 0:
            x -= x @ base * base
            c = rng.uniform(0.968, 0.99)
            x = c * base + math.sqrt(1 - c * c) * x / np.linalg.norm(x)
        rows.append((i, x.astype(np.float32).tolist(), 0))
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    linked = v @ v.T >= 0.93
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in pivots.near_duplicates(df.repartition(3)).collect()}
    assert all(got[i]["n_links"] <= want[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * want.sum() > 100_000
    assert {got[i]["component_id"] for i in range(0, 1500, 3) if want[i]} == {0}


def test_pivot_lists_do_not_grow_with_the_table():
    """Pairs compared and rows dealt per vector stay as they are from 16,000 to 64,000 vectors; near pairs meet."""
    seen = {}
    for n in (16_000, 64_000):
        rng = np.random.default_rng(n)
        x = rng.standard_normal((n, 48))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        noise = rng.standard_normal((2000, 48))
        noise -= (noise * x[:2000]).sum(1, keepdims=True) * x[:2000]
        c = rng.uniform(0.93, 1.0, (2000, 1))
        x[2000:4000] = c * x[:2000] + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
        most = pivots.pivot_count(n)
        near = pivots._nearest(x, pivots._two_sets(x[rng.permutation(n)[:4096]], most))
        first, second = near[:, :pivots.TOP], near[:, pivots.PREFIX:pivots.PREFIX + pivots.TOP]
        lists = (first[:, :, None].astype(np.int64) * most + second[:, None, :]).reshape(n, -1)
        sizes = np.bincount(lists.ravel())
        blocks = -(-sizes // pivots.BLOCK)
        seen[n] = ((sizes ** 2).sum() / n, (sizes * blocks).sum() / n)
        whole = [np.zeros((n, most), bool) for _ in range(2)]
        for k in (0, 1):
            np.put_along_axis(whole[k], near[:, k * pivots.PREFIX:(k + 1) * pivots.PREFIX].astype(np.int64), True, 1)
        found = [len(set(lists[i]) & set(lists[i + 2000])) > 0
                 and all((w[i] & w[i + 2000]).sum() >= pivots.SHARED for w in whole) for i in range(2000)]
        assert np.mean(found) >= 0.95
    assert seen[64_000][0] < 1.5 * seen[16_000][0] and seen[64_000][1] < 1.5 * seen[16_000][1]


def test_pivot_pairs_count_once():
    """Over all lists, every pair that shares enough pivots counts in exactly one."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = pivots._nearest(x, pivots._two_sets(x[:12], 12))
    seen = collections.Counter()
    for p in range(12):
        for q in range(12):
            own = np.flatnonzero((near[:, :pivots.TOP] == p).any(1)
                                 & (near[:, pivots.PREFIX:pivots.PREFIX + pivots.TOP] == q).any(1))
            if len(own) > 1:
                at = np.arange(len(own))
                for i, j in np.argwhere(pivots._candidates(near[own], (p, q), at, at, 3)):
                    seen[own[i], own[j]] += 1
    top = [(set(r[:pivots.TOP]), set(r[pivots.PREFIX:pivots.PREFIX + pivots.TOP])) for r in near.tolist()]
    want = {(i, j) for i in range(300) for j in range(300) if top[i][0] & top[j][0] and top[i][1] & top[j][1]}
    assert set(seen) == want and set(seen.values()) == {1}


def test_jaccard_shared_ids(spark):
    """Rows of one id with different texts are nodes of their own; texts that differ in case have one set."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    a, b = prose(rng, 60, words), prose(rng, 60, words)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (1, a.upper()), (1, a), (9, prose(rng, 60, words))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got) == [
        (1, 1, 1), (1, 1, 3), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 1, 1), (9, 9, 0)]


def passages(seed, n, own, shared):
    """Documents with a passage in common and words of their own, and near copies of every tenth."""
    rng = random.Random(seed)
    common = [f"p{i}" for i in range(shared)]
    rows = []
    for i in range(n):
        w = [f"d{i}x{rng.randrange(10 ** 6)}" for _ in range(own)] + common
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            w[rng.randrange(own)] = "changed"
            rows.append((1000 + i, " ".join(w)))
    return rows


def test_jaccard_common_passage(spark, monkeypatch):
    """Documents that share a passage whose shingles the order table does not hold are not searched as one cluster."""
    monkeypatch.setattr(jaccard, "ORDER_TABLE", 16)
    k, num, rows = 3, 90, passages(3, 200, 90, 20)
    seen = []
    plain = jaccard._candidates
    monkeypatch.setattr(jaccard, "_candidates", lambda *a: seen.append(plain(*a)) or seen[0])
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, num, 100).collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows, k, num, 100)
    assert sum(r["n_links"] > 0 for r in got) == 40
    sizes = collections.Counter(r["root"] for r in graph.components(seen[0]).collect())
    assert max(sizes.values()) <= 4 and sum(sizes.values()) <= 60


def test_thinned(spark):
    """Before an exact join: every row of the ids stays, few others do, nulls go; columns may have any name."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 100 != 7, F.col("id")).alias("doc_id"), F.lit(1).alias("word"), F.lit(2).alias("bits"))
    ids = spark.createDataFrame([(i * 50,) for i in range(300)] + [(None,), (0,), (-5,)], "at long")
    got = common.thinned(docs, "doc_id", ids, "at")
    assert got.columns == docs.columns
    kept = collections.Counter(r["doc_id"] for r in got.collect())
    assert {i * 50 for i in range(300)} <= set(kept) and len(kept) < 310 and None not in kept and max(kept.values()) == 1
    assert common.thinned(docs, "doc_id", ids.limit(0), "at").count() == 0


def test_jaccard_marks_of_linked_sets():
    """Two sets that link share a mark, whatever the order table holds; so do the packed rows."""
    rng = np.random.default_rng(4)
    n_pairs = 0
    for num in (50, 80, 90, 99):
        groups = jaccard._groups(500, num, 100)
        for _ in range(150):
            x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64))
            cut, more = (int(rng.integers(0, len(x) * (100 - num) // num + 2)) for _ in range(2))
            y = np.unique(np.r_[rng.permutation(x)[cut:], rng.integers(0, 1 << 63, more).astype(np.uint64)])
            both = len(np.intersect1d(x, y))
            if 100 * both < num * (len(x) + len(y) - both) or both == len(x) == len(y):
                continue
            hot = np.sort(rng.choice(x, len(x) // 2, replace=False))
            owner, marks = jaccard._marks_of([x, y], groups, hot, rng.integers(17, 5000, len(hot)))
            assert set(marks[owner == 0]) & set(marks[owner == 1])
            bucket = (marks % np.uint64(3)).astype(np.int64)
            packed = jaccard._packed(bucket, marks, owner.astype(np.uint64) + np.uint64(7)).to_pylist()
            edges = [jaccard._chains((), pa.table({"marks": [r["marks"]]})).to_pylist() for r in packed]
            assert {(e["u"], e["v"]) for es in edges for e in es} == {(7, 8)}
            n_pairs += 1
    assert n_pairs > 150


@pytest.mark.parametrize("block", [1 << 18, 4000])
def test_jaccard_family(spark, monkeypatch, block):
    """A family of near copies of several lengths: rows between the stages grow with it, links are whole."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    edges = {}
    for n in (100, 400):
        rng = random.Random(n)
        base = [f"w{rng.randrange(3000)}" for _ in range(80)]
        rows = []
        for i in range(n):
            w = base + [f"v{j}" for j in range(i % 24)]
            w[rng.randrange(len(w))] = f"u{i}"
            rows.append((i, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        seen = []
        plain = jaccard._candidates
        monkeypatch.setattr(jaccard, "_candidates", lambda *a: seen.append(plain(*a)) or seen[0])
        got = jaccard.jaccard_components(df, 3, 80, 100).collect()
        monkeypatch.setattr(jaccard, "_candidates", plain)
        edges[n] = seen[0].count()
        sets = {i: {tuple(t.split()[j: j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
        want = {i: sum(10 * len(s & x) >= 8 * len(s | x) for j, x in sets.items() if j != i) for i, s in sets.items()}
        assert {r["doc_id"]: r["n_links"] for r in got} == want and sum(want.values()) > n
    assert edges[400] <= 6 * edges[100]


def test_license_long_line(spark):
    """Time in proportion to the line, and the same answer as for a short one."""
    text = " ".join(f"word{i % 700}" for i in range(20_000)) + " Licensed under the Apache License, Version 2.0."
    df = spark.createDataFrame([(1, text), (2, "Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in licenses.license_paragraphs(df).collect()}
    assert got[2] == "apache"


def test_license_result_matches_plain_python(spark):
    rng = random.Random(6)
    temps = [(k, t) for k, ts in licenses.TEMPLATES.items() for t in ts]
    rows = []
    for i in range(120):
        _, t = rng.choice(temps)
        w = t.split()
        for _ in range(rng.choice((0, 0, 1, 3))):
            w[rng.randrange(len(w))] = rng.choice(("alpha", "license", "of", "the", "beta"))
        first = prose(rng, 12, ["alpha", "beta", "gamma", "rights", "public"]) + rng.choice(("", ".", ". But"))
        for _ in range(rng.choice((0, 1, 2))):
            w[rng.randrange(len(w))] += "\n"
        rows.append((i, "\n".join([first, " ".join(w), rng.choice(("", " ", "\r")), rng.choice(licenses.DECOYS)])))
    rows += [(500, "Foo bar.\nReleased under\nthe MIT\nLicense. More of it\nfollows."), (501, "Released under\n\nthe MIT License"), (None, "Released\nunder\nthe MIT\nLicense."),
             (502, "\n\n\x01\n1\x01Released\r\nunder\tthe\r\nMIT License\r\n\r\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = df.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    model = licenses.Classifier(lines)
    weight = {r["gram"]: np.array(r["w"]) for r in model.weights}

    def words_in(t):
        return [w for w in re.split("[^a-z0-9]+", t.lower()) if w]

    def judge(line):
        w = words_in(line)
        g = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}
        if not any(x in weight for x in g):
            return None
        z = sum((weight[x] for x in g if x in weight), np.zeros(len(model.classes))) + np.array(model.bias)
        e = np.exp(z - z.max())
        best = int(z[:-1].argmax())
        p = e[best] / e.sum()
        sim = max((max(len(g & t) / len(g), len(g & t) / len(t)) for t in (
            {*u, *(f"{a} {b}" for a, b in zip(u, u[1:], strict=False))} for u in map(words_in, licenses.TEMPLATES[model.classes[best]]))), default=0)
        return (model.classes[best], round(sim, 6)) if p > model.level and sim >= licenses.CONFIRM else None

    def sentences(text):
        """(first line, lines, words) of sentences on several lines, line by line."""
        out, now = [], []

        def end():
            if now and now[-1][0] > now[0][0]:
                out.append((now[0][0], now[-1][0] - now[0][0] + 1, "\n".join(x for _, x in now)))
            now.clear()

        for no, line in enumerate(text.replace("\x01", " ").split("\n")):
            line, start = line.rstrip(" \t\r"), 0
            if not line:
                end()
                continue
            for k in range(2, len(line)):
                if line[k].isupper() and line[k - 1] in " \t" and line[k - 2] in ".!?":
                    now.append((no, line[start:k]))
                    end()
                    start = k
            now.append((no, line[start:]))
            if line[-1] in ".!?":
                end()
        end()
        return out

    want = set()
    for i, text in rows:
        alone = {at: judge(line) for at, line in enumerate(text.split("\n")) if judge(line)}
        want |= {(i, at, 1, *v) for at, v in alone.items()}
        want |= {(i, at, n, *judge(s)) for at, n, s in sentences(text) if judge(s) and alone.keys().isdisjoint(range(at, at + n))}
    got = {(r["doc_id"], r["paragraph"], r["n_lines"], r["family"], r["similarity"]) for r in licenses.license_paragraphs(df).collect()}
    assert got == want and len(want) > 60
    assert {(500, 1, 3), (None, 0, 4), (502, 3, 3)} <= {x[:3] for x in want} and sum(x[2] > 1 for x in want) > 10


def test_toxicity_calibrates_on_long_texts(spark, monkeypatch):
    """Labelled texts beyond TRAIN_BYTES, of null text too, reach the calibration; training does without them."""
    rows, labels = labelled(spark, random.Random(3))
    long = [(i, "lorem ipsum " * 4_000) for i in range(600, 640)]
    rows += [*long, (700, None), *rows[:50], *long[:5]]
    labels += [(i, 0) for i, _ in long] + [(700, 0)]
    seen = []
    monkeypatch.setattr(toxicity, "platt", lambda x, y: seen.append((len(x), y.sum())) or (1.0, 0.0))
    bag = toxicity.Words
    trained = []
    monkeypatch.setattr(toxicity, "Words", lambda s: trained.append(s.hi) or bag(s))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))

    def fold(i):
        return zlib.crc32(str(i).encode()) % 5

    assert seen == [(sum(fold(i) == 1 for i, _ in labels), sum(y for i, y in labels if fold(i) == 1))]
    assert trained == [sum(fold(i) > 1 and i < 600 for i, _ in labels)]
