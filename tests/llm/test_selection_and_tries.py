"""Operators 11 to 13 against plain Python, with the awkward rows of every contract."""

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

from webloom.llm import convtrie, resampling, textcore, urlglob

LOWER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def multiset(df, columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


# --- 11: resampling

def plain_features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def plain_resample(rows, target, percent=25, least=20):
    feats = [plain_features(t) for _, t in rows]
    s = collections.Counter(b for _, f in feats for b in f)
    t = collections.Counter(b for x in target for b in plain_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (w, f) in zip(rows, feats, strict=True):
        g = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in f]
        weight = sum(g) // len(g) if g else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(w)])
    fit = sorted((r for r in out if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcÄéñ日9Z") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    words += ["x" * 63, "y" * 64, "Z" * 65, "ü" * 200]
    seps = [" ", "  ", ", ", "\n", "-", "\x7f", "[", "`"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " ,;"), (303, "solo"), (304, " ".join(rng.choice(words) for _ in range(60_000)))]
    rows += [rows[5]] * 150 + [(7, "another text of id seven " * 9), (None, rows[9][1]), (None, None), (-3, rows[9][1])]
    return rows


RESAMPLED = ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("few, ranges", [(2048, 500_000), (8, 7)])
def test_resampling(spark, texts, monkeypatch, few, ranges):
    monkeypatch.setattr(resampling, "FEW", few)
    monkeypatch.setattr(resampling, "RANGE_ROWS", ranges)
    target = [texts[3][1], texts[4][1], None, "", "abc abc"]
    docs = (spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
            .select("*", *(F.lit(1).alias(c) for c in ("row", "down", "score", "rank", "part", "weight", "words", "place"))))
    bench = spark.createDataFrame([(t,) for t in target], "text string").withColumn("bucket", F.lit(1))
    assert multiset(resampling.resample(docs, bench), RESAMPLED) == plain_resample(texts, target)


def test_resampling_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(none, one).count() == 0
    got = resampling.resample(one, none.select("text"))
    assert multiset(got, RESAMPLED) == plain_resample([(1, "a b " * 20)], [])
    assert resampling.resample(one, one, percent=100).first()["rank"] == 1


def test_kth_key_of_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(resampling, "FEW", 5)
    rows = (spark.range(5000).withColumn("row", F.col("id")).withColumn("down", F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id") % 50))
            .withColumn("doc_id", F.lit(4).cast("long")).withColumn("n_features", F.lit(1).cast("long")).withColumn("weight", F.lit(0).cast("long")))
    every = sorted(tuple(r) for r in rows.select(*resampling.KEY).collect())
    for k in (1, 1666, 5000):
        assert resampling.kth_key(rows, k) == every[k - 1]
    assert resampling.kth_key(rows, 0) is None


def test_checksums():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aé日 -Q7") for _ in range(n)) for n in (0, 1, 5, 300, 2000)] + ["k" * 70 + " " + "m" * 90, "a " + "b" * 64]
    for s in textcore.slices(pa.array(texts)):
        got = resampling.features(s)
        for d in range(s.lo, s.hi):
            assert sorted(got.bucket[got.doc == d - s.lo].tolist()) == sorted(plain_features(texts[d])[1])


# --- 12: URL globs

def regex_of(glob):
    out = re.escape(glob).replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace("\0", ".*").replace(r"\?", ".")
    return re.compile(out, re.S)


def test_automaton_agrees_with_regex():
    rng = random.Random(4)
    for _ in range(40):
        globs = ["".join(rng.choice(["a", "b", "/", "é", "*", "**", "?"]) for _ in range(rng.randint(0, 9))).replace("***", "**")
                 for _ in range(rng.randint(1, 30))]
        globs = [re.sub(r"\*{3,}", "**", g) for g in globs] + ["a" * 130 + "*"]
        texts = ["".join(rng.choice("aabb/é日") for _ in range(rng.randint(0, 8))) for _ in range(60)] + ["a" * 130, "a" * 129 + "b", "a" * 131, ""]
        col = pa.array(texts)
        machine = urlglob.Automaton(globs)
        got = np.concatenate([machine.winners(s.buf, s.off) for s in textcore.slices(col)])
        want = [next((i for i, g in enumerate(globs) if regex_of(g).fullmatch(t)), -1) for t in texts]
        assert got.tolist() == want


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = host.translate(LOWER)
    fits = [(r, v) for r, v in urlglob.RULES
            if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    if fits:
        rule, verdict = max(fits, key=lambda x: len(x[0]))
        return host, path, rule, verdict
    own = any(regex_of(g).fullmatch(host + path) for g in urlglob.FILTER)
    return host, path, None, "block" if own else "allow"


def test_url_rules(spark):
    urls = [None, "", "://", "no scheme", "http:/one/slash", "http://Example.ORG/es/1", "http://example.org/ES/1", "https://a.example.org/en/1",
            "https://a.example.org/en/2", "http://notexample.org/es/x", "http://evil.net/x.org/es/", "http://org", "http://org/", "http://org?x=/",
            "http://x.com/fr/1#a", "http://x.com/de", "http://x.com/de/?q", "http://x.com/it/a.jpg", "http://x.com/it/a.jpg?b", "http://x.net/login",
            "http://m.x.net/a", "http://x.net:80/search/q", "a://b://c.org/d", "http://x.net/\n/a.png", "http://ÄB.org/é", "http://x.net/" + "a/" * 60_000 + "z.jpg",
            "http://example.org/es/" + "q" * 200_000, "http://x.net/tag/a/page/2", "http://x.net/tag/a/b/page/2", "http://x.net/font.woff2"]
    rows = [(i % 20 or None, u) for i, u in enumerate(urls + urls[:9])]
    pages = (spark.createDataFrame(rows, "page_id long, url string").repartition(3)
             .select("*", *(F.lit(1).alias(c) for c in ("host", "path", "rule", "verdict", "glob", "address", "after"))))
    got = multiset(urlglob.filter_urls(pages), ["page_id", "host", "path", "rule", "verdict"])
    assert got == collections.Counter((i, *plain_url(u)) for i, u in rows)
    assert urlglob.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    with pytest.raises(ValueError):
        urlglob.globs_of([("a*/", "block")], [])


def test_url_verdicts_of_the_contract(spark):
    from webloom.llm import oracle
    want = {"http://x.org/a": ("org/", "allow"), "http://example.org/es/a": ("example.org/es/", "block"),
            "http://example.org/en/1": ("example.org/en/1", "block"), "http://a.example.org/en/12": ("example.org/en/1", "block"),
            "http://example.org/en/2": ("org/", "allow"), "http://x.com/fr/a": ("com/fr/", "allow"), "http://x.com/de/a": ("com/de/", "block")}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlglob.filter_urls(pages).collect()}
    assert got == dict(enumerate(want.values()))
    for rule, verdict in want.values():
        assert f"{{'rule': '{rule}', 'verdict': '{verdict}'," in oracle.URLS


# --- 13: prefix trie

def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [(r[3], r[4]) for r in sorted(t)] for c, t in own.items()}
    members = collections.defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - int(math.fmod(c, 100))
        seq = tuple(own.get(head, [])[:h] + t[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, len(seq)))
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return collections.Counter(
        (min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c, n in sorted(m) if n == len(p)).encode()).hexdigest())
        for p, m in members.items())


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    openers = ["hi", "hello", "héllo 日本", "", None]
    rows = []
    for c in [*range(0, 320), *range(-120, -90), 1000, 1007, 2099]:
        n = rng.randint(0, 7)
        for t in range(n):
            rows.append((c, t, ("user", "assistant", None)[t % 2 if c % 7 else 2], rng.choice(openers) if t < 3 else f"{rng.randint(0, 3)}"))
    for c in range(400, 640):  # a third of all conversations alike
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "Same"), (c, 2, "user", "s")]
    rows += [(400, 9, "user", "x" * 50_000)] + [(5000, t, "user", str(t % 5)) for t in range(120)]
    rows += [(700, None, "user", "first"), (700, -1, "user", "second"), (700, -1, "user", "second"), (700, -1, "a", "second"), (None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(800, 0, "ab", "c"), (901, 0, "a", "bc"), (902, 0, "ab", "c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 2, 9, 60])
def test_trie(spark, turns, shards, monkeypatch):
    monkeypatch.setattr(convtrie, "BLOCK_IDS", 7)
    monkeypatch.setattr(convtrie, "BATCH", 50)
    df = (spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
          .select("*", *(F.lit(1).alias(c) for c in ("head", "own", "path", "chars", "kind", "shard", "t", "first"))))
    got = convtrie.prefix_trie(df, shards=shards)
    assert multiset(got, TRIE) == plain_trie(turns)


def test_splitters_part_equal_paths(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    marks = convtrie.splitters(convtrie.paths(df).cache(), 40)
    assert marks == sorted(set(marks)) and len(marks) > 15
    hot = collections.Counter(p for p, _ in marks)
    assert max(hot.values()) >= 5  # the group of equal paths lies in several shards


def test_trie_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert convtrie.prefix_trie(none).count() == 0
    turnless = [(101, 0, "u", "a")]  # crc32("101") % 6 is above 0, and conversation 100 is absent
    one = spark.createDataFrame(turnless, none.schema)
    assert multiset(convtrie.prefix_trie(one), TRIE) == plain_trie(turnless)
