"""Operator 1: secret scan with corpus-wide ownership frequency.

Every whole text is searched for the base kinds (assign, access, hex) and for
*token* candidates: runs of 20 or more of ``A-Za-z0-9+/_-`` with a letter, a
digit and an entropy of 3 bits a character, outside the base spans.  The SHA-256
of each candidate's value is aggregated over the corpus, first by (value,
owner, repository), then by value: a value with ``wide`` or more owners, or with several
owners in ``WIDE_REPOS`` or more repositories, is a widely copied example; any other belongs to its owners.  A span is *live* if its
value looks like a credential (entropy, no placeholder words) and is not widely
copied.  Token candidates become spans only where they are live; base spans
always stay.

The owner of a document is its ``source``; a repository is a (source, lang)
collection.  Positions are code points, end exclusive; the span of an assign
match is the whole match, its value the right-hand side.

Defined cases: a null text is an empty one; null owners count together as one
owner; repeated rows are scanned one by one, and their copies of a value count
once per repository; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import cut, fresh, sized
from webloom.session import ship_package

WIDE, WIDE_REPOS = 5, 8
LIVE_ROWS = 50_000
KINDS = ("assign", "access", "hex", "token")
FOUND = "array<struct<start: int, kind: int, end: int, hash: string, looks: boolean>>"
_ITEM = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string()),
                   ("looks", pa.bool_())])

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef", re.IGNORECASE)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _looks_live(kind: int, value: str) -> bool:
    return entropy(value) >= (3.0 if kind == 3 else 2.5) and not PLACEHOLDER.search(value)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base spans and token candidates."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    taken, reach = sorted((a, b) for a, _, b, _ in out), []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))  # the furthest end of the spans up to here
    for m in TOKEN.finditer(text):
        v = m[0]
        before = bisect_left(taken, (m.end(), 0))
        if (any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= 3.0
                and not (before and reach[before - 1] > m.start())):
            out.append((m.start(), 3, m.end(), v))
    return sorted(out)


def _find_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, shas, found = [], [], []
        for text in b.column(3):
            got = find(text.as_py() or "")
            base = [x for x in got if x[1] < 3]
            counts.append([sum(x[1] == k for x in base) for k in range(3)])
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
            found.append([{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest(),
                           "looks": _looks_live(k, v)} for s, k, e, v in got])
        cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(4), *cols,
                               pa.array(shas, pa.string()), pa.array(found, pa.list_(_ITEM))],
                              ["doc_id", "owner", "repo", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def _scanned(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    owner = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"),
                       F.concat_ws("/", owner, F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("repo"),
                       F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    found = rows.mapInArrow(_find_rows, "doc_id long, owner string, repo string, text_hash long, "
                            f"n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}")
    # Row numbers stay as they are once the rows are checkpointed.
    return cut(cut(found).withColumn("row", F.monotonically_increasing_id()))


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos over the whole corpus."""
    return (scanned.select(F.explode("found.hash").alias("hash"), "owner", "repo")
            .groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
            .groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.count("*").alias("n_repos")))


def _judged(scanned: DataFrame, wide: int) -> DataFrame:
    """row, spans: the spans of each row that has candidates, with live."""
    stats = cut(ownership(scanned))
    item = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    stats = stats.withColumn("wide", (F.col("n_owners") >= wide) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= WIDE_REPOS)))
    live = F.col("looks") & ~F.col("wide")
    return (item.join(stats, "hash").withColumn("live", live).where("live or kind < 3")
            .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live", "wide", "n_owners", "n_repos")))
                                .alias("spans")))


def secret_scan(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """docs (doc_id, text, source, lang, ...) -> per document doc_id, n_assign,
    n_access, n_hex, base_sha256, spans, n_live, n_wide, and the most owners and
    repositories of a value in it."""
    scanned = _scanned(docs)
    kind = F.array(*map(F.lit, KINDS))
    spans = F.coalesce("spans", F.expr("array()"))
    text = F.transform("spans", lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"]))
    return (scanned.drop("found", "owner", "repo").join(_judged(scanned, wide), "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(text, ","), F.lit("")).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: s["wide"])).cast("long").alias("n_wide"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["n_owners"])), F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["n_repos"])), F.lit(0)).cast("long").alias("most_repos")))


def _blank(at: int):
    """The last column holds the live spans; it is applied to column ``at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if spans:
                    done = len(text)
                    for s in sorted(spans, key=lambda s: (-s["end"], s["start"])):
                        end = min(s["end"], done)
                        if s["start"] < end:
                            text, done = f"{text[:s['start']]}[secret]{text[end:]}", s["start"]
                out.append(text)
            cols = [pa.array(out, b.column(i).type) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.record_batch(cols, b.schema.names[:-1])
    return run


def redact(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """All rows and columns of docs, with each live credential of the text
    replaced by ``[secret]`` (and n_chars counted anew where it is there)."""
    names, scanned = docs.columns, _scanned(docs)
    span = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    live = (_judged(scanned, wide).select("row", F.filter("spans", lambda s: s["live"]).alias("s"))
            .where(F.size("s") > 0).join(scanned.select("row", "doc_id", "text_hash"), "row")
            .groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.first(span).alias("live")))
    live = sized(live, LIVE_ROWS)
    same = docs["doc_id"].cast("long").eqNullSafe(live["id"]) & (F.xxhash64(docs["text"]) == live["text_hash"])
    out = (docs.join(live, same, "left").select(*(docs[n] for n in names), live["live"].alias(fresh(docs, "live")))
           .mapInArrow(_blank(names.index("text")), docs.schema))
    if "n_chars" not in names:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
