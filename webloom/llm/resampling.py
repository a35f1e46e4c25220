"""Operator 11: target-distribution importance resampling.

1. Features of a text are its words and pairs of consecutive words (A-Z lower-cased, words
   ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, a pair joined by one space); a feature's bucket is the crc32 of its
   bytes modulo ``BUCKETS``.  Both passes hash on Arrow buffers: words byte column by byte
   column, a pair's checksum from those of its words (a checksum of joined
   strings is linear in its parts).
2. Bucket counts of the corpus and of the target add up on the cluster to one array of ``BUCKETS`` gains;
   a document's weight is the floored mean gain of its features.
3. Scores (weight plus Gumbel noise of the id) are written once with a row number, so
   that composite keys (score down, doc_id up, the other columns, row number) are distinct.
4. Distributed quickselect: each round draws random pivot keys of the open range, counts
   exactly the rows below, at and above each on all partitions, and keeps the
   range of the k-th key, until a range of at most ``FEW`` keys is left.
5. Winners alone are sorted by range; a rank is the row's place in its range after the
   ranges before it.  The others are appended without a join.

Defined cases: null and blank texts have no features (weight 0); a row with a null doc_id
has no noise, so its score is null and it is never drawn, but its text counts
in the corpus; repeated rows are drawn one by one; without benchmark texts all gains are those of
empty target counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm import textcore as T
from webloom.llm.common import cut
from webloom.session import ship_package

BUCKETS = 10_000
PIVOTS = 24
FEW = 2048
RANGE_ROWS = 500_000
LONG_WORD = 64

U32 = np.uint32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=U32)
    for _ in range(8):
        c = (c >> U32(1)) ^ np.where(c & U32(1), U32(0xEDB88320), U32(0))
    return c


CRC = _crc_table()
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def _shift_tables() -> np.ndarray:
    """[n, k, v]: what byte k with value v of a checksum becomes when n bytes follow, n <= LONG_WORD."""
    out = np.zeros((LONG_WORD + 1, 4, 256), U32)
    for k in range(4):
        c = np.arange(256, dtype=U32) << U32(8 * k)
        out[0, k] = c
        for n in range(1, LONG_WORD + 1):
            c = CRC[c & U32(255)] ^ (c >> U32(8))
            out[n, k] = c
    return out


def word_crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each span: all spans in step, the few long ones by the library."""
    size = end - start
    out = np.zeros(len(size), U32)
    long = np.flatnonzero(size > LONG_WORD)
    view = memoryview(np.ascontiguousarray(buf))
    for i in long:
        out[i] = zlib.crc32(view[start[i]: end[i]])
    rest = np.flatnonzero(size <= LONG_WORD)
    rest = rest[np.argsort(-size[rest], kind="stable")]
    length, at = size[rest], start[rest]
    c = np.full(len(rest), U32(0xFFFFFFFF))
    live = np.searchsorted(-length, -np.arange(LONG_WORD), side="left")
    for j in range(int(length[0]) if len(length) else 0):
        n = live[j]
        now = c[:n]
        c[:n] = CRC[(now ^ buf[at[:n] + j]) & U32(255)] ^ (now >> U32(8))
    out[rest] = c ^ U32(0xFFFFFFFF)
    return out


class Features(NamedTuple):
    bucket: np.ndarray
    doc: np.ndarray
    words: np.ndarray  # per document


def features(s: T.Slice) -> Features:
    buf = FOLD[s.buf]
    start, end = T.run_spans(IN_WORD[buf].astype(np.uint8), s.off, np.array([False, True]))
    doc = T.doc_of(s.off, start)
    words = np.bincount(doc, minlength=s.hi - s.lo) if len(doc) else np.zeros(s.hi - s.lo, np.int64)
    crc = word_crcs(buf, start, end)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    spaced = ~crc[pair]
    spaced = ~(CRC[(spaced ^ U32(32)) & U32(255)] ^ (spaced >> U32(8)))
    size = (end - start)[pair + 1]
    both = crc[pair + 1].copy()
    store = T.worker_store()
    if "crc_shift" not in store:
        store["crc_shift"] = _shift_tables()
    shift = store["crc_shift"]
    short = size <= LONG_WORD
    n, head = size[short], spaced[short]
    both[short] ^= (shift[n, 0, head & U32(255)] ^ shift[n, 1, (head >> U32(8)) & U32(255)]
                    ^ shift[n, 2, (head >> U32(16)) & U32(255)] ^ shift[n, 3, head >> U32(24)])
    view = memoryview(np.ascontiguousarray(buf))
    for i in np.flatnonzero(~short):
        w = pair[i] + 1
        both[i] = zlib.crc32(view[start[w]: end[w]], int(spaced[i]))
    every = np.concatenate([crc, both]) % U32(BUCKETS)
    return Features(every.astype(np.int64), np.concatenate([doc, doc[pair]]), words)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for s in T.slices(b.column(0)):
            total += np.bincount(features(s).bucket, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Feature counts of all texts, by bucket."""
    ship_package(texts.sparkSession)
    rows = (texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    big_s, big_t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + BUCKETS) / ((s + 1) * (big_t + BUCKETS))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column("text")):
                f = features(s)
                total = np.zeros(s.hi - s.lo, np.int64)
                np.add.at(total, f.doc, gain[f.bucket])
                n = np.maximum(2 * f.words - 1, 0)
                yield pa.record_batch([b.column("doc_id").slice(s.lo, s.hi - s.lo), pa.array(n),
                                       pa.array(total // np.maximum(n, 1)), pa.array(f.words)],
                                      ["doc_id", "n_features", "weight", "words"])
    return run


def scored(docs: DataFrame, target: DataFrame, seed: str = "7") -> DataFrame:
    """doc_id, n_features, weight, words, score of each row."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    out = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
           .mapInArrow(_weigh(gain), "doc_id long, n_features long, weight long, words long"))
    name = F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return out.withColumn("score", F.col("weight") + noise.cast("long"))


KEY = ["down", "doc_id", "n_features", "weight", "row"]


def _key(values=None) -> Column:
    """The composite key of a row, or a given one as a constant."""
    if values is None:
        return F.struct(*KEY)
    return F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(KEY, values, strict=True)))


def kth_key(rows: DataFrame, k: int) -> tuple | None:
    """The k-th smallest key (from 1; None if k < 1) of rows with the columns KEY, all distinct keys
    and at least k rows.  Each round is one pass with constant memory."""
    if k < 1:
        return None
    open_rows, left, turn = rows, rows.count(), 0
    low = high = None
    while left > FEW:
        turn += 1
        pivots = sorted(tuple(r) for r in open_rows.orderBy(F.xxhash64("row", F.lit(turn)), "row")
                        .limit(PIVOTS).select(*KEY).collect())
        key = _key()
        # 2i: between pivots i-1 and i; 2i+1: pivot i itself
        place = sum((F.when(key > _key(p), 2).when(key == _key(p), 1).otherwise(0) for p in pivots), F.lit(0))
        counts = {r["place"]: r["n"] for r in open_rows.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        for at in range(2 * len(pivots) + 1):
            n = counts.get(at, 0)
            if k <= n:
                break
            k -= n
        if at % 2:
            return pivots[at // 2]
        low = pivots[at // 2 - 1] if at else low
        high = pivots[at // 2] if at // 2 < len(pivots) else high
        open_rows, left = rows, counts[at]
        if low is not None:
            open_rows = open_rows.where(key > _key(low))
        if high is not None:
            open_rows = open_rows.where(key < _key(high))
    return sorted(tuple(r) for r in open_rows.select(*KEY).collect())[k - 1]


def ranked(winners: DataFrame, n: int) -> DataFrame:
    """winners with ``rank`` 1, 2, ... in key order, sorted by range."""
    if not n:
        return winners.withColumn("rank", F.lit(None).cast("long"))
    parts = -(-n // RANGE_ROWS)
    dealt = cut(winners.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    table = winners.sparkSession.createDataFrame(offsets, "part int, ahead long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*KEY))
    return dealt.withColumn("place", place).join(table, "part").withColumn("rank", (F.col("place") + F.col("ahead")).cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7") -> DataFrame:
    """docs (doc_id, text, ...), target (text, ...) -> doc_id, n_features, weight, score, rank
    (null where not drawn) of every row of docs."""
    rows = cut(scored(docs, target, seed).withColumn("down", -F.col("score"))
               .withColumn("row", F.monotonically_increasing_id()))
    fit = rows.where((F.col("words") >= least_words) & F.col("score").isNotNull())
    k = percent * fit.count() // 100
    last = kth_key(fit, k)
    drawn = F.lit(False) if last is None else (
        (F.col("words") >= least_words) & F.col("score").isNotNull() & (_key() <= _key(last)))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    others = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*out)
    if last is None:
        return others
    return ranked(rows.where(drawn), k).select(*out).unionByName(others)
