"""Operator 4: packing along a space-filling curve.

Each text becomes a hashed bag-of-words vector, is projected to three dimensions
by a fixed Gaussian matrix, and gets the Hilbert index of its cell.  Documents
are dealt to ranges of (Hilbert index, hash of the id): the hash breaks ties, so
thousands of copies in one cell spread over ranges.  Each range is sorted by
that key, encoded and cut every ``length`` ids: neighbours on the curve share
sequences, and only the last sequence of a range can be padded.  Ranges hold
between ``RANGE_BYTES`` and ``LARGE_RANGE_BYTES`` of text or so, so padding stays near 0.2 % or below whatever the size.

A document's ids end with ``end_id``.  ``sequence_id`` is the range number
times 2**40 plus the sequence's number in the range.

Defined cases: a null or blank text is the end id alone; repeated rows are
packed as often as they occur, in an order that their text decides; a null doc_id
is kept as null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textcore as T
from webloom.llm.common import cut, shuffle_partitions
from webloom.llm.tokens import Units, worker_encoder
from webloom.session import ship_package

RANGE_BYTES, LARGE_RANGE_BYTES = 2 << 20, 64 << 20
MARKS = 4096
BUCKETS, DIMS, BITS = 256, 3, 10
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows of ``dims``
    coordinates below 2**bits), by the transpose method (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(s: T.Slice) -> np.ndarray:
    """Hilbert index of each document of a slice; blank texts are at cell 0."""
    h, counts = T.words(s)
    doc = np.repeat(np.arange(len(counts)), counts)
    sign = np.where(h >> T.U(63), 1.0, -1.0)
    bucket = (h & T.U(BUCKETS - 1)).astype(np.int64)
    vec = np.bincount(doc * BUCKETS + bucket, sign, len(counts) * BUCKETS).reshape(-1, BUCKETS)
    norm = np.sqrt((vec * vec).sum(1, keepdims=True))
    flat = vec / np.where(norm > 0, norm, 1)
    y = flat @ np.random.default_rng(4).standard_normal((BUCKETS, DIMS))
    cell = np.minimum((1 << BITS) - 1, ((1 << BITS) / (1 + np.exp(-1.702 * y))).astype(np.int64))
    cell[norm[:, 0] == 0] = 0
    return hilbert_index(cell, BITS)


def _keys(with_text: bool, bounds: np.ndarray | None):
    """(key, n_bytes) per document, or the document with its range and key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tie = b.column(2).to_numpy().astype(np.int64) & 0xFFFFFFFF
            for s in T.slices(b.column(1)):
                key = (curve_keys(s) << 32) | tie[s.lo: s.hi]
                if not with_text:
                    yield pa.record_batch([pa.array(key), pa.array(np.diff(s.off))], ["key", "n_bytes"])
                    continue
                rows = b.slice(s.lo, s.hi - s.lo)
                part = np.searchsorted(bounds, key, side="right").astype(np.int32)
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array(part), pa.array(key)],
                                      ["doc_id", "text", "part", "key"])
    return run


def _pieces(path: str, length: int, end_id: int):
    def cuts(pos: int, n: int) -> list[int]:
        """Where [0, n) is cut if it begins at ``pos`` of the range."""
        first = length - pos % length
        return [0, *range(first, n, length), n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, pos = worker_encoder(path), None, 0
        for b in batches:
            parts = b.column(2).to_numpy()
            for s in T.slices(b.column(1)):
                u = Units(s)
                k, first, inv = np.unique(u.hash, return_index=True, return_inverse=True)
                ids, size = enc.gather(enc.places(u, first, k)[inv])
                at = np.concatenate([[0], np.cumsum(size)])[u.per_doc]
                rows: list[list[int]] = []
                which = []
                for d in range(s.hi - s.lo):
                    if parts[s.lo + d] != part:
                        part, pos = int(parts[s.lo + d]), 0
                    own = np.append(ids[at[d]: at[d + 1]], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    edges = cuts(pos, n)
                    for lo, hi in zip(edges, edges[1:], strict=False):
                        p = pos + lo
                        which.append(s.lo + d)
                        rows.append([lo, hi - lo, zlib.crc32(own[lo:hi].tobytes()), n,
                                     (part << 40) + p // length, p % length])
                    pos += n
                cols = np.array(rows, np.int64).reshape(-1, 6)
                yield pa.record_batch([b.column(0).take(pa.array(which, pa.int64())),
                                       *(pa.array(np.ascontiguousarray(cols[:, i])) for i in range(6))],
                                      ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def range_count(total: int, tasks: int) -> int:
    """Ranges for so many bytes: RANGE_BYTES each, as long as that gives every task one; then it grows
    with the bytes alone."""
    return max(1, min(tasks, total // RANGE_BYTES), total // LARGE_RANGE_BYTES)


def range_bounds(marks: np.ndarray, n: int) -> np.ndarray:
    """n - 1 bounds from quantiles of the keys; between two quantiles they lie at even distances."""
    if n < 2 or not len(marks):
        return np.zeros(0, np.int64)
    at = np.arange(1, n) * (len(marks) + 1) / n - 1
    lo = np.clip(np.floor(at).astype(np.int64), 0, len(marks) - 1)
    hi = np.minimum(lo + 1, len(marks) - 1)
    return marks[lo] + ((marks[hi] - marks[lo]) * np.clip(at - lo, 0, 1)).astype(np.int64)


def ranged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, text, part, key: dealt to ranges of
    the curve and sorted along it."""
    spark = ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("doc_id", "text"))
    keys = cut(docs.mapInArrow(_keys(False, None), "key long, n_bytes long"))
    rows, total = keys.agg(F.count("*"), F.sum("n_bytes")).first()
    n = range_count(int(total or 0), shuffle_partitions(spark))
    most = min(n, MARKS)
    marks = keys.agg(F.percentile_approx("key", [i / most for i in range(1, most)], 10 * MARKS)).first()[0] if most > 1 else []
    bounds = range_bounds(np.array(marks if rows else [], np.int64), n)
    dealt = docs.mapInArrow(_keys(True, bounds), "doc_id long, text string, part int, key long")
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "key", "doc_id", F.xxhash64("text"))


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset."""
    return ranged(docs).select("doc_id", "text", "part").mapInArrow(_pieces(path, length, end_id), SCHEMA)
