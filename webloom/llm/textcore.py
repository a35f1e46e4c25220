"""Vectorised text primitives shared by the operators of this subpackage.

They work on the Arrow buffers of a string column, without a Python object
per row or word.  A *slice* is a run of whole documents of about one
megabyte (a longer document is a slice of its own), so memory follows the
slice, not the partition.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A word's
64-bit hash is a difference of prefix sums of (random value of the byte) *
(power of an odd constant), scaled back to the word's start, then mixed with
its length; equal words have equal hashes wherever they stand.  Different words
collide with a chance of about 2**-64.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

U = np.uint64
_POWER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Slice(NamedTuple):
    """Whole documents: rows [lo, hi) of the batch, their bytes and offsets."""
    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray


def worker_store() -> dict:
    """A dict that lives as long as the Python worker, over all its tasks."""
    return sys.__dict__.setdefault("_webloom_worker_store", {})


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64) \
        if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    buf, off = text_buffers(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Slice(lo, hi, buf[off[lo]: off[hi]], off[lo: hi + 1] - off[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(fold: bool) -> np.ndarray:
    """A fixed random 64-bit value per byte; with fold, A-Z have those of a-z."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * U(_POWER))
    if fold:
        v[65:91] = v[97:123]
    return v


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    store = worker_store()
    if "powers" not in store or len(store["powers"][0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for p in (_POWER, pow(_POWER, -1, 1 << 64)):
            a = np.full(size, U(p), np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        if n > 4 * SLICE_BYTES:  # for one very long document: not kept
            return both[0], both[1]
        store["powers"] = tuple(both)
    return store["powers"]


def prefix_hash(buf: np.ndarray, fold: bool = True) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` gets the hash of any span."""
    pw, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(byte_values(fold)[buf] * pw[: len(buf)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(pre))
    h = (pre[end] - pre[start]) * inv[start]
    return mix(h + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def is_space() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = True
    return t


def run_spans(kind: np.ndarray, off: np.ndarray, keep: np.ndarray, single: int = -1):
    """Starts and ends of maximal runs of equal ``kind`` (one value per byte)
    inside documents, where keep[kind]; every byte of kind ``single`` is a run."""
    n = len(kind)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[off] = True
    if single >= 0:
        s = kind == single
        edge[:n] |= s
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    ok = keep[kind[start]]
    return start[ok], end[ok]


def word_spans(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document within the slice) of each word."""
    start, end = run_spans(is_space()[s.buf].astype(np.uint8), s.off, np.array([True, False]))
    return start, end, doc_of(s.off, start)


def doc_of(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    counts = np.diff(np.searchsorted(at, off))
    return np.repeat(np.arange(len(off) - 1), counts)


def words(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(hash per word, word count per document) of a slice."""
    start, end, _ = word_spans(s)
    h = span_hash(prefix_hash(s.buf), start, end)
    return h, np.diff(np.searchsorted(start, s.off))


def fold_hash(acc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(acc * U(0xFF51AFD7ED558CCD) + h)


def shingle_sets(s: Slice, k: int) -> list[np.ndarray]:
    """Per document: the sorted distinct hashes of its k-word shingles; with
    1 to k-1 words the whole sequence is the one shingle; without, empty."""
    h, counts = words(s)
    n = len(h)
    acc = np.full(n, U(k), np.uint64)
    upto = max(n - k + 1, 0)
    roll = acc[:upto]
    for j in range(k):
        roll = fold_hash(roll, h[j: j + upto])
    at = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for d in range(len(counts)):
        a, b = at[d], at[d + 1]
        if b - a >= k:
            out.append(np.unique(roll[a: b - k + 1]))
        elif b > a:
            one = np.full(1, U(b - a), np.uint64)
            for x in h[a: b]:
                one = fold_hash(one, x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def as_list(rows: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """An Arrow list column from one array per row."""
    off = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=off[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


def blob(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())
