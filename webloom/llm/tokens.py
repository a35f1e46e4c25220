"""Operator 9: token counts by a two-tier map-side lookup (also the encoder of
operator 4).

A text falls into *units*: for words of ASCII and the letters U+00C0 to U+00FF
the pre-tokens of the vocabulary's own pattern (letter runs, single digits, runs of
other characters); any other word between ASCII white space (with an
apostrophe, ``<``, a control character or any other character) is one unit as it
stands and goes through the library whole.  The tokens of a text are those of
its units in order.  Units are found and hashed with numpy on the Arrow buffer.

Tier one is a broadcast table of the most frequent units of the corpus (hash to
token count, at most ``FREQUENT`` entries, gathered from at most ``PER_TASK`` per
task).  What it lacks is encoded by the library in the task and kept in a cache
of the worker, which starts anew beyond ``CACHE_UNITS`` entries.  No unit is
shuffled.

Defined cases: a null or blank text has no tokens; repeated rows and a null
doc_id are counted as they come; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textcore as T
from webloom.session import ship_package

FREQUENT = 1 << 16
PER_TASK = 1 << 13
CACHE_UNITS = 300_000

SPACE, LETTER, DIGIT, OTHER, ODD, WHOLE = range(6)


def _byte_kinds() -> np.ndarray:
    t = np.full(256, ODD, np.uint8)
    t[33:127] = OTHER
    t[48:58] = DIGIT
    t[65:91] = t[97:123] = LETTER
    t[[39, 60]] = ODD  # apostrophe and <
    t[T.is_space()] = SPACE
    return t


class Units:
    """The units of a slice: spans over ``buf`` (lower-cased where simple)."""

    def __init__(self, s: T.Slice):
        buf, kind = s.buf.copy(), _byte_kinds()[s.buf]
        two = np.flatnonzero(buf == 0xC3)
        if len(two):
            nxt = buf[two + 1]
            plain = (nxt != 0x97) & (nxt != 0xB7)
            two, nxt = two[plain], nxt[plain]
            kind[two] = kind[two + 1] = LETTER
        if (kind == ODD).any():
            w0, w1 = T.run_spans((kind == SPACE).astype(np.uint8), s.off, np.array([True, False]))
            odd = np.concatenate([[0], np.cumsum(kind == ODD)])
            mark = odd[w1] > odd[w0]
            step = np.zeros(len(kind) + 1, np.int32)
            np.add.at(step, w0[mark], 1)
            np.add.at(step, w1[mark], -1)
            kind[np.cumsum(step[:-1]) > 0] = WHOLE
        up = (kind == LETTER) & (buf >= 65) & (buf <= 90)
        buf[up] += 32
        if len(two):
            two = two[(nxt <= 0x9E) & (kind[two] == LETTER)] + 1
            buf[two] += 32
        self.buf = buf
        self.start, self.end = T.run_spans(kind, s.off, np.array([False, True, True, True, False, True]), DIGIT)
        self.whole = kind[self.start] == WHOLE if len(self.start) else np.zeros(0, bool)
        self.per_doc = np.searchsorted(self.start, s.off)
        self.hash = T.span_hash(T.prefix_hash(buf, fold=False), self.start, self.end)

    def text(self, i: int) -> str:
        return self.buf[self.start[i]: self.end[i]].tobytes().decode()


class Encoder:
    """Token ids of units, through the library for those not seen before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.at = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.n_units = self.n_ids = 0

    def encode(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _simple(self, units: list[str]) -> list[np.ndarray]:
        ids = np.array(self.encode(" ".join(units)), np.uint32)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) == len(units) and (not len(ids) or cut[-1] == len(ids)):
            return np.split(ids, cut[:-1])
        return [np.array(self.encode(u), np.uint32) for u in units]

    def learn(self, keys: list[int], units: list[str], whole: list[bool]) -> None:
        simple = [i for i, w in enumerate(whole) if not w]
        got: list = [None] * len(units)
        for lo in range(0, len(simple), 2000):
            part = simple[lo: lo + 2000]
            for i, ids in zip(part, self._simple([units[i] for i in part]), strict=True):
                got[i] = ids
        odd = [i for i, w in enumerate(whole) if w]
        for i in odd:
            got[i] = np.array(self.encode(units[i]), np.uint32)
        size = np.array([len(g) for g in got])
        need_u, need_i = self.n_units + len(units) + 1, self.n_ids + int(size.sum())
        if need_u > len(self.at):
            self.at = np.resize(self.at, 2 * need_u)
        if need_i > len(self.ids):
            self.ids = np.resize(self.ids, 2 * need_i)
        self.ids[self.n_ids: need_i] = np.concatenate(got)
        self.at[self.n_units + 1: need_u] = self.n_ids + np.cumsum(size)
        self.known.update(zip(keys, range(self.n_units, need_u - 1), strict=True))
        self.n_units, self.n_ids = need_u - 1, need_i

    def places(self, u: Units, first: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Index in the cache of the units at ``first`` with hashes ``keys``."""
        if len(self.known) > CACHE_UNITS:
            self.clear()
        want = keys.tolist()
        miss = [i for i, k in enumerate(want) if k not in self.known]
        if miss:
            self.learn([want[i] for i in miss], [u.text(first[i]) for i in miss], [bool(u.whole[first[i]]) for i in miss])
        return np.fromiter((self.known[k] for k in want), np.int64, len(want))

    def lengths(self, place: np.ndarray) -> np.ndarray:
        return self.at[place + 1] - self.at[place]

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these units one after the other, their lengths)."""
        size = self.lengths(place)
        ends = np.cumsum(size)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[place] - (ends - size), size)
        return self.ids[index], size


def worker_encoder(path: str) -> Encoder:
    store = T.worker_store()
    if ("encoder", path) not in store:
        store["encoder", path] = Encoder(path)
    return store["encoder", path]


def _top(keys, counts, names, most):
    if len(keys) <= most:
        return keys, counts, names
    pick = np.argpartition(-counts, most)[:most]
    return keys[pick], counts[pick], [names[i] for i in pick]


def _frequent_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for b in batches:
        for s in T.slices(b.column(0)):
            u = Units(s)
            k, first, c = np.unique(u.hash, return_index=True, return_counts=True)
            ok = ~u.whole[first]
            k, first, c = k[ok], first[ok], c[ok]
            pick = np.argsort(-c, kind="stable")[: 2 * PER_TASK]
            k, first, c = k[pick], first[pick], c[pick]
            all_k = np.concatenate([keys, k])
            all_c, all_n = np.concatenate([counts, c]), names + [u.text(i) for i in first]
            keys, at, inv = np.unique(all_k, return_index=True, return_inverse=True)
            counts = np.bincount(inv, all_c, len(keys)).astype(np.int64)
            keys, counts, names = _top(keys, counts, [all_n[i] for i in at], 2 * PER_TASK)
    keys, counts, names = _top(keys, counts, names, PER_TASK)
    yield pa.record_batch([pa.array(names, pa.string()), pa.array(counts)], ["unit", "c"])


def frequent_table(docs: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, token counts) of the most frequent units."""
    rows = (docs.select("text").mapInArrow(_frequent_units, "unit string, c long").groupBy("unit")
            .agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "unit").limit(FREQUENT).select("unit").toArrow())
    names = rows.column("unit").to_pylist()
    enc = Encoder(path)
    buf = np.frombuffer("".join(names).encode(), np.uint8)
    end = np.cumsum([len(n.encode()) for n in names]).astype(np.int64)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    keys = T.span_hash(T.prefix_hash(buf, fold=False), start, end)
    enc.learn(keys.tolist(), names, [False] * len(names))
    size = enc.lengths(np.arange(len(names)))
    order = np.argsort(keys)
    return keys[order], size[order].astype(np.int32)


def _count(path: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, size = table.value
        enc = worker_encoder(path)
        for b in batches:
            for s in T.slices(b.column(1)):
                u = Units(s)
                k, first, inv = np.unique(u.hash, return_index=True, return_inverse=True)
                n = np.zeros(len(k), np.int64)
                at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
                hit = keys[at] == k if len(keys) else np.zeros(len(k), bool)
                n[hit] = size[at[hit]]
                miss = np.flatnonzero(~hit)
                if len(miss):
                    n[miss] = enc.lengths(enc.places(u, first[miss], k[miss]))
                total = np.concatenate([[0], np.cumsum(n[inv])])[u.per_doc]
                tokens = np.diff(total)
                yield pa.record_batch([b.column(0).slice(s.lo, s.hi - s.lo), pa.array(np.diff(s.off)), pa.array(tokens),
                                       pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit.

    path: a ``tokenizers`` JSON file with word-end BPE, as every worker sees it.
    """
    spark = ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(frequent_table(docs, path))
    return docs.mapInArrow(_count(path, table, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
