"""Operator 5: language identification with hyperdimensional profiles.

Every letter has a fixed random vector of ``DIM`` signs.  A letter with its two
neighbours (runs of non-letters count as one blank) is bound into a trigram
vector ``rot(rot(a)) * rot(b) * c``; the trigram vectors of a text are bundled by
addition.  A language's prototype is the bundle of its training texts, summed
per task and then by Spark as integers, so it does not depend on partitioning.  A
text goes to the prototype with the largest cosine.

Defined cases: a null text or one without a letter is ``und`` with score 0; on
equal cosines the first language in text order wins; without any prototype
every text is ``und``; rows with a null doc_id are predicted, never learned
from.  A score is the cosine, cut to [0, 1].  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textcore as T
from webloom.llm.common import fold_of
from webloom.session import ship_package

DIM = 1024
CELLS = 4_000_000  # largest dense count block, documents x trigrams


def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, 0 where it is no letter."""
    store = T.worker_store()
    if "letters" not in store:
        table = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        store["letters"] = table
    return store["letters"]


def _letter_vector(cp: int) -> np.ndarray:
    store = T.worker_store().setdefault("letter_vectors", {})
    if cp not in store:
        store[cp] = (np.random.default_rng([5, cp]).integers(0, 2, DIM) * 2 - 1).astype(np.int8)
    return store[cp]


class Trigrams:
    """The trigrams of a slice: document and index of each, vector per index."""

    def __init__(self, s: T.Slice):
        points = np.frombuffer(s.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80)])
        off = lead[s.off]
        c = _letters()[points]
        left, right = np.zeros_like(c), np.zeros_like(c)
        left[1:], right[:-1] = c[:-1], c[1:]
        edge = off[:-1][np.diff(off) > 0]
        left[edge] = 0
        right[off[1:][np.diff(off) > 0] - 1] = 0
        at = np.flatnonzero(c)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(at, off)))
        seen = np.zeros(0x110000, bool)
        seen[c[at]] = True
        self.letters = np.concatenate([[0], np.flatnonzero(seen)])
        n = len(self.letters)
        code = np.zeros(0x110000, np.int64)
        code[self.letters] = np.arange(n)
        key = (code[left[at]] * n + code[c[at]]) * n + code[right[at]]
        if n <= 160:
            there = np.flatnonzero(np.bincount(key, minlength=1))
            index = np.zeros(n ** 3, np.int64)
            index[there] = np.arange(len(there))
            self.index = index[key]
        else:
            there, self.index = np.unique(key, return_inverse=True)
        self.keys = there

    def vectors(self, lo: int, hi: int) -> np.ndarray:
        n, k = len(self.letters), self.keys[lo:hi]
        base = np.stack([_letter_vector(int(cp)) for cp in self.letters])
        out = np.roll(base, 2, 1)[k // (n * n)] * np.roll(base, 1, 1)[k // n % n] * base[k % n]
        return out.astype(np.float32)

    def bundle(self, group: np.ndarray, n_groups: int) -> np.ndarray:
        """n_groups x DIM: the summed vectors of the trigrams of each group."""
        out = np.zeros((n_groups, DIM), np.float64)
        step = max(1, CELLS // max(1, max(n_groups, DIM)))
        for lo in range(0, len(self.keys), step):
            hi = min(lo + step, len(self.keys))
            m = (self.index >= lo) & (self.index < hi)
            counts = np.bincount(group[m] * (hi - lo) + self.index[m] - lo, minlength=n_groups * (hi - lo))
            out += counts.reshape(n_groups, -1).astype(np.float32) @ self.vectors(lo, hi)
        return out


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for s in T.slices(b.column(1)):
            t = Trigrams(s)
            own = langs[s.lo: s.hi]
            names = sorted(set(own))
            number = {x: i for i, x in enumerate(names)}
            group = np.array([number[x] for x in own], np.int64)[t.doc]
            for name, v in zip(names, t.bundle(group, len(names)), strict=True):
                sums[name] = sums.get(name, 0) + v
    for name, v in sums.items():
        yield pa.record_batch([pa.array([name]), T.as_list([np.rint(v).astype(np.int64)])], ["lang", "v"])


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """docs (lang, text) -> (languages in text order, unit prototypes)."""
    rows = (docs.where("lang is not null and text is not null").select("lang", "text")
            .mapInArrow(_learn, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
            .groupBy("lang", "i").agg(F.sum("x").alias("x")).toArrow())
    langs = rows.column("lang").to_pylist()
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    proto = np.zeros((len(names), DIM))
    if names:
        proto[[number[x] for x in langs], rows.column("i").to_numpy()] = rows.column("x").to_numpy()
    norm = np.linalg.norm(proto, axis=1)
    some = norm > 0
    return [x for x, ok in zip(names, some, strict=True) if ok], proto[some] / norm[some][:, None]


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, proto = model.value
        for b in batches:
            for s in T.slices(b.column(1)):
                n = s.hi - s.lo
                pred, score = np.full(n, "und", object), np.zeros(n)
                t = Trigrams(s)
                if names and len(t.doc):
                    v = t.bundle(t.doc, n)
                    norm = np.linalg.norm(v, axis=1)
                    has = np.zeros(n, bool)
                    has[t.doc] = True
                    cos = v @ proto.T / np.where(norm > 0, norm, 1)[:, None]
                    best = cos.argmax(1)
                    pred[has] = np.array(names, object)[best[has]]
                    score[has] = np.clip(cos[np.arange(n), best], 0, 1)[has]
                yield pa.record_batch([b.column(0).slice(s.lo, n), pa.array(pred, pa.string()), pa.array(score)],
                                      ["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> doc_id, held_out (crc32 of the id
    modulo ``folds`` is ``held_fold``), lang_pred, score."""
    spark = ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    fold = fold_of(F.col("doc_id"), folds)
    model = spark.sparkContext.broadcast(prototypes(docs.where(fold != held_fold)))
    out = docs.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold == held_fold).alias("held_out"), "lang_pred", "score")
