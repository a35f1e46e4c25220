"""Operator 10: quality scores from random Fourier features.

1. Each whole text is reduced to the statistics of :func:`statistics` (byte
   classes, word and line lengths, repetition), with numpy on Arrow buffers.
2. Standardised statistics go through ``FEATURES`` random cosines, which
   approximate a Gaussian kernel.  Each task sums its part of the ridge
   normal equations over the labelled rows; the sums are added up in a tree, and
   the driver solves one system of fixed size.
3. A quarter of the training rows is left for calibration: raw scores are counted
   in ``BINS`` bins on the cluster and the isotonic fit runs over the bins.

Defined cases: a null or blank text has all-zero statistics and is scored like any
other; rows with a null doc_id are scored but never learned from; a label
that is null or not 0/1 is ignored; of several labels of one id the largest
counts; without labelled rows every score is 0.5.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textcore as T
from webloom.llm.common import cut, fold_of
from webloom.session import ship_package

FEATURES = 256
BINS = 2000
RIDGE = 1e-3
LOW, HIGH = -0.5, 1.5
STATS = 24


def _repeats(key: np.ndarray, doc: np.ndarray, n_docs: int):
    """Per document: distinct keys, largest count and sum of squared counts."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(k)])
    own = d[first]
    most = np.zeros(n_docs)
    np.maximum.at(most, own, count)
    return np.bincount(own, minlength=n_docs), most, np.bincount(own, count.astype(float) ** 2, n_docs)


def statistics(s: T.Slice) -> np.ndarray:
    """documents x STATS, float64, all finite."""
    n = s.hi - s.lo
    size = np.diff(s.off)
    hist = np.bincount(np.repeat(np.arange(n) * 256, size) + s.buf, minlength=n * 256).reshape(n, 256).astype(float)
    total = np.maximum(size, 1)
    share = hist / total[:, None]
    pre = T.prefix_hash(s.buf)
    w0, w1, wd = T.word_spans(s)
    words = np.bincount(wd, minlength=n)
    some = np.maximum(words, 1)
    length = (w1 - w0).astype(float)
    mean = np.bincount(wd, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(wd, length * length, n) / some - mean * mean, 0))
    h = T.span_hash(pre, w0, w1)
    distinct, most, squares = _repeats(h, wd, n)
    same = np.r_[False, (h[1:] == h[:-1]) & (wd[1:] == wd[:-1])] if len(h) else np.zeros(0, bool)
    l0, l1 = T.run_spans((s.buf == 10).astype(np.uint8), s.off, np.array([True, False]))
    ld = T.doc_of(s.off, l0)
    lines = np.bincount(ld, minlength=n)
    many = np.maximum(lines, 1)
    ldistinct, _, _ = _repeats(T.span_hash(pre, l0, l1), ld, n)
    last = s.buf[l1 - 1] if len(l1) else np.zeros(0, np.uint8)
    first = s.buf[w0] if len(w0) else np.zeros(0, np.uint8)
    final = s.buf[w1 - 1] if len(w1) else np.zeros(0, np.uint8)
    upper, digit = share[:, 65:91].sum(1), share[:, 48:58].sum(1)
    lower = share[:, 97:123].sum(1)
    marks = np.concatenate([share[:, 33:48], share[:, 58:65], share[:, 91:97], share[:, 123:127]], 1).sum(1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)

    def per_word(mask):
        return np.bincount(wd, mask.astype(float), n) / some

    upper_first = (first >= 65) & (first <= 90)
    odd_end = np.isin(final, np.frombuffer(b"!#$%&*|~^<>=+@_", np.uint8))
    cols = [np.log1p(size), np.log1p(words), mean, spread, upper, lower, digit, marks, share[:, 128:].sum(1),
            share[:, [32, 9, 10, 11, 12, 13]].sum(1), np.sqrt(share[:, 33]), np.sqrt(share[:, 124]),
            np.sqrt(share[:, [35, 36, 37, 38, 42]].sum(1)), share[:, [44, 46]].sum(1), entropy, distinct / some,
            most / some, squares / some ** 2, per_word(same), per_word(upper_first), per_word(odd_end),
            np.log1p(size / many), ldistinct / many,
            np.bincount(ld, np.isin(last, np.frombuffer(b".!?", np.uint8)).astype(float), n) / many]
    return np.stack(cols, 1)


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in T.slices(b.column(1)):
            x = statistics(s)
            yield pa.record_batch([b.column(0).slice(s.lo, s.hi - s.lo),
                                   T.as_list(list(x), pa.float64())], ["doc_id", "x"])


class Model:
    """Standardisation, random cosines, ridge weights, isotonic steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(10)
        self.mean, self.scale = mean, scale
        self.freq = rng.standard_normal((len(mean), FEATURES)) / np.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.freq + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.steps is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), *self.steps)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), -1)


def _equations(model: Model):
    """The task's sum of z z', z y and the row count, as one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        acc = np.zeros((d, d + 1))
        for b in batches:
            if b.num_rows:
                z = model.features(_matrix(b.column(0)))
                acc += np.hstack([z.T @ z, z.T @ b.column(1).to_numpy().astype(float)[:, None]])
        yield pa.record_batch([pa.array([acc.tobytes()], pa.binary())], ["part"])
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc = None
    for b in batches:
        for x in b.column(0):
            a = np.frombuffer(x.as_py())
            acc = a.copy() if acc is None else acc + a
    if acc is not None:
        yield pa.record_batch([pa.array([acc.tobytes()], pa.binary())], ["part"])


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit of positive/total, weights total > 0."""
    value, weight, width = [], [], []
    for t, p in zip(total.tolist(), positive.tolist(), strict=True):
        value.append(p / t)
        weight.append(t)
        width.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            w = weight[-2] + weight[-1]
            value[-2:] = [(value[-2] * weight[-2] + value[-1] * weight[-1]) / w]
            weight[-2:] = [w]
            width[-2:] = [width[-2] + width[-1]]
    return np.repeat(value, width)


def fit(stats: DataFrame, labels: DataFrame, label: str, folds: int = 5) -> Model:
    """stats: doc_id, x.  Learns from ids whose fold is not 0; fold 1 calibrates."""
    moments = stats.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(STATS)
                          for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(STATS)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(STATS)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
         .where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y")))
    known = cut(stats.join(y.where(fold_of(F.col("doc_id"), folds) != 0), "doc_id")
                .select("x", "y", (fold_of(F.col("doc_id"), folds) == 1).alias("calibrate")))
    train = known.where("not calibrate").select("x", "y")
    parts = train.mapInArrow(_equations(model), "part binary").repartition(8).mapInArrow(_add, "part binary").collect()
    acc = sum((np.frombuffer(r["part"]) for r in parts), np.zeros((FEATURES + 1) * (FEATURES + 2)))
    acc = acc.reshape(FEATURES + 1, FEATURES + 2)
    rows = acc[-1, -2]
    if rows:
        model.weights = np.linalg.solve(acc[:, :-1] + RIDGE * rows * np.eye(FEATURES + 1), acc[:, -1])

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    r = (model.raw(_matrix(b.column(0))) - LOW) / (HIGH - LOW) * BINS
                    yield pa.record_batch([pa.array(np.clip(r, 0, BINS - 1).astype(np.int32)), b.column(1)], ["bin", "y"])

        def counts(rows: DataFrame):
            return (rows.select("x", "y").mapInArrow(binned, "bin int, y int").groupBy("bin")
                    .agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect())

        got = counts(known.where("calibrate")) or counts(known)
        n, p = np.array([r["n"] for r in got], float), np.array([r["p"] for r in got], float)
        at = LOW + (np.array([r["bin"] for r in got]) + 0.5) * (HIGH - LOW) / BINS
        model.steps = (at, isotonic(n, p))
    return model


def document_statistics(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(_stat_rows, "doc_id long, x array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5,
                   threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, <label>, ...) -> doc_id,
    held_out (crc32 of the id modulo ``folds`` is 0), score, predicted."""
    stats = cut(document_statistics(docs))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, label, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), pa.array(model.value.score(_matrix(b.column(1))))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least ``threshold``."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(cut(document_statistics(docs)), labels, "quality"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(at)):
                ok = model.value.score(statistics(s)) >= threshold
                yield b.slice(s.lo, s.hi - s.lo).filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
