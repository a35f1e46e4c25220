"""Operator 6: toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its character 3- to 5-grams (with word edges), hashed to
``BUCKETS`` embeddings; a window of ``WINDOW`` words is the average of its words;
the softmax over (clean, toxic) reads that average, and a text has the score of
its most toxic window, so a few words count as much in a long text as in a
short one.  Embeddings and softmax are trained together in numpy on the driver, on
at most ``TRAIN_ROWS`` labelled documents of each class of at most
``TRAIN_BYTES`` bytes each (chosen by a hash of the id), on the window that
scores highest.  The score is calibrated by a logistic fit on at most
``CALIBRATE_ROWS`` documents of any length that the training left out: they are scored
in Spark tasks like all others, and two numbers a document come back.  Scoring covers
every whole text; only one number per bucket is broadcast.

Defined cases: a null or blank text has the score of a window without
evidence; a label that is null or not 0/1 is ignored, of several labels of one
id the largest counts; of several texts of one id training takes the least, and
calibration the highest score; rows with a null doc_id are scored, never learned from;
without labels of both classes every score is that class's share, or 0
without any.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import textcore as T
from webloom.llm.common import bounded_rows, cut, fold_of
from webloom.session import ship_package

BUCKETS = 1 << 17
DIM = 16
WINDOW, STRIDE = 2, 1
TRAIN_ROWS, TRAIN_BYTES = 1500, 32_768
CALIBRATE_ROWS = 3000
EPOCHS, RATE, SCALE, MIN_DOCS = 40, 0.02, 16.0, 2


class Words:
    """The words of a slice: unique words with their subword buckets, and per
    word occurrence the unique word and the document."""

    def __init__(self, s: T.Slice):
        start, end, self.doc = T.word_spans(s)
        h = T.span_hash(T.prefix_hash(s.buf), start, end)
        _, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.n_docs, self.n_words = s.hi - s.lo, len(first)
        self.bucket, self.owner = subwords(s.buf, start[first], end[first])


def subwords(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character 3- to 5-gram of ``<word>``."""
    size = end - start + 2
    to = np.cumsum(size)
    total = int(to[-1]) if len(to) else 0
    at = to - size
    src = np.arange(total) - np.repeat(at - start + 1, size)
    own = np.repeat(np.arange(len(start)), size)
    flat = buf[np.clip(src, 0, max(len(buf) - 1, 0))] if len(buf) else np.zeros(0, np.uint8)
    flat[at], flat[to - 1] = 60, 62
    pre = T.prefix_hash(flat)
    lead = np.flatnonzero((flat & 0xC0) != 0x80)
    who = own[lead]
    stop = np.append(lead, total)
    buckets, owners = [], []
    for n in (3, 4, 5):
        m = len(lead) - n + 1
        if m <= 0:
            continue
        ok = who[:m] == who[n - 1: n - 1 + m]
        a, b = lead[:m][ok], stop[n: n + m][ok]
        buckets.append((T.span_hash(pre, a, b) & T.U(BUCKETS - 1)).astype(np.int32))
        owners.append(who[:m][ok].astype(np.int32))
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def word_values(w, weight: np.ndarray) -> np.ndarray:
    """Per unique word the mean of its subwords' weights."""
    n = np.bincount(w.owner, minlength=w.n_words)
    return np.bincount(w.owner, weight[w.bucket], w.n_words) / np.maximum(n, 1)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end word) of the windows of texts with these
    word counts; a text of up to WINDOW words is one window."""
    at = np.concatenate([[0], np.cumsum(counts)])
    number = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(counts)), number)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    first = at[doc] + k * STRIDE
    return doc, first, np.minimum(first + WINDOW, at[doc + 1])


def top_windows(value: np.ndarray, win, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document its best window (-1: none) and that window's mean."""
    doc, first, end = win
    run = np.concatenate([[0], np.cumsum(value)])
    mean = (run[end] - run[first]) / np.maximum(end - first, 1)
    best, top = np.full(n_docs, -1), np.zeros(n_docs)
    order = np.lexsort((mean, doc))
    last = np.flatnonzero(np.r_[doc[order][1:] != doc[order][:-1], True]) if len(doc) else np.zeros(0, np.int64)
    best[doc[order][last]] = order[last]
    top[doc[order][last]] = mean[order][last]
    return best, top


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def evidence(w: Words, y: np.ndarray, block: int = 200) -> np.ndarray:
    """z value of each bucket's share of toxic against clean documents; 0 for
    buckets that fewer than MIN_DOCS documents have.  Works on ``block``
    documents at a time."""
    start = np.searchsorted(w.owner, np.arange(w.n_words + 1))
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    edge = np.searchsorted(w.doc, np.arange(0, w.n_docs + block, block))
    for lo, hi in zip(edge, edge[1:], strict=False):
        pair = np.unique(w.doc[lo:hi].astype(np.int64) * w.n_words + w.word[lo:hi])
        doc, word = pair // w.n_words, pair % w.n_words
        size = (start[1:] - start[:-1])[word]
        at = np.arange(size.sum()) + np.repeat(start[word] - (np.cumsum(size) - size), size)
        key = np.unique(np.repeat(doc, size) * BUCKETS + w.bucket[at])
        own = y[key // BUCKETS]
        toxic += np.bincount(key % BUCKETS, own, BUCKETS)
        clean += np.bincount(key % BUCKETS, 1 - own, BUCKETS)
    n1, n0 = y.sum(), (1 - y).sum()
    p = (toxic + clean + 1) / (n1 + n0 + 2)
    z = (toxic / n1 - clean / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return np.where(toxic + clean >= MIN_DOCS, np.clip(z, -10, 10), 0)


def train(w: Words, y: np.ndarray) -> np.ndarray:
    """Joint training of embeddings and softmax (Adam on the log loss of the
    highest window, classes weighted alike); returns the logit difference of
    each bucket.  Embeddings begin along one direction, as long as the
    bucket's evidence, plus noise."""
    rng = np.random.default_rng(6)
    z = evidence(w, y)
    used = (z != 0)[:, None]
    ray = rng.standard_normal(DIM)
    ray /= np.linalg.norm(ray)
    noise = rng.standard_normal((BUCKETS, DIM))
    emb = ((0.1 * z[:, None] * ray + 0.001 * noise) * used).astype(np.float32)
    soft = np.stack([-ray / 2, ray / 2], 1).astype(np.float32)
    bias = 0.0
    win = windows(np.bincount(w.doc, minlength=w.n_docs))
    per_word = np.maximum(np.bincount(w.owner, minlength=w.n_words), 1)
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (emb, soft)]
    for epoch in range(1, EPOCHS + 1):
        diff = soft[:, 1] - soft[:, 0]
        best, top = top_windows(word_values(w, emb @ diff)[w.word], win, w.n_docs)
        g = (_sigmoid(SCALE * top + bias) - y) * balance
        has = best >= 0
        lo, hi = win[1][best[has]], win[2][best[has]]
        share = SCALE * g[has] / (hi - lo)
        on_word = np.zeros(w.n_words)
        for k in range(WINDOW):
            ok = lo + k < hi
            on_word += np.bincount(w.word[lo[ok] + k], share[ok], w.n_words)
        on_bucket = np.bincount(w.bucket, (on_word / per_word)[w.owner], BUCKETS).astype(np.float32)
        on_bucket[~used[:, 0]] = 0
        d_diff = emb.T @ on_bucket
        for (p, m, v), d in zip(state, (on_bucket[:, None] * diff, np.stack([-d_diff, d_diff], 1)), strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= RATE * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.99 ** epoch)) + 1e-7)
        bias -= 4 * g.sum()
    return emb @ (soft[:, 1] - soft[:, 0])


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic fit of y on x, by Newton steps."""
    mu, sd = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mu) / sd, np.ones(len(x))], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(z @ theta)
        grad = z.T @ (p - y) + 0.01 * theta
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        theta -= np.linalg.solve(hess, grad)
    return float(theta[0] / sd), float(theta[1] - theta[0] * mu / sd)


def _whole(texts: pa.ChunkedArray) -> T.Slice:
    buf, off = T.text_buffers(texts.combine_chunks())
    return T.Slice(0, len(off) - 1, buf, off)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5):
    """(weight per bucket, slope, intercept); a constant where labels lack."""
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
         .where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
         .where(fold_of(F.col("doc_id"), folds) != 0))
    known = y.join(docs.groupBy("doc_id").agg(F.min(F.octet_length("text")).alias("size")), "doc_id")
    tuned = fold_of(F.col("doc_id"), folds) == 1
    short = known.where(~tuned & (F.col("size") <= TRAIN_BYTES))
    # The picked ids are bounded (2 * TRAIN_ROWS + CALIBRATE_ROWS), so they are broadcast.
    picked = cut(
        bounded_rows(short.where("y = 1"), "doc_id", TRAIN_ROWS).unionByName(bounded_rows(short.where("y = 0"), "doc_id", TRAIN_ROWS))
        .withColumn("use", F.lit(0))
        .unionByName(bounded_rows(known.where(tuned), "doc_id", CALIBRATE_ROWS).withColumn("use", F.lit(1)))
        .select("doc_id", "y", "use"))
    rows = cut(docs.join(F.broadcast(picked), "doc_id"))
    got = (rows.where((F.col("use") == 0) & (F.octet_length("text") <= TRAIN_BYTES)).groupBy("doc_id", "y")
           .agg(F.min("text").alias("text")).toArrow().combine_chunks().sort_by("doc_id"))
    target = got.column("y").to_numpy().astype(float)
    if len(set(target)) < 2:
        n, toxic = picked.agg(F.count("*"), F.sum("y")).first()
        share = toxic / n if n else 0.0
        return None, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))) if n else -40.0
    weight = train(Words(_whole(got.column("text"))), target).astype(np.float32)
    tops = (rows.select("doc_id", "use", "y", "text").mapInArrow(_rank(docs.sparkSession.sparkContext.broadcast(weight)),
                                                                "doc_id long, use int, y int, top double")
            .groupBy("doc_id", "use", "y").agg(F.max("top").alias("top")).toArrow().sort_by("doc_id"))
    use, target = tops.column("use").to_numpy(), tops.column("y").to_numpy().astype(float)
    held = use == 1 if len(set(target[use == 1])) == 2 else use == 0
    slope, offset = platt(tops.column("top").to_numpy()[held], target[held])
    return weight, slope, offset


def best_means(weight: np.ndarray | None, texts: pa.Array) -> np.ndarray:
    """Per text the mean of its best window; 0 without words or weights."""
    top = np.zeros(len(texts))
    if weight is not None:
        for s in T.slices(texts):
            w = Words(s)
            _, top[s.lo:s.hi] = top_windows(word_values(w, weight)[w.word],
                                            windows(np.bincount(w.doc, minlength=w.n_docs)), w.n_docs)
    return top


def _rank(weight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            top = pa.array(best_means(weight.value, b.column(3)))
            yield pa.record_batch([*b.columns[:3], top], ["doc_id", "use", "y", "top"])
    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, slope, offset = model.value
        for b in batches:
            score = _sigmoid(slope * best_means(weight, b.column(1)) + offset)
            yield pa.record_batch([b.column(0), pa.array(score)], ["doc_id", "score"])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5,
                    threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, <label>, ...) -> doc_id,
    held_out (crc32 of the id modulo ``folds`` is 0), score, predicted."""
    spark = ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(fit(docs, labels, label, folds))
    out = docs.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
