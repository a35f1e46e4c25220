"""Operator 8: embedding near-duplicates by a pivot-permutation index.

1. Equal vectors of a label collapse to one representative.
2. Two sets of reference vectors are drawn by a hash of the vector (a bounded sample; every
   vector is indexed).  Vectors close to a pivot already taken (a cosine of ``APART`` or
   more, its limits tried in turn) are passed over, so a large group of near copies holds
   hardly more pivots than a small one.  The size of a set follows the square root of the
   largest label, so a list of two pivots holds about ``LIST`` vectors whatever the table's
   size (up to ``MOST_PIVOTS`` a set; lists grow with the table only beyond that).
3. A vector is described by its ``PREFIX`` nearest pivots of each set in order and entered
   in the inverted lists of the pairs (one pivot of each set) of its first ``TOP`` ones,
   kept apart by label and dimension.
4. Vectors that stand together in a list and share at least ``SHARED`` prefix pivots of
   each set are candidates; a pair counts only in the list of the first pivots (by
   number) that it shares.  Longer lists (a group of near copies) are cut in blocks of
   about ``BLOCK`` vectors and every two blocks meet; lists lie one after the other in a
   task, which holds one at a time.
5. Candidates are verified by the cosine in double precision.  A task returns link
   counts and a spanning forest, never its pairs.

The index is approximate: a pair with fewer shared pivots is missed.  Links found
are exact.  The recall on perturbed vectors is measured in tests/llm.

Defined cases: a null label, a null, empty or zero vector and one with a null or
non-finite component link with nothing and are their own component; vectors
of different lengths do not link; repeated rows are copies of each other; a
row without vec_id has a null component and is not kept.  Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import cut, shuffle_partitions
from webloom.llm.graph import components
from webloom.session import ship_package

PREFIX, TOP, SHARED = 10, 4, 3
LIST, LEAST_PIVOTS, MOST_PIVOTS = 256, 32, 4096
BLOCK = 1024
SMALL = 100_000
APART = (0.5, 0.7, 0.9)
SAMPLE, PER_PIVOT, SAMPLE_VALUES = 4096, 4, 1 << 22
LISTS = ["label", "dim", "p1", "p2", "bi", "bj"]


def _unit(rows) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivot_count(vectors: int) -> int:
    """Pivots of a set, so that lists of a label of so many vectors hold about ``LIST``."""
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(TOP * math.sqrt(vectors / LIST))))


def _draw(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows in order, none within the last limit of ``APART`` of another.
    The looser limits only fill up what the stricter ones leave open."""
    top, taken = np.full(len(sample), -1.0), []
    for limit in APART:
        for i in range(len(sample)):
            if len(taken) < most and top[i] < limit:
                taken.append(i)
                top = np.maximum(top, sample @ sample[i])
                top[i] = 1.0
    return sample[taken]


def _two_sets(sample: np.ndarray, most: int) -> list[np.ndarray]:
    """The sets start from the two ends of the sample, so they differ where it is large enough."""
    return [_draw(sample, most), _draw(sample[::-1], most)]


def _nearest(unit: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The PREFIX nearest pivots of each set in order; -1 where a set has fewer."""
    near = np.full((len(unit), 2 * PREFIX), -1, np.int16)
    for k, pivots in enumerate(sets):
        order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :PREFIX]
        near[:, k * PREFIX:k * PREFIX + order.shape[1]] = order
    return near


def _describe(sets, kind: str):
    """rep, size, label, embedding -> with dim, the bytes of the vector, its nearest pivots and the
    first TOP of each set as lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sets.value
        for b in batches:
            values, dims = b.column(3).flatten().to_numpy(), pc.list_value_length(b.column(3)).to_numpy()
            ends = np.cumsum(dims)
            near, blobs = np.full((len(dims), 2 * PREFIX), -1, np.int16), [b""] * len(dims)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                vecs = values[(ends[own] - dim)[:, None] + np.arange(dim)]
                near[own] = _nearest(_unit(vecs), table[dim])
                for i, v in zip(own, vecs.astype(kind), strict=True):
                    blobs[i] = v.tobytes()
            first = [[[int(x) for x in n[k:k + TOP] if x >= 0] for n in near] for k in (0, PREFIX)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(dims, pa.int32()),
                                   pa.array(blobs, pa.binary()),
                                   pa.array([n.tobytes() for n in near], pa.binary()),
                                   pa.array(first[0], pa.list_(pa.int32())), pa.array(first[1], pa.list_(pa.int32()))],
                                  ["rep", "size", "label", "dim", "vec", "near", "first1", "first2"])
    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each index reaches in a symmetric link matrix."""
    top = np.arange(len(linked))
    while True:
        new = np.minimum(top, np.where(linked, top[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == top).all():
            return top
        top = new


def _membership(near: np.ndarray, pivot: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One set's prefixes as rows over the pivots that occur: the whole prefix, its first
    TOP, and how many of the columns are pivots before ``pivot``."""
    numbers, at = np.unique(near, return_inverse=True)
    at = at.reshape(near.shape)
    whole = np.zeros((len(near), len(numbers)), np.float32)
    top = whole.copy()
    np.put_along_axis(whole, at, 1, 1)
    np.put_along_axis(top, at[:, :TOP], 1, 1)
    absent = np.searchsorted(numbers, 0)
    return whole[:, absent:], top[:, absent:], int(np.searchsorted(numbers, pivot)) - absent


def _candidates(near: np.ndarray, pivots: tuple[int, int], a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """Pairs of a list that share enough pivots of each set and no earlier list."""
    ok = np.ones((len(a), len(b)), bool)
    for k, pivot in enumerate(pivots):
        whole, top, before = _membership(near[:, k * PREFIX:(k + 1) * PREFIX], pivot)
        ok &= whole[a] @ whole[b].T >= min(shared, whole.sum(1).min())
        ok &= top[a][:, :before] @ top[b][:, :before].T == 0
    return ok


def _rows(column: pa.ChunkedArray, kind) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _search_list(key: tuple, table: pa.Table, least: float, shared: int, kind: str) -> pa.RecordBatch:
    rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy()
    side = table.column("side").to_numpy()
    unit = _unit(_rows(table.column("vec"), kind))
    near = _rows(table.column("near"), np.int16)
    a = np.flatnonzero(side == 0)
    b = a if key[4] == key[5] else np.flatnonzero(side == 1)
    ok = _candidates(near, key[2:4], a, b, shared) & (unit[a] @ unit[b].T >= least)
    linked = np.zeros((len(rep), len(rep)), bool)
    linked[np.ix_(a, b)] = ok
    linked |= linked.T
    np.fill_diagonal(linked, False)
    links = linked @ size
    some = links > 0
    return pa.record_batch([pa.array(rep[some]), pa.array(rep[_forest(linked)][some]), pa.array(links[some].astype(np.int64))],
                           ["rep", "root", "links"])


def _search(least: float, shared: int, kind: str):
    """Rows sorted by list -> links and forests; holds one list (two blocks) and one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in LISTS], axis=1)
            starts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for at, end in zip([0, *starts], [*starts, len(keys)], strict=True):
                new = tuple(int(x) for x in keys[at])
                if new != key and parts:
                    yield _search_list(key, pa.Table.from_batches(parts), least, shared, kind)
                    parts = []
                key = new
                parts.append(batch.slice(at, end - at))
        if parts:
            yield _search_list(key, pa.Table.from_batches(parts), least, shared, kind)
    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, shared: int = SHARED) -> DataFrame:
    """vectors (vec_id, embedding array<float>, label, ...) -> vec_id, n_links,
    component_id, kept."""
    spark = ship_package(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & ~bad
                    & F.exists(e, lambda x: x != 0), F.lit(False))
    # Adding 0 turns -0.0 into 0.0: equal vectors hash alike.
    plain = F.transform(e, lambda x: x + F.lit(0.0))
    v = v.select("vec_id", "label", "embedding", ok.alias("ok"), F.when(ok, F.xxhash64(plain)).alias("h1"),
                 F.when(ok, F.xxhash64(F.lit(8), plain)).alias("h2"))
    classes = cut(v.where("ok").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.any_value("embedding").alias("embedding")))
    per_label = classes.groupBy("label", F.size("embedding").alias("d")).count()
    sets = {}
    for d, largest in per_label.groupBy("d").agg(F.max("count")).collect():
        most = pivot_count(largest)
        rows = classes.where(F.size("embedding") == d).orderBy(F.xxhash64("h1", "h2"), "rep").limit(
            max(LEAST_PIVOTS, min(max(SAMPLE, PER_PIVOT * most), SAMPLE_VALUES // d))).collect()
        sets[d] = _two_sets(_unit([r["embedding"] for r in rows]), most)
    kind = "f4" if v.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    described = cut(classes.select("rep", "size", "label", "embedding").mapInArrow(
        _describe(spark.sparkContext.broadcast(sets), kind),
        "rep long, size long, label long, dim int, vec binary, near binary, first1 array<int>, first2 array<int>"))
    entry = described.select("*", F.explode("first1").alias("p1")).select("*", F.explode("first2").alias("p2"))
    lists = cut(entry.groupBy("label", "dim", "p1", "p2").agg(F.count("*").alias("n")).where("n > 1")
                .select("label", "dim", "p1", "p2", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    entry = entry.join(F.broadcast(lists) if lists.count() <= SMALL else lists, ["label", "dim", "p1", "p2"])
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    ways = F.expr("transform(sequence(0, blocks - 1), b -> struct(least(b, own) as bi, greatest(b, own) as bj, "
                  "if(b < own, 1, 0) as side))")
    dealt = (entry.withColumn("own", own).withColumn("w", F.explode(ways))
             .select("label", "dim", "p1", "p2", "w.bi", "w.bj", "w.side", "rep", "size", "vec", "near"))
    out = cut(dealt.repartition(shuffle_partitions(spark), *LISTS).sortWithinPartitions(*LISTS)
              .mapInArrow(_search(least, shared, kind), "rep long, root long, links long"))
    degree = out.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(out.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    final = cut(classes.select("label", "h1", "h2", "rep", "size").join(degree, "rep", "left")
                .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
                .select("label", "h1", "h2", F.coalesce("root", "rep").alias("root"),
                        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    return (v.select("vec_id", "label", "h1", "h2").join(final, ["label", "h1", "h2"], "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")))
