"""Ordered state over long histories, in two levels.

A history (a jar, a cookie) may hold a third of all events, so it is never one
window.  All events are cut at quantiles of their time into buckets of about
``ROWS`` rows; windows run inside (key, bucket), and what a bucket needs of its
neighbours comes in as extra rows made of one summary row per (key, bucket).
Results do not depend on the buckets.  Where there are buckets, the functions read
their rows more than once; callers give them rows of a short plan (``session.stored``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import stored

ROWS = 1 << 20
BUCKET, EDGE = "_bucket", "_edge"


def bucket_bounds(times: DataFrame, rows: int = ROWS) -> list[int]:
    """Times (microseconds) that part the one timestamp column of ``times`` into buckets."""
    ts = F.unix_micros(F.col(times.columns[0]))
    n = -(-times.count() // rows)
    if n < 2:
        return []
    marks = times.agg(F.percentile_approx(ts, [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0]
    return sorted(set(marks or []))


def bucket_of(ts: Column, bounds: list[int]) -> Column:
    """The number of bounds that are not after ``ts``, by binary search."""
    if not bounds:
        return F.lit(0)
    table, us = F.array(*map(F.lit, bounds)), F.unix_micros(ts)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(table, at + step - 1) <= us, F.lit(False)), at + step).otherwise(at))


def carry(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bounds: list[int]) -> DataFrame:
    """rows (with BUCKET) and ``out``: the last value that is not null, at the row or before it in
    the order of its key."""
    own, v = [*keys, BUCKET], "_carried"
    every = rows.withColumn(v, value).withColumn(EDGE, F.lit(1))
    if bounds:
        ends = every.groupBy(*own).agg(F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v))
        before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        starts = ends.withColumn(v, F.last(v, ignorenulls=True).over(before)).where(F.col(v).isNotNull())
        every = every.unionByName(starts.withColumn(EDGE, F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*own).orderBy(EDGE, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn(out, F.last(v, ignorenulls=True).over(upto)).where(F.col(EDGE) == 1).drop(v, EDGE)


def with_neighbours(rows: DataFrame, keys: list[str], order: list[str], bounds: list[int]) -> DataFrame:
    """rows with EDGE = 1 and, in each (key, bucket), copies of the row before it (EDGE = 0) and
    after it (EDGE = 2), for LAG and LEAD inside the bucket."""
    every = rows.withColumn(EDGE, F.lit(1))
    if not bounds:
        return every
    one, at = F.struct(*rows.columns), F.struct(*order)
    ends = rows.groupBy(*keys, BUCKET).agg(F.min_by(one, at).alias("first"), F.max_by(one, at).alias("last"))
    along = Window.partitionBy(*keys).orderBy(BUCKET)
    near = stored(ends.select(BUCKET, F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after")),
                  "neighbours")
    for edge, name in ((0, "before"), (2, "after")):
        copies = near.where(F.col(name).isNotNull()).select(
            *(F.col(BUCKET) if c == BUCKET else F.col(name)[c].alias(c) for c in rows.columns), F.lit(edge).alias(EDGE))
        every = every.unionByName(copies)
    return every
