"""Connected components over an edge DataFrame, wholly distributed.

Alternating large-star and small-star steps (Kiveris et al., 2014).  Each step
is a map-side combined ``min`` per node and a join back on the node, which
adaptive execution may split where one node has very many edges.  The edges are
checkpointed after each round; the driver only sees counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import cut

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u != v.  For each node the smallest of its neighbours and
    itself; link its larger (large) or not larger (small) neighbours to it."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        out = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node that it
    reaches.  edges: bigint columns u, v; empty, repeated or reflexive edges
    are allowed."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u != v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def state(x: DataFrame):
        r = x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    before = None
    for _ in range(MAX_ROUNDS):
        e = cut(_star(_star(e, True), False))
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no fixed point within {MAX_ROUNDS} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
