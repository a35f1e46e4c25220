"""Link graph and crawl frontier.

Links are an edge DataFrame; a crawl is an iterative equi-join of the current
level with the edges, minus everything already seen (``left_anti``) - a
breadth-first expansion in which each node is reached once, at its smallest
depth.  Each level is cut off with a reliable ``checkpoint`` (shared
``spark.checkpoint.dir``), so plans stay as short at depth 50 as at depth 1 and
survive executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import cut_lineage

LINK_TYPES = ("CONTENT", "NEXT", "FOLLOW")


def link_edges(results: DataFrame, key: str = "page_key") -> DataFrame:
    """Every CONTENT/NEXT/FOLLOW value becomes an edge (src, dst, type)."""
    return (results.where(F.col("type").isin(*LINK_TYPES))
            .select(F.col(key).alias("src"), F.col("value").alias("dst"), "type", *(
                [c for c in ("seq",) if c in results.columns])))


def frontier(edges: DataFrame, seen: DataFrame, dst: str = "dst", seen_col: str = "url") -> DataFrame:
    """Distinct new requests not seen before."""
    new = edges.select(F.col(dst).alias("url")).distinct()
    return new.join(seen.select(F.col(seen_col).alias("url")), "url", "left_anti")


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Nodes reachable from ``seeds`` (column ``node``) within
    ``max_depth`` hops over ``edges(src, dst)``; each node once with its
    smallest depth and the smallest ``parent`` of the level before (null for
    seeds).  Every level is checkpointed, so a level's plan reads files: it does not
    contain the levels before it."""
    hops = edges.select(F.col("src").alias("node"), "dst")
    level = cut_lineage(seeds.select("node").distinct().select(
        "node", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent")))
    out = level
    for d in range(1, max_depth + 1):
        found = (level.select("node").join(hops, "node").groupBy(F.col("dst").alias("new")).agg(F.min("node").alias("parent"))
                 .join(out.select(F.col("node").alias("new")), "new", "left_anti"))
        level = cut_lineage(found.select(F.col("new").alias("node"), F.lit(d).alias("depth"), "parent"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def ancestors(reached: DataFrame, max_depth: int) -> DataFrame:
    """(node, anc): the breadcrumb of each reached node up to ``max_depth`` steps, itself not included.
    Pointer jumping: each round doubles the steps, so depth d takes log2(d) rounds."""
    jump = cut_lineage(reached.where("parent is not null").select("node", F.col("parent").alias("anc"), F.lit(1).alias("far")))
    out, reach = jump, 1
    while reach < max_depth and not jump.isEmpty():
        hop = jump.select("node", F.col("anc").alias("mid"))

        def over(step: DataFrame) -> DataFrame:
            return hop.join(step.select(F.col("node").alias("mid"), "anc", (F.col("far") + reach).alias("far")), "mid").drop("mid")

        out, jump = cut_lineage(out.unionByName(over(out))), cut_lineage(over(jump))
        reach *= 2
    return out.where(F.col("far") <= max_depth).select("node", "anc")


def inherited_tags(reached: DataFrame, anc: DataFrame, page_tags: DataFrame, urls: DataFrame) -> DataFrame:
    """An item takes the tags of every page on its breadcrumb path (its
    ancestors): the distinct tags sorted, then lower-cased; then
    ``source:<url>`` and ``filename:<base name of the url>``.

    The tag set per item is built from distinct (item, tag) rows."""
    tagged = (anc.join(page_tags.select(F.col("node").alias("anc"), F.explode("tags").alias("tag")), "anc")
              .select("node", "tag").distinct()
              .groupBy("node").agg(F.collect_list("tag").alias("_t")))
    u = urls.select("node", "url")
    stripped = F.regexp_replace(F.col("url"), "/+$", "")
    basename = F.when(stripped == "", F.when(F.col("url") == "", F.lit(".")).otherwise(F.lit("/"))).otherwise(
        F.substring_index(stripped, "/", -1))
    return (reached.select("node", "depth").join(tagged, "node", "left").join(u, "node", "left")
            .select("node", "depth", F.concat(
                F.transform(F.array_sort(F.coalesce(F.col("_t"), F.array().cast("array<string>"))), lambda t: F.lower(t)),
                F.array(F.concat(F.lit("source:"), F.col("url")), F.concat(F.lit("filename:"), basename))).alias("tags")))


def route_bodies(bodies: DataFrame, content_type: str = "content_type") -> DataFrame:
    """``text/html`` bodies go to parsing, all others to ingest
    (case-sensitive prefix test, as the reference)."""
    return bodies.withColumn("route", F.when(F.col(content_type).startswith("text/html"), F.lit("parse"))
                             .otherwise(F.lit("ingest")))


def prefix_values(values: DataFrame, prefix: str, col: str = "value") -> DataFrame:
    """Of ``kind:value`` strings keep those of one kind, prefix stripped."""
    p = prefix + ":"
    return (values.where(F.col(col).startswith(p))
            .withColumn(col, F.substring(F.col(col), len(p) + 1, 1 << 30)))
