"""Registered crawl and cache queries.

Pages do not link to each other, so the crawl uses heap edges over
``page_id``: p -> 2p+1 and p -> 2p+2 where the target exists, plus a back edge
p -> 0 that the seen-set must absorb; seed 0, depth 3.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import cache as CA
from webloom.operators import crawl as CR
from webloom.operators import extract as X
from webloom.plans import extract_q
from webloom.sources import rules as R
from webloom.sources import tables

DEPTH = 3


def link_edges(spark, sf_dir):
    res = extract_q._results(spark, sf_dir)
    return CR.link_edges(res).select(F.col("src").alias("page_id"), "type", "seq", "dst")


def frontier(spark, sf_dir):
    edges = CR.link_edges(extract_q._results(spark, sf_dir))
    return CR.frontier(edges, tables.pages(spark, sf_dir, "url"))


def heap_edges(spark, sf_dir):
    ids = tables.pages(spark, sf_dir, "page_id")
    kids = (ids.select(F.col("page_id").alias("src"),
                       F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)).alias("dst"))
            .join(ids.select(F.col("page_id").alias("dst")), "dst", "left_semi"))
    back = ids.select(F.col("page_id").alias("src"), F.lit(0).cast("bigint").alias("dst"))
    return kids.select("src", "dst").unionByName(back)


def _reached(spark, sf_dir):
    seeds = tables.pages(spark, sf_dir, "page_id").where(F.col("page_id") == 0).select(F.col("page_id").alias("node"))
    return CR.expand(seeds, heap_edges(spark, sf_dir), DEPTH)


def crawl_depth3(spark, sf_dir):
    return _reached(spark, sf_dir).select(F.col("node").alias("page_id"), "depth")


def inherited_tags(spark, sf_dir):
    reached = _reached(spark, sf_dir)
    anc = CR.ancestors(reached, DEPTH)
    # Only pages on some breadcrumb are tokenized.
    pages = tables.pages(spark, sf_dir, "page_id", "html").join(
        anc.select(F.col("anc").alias("page_id")).distinct(), "page_id", "left_semi")
    tags = X.apply_parsers(pages, [p for p in R.load_parsers() if p.type == "TAG"])
    page_tags = X.page_tags(tags).select(F.col("page_key").alias("node"), "tags")
    urls = tables.pages(spark, sf_dir, "page_id", "url").select(F.col("page_id").alias("node"), "url")
    t = CR.inherited_tags(reached, anc, page_tags, urls)
    return t.select(F.col("node").alias("page_id"), "depth", F.array_join("tags", ",").alias("tags"))


def route_bodies(spark, sf_dir):
    pages = tables.pages(spark, sf_dir, "page_id").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        F.lit("text/html; charset=utf-8").alias("content_type"))
    docs = tables.documents(spark, sf_dir, "doc_id").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit("text/plain").alias("content_type"))
    return CR.route_bodies(pages.unionByName(docs)).select("kind", "id", "route")


def prefix_values(spark, sf_dir):
    return CR.prefix_values(extract_q.extract_titles(spark, sf_dir), "title").select("page_id", "value")


def _versions(spark, sf_dir):
    return _versions_of(tables.pages(spark, sf_dir, "page_id", "url", "html"))


def _versions_of(p):
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("version")
    return (p.select("page_id", "url", "html", k)
            .select("url", "version",
                    (F.lit("2024-01-01").cast("timestamp")
                     + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("version") * F.col("page_id")).cast("int"))
                     ).alias("fetched_at"),
                    F.concat("html", F.lit("<!-- "), F.col("version").cast("string"), F.lit(" -->")).alias("body")))


def cache_table(spark, sf_dir):
    return CA.cache_upsert(_versions(spark, sf_dir), tie_col="version")


def page_cache_latest(spark, sf_dir):
    return cache_table(spark, sf_dir).select("url_key", "url", "version", "fetched_at",
                                             F.length("body").alias("body_chars"))


def _https_cache(spark, sf_dir):
    # Whether a key is cached does not depend on which version won.
    https = tables.pages(spark, sf_dir, "page_id", "url").where(F.col("url").startswith("https:"))
    return https.select(CA.url_key("url").alias("url_key")).distinct()


def cache_hits(spark, sf_dir):
    return CA.cache_hits(tables.pages(spark, sf_dir, "page_id", "url"), _https_cache(spark, sf_dir)).select("page_id", "url")


def cache_misses(spark, sf_dir):
    return CA.cache_misses(tables.pages(spark, sf_dir, "page_id", "url"), _https_cache(spark, sf_dir)).select("page_id", "url")


QUERIES = {
    "link_edges": link_edges,
    "frontier": frontier,
    "crawl_depth3": crawl_depth3,
    "inherited_tags": inherited_tags,
    "route_bodies": route_bodies,
    "prefix_values": prefix_values,
    "page_cache_latest": page_cache_latest,
    "cache_hits": cache_hits,
    "cache_misses": cache_misses,
}
