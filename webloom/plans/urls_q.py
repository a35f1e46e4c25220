"""Registered queries over ``pages``: classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import classify as C
from webloom.sources import rules as R
from webloom.sources import tables


def classified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only the URL is needed: the html column never leaves the scan.
    return C.classify(tables.pages(spark, sf_dir, "page_id", "url"), R.load_classes())


def classify_pages(spark, sf_dir):
    return classified_pages(spark, sf_dir).select("page_id", "url", "uclass", "class_type", "normalized_url")


def classify_counts(spark, sf_dir):
    return (classified_pages(spark, sf_dir).groupBy("uclass", "class_type")
            .agg(F.count(F.lit(1)).alias("n_pages")))


def unclassified_pages(spark, sf_dir):
    return C.unclassified(classified_pages(spark, sf_dir)).select("page_id", "url")


def ignored_pages(spark, sf_dir):
    return C.ignored(classified_pages(spark, sf_dir)).select("page_id", "url", "uclass")


def normalize_urls(spark, sf_dir):
    return (C.processable(classified_pages(spark, sf_dir))
            .select("page_id", "url", "uclass", "normalized_url"))


def classify_pages_by_host(spark, sf_dir):
    """The form for large rule sets: rules as a table, joined by host."""
    c = C.classify_by_host(tables.pages(spark, sf_dir, "page_id", "url"), R.load_classes())
    return c.select("page_id", "url", "uclass", "class_type", "normalized_url")


QUERIES = {
    "classify_pages": classify_pages,
    "classify_pages_by_host": classify_pages_by_host,
    "classify_counts": classify_counts,
    "unclassified_pages": unclassified_pages,
    "ignored_pages": ignored_pages,
    "normalize_urls": normalize_urls,
}
