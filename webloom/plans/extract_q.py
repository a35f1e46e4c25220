"""Registered queries: class-parser binding and extraction over ``pages``
(SURVEY 7.4 rows 3-5, FIXTURES 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import binding as B
from webloom.operators import classify as C
from webloom.operators import extract as X
from webloom.operators import store
from webloom.operators.cache import url_key
from webloom.session import cut_lineage, work_dir
from webloom.sources import rules as R
from webloom.sources import tables


def _parser(name):
    return next(p for p in R.load_parsers() if p.name == name)


def _bound(spark, sf_dir, typed):
    """Each page with the parsers that apply to its class."""
    pages = C.classify(tables.pages(spark, sf_dir, "page_id", "url"), R.load_classes()).select("page_id", "uclass")
    bound = B.binding(spark, R.load_classes(), [*R.load_parsers(), *BAD_SAMPLES], typed=typed)
    return pages.join(bound.select("uclass", "parser"), "uclass").select("page_id", "uclass", "parser")


# A sample URL that does not parse binds nothing.
BAD_SAMPLES = [R.parser({"name": "bad samples", "type": "TAG", "operations": [{"type": "VALUE", "value": "x"}],
                         "urls": ["https://a.example.com:port/en/1", "https://a.example.com/%zz/1"]}, 99)]


def class_parser_binding(spark, sf_dir):
    return _bound(spark, sf_dir, True)


def class_parser_binding_untyped(spark, sf_dir):
    return _bound(spark, sf_dir, False)


def _run_all(spark, sf_dir, parser):
    pages = tables.pages(spark, sf_dir, "page_id", "html")
    res = X.apply_parser(pages, parser)
    return res.select(F.col("page_key").alias("page_id"), "seq", "value")


def extract_titles(spark, sf_dir):
    return _run_all(spark, sf_dir, _parser("title"))


def extract_links(spark, sf_dir):
    return _run_all(spark, sf_dir, _parser("nav links"))


def extract_ad_text(spark, sf_dir):
    return _run_all(spark, sf_dir, _parser("ad text"))


def extract_regex(spark, sf_dir):
    return _run_all(spark, sf_dir, _parser("tracker"))


def extract_value(spark, sf_dir):
    return _run_all(spark, sf_dir, _parser("constant"))


CHAIN = R.parser({"name": "nav words", "type": "TAG", "operations": [
    {"type": "XPATH", "value": "//nav//a/@href"}, {"type": "REGEX", "value": "[A-Za-z]+"},
    {"type": "PREFIX", "value": "word:"}, {"type": "SUFFIX", "value": ";"}]}, 0)


def extract_chain(spark, sf_dir):
    return _run_all(spark, sf_dir, CHAIN)


def _results(spark, sf_dir):
    classes, parsers = R.load_classes(), R.load_parsers()
    pages = C.processable(C.classify(tables.pages(spark, sf_dir, "page_id", "url", "html"), classes))
    return X.page_results(pages, B.binding_map(spark, classes, parsers))


def page_results(spark, sf_dir):
    return (_results(spark, sf_dir)
            .select(F.col("page_key").alias("page_id"), "uclass", "parser", "type", "seq", "value"))


def page_tags(spark, sf_dir):
    t = X.page_tags(_results(spark, sf_dir))
    return t.select(F.col("page_key").alias("page_id"), F.array_join("tags", ",").alias("tags"),
                    F.size("tags").alias("n_tags"))


def page_results_html_only(spark, sf_dir):
    """A9 in the page job; the content type differs from page to page."""
    kind = F.when(F.col("page_id") % 4 == 0, "application/pdf").when(F.col("page_id") % 4 == 1, "Text/HTML").when(
        F.col("page_id") % 4 == 2, "text/html").otherwise("text/html; charset=utf-8")
    classes, parsers = R.load_classes(), R.load_parsers()
    pages = C.processable(C.classify(tables.pages(spark, sf_dir, "page_id", "url", "html"), classes))
    res = X.page_results(pages.withColumn("kind", kind), B.binding_map(spark, classes, parsers), content_type="kind")
    return res.select(F.col("page_key").alias("page_id"), "uclass", "parser", "type", "seq", "value")


def page_results_latest(spark, sf_dir):
    """Results are stored per md5(url); a later put of a page replaces all of them.  All pages are put, then
    those with an even id once more, with their TAG results alone."""
    pages = tables.pages(spark, sf_dir, "page_id", "url")
    found = cut_lineage(_results(spark, sf_dir).withColumnRenamed("page_key", "page_id"))
    one = F.struct("parser", "type", "seq", "value")

    def rows(results, version):
        listed = results.groupBy("page_id").agg(F.collect_list(one).alias("results"))
        return (pages.join(listed, "page_id").select(url_key("url").alias("url_key"), "page_id", F.lit(version).alias("version"), "results"))

    path = work_dir(spark, "results")
    store.put(rows(found, 0), path, "url_key", ["version", "page_id"])
    store.put(rows(found.where("page_id % 2 = 0 and type = 'TAG'"), 1), path, "url_key", ["version", "page_id"])
    return (spark.read.parquet(path).select("page_id", "url_key", F.explode("results").alias("r"))
            .select("page_id", "url_key", "r.type", "r.seq", "r.value"))


QUERIES = {
    "page_results_html_only": page_results_html_only,
    "page_results_latest": page_results_latest,
    "class_parser_binding": class_parser_binding,
    "class_parser_binding_untyped": class_parser_binding_untyped,
    "extract_titles": extract_titles,
    "extract_links": extract_links,
    "extract_ad_text": extract_ad_text,
    "extract_regex": extract_regex,
    "extract_value": extract_value,
    "extract_chain": extract_chain,
    "page_results": page_results,
    "page_tags": page_tags,
}
