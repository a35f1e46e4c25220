"""Extraction programs over pages.

A parser is a chain of operations over a list of strings; here the list is an
ARRAY column of the page's row and every operation a Column expression on it:

* VALUE  -> one constant if there is any value (D1)
* XPATH  -> filters on the node array (D2, ``html_nodes`` / ``xpath``)
* REGEX  -> all matches of each value, flattened (D3)
* PREFIX / SUFFIX -> ``concat`` (D4, D5)

An empty list ends the chain with no result (D6) because every operation
maps an empty list to itself; TAG results are lower-cased at the end (D7).  All
parsers bound to a page's class are columns of the same projection (D8), so a
page is tokenized once, nothing is joined or shuffled, and one generator turns
the lists into rows.  ``page_results`` adds the SOURCE row and resolves
CONTENT/NEXT/FOLLOW values against the page URL (D9, B11).

An XPATH operation that is not the first one parses its input values as
documents of their own: the values become rows, are tokenized, and are put
together again per page (``_reparse``).  Rules are validated when they are loaded
(``sources.rules``); an unsupported one raises there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import html_nodes, xpath
from webloom.operators.crawl import route_bodies
from webloom.sources.rules import Parser, regex_for_op

LINK_TYPES = ("CONTENT", "NEXT", "FOLLOW")


def _apply(op, vals: Column, nodes: Column | None) -> Column:
    """One operation on an array<string>."""
    if op.type == "VALUE":
        return F.when(F.size(vals) > 0, F.array(F.lit(op.value))).otherwise(F.array().cast("array<string>"))
    if op.type == "PREFIX":
        return F.transform(vals, lambda v: F.concat(F.lit(op.value), v))
    if op.type == "SUFFIX":
        return F.transform(vals, lambda v: F.concat(v, F.lit(op.value)))
    if op.type == "REGEX":
        p = F.lit(regex_for_op(op.value))
        return F.flatten(F.transform(vals, lambda v: F.regexp_extract_all(v, p, F.lit(0))))
    if op.type == "XPATH" and nodes is not None:
        return xpath.values(nodes, xpath.compile_xpath(op.value))
    raise ValueError(op.type)


def _chain(ops, vals: Column, nodes: Column | None) -> Column:
    for op in ops:
        vals = _apply(op, vals, nodes)
    return vals


def _finish(p: Parser, vals: Column) -> Column:
    return F.transform(vals, F.lower) if p.type == "TAG" else vals


def _xpaths(parsers) -> list:
    return [xpath.compile_xpath(p.operations[0].value) for p in parsers if p.operations[0].type == "XPATH"]


def _nested(p: Parser) -> bool:
    return any(o.type == "XPATH" for o in p.operations[1:])


def _reparse(rows: DataFrame, ops) -> DataFrame:
    """rows (page_key, vals, ...) with ``vals`` after the chain ``ops``, whose
    first operation is an XPATH: each value is a document."""
    stop = next((i for i, o in enumerate(ops[1:], 1) if o.type == "XPATH" or o.type == "VALUE"), len(ops))
    paths = xpath.compile_xpath(ops[0].value)
    one = rows.select("page_key", F.posexplode("vals").alias("at", "html"))
    done = html_nodes.with_nodes(one, *xpath.names_used(paths), drop_html=True).select(
        "page_key", "at", _chain(ops[1:stop], xpath.values(F.col("nodes"), paths), None).alias("v"))
    back = done.groupBy("page_key").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])).alias("vals"))
    rest = ops[stop:]
    while rest and rest[0].type != "XPATH":
        back, rest = back.select("page_key", _apply(rest[0], F.col("vals"), None).alias("vals")), rest[1:]
    return _reparse(back, rest) if rest else back


def _nested_values(docs: DataFrame, p: Parser) -> DataFrame:
    """docs (page_key, html) -> page_key, vals for a parser with a later XPATH."""
    cut = next(i for i, o in enumerate(p.operations) if o.type == "XPATH" and i)
    if p.operations[0].type == "XPATH":
        rows = html_nodes.with_nodes(docs, *xpath.merge_names([xpath.names_used(x) for x in _xpaths([p])]), drop_html=True)
        start = _chain(p.operations[:cut], F.lit(None), F.col("nodes"))
    else:
        rows, start = docs, _chain(p.operations[:cut], F.array("html"), None)
    out = _reparse(rows.select("page_key", start.alias("vals")), p.operations[cut:])
    return out.select("page_key", _finish(p, F.col("vals")).alias("vals"))


def _lists(pages: DataFrame, bind: dict[str, list[Parser]], key_col: str, extra: list[str], source: Column | None) -> DataFrame:
    """One row per page: page_key, uclass, extra columns and ``lists``, an
    array<struct<parser, type, vals>> of the page's results."""
    parsers, classes = {}, {}
    for c, ps in sorted(bind.items()):
        for p in ps:
            parsers[p.name] = p
            classes.setdefault(p.name, []).append(c)
    flat = [p for p in sorted(parsers.values(), key=lambda p: p.ordinal) if not _nested(p)]
    rows = pages.select(F.col(key_col).alias("page_key"), "uclass", *extra, "html")
    raw = any(p.operations[0].type != "XPATH" for p in flat)
    found = _xpaths(flat)
    if found:
        wanted = sorted({c for p in flat if p.operations[0].type == "XPATH" for c in classes[p.name]})
        rows = html_nodes.with_nodes(rows.withColumn("_wanted", F.coalesce(F.col("uclass").isin(*wanted), F.lit(False))),
                                     *xpath.merge_names([xpath.names_used(x) for x in found]), wanted_col="_wanted",
                                     drop_html=not raw)
    kind = "array<struct<parser: string, type: string, vals: array<string>>>"
    parts = [F.array(F.struct(F.lit(None).cast("string").alias("parser"), F.lit("SOURCE").alias("type"),
                              F.array(source).alias("vals"))).cast(kind)] if source is not None else []
    for p in flat:
        first = F.array("html") if p.operations[0].type != "XPATH" else F.lit(None)
        vals = _finish(p, _chain(p.operations, first, F.col("nodes") if found else None))
        bound = F.col("uclass").isin(*classes[p.name])
        parts.append(F.when(bound, F.array(F.struct(F.lit(p.name).alias("parser"), F.lit(p.type).alias("type"), vals.alias("vals")))
                            ).otherwise(F.array().cast(kind)).cast(kind))
    lists = F.concat(*parts) if parts else F.array().cast(kind)
    return rows.select("page_key", "uclass", *extra, lists.alias("lists"))


def _rows(pages: DataFrame, bind, key_col: str, extra: list[str], source: Column | None = None) -> DataFrame:
    """Long rows page_key, uclass, extra, parser, type, seq, value."""
    out = (_lists(pages, bind, key_col, extra, source).select("page_key", "uclass", *extra, F.explode("lists").alias("l"))
           .select("page_key", "uclass", *extra, "l.parser", "l.type", F.posexplode("l.vals").alias("seq", "value")))
    later = {p.name: p for ps in bind.values() for p in ps if _nested(p)}
    for name, p in sorted(later.items()):
        own = pages.where(F.col("uclass").isin(*[c for c, ps in bind.items() if any(q.name == name for q in ps)]))
        docs = own.select(F.col(key_col).alias("page_key"), "uclass", *extra, "html")
        vals = _nested_values(docs.select("page_key", "html"), p).where(F.size("vals") > 0)
        out = out.unionByName(docs.drop("html").join(vals, "page_key").select(
            "page_key", "uclass", *extra, F.lit(p.name).alias("parser"), F.lit(p.type).alias("type"),
            F.posexplode("vals").alias("seq", "value")))
    return out


def run_parsers(pages: DataFrame, bind: dict[str, list[Parser]], key_col: str = "page_id") -> DataFrame:
    """Results of every bound parser on every page of its classes.

    ``pages`` needs (key_col, uclass, html); returns long rows
    (page_key, uclass, parser, type, seq, value) with TAG values lower-cased.
    """
    return _rows(pages, bind, key_col, [])


def page_results(pages: DataFrame, bind: dict[str, list[Parser]], key_col: str = "page_id",
                 url_col: str = "url", content_type: str | None = None) -> DataFrame:
    """Per processable page a SOURCE row with the page URL, then the
    results of each bound parser; CONTENT/NEXT/FOLLOW values resolved
    against the page URL (unparsable values kept as they are).  A page whose
    class binds no parser still gets its SOURCE row.  With a ``content_type`` column only
    ``text/html`` bodies are parsed (A9)."""
    if content_type:
        pages = route_bodies(pages, content_type).where("route = 'parse'").drop("route")
    base = U.with_url_string(pages, url_col, "_src").withColumnRenamed(url_col, "_base")
    rows = _rows(base, bind, key_col, ["_base", "_src"], F.col("_src"))
    link = F.when(F.col("type").isin(*LINK_TYPES), F.col("value"))
    rows = U.with_resolved(rows.withColumn("_ref", link), "_base", "_ref", "_resolved")
    return rows.select("page_key", "uclass", "parser", "type", "seq",
                       F.when(F.col("type").isin(*LINK_TYPES), F.col("_resolved")).otherwise(F.col("value")).alias("value"))


def page_tags(results: DataFrame) -> DataFrame:
    """All TAG values of a page, sorted and distinct.  Distinct first
    (partial aggregate), then the per-page list."""
    t = results.where(F.col("type") == "TAG").select("page_key", "value").distinct()
    return t.groupBy("page_key").agg(F.array_sort(F.collect_list("value")).alias("tags"))


def apply_parsers(docs: DataFrame, parsers: list[Parser], key_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Some parsers over every document of ``docs`` (no class binding): long
    rows (page_key, parser, type, seq, value); TAG values lower-cased."""
    all_pages = docs.select(key_col, F.lit("").alias("uclass"), F.col(html_col).alias("html"))
    return run_parsers(all_pages, {"": parsers}, key_col).drop("uclass")


def apply_parser(docs: DataFrame, p: Parser, key_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return apply_parsers(docs, [p], key_col, html_col)
