"""Registry of the named queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.plans import (content_q, cookies_q, crawl_q, extract_q, oracle_content, oracle_cookies, oracle_crawl,
                           oracle_extract, oracle_similar, oracle_urls, similar_q, stream_q, urls_q)

_MODULES = [urls_q, content_q, extract_q, similar_q, crawl_q, cookies_q, stream_q]
_ORACLES = [oracle_urls, oracle_content, oracle_extract, oracle_similar, oracle_crawl, oracle_cookies]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _ORACLES:
        out.update(m.ORACLE)
    return out
