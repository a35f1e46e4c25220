"""Page cache and result store as tables.

The reference keys both by ``md5(url)``; here that key is a column.  "Last
write wins" is a narrow ``max`` aggregate (partial on the map side, so a URL
fetched millions of times costs one row per task before the shuffle) and a
semi-join; lookups are semi/anti joins on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def url_key(url_col: str = "url"):
    return F.md5(F.col(url_col))


def latest(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version per key by ``order`` (ties broken by the
    later columns of ``order``).

    Only key and order columns are aggregated (partially on the map side); the
    rows of the winners come back by a semi-join, so bodies are neither
    sorted nor carried where they are not read.  A null order value is the lowest, a null
    key a key of its own; of versions with equal (key, order) one stays.
    """
    best = versions.groupBy(key).agg(F.max(F.struct(*order)).alias("_o")).select(
        F.col(key).alias("_key"), *(F.col("_o")[c].alias(f"_o_{c}") for c in order))
    same = versions[key].eqNullSafe(best["_key"])
    for c in order:
        same = same & versions[c].eqNullSafe(best[f"_o_{c}"])
    return versions.join(best, same, "left_semi").dropDuplicates([key])


def cache_upsert(versions: DataFrame, url_col: str = "url", ts_col: str = "fetched_at",
                 tie_col: str = "version") -> DataFrame:
    """A4: last response per md5(url) wins; method ignored, no expiry."""
    return latest(versions.withColumn("url_key", url_key(url_col)), "url_key", [ts_col, tie_col])


def cache_hits(requests: DataFrame, cache: DataFrame, url_col: str = "url") -> DataFrame:
    """A5: requests answered from the cache."""
    return requests.withColumn("url_key", url_key(url_col)).join(cache.select("url_key"), "url_key", "left_semi")


def cache_misses(requests: DataFrame, cache: DataFrame, url_col: str = "url") -> DataFrame:
    """A5: requests that still need a fetch."""
    return requests.withColumn("url_key", url_key(url_col)).join(cache.select("url_key"), "url_key", "left_anti")
