"""Keyed tables that are rewritten in part.

A table is Parquet, partitioned by a hash bucket of its key.  An update reads the
buckets that it touches, keeps the last row of each key, and overwrites only those
buckets (dynamic partition overwrite); readers scan one row per key.  An update that is
run again changes nothing.  Tables whose first row of a key stays are only added to
(``add``): a numbered part for each update, without the keys that earlier parts hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from webloom.operators.cache import latest
from webloom.session import cut_lineage

BUCKETS = 64
BUCKET, PART = "bucket", "part"


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a store, one per key; None if nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _with_bucket(rows: DataFrame, key: str, buckets: int) -> tuple[DataFrame, list[int]]:
    """The rows with their bucket, and the buckets that occur (at most ``buckets`` numbers)."""
    rows = cut_lineage(rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    return rows, [r[0] for r in rows.select(BUCKET).distinct().collect()]


def add(rows: DataFrame, path: str, key: str, part: int, buckets: int = BUCKETS) -> None:
    """Write the rows (one per key; a null is a key) whose key no earlier part holds as
    part ``part``.  Only the keys of the touched buckets are read."""
    new, touched = _with_bucket(rows, key, buckets)
    old = read(rows.sparkSession, path)
    if old is not None and PART in old.columns:
        held = old.where((F.col(PART) < part) & F.col(BUCKET).isin(touched)).select(F.col(key).alias("held"))
        new = new.join(held, new[key].eqNullSafe(held["held"]), "left_anti")
    new.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/{PART}={part}")


def put(updates: DataFrame, path: str, key: str, order: list[str], buckets: int = BUCKETS) -> int:
    """Write rows over those of their keys; among rows of one key the last by ``order``
    stays.  Returns the number of buckets rewritten."""
    spark = updates.sparkSession
    new, touched = _with_bucket(latest(updates, key, order), key, buckets)
    if not touched:
        return 0
    old = read(spark, path)
    if old is not None:
        both = old.where(F.col(BUCKET).isin(touched)).unionByName(new)
        new = cut_lineage(latest(both, key, order))  # read in full before its buckets are overwritten
    (new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).parquet(path))
    return len(touched)
