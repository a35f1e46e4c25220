"""Content store and tag store as tables.

The reference keeps bodies under ``content/<sha256>`` and comma-joined tags
under ``metadata/<sha256>`` in a key-value store.  Here both are DataFrames
keyed by ``id_hash``: the store operations become aggregations and semi/anti
joins keyed on the hash, which hash-partition cleanly.  Hashes are returned
bare (no ``content/`` or ``metadata/`` prefix) everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import tags as TG


def with_id_hash(df: DataFrame, body_col: str = "body", out: str = "id_hash") -> DataFrame:
    """F1 as a stage."""
    return df.withColumn(out, TG.id_hash(F.col(body_col)))


def ingest(df: DataFrame, body_col: str = "body", seq_col: str = "seq") -> DataFrame:
    """F3 ``Put`` over a batch: one row per distinct body, keyed by its hash,
    with the first ingest (lowest ``seq``, unique) and the copy count.

    Only hash and sequence are aggregated (partially on the map side, so a hash
    that holds a third of all rows is one row per task in the shuffle); the body of
    the winner comes back by :func:`bodies` where it is wanted.
    """
    h = with_id_hash(df, body_col)
    return h.groupBy("id_hash").agg(F.min(seq_col).alias("first_seq"), F.count(F.lit(1)).alias("n_copies"))


def bodies(first: DataFrame, df: DataFrame, body_col: str = "body", seq_col: str = "seq", kept: Column | None = None) -> DataFrame:
    """F5 ``Get``: the stored body of each item of :func:`ingest`, one row per item; a sequence may be
    null or repeated.  ``kept``: what is wanted of the body, if not all of it."""
    own = with_id_hash(df, body_col, "_hash").select("_hash", F.col(seq_col).alias("_seq"), (F.col(body_col) if kept is None else kept).alias("body"))
    same = first["id_hash"].eqNullSafe(own["_hash"]) & first["first_seq"].eqNullSafe(own["_seq"])
    return first.join(own, same).drop("_hash", "_seq").dropDuplicates(["id_hash"])


def source_tags(ingests: DataFrame, tag_col: str = "tag", seq_col: str = "seq",
                key: str = "id_hash") -> DataFrame:
    """each ingest appends its tag (e.g. ``source:<url>``) to the item;
    duplicates are dropped keeping first-occurrence order.

    Two steps keep hot hashes cheap: (hash, tag) -> first seq is a partial
    aggregate (bounded by distinct tags, not by copies), then the ordered
    distinct list per hash is built from those few rows.
    """
    first = ingests.groupBy(key, tag_col).agg(F.min(seq_col).alias("_seq"))
    return (first.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_seq"), F.col(tag_col)))).alias("_t"))
            .select(key, F.transform("_t", lambda x: x[tag_col]).alias("tags")))


def has(ids: DataFrame, store: DataFrame, key: str = "id_hash") -> DataFrame:
    """F5/F11 ``Has`` for many ids at once: ids with a flag."""
    present = store.select(key).distinct().withColumn("_has", F.lit(True))
    return ids.join(present, key, "left").withColumn("present", F.coalesce("_has", F.lit(False))).drop("_has")


def get(ids: DataFrame, store: DataFrame, key: str = "id_hash") -> DataFrame:
    """F5 ``Get``: the stored rows of the requested ids (inner join)."""
    return ids.join(store, key, "inner")


def put_tags(puts: DataFrame, key: str = "id_hash", seq_col: str = "seq",
             tags_col: str = "tags") -> DataFrame:
    """each put overwrites the whole set; the last put (highest seq) wins
    and is stored deduplicated, order kept.  ``max_by`` is a partial
    aggregate, so hot keys do not pile up in one task."""
    return (puts.groupBy(key)
            .agg(F.max_by(F.col(tags_col), F.col(seq_col)).alias("_t"))
            .select(key, TG.omit_duplicates(F.col("_t")).alias("tags")))


def get_tags(ids: DataFrame, tag_store: DataFrame, key: str = "id_hash") -> DataFrame:
    """tags of each id; a missing id gives an empty list."""
    return (ids.join(tag_store, key, "left")
            .withColumn("tags", F.coalesce(F.col("tags"), F.array().cast("array<string>"))))


def find_tagged(tag_store: DataFrame, key: str = "id_hash", all_of: list[str] | None = None,
                any_of: list[str] | None = None, none_of: list[str] | None = None) -> DataFrame:
    """F12 ``Find``: ids with at least one tag (a stored '' counts).  The
    ``all_of``/``any_of``/``none_of`` predicates are an extension."""
    cond = F.size("tags") > 0
    if all_of:
        cond = cond & TG.has_all(F.col("tags"), all_of)
    if any_of:
        cond = cond & TG.has_any(F.col("tags"), any_of)
    if none_of:
        cond = cond & ~TG.has_any(F.col("tags"), none_of)
    return tag_store.where(cond).select(key)
