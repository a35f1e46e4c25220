"""Content-id and tag-list Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_hash(body: Column) -> Column:
    """lower-case hex SHA-256 of the bytes (strings hash as UTF-8)."""
    return F.sha2(body, 256)


def id_color(h: Column) -> Column:
    """'#' + first 3 bytes in lower-case hex; not hex (or under 3 bytes)
    -> ''."""
    ok = h.rlike("^([0-9a-fA-F]{2})+$") & (F.length(h) >= 6)
    return F.when(ok, F.concat(F.lit("#"), F.lower(F.substring(h, 1, 6)))).otherwise(F.lit(""))


def tags_from_string(s: Column) -> Column:
    """split on ',', sort bytewise, drop duplicates; no trimming; '' gives
    one empty tag."""
    return F.array_distinct(F.array_sort(F.split(s, ",", -1)))


def omit_duplicates(tags: Column) -> Column:
    """keep the first of each, order kept."""
    return F.array_distinct(tags)


def tags_to_string(tags: Column) -> Column:
    """F8: dedup then join with ','."""
    return F.array_join(F.array_distinct(tags), ",")


def stored_tags(blob: Column) -> Column:
    """F10 read side: the stored comma-joined string, split and deduplicated
    (not sorted)."""
    return F.array_distinct(F.split(blob, ",", -1))


def has_all(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), tags)) == 0


def has_any(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted]))
