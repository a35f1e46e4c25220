"""Registered queries over ``documents``/``labels``/``benchmark``: content ids,
dedup and tag stores (SURVEY 7.4, FIXTURES 2.5).

Body = ``text``; each document is one ingest with sequence ``doc_id`` and
source tag ``source:<source>``; labelled documents put ``quality:``/``toxic:``
tag sets onto their hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import tags as TG
from webloom.operators import content as CT
from webloom.sources import tables


def _ingests(spark, sf_dir) -> DataFrame:
    d = tables.documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    return CT.with_id_hash(d, "text")


def content_store(spark, sf_dir) -> DataFrame:
    d = tables.documents(spark, sf_dir, "doc_id", "text").withColumnRenamed("doc_id", "seq")
    return CT.ingest(d, body_col="text", seq_col="seq")


def content_ids(spark, sf_dir):
    return _ingests(spark, sf_dir).select("doc_id", "id_hash")


def id_color(spark, sf_dir):
    return content_store(spark, sf_dir).select("id_hash", TG.id_color(F.col("id_hash")).alias("color"))


def content_dedup(spark, sf_dir):
    docs = tables.documents(spark, sf_dir, "doc_id", "text")
    stored = CT.bodies(content_store(spark, sf_dir), docs, "text", "doc_id", F.length("text"))
    return stored.select("id_hash", F.col("first_seq").alias("first_doc_id"), "n_copies", F.col("body").alias("body_chars"))


def content_lookup(spark, sf_dir):
    store = content_store(spark, sf_dir).select("id_hash", "first_seq")
    probes = (tables.table(spark, sf_dir, "benchmark", "item_id", "text")
              .select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("probe_id"),
                      TG.id_hash(F.col("text")).alias("id_hash"))
              .unionByName(tables.documents(spark, sf_dir, "doc_id", "text")
                           .select(F.lit("document").alias("kind"), F.col("doc_id").alias("probe_id"),
                                   TG.id_hash(F.col("text")).alias("id_hash"))))
    found = probes.join(store, "id_hash", "left")
    return found.select("kind", "probe_id", "id_hash", F.col("first_seq").isNotNull().alias("present"),
                        F.col("first_seq").alias("first_doc_id"))


def source_tags(spark, sf_dir):
    ing = _ingests(spark, sf_dir).select(
        "id_hash", F.col("doc_id").alias("seq"), F.concat(F.lit("source:"), "source").alias("tag"))
    t = CT.source_tags(ing)
    return t.select("id_hash", TG.tags_to_string(F.col("tags")).alias("tags"), F.size("tags").alias("n_tags"))


def tags_parse(spark, sf_dir):
    d = tables.documents(spark, sf_dir, "doc_id", "lang", "source")
    raw = F.concat(F.lit("source:"), F.col("source"), F.lit(",lang:"), F.col("lang"),
                   F.lit(",source:"), F.col("source"))
    parsed = TG.tags_from_string(raw)
    return d.select("doc_id", TG.tags_to_string(parsed).alias("tags"), F.size(parsed).alias("n_tags"))


def tags_string(spark, sf_dir):
    ing = _ingests(spark, sf_dir)
    both = ing.select("id_hash", F.explode(F.array(
        F.struct((F.col("doc_id") * 2).alias("seq"), F.concat(F.lit("source:"), "source").alias("tag")),
        F.struct((F.col("doc_id") * 2 + 1).alias("seq"), F.concat(F.lit("lang:"), "lang").alias("tag")))).alias("e"))
    t = CT.source_tags(both.select("id_hash", "e.seq", "e.tag"))
    return t.select("id_hash", TG.tags_to_string(F.col("tags")).alias("tags"), F.size("tags").alias("n_tags"))


def tag_store(spark, sf_dir) -> DataFrame:
    lab = tables.labels(spark, sf_dir)
    docs = _ingests(spark, sf_dir).select("doc_id", "id_hash")
    puts = (docs.join(lab, "doc_id", "inner")
            .select("id_hash", F.col("doc_id").alias("seq"),
                    F.array(F.concat(F.lit("quality:"), F.col("quality").cast("string")),
                            F.concat(F.lit("toxic:"), F.col("toxic").cast("string"))).alias("tags")))
    return CT.put_tags(puts)


def tag_put_get(spark, sf_dir):
    ids = content_store(spark, sf_dir).select("id_hash")
    got = CT.get_tags(ids, tag_store(spark, sf_dir))
    return got.select("id_hash", TG.tags_to_string(F.col("tags")).alias("tags"), F.size("tags").alias("n_tags"))


def tags_has(spark, sf_dir):
    return CT.has(content_store(spark, sf_dir).select("id_hash"), tag_store(spark, sf_dir))


def find_tagged(spark, sf_dir):
    return CT.find_tagged(tag_store(spark, sf_dir))


def find_tagged_quality(spark, sf_dir):
    return CT.find_tagged(tag_store(spark, sf_dir), any_of=["quality:1"], none_of=["toxic:1"])


QUERIES = {
    "content_ids": content_ids,
    "id_color": id_color,
    "content_dedup": content_dedup,
    "content_lookup": content_lookup,
    "source_tags": source_tags,
    "tags_parse": tags_parse,
    "tags_string": tags_string,
    "tag_put_get": tag_put_get,
    "tags_has": tags_has,
    "find_tagged": find_tagged,
    "find_tagged_quality": find_tagged_quality,
}
