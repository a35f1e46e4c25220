"""Registered similarity queries over ``embeddings`` (FIXTURES 2.6): each
vector's sign bits give a 64-bit signature stored as a ``phash:p:<hex>`` tag;
a perturbed copy per vector (id + 100000, signature XOR ((1 << vec_id % 12) - 1))
gives pairs at every distance from 0 to 11."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import signatures as S
from webloom.operators import similar as SIM
from webloom.sources import tables

PAIRS_MAX_DIST = 10
TARGET_ID = 0
TARGET_MAX_DIST = 22


def tagged_items(spark, sf_dir):
    e = tables.embeddings(spark, sf_dir).select("vec_id", S.sign_bits(F.col("embedding")).alias("sig"))
    orig = e.select(F.col("vec_id").alias("id"), "sig")
    copy = e.select((F.col("vec_id") + 100000).alias("id"),
                    F.col("sig").bitwiseXOR(F.expr("shiftleft(CAST(1 AS BIGINT), CAST(vec_id % 12 AS INT)) - 1"))
                    .alias("sig"))
    items = orig.unionByName(copy)
    # The signature tag joins the item's other tags
    return items.select("id", S.add_signature_tag(F.array(F.lit("kind:vector")), F.col("sig")).alias("tags"))


def signatures(spark, sf_dir):
    return SIM.signature_table(tagged_items(spark, sf_dir))


def signature_of_embedding(spark, sf_dir):
    return signatures(spark, sf_dir).select("id", "sig", S.signature_tag(F.col("sig")).alias("tag"))


def similar_pairs(spark, sf_dir):
    return SIM.similar_pairs(signatures(spark, sf_dir), PAIRS_MAX_DIST)


def similar_to_target(spark, sf_dir):
    sigs = signatures(spark, sf_dir)
    return SIM.similar_to(sigs, sigs.where(F.col("id") == TARGET_ID), TARGET_MAX_DIST)


QUERIES = {
    "signature_of_embedding": signature_of_embedding,
    "similar_pairs": similar_pairs,
    "similar_to_target": similar_to_target,
}
