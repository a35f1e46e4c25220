"""A training-data pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame that is written as Parquet and read again for the
next.  All but the last return the columns of documents.

1. quality: documents that the classifier of operator 10 rejects (score below 0.3) go.
2. near duplicates: of each group that operator 3 links (five-word shingles, Jaccard
   0.8 or more) the document with the smallest doc_id stays; of repeated rows one.
3. decontamination: documents with a benchmark passage (operator 7) go.
4. secrets: live credentials (operator 1) are replaced by ``[secret]`` in place.
5. packing: what is left is packed by operator 4; one row per piece.

Rows with a null doc_id pass stage 2 untouched and are judged by their text in the others.
SQL cannot express the stages, so there is no ORACLE_SQL; tests/llm compares
them with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontam, jaccard, packing, quality, secrets
from webloom.llm.common import cut, fresh, read, scratch_dir, sized, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), threshold=0.3)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    group = jaccard.jaccard_components(docs, k=5, num=80, den=100).where("doc_id is not null")
    ids = group.groupBy("doc_id").agg(F.max(F.expr("doc_id = component_id")).alias("first"), F.count("*").alias("n"))
    ids = cut(ids.where("not first or n > 1"))
    # Texts move only where these ids are too many to broadcast.
    gone = sized(ids.where("not first").select(F.col("doc_id").alias("gone")))
    again = sized(ids.where("first and n > 1").select(F.col("doc_id").alias("again")))
    key = docs["doc_id"].cast("long")
    kept = docs.join(gone, key == gone["gone"], "left_anti")
    text = fresh(docs, "text_hash")
    key = kept["doc_id"].cast("long")
    one = (kept.join(again, key == again["again"], "left_semi").withColumn(text, F.xxhash64("text"))
           .dropDuplicates(["doc_id", text]).drop(text))
    return kept.join(again, key == again["again"], "left_anti").unionByName(one)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(TOKENIZER), length=2048, end_id=1)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", blank_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the
    folder that the cluster shares."""
    docs = read(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
