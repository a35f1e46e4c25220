"""Structured Streaming forms of the batch jobs.

* S1 ``classify_parse_stream``: pages arrive as a file stream; each
  micro-batch runs the batch classification + extraction plan in
  ``foreachBatch`` (the XPath joins are batch joins inside the micro-batch)
  and appends its results, keyed by batch id so a replayed batch overwrites
  its own output (exactly-once at the sink).
* S2 ``ingest_dedup_stream``: bodies hashed and deduplicated by streaming state in RocksDB
  for as long as a copy is likely to follow (``keep`` after its arrival, so no body is ever
  late), and exactly by an anti-join of each micro-batch with the stored hashes of its
  buckets.  The state holds the hashes of that time and not those of all time.
* S3 ``cache_upsert_stream``: each micro-batch is put into a keyed store (``operators.store``):
  only the buckets it touches are rewritten, readers scan one version per key.

* S4 ``cookie_state_stream``: each micro-batch advances the cookie state
  (``operators.cookies.advance``) of the jar buckets it touches; only these are read and
  written, as folders of the batch's number, so a replayed batch starts from the same state.
  Batches must arrive in event order.

Checkpoints and outputs live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import binding as B
from webloom.operators import cache as CA
from webloom.operators import classify as C
from webloom.operators import cookies as CK
from webloom.operators import extract as X
from webloom.operators import store
from webloom.functions import tags as TG
from webloom.session import cut_lineage, work_dir  # noqa: F401


BATCH_BYTES = 1 << 30


def file_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The files of a table, which is one Parquet file or a folder of them, in micro-batches of
    about ``BATCH_BYTES``."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet")).schema
    # As a pattern the path may name a file or a folder; a plain one must be a folder.
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES)
            .parquet(os.path.join(sf_dir, f"{table}.parque[t]")))


def classify_parse_stream(spark: SparkSession, pages: DataFrame, classes, parsers, out: str, ckpt: str):
    bind = B.binding_map(spark, classes, parsers)

    def run(batch: DataFrame, batch_id: int):
        cl = C.processable(C.classify(batch.select("page_id", "url", "html"), classes))
        res = X.page_results(cl, bind)
        (res.select(F.col("page_key").alias("page_id"), "uclass", "parser", "type", "seq", "value")
         .write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}")))

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB (a stream copies the settings as it starts)."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def ingest_dedup_stream(docs: DataFrame, body_col: str, out: str, ckpt: str, keep: str = "1 hour"):
    """Appends (id_hash, body_chars) of each body that ``out`` does not hold yet."""
    bodies = docs.select(TG.id_hash(F.col(body_col)).alias("id_hash"), F.length(body_col).alias("body_chars"),
                         F.current_timestamp().alias("arrived"))
    recent = bodies.withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["id_hash"])

    def run(batch: DataFrame, batch_id: int):
        store.add(batch.select("id_hash", "body_chars"), out, "id_hash", batch_id)

    with rocksdb_state(docs.sparkSession):
        return recent.writeStream.foreachBatch(run).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


def cache_upsert_stream(versions: DataFrame, out: str, ckpt: str, tie_col: str = "version"):
    def run(batch: DataFrame, batch_id: int):
        rows = batch.withColumn("url_key", CA.url_key())
        store.put(rows, out, "url_key", ["fetched_at", tie_col])

    return versions.writeStream.foreachBatch(run).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


def cookie_state_stream(events: DataFrame, prepare, out: str, ckpt: str):
    """prepare: a batch of raw events -> (entries, requests).  Ended versions go to
    ``out/ended``, the touched buckets of the state after batch n to ``out/state`` as number n."""
    def run(batch: DataFrame, batch_id: int):
        ents, reqs = (cut_lineage(rows) for rows in prepare(batch))
        before = None
        if batch_id:
            before = CK.load_state(batch.sparkSession, f"{out}/state", batch_id, CK.touched_buckets(ents, reqs))
        ended, state = CK.advance(ents, reqs, before)
        ended.write.mode("overwrite").parquet(f"{out}/ended/batch={batch_id}")
        CK.save_state(state, f"{out}/state", batch_id)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
