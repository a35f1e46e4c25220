"""Registered streaming queries: each runs its stream to completion
(``availableNow``) over the input table and reads the sink back, so the
result can be checked against the batch twin's oracle."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from webloom.operators import cookies as CK
from webloom.operators import store
from webloom.plans import cookies_q
from webloom.sources import rules as R
from webloom.sources import tables
from webloom.streaming import jobs as S


def stream_classify_parse(spark, sf_dir):
    base = S.work_dir(spark, "s1")
    q = S.classify_parse_stream(spark, S.file_stream(spark, sf_dir, "pages"), R.load_classes(), R.load_parsers(),
                                os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out")).drop("batch")


def stream_content_dedup(spark, sf_dir):
    base = S.work_dir(spark, "s2")
    q = S.ingest_dedup_stream(S.file_stream(spark, sf_dir, "documents"), "text",
                              os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    kept = store.read(spark, os.path.join(base, "out"))
    if kept is None:
        return spark.createDataFrame([], "id_hash string, body_chars int")
    return kept.select("id_hash", "body_chars")


def stream_page_cache(spark, sf_dir):
    from webloom.plans import crawl_q
    base = S.work_dir(spark, "s3")
    stream = S.file_stream(spark, sf_dir, "pages")
    versions = crawl_q._versions_of(stream)
    q = S.cache_upsert_stream(versions, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out")).select("url_key", "url", "version", "fetched_at", F.length("body").alias("body_chars"))


STATE_SLICES, SLICE_ROWS = 3, 50_000_000


def stream_cookie_versions(spark, sf_dir):
    """The events arrive in slices of time: a folder and a micro-batch each, on one checkpoint."""
    base = S.work_dir(spark, "s4")
    raw = tables.events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slices = max(STATE_SLICES, raw.count() // SLICE_ROWS)
    marks = raw.agg(F.percentile_approx(micros, [i / slices for i in range(1, slices)])).first()[0]
    part = sum((F.when(micros >= m, 1).otherwise(0) for m in marks or []), F.lit(0))
    for i in range(slices):
        raw.where(part == i).write.parquet(f"{base}/in/slice={i}")
        stream = spark.readStream.schema(raw.schema).parquet(f"{base}/in/slice=*")
        S.cookie_state_stream(stream, cookies_q.prepared, f"{base}/out", f"{base}/ckpt").awaitTermination()
    ended = spark.read.parquet(f"{base}/out/ended").drop("batch")
    now = CK.open_versions(CK.load_state(spark, f"{base}/out/state"))
    return ended.unionByName(now).select(*cookies_q.VERSION_COLUMNS)


QUERIES = {
    "stream_classify_parse": stream_classify_parse,
    "stream_content_dedup": stream_content_dedup,
    "stream_page_cache": stream_page_cache,
    "stream_cookie_versions": stream_cookie_versions,
}
