"""Deduplicated ingest: exact over all batches, with state of recent hashes only."""

import hashlib

from webloom.operators import store
from webloom.streaming import jobs


def digest(text):
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


def test_ingest_is_exact_and_its_state_bounded(spark, tmp_path):
    batches = []
    for i in range(6):
        texts = [f"body {i} {j}" for j in range(100)] + [f"body 0 {j}" for j in range(50)] + [None, "", f"body {i} 7"]
        batches.append(texts)
    out, ckpt, files = str(tmp_path / "out"), str(tmp_path / "ckpt"), str(tmp_path / "in")
    rows_kept = []
    for i, texts in enumerate(batches):  # each start takes up where the last one ended
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(files)
        q = jobs.ingest_dedup_stream(spark.readStream.schema("text string").parquet(files), "text", out, ckpt, keep="0 seconds")
        q.awaitTermination()
        assert q.exception() is None
        state = q.recentProgress[-1]["stateOperators"][0]
        assert any("rocksdb" in name for name in state["customMetrics"])
        rows_kept.append(state["numRowsTotal"])
    got = sorted((r["id_hash"] or "", r["body_chars"]) for r in store.read(spark, out).collect() if r["body_chars"] is not None)
    want = {t for texts in batches for t in texts if t is not None}
    assert got == sorted((digest(t), len(t)) for t in want)
    assert sum(r["id_hash"] is None for r in store.read(spark, out).collect()) == 1
    assert max(rows_kept) <= 320 and len(got) > 600
    assert spark.conf.get(jobs.PROVIDER, None) != jobs.ROCKSDB


def test_a_part_that_is_written_again_stays_the_same(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, v int")
    second = spark.createDataFrame([("b", 2), ("c", 2), (None, 2)], "k string, v int")
    for _ in range(2):
        store.add(first, path, "k", 0)
        store.add(second, path, "k", 1)
        store.add(first.limit(0), path, "k", 2)
    got = {r["k"]: r["v"] for r in store.read(spark, path).collect()}
    assert got == {"a": 1, "b": 1, None: 1, "c": 2} and store.read(spark, path).count() == 4
