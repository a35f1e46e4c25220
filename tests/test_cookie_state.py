"""The cookie state between batches: only touched buckets are written, the newest of each counts."""

import os

from webloom.operators import cookies


def tables(spark, jars, value):
    df = spark.createDataFrame([(j, f"k{j}", value) for j in jars], "jar_id long, jar_key string, value int")
    return {"cookies": df, "reads": df.withColumnRenamed("value", "read")}


def test_state_of_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "state")
    cookies.save_state(tables(spark, range(300), 0), path, 0)
    mine = tables(spark, [7], 1)["cookies"]
    touched = cookies.touched_buckets(mine, mine)
    assert len(touched) == 1
    held = cookies.load_state(spark, path, 1, touched)["cookies"]
    inside = {r["jar_id"] for r in held.collect()}
    assert 7 in inside and len(inside) < 30
    for _ in range(2):  # the second time is a replay
        held = cookies.load_state(spark, path, 1, touched)["cookies"]
        assert {r["value"] for r in held.collect()} == {0}
        cookies.save_state(tables(spark, sorted(inside), 1), path, 1)
    folders = [f for f in os.listdir(f"{path}/cookies/batch=1") if f.startswith("bucket=")]
    assert folders == [f"bucket={touched[0]}"]
    now = {r["jar_id"]: r["value"] for r in cookies.load_state(spark, path)["cookies"].collect()}
    assert now == {j: int(j in inside) for j in range(300)}
    cookies.save_state(tables(spark, [], 2), path, 2)
    assert cookies.load_state(spark, path)["reads"].count() == 300


def test_empty_state(spark, tmp_path):
    path = str(tmp_path / "state")
    cookies.save_state(tables(spark, [], 0), path)
    state = cookies.load_state(spark, path)
    assert state["cookies"].columns == ["jar_id", "jar_key", "value"] and state["cookies"].count() == 0
