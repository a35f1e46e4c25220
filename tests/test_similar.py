"""Signatures and the band join against brute force (property test)."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import signatures as S
from webloom.operators import similar as SIM


def test_tag_round_trip(spark):
    df = spark.createDataFrame([(1, -1), (2, 0x0123456789abcdef), (3, -(1 << 63))], "id long, sig long")
    t = df.select("id", "sig", S.add_signature_tag(F.array(F.lit("a:b")), F.col("sig")).alias("tags"))
    back = {r.id: r.sig for r in SIM.signature_table(t).collect()}
    assert back == {1: -1, 2: 0x0123456789abcdef, 3: -(1 << 63)}
    assert t.where("id = 1").select(F.get("tags", 1)).first()[0] == "phash:p:ffffffffffffffff"
    other = spark.createDataFrame([(1, ["phash:a:00ff"]), (2, ["x"])], "id long, tags array<string>")
    assert SIM.signature_table(other).count() == 0


@pytest.mark.parametrize("max_dist", [0, 3, 10, 22, 40])
def test_band_join_equals_brute_force(spark, max_dist):
    rnd = random.Random(max_dist)
    base = [rnd.getrandbits(64) for _ in range(40)]
    sigs = []
    for i, b in enumerate(base):
        sigs.append((i, b))
        flip = b
        for bit in rnd.sample(range(64), rnd.randint(0, 24)):
            flip ^= 1 << bit
        sigs.append((1000 + i, flip))
    sigs.append((5000, base[0]))  # duplicate signature
    to_signed = [(i, s - (1 << 64) if s >= 1 << 63 else s) for i, s in sigs]
    df = spark.createDataFrame(to_signed, "id long, sig long")
    got = {(r.id_a, r.id_b): r.dist for r in SIM.similar_pairs(df, max_dist).collect()}
    want = {}
    for i, (a, sa) in enumerate(sigs):
        for b, sb in sigs[i + 1:]:
            d = bin(sa ^ sb).count("1")
            if d <= max_dist:
                want[(min(a, b), max(a, b))] = float(d)
    assert got == want


def test_bands_are_selective(spark):
    rnd = random.Random(1)
    n = 10_000
    df = spark.createDataFrame([(rnd.getrandbits(64) - (1 << 63),) for _ in range(n)], "sig long")
    met = SIM.candidates(df, df, *SIM.plan_bands(10)).count()
    assert met < 0.02 * n * n
    assert SIM.plan_bands(0) == (1, 0) and SIM.plan_bands(40) is None


@pytest.mark.parametrize("block", [1000, 3])
def test_hot_signature_and_many_targets(spark, monkeypatch, block):
    monkeypatch.setattr(SIM, "ID_BLOCK", block)
    df = spark.createDataFrame([(i, 5) for i in range(20)] + [(50, 4), (60, 1 << 40)], "id long, sig long")
    got = {(r.id_a, r.id_b): r.dist for r in SIM.similar_pairs(df, 1).collect()}
    want = {(i, j): 0.0 for i in range(20) for j in range(i + 1, 20)} | {(i, 50): 1.0 for i in range(20)}
    assert got == want and SIM.similar_pairs(df, 1).count() == len(want)
    few = sorted(map(tuple, SIM.similar_to(df, df.where("id >= 50"), 1).collect()))
    monkeypatch.setattr(SIM, "LITERAL_TARGETS", 0)
    assert sorted(map(tuple, SIM.similar_to(df, df.where("id >= 50"), 1).collect())) == few == [(50, i, 1.0) for i in range(20)]


def test_probe_rows_are_not_broadcast(spark):
    """548 probe rows of a signature are in no statistics; a broadcast of them passes through the driver."""
    sigs = spark.createDataFrame([(i,) for i in range(50)], "sig long")
    plan = spark._jvm.PythonSQLUtils.explainString(SIM.candidates(sigs, sigs, 4, 2)._jdf.queryExecution(), "simple")
    assert "SortMergeJoin [band" in plan and "Broadcast" not in plan
