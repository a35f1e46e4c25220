"""Similarity by Hamming distance of 64-bit signatures.

G7 (all pairs within ``max_dist``) is an exact multi-index hashing join
(Norouzi, Punjani, Fleet, "Fast search in Hamming space with multi-index
hashing", CVPR 2012): split the 64 bits into ``m`` bands; if two signatures
differ in at most ``d`` bits, some band differs in at most ``r = d // m`` bits
(pigeonhole).  One side emits, per band, every value within ``r`` bits of its
own (a literal mask array, ``explode``), the other its exact band values; an
equi-join on (band, value) yields candidates that are verified with the full
distance.  A pair is kept only from the *first* band that qualifies it, so no
dedup shuffle is needed.

``plan_bands`` picks the bands by expected work per signature: candidates
(``n * m * V / 2**w`` for n signatures, V variants of w-bit bands) plus the rows
emitted (``m * V``).  Where no index beats comparing everything (``n``
candidates), as for radii near half the bits, blocks of signatures are compared
pairwise in tasks of bounded size.

Identical signatures are one row in the join.  ``signature_pairs`` returns pairs
of signatures, to be read with the membership table (id, sig); ``similar_pairs``
expands them to ids, the ids of a hot signature in blocks of ``ID_BLOCK``.
A few targets (``similar_to``) are a filter over one scan, without a join.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import signatures as S

TYPICAL_SIGNATURES = 1_000_000  # for the cost formula alone
SIG_BLOCK, ID_BLOCK = 4096, 1000
LITERAL_TARGETS = 64


def _masks(width: int, r: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(r + 1) for bits in combinations(range(width), k)]


def band_cost(bands: int, max_dist: int, n: int = TYPICAL_SIGNATURES) -> tuple[float, int]:
    """(candidates per signature, rows emitted per signature)."""
    width, r = 64 // bands, max_dist // bands
    variants = sum(comb(width, k) for k in range(min(r, width) + 1))
    return n * bands * variants / 2 ** width, bands * variants


def plan_bands(max_dist: int, n: int = TYPICAL_SIGNATURES) -> tuple[int, int] | None:
    """(bands, r) with the least expected work; None if comparing all is less."""
    cost, m = min((sum(band_cost(m, max_dist, n)), m) for m in (1, 2, 4, 8, 16, 32, 64))
    return None if cost >= n else (m, max_dist // m)


def signature_table(items: DataFrame, id_col: str = "id", tags_col: str = "tags") -> DataFrame:
    """(id, sig) for items whose tags hold a readable ``phash:`` tag;
    items without one are skipped."""
    return (items.select(F.col(id_col).alias("id"), S.from_tags(F.col(tags_col)).alias("sig"))
            .where(F.col("sig").isNotNull()))


def candidates(left: DataFrame, right: DataFrame, bands: int, r: int) -> DataFrame:
    """(sig_a, sig_b, band) of signatures that meet in a band."""
    def bits(i, sig="sig"):
        return S.band(F.col(sig), i, bands) if bands > 1 else F.col(sig)

    exact = right.select(F.col("sig").alias("sig_b"), F.posexplode(F.array(*map(bits, range(bands)))).alias("band", "bits"))
    probe = left.select(F.col("sig").alias("sig_a"), F.posexplode(F.array(*map(bits, range(bands)))).alias("band", "own"))
    if r:
        probe = probe.withColumn("_mask", F.explode(F.array(*map(F.lit, _masks(64 // bands, r)))))
        probe = probe.withColumn("own", F.col("own").bitwiseXOR(F.col("_mask")))
    # Statistics do not see the rows that explode adds: without the hint the probes would be broadcast.
    return probe.select("sig_a", "band", F.col("own").alias("bits")).join(exact.hint("merge"), ["band", "bits"]).drop("bits")


def _block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(sig_a, sig_b): everything, in tasks of at most two blocks."""
    na, nb = (max(1, -(-d.count() // SIG_BLOCK)) for d in (left, right))

    def own(n):
        return F.pmod(F.xxhash64("sig"), F.lit(n))

    a = left.select(F.col("sig").alias("sig_a"), own(na).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("j"))
    b = right.select(F.col("sig").alias("sig_b"), F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("i"), own(nb).alias("j"))
    key = [F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")]
    return a.select("sig_a", *key).join(b.select("sig_b", *key), ["i", "j"]).drop("i", "j")


def band_join(left: DataFrame, right: DataFrame, max_dist: int, n: int = TYPICAL_SIGNATURES) -> DataFrame:
    """(sig_a from ``left``, sig_b from ``right``, dist) for every pair of
    distinct signatures within ``max_dist`` (both inputs: column ``sig``)."""
    left, right = left.select("sig").distinct(), right.select("sig").distinct()
    plan = plan_bands(max_dist, n)
    if plan is None:
        met = _block_pairs(left, right)
    else:
        bands, r = plan
        met = candidates(left, right, bands, r)
        # keep a pair only from the first band in which it differs in <= r bits
        first = F.lit(None).cast("int")
        for i in reversed(range(bands)):
            differ = F.bit_count((S.band(F.col("sig_a"), i, bands).bitwiseXOR(S.band(F.col("sig_b"), i, bands))) if bands > 1
                                 else F.col("sig_a").bitwiseXOR(F.col("sig_b")))
            first = F.when(differ <= r, F.lit(i)).otherwise(first)
        met = met.where(first == F.col("band"))
    return (met.select("sig_a", "sig_b", S.hamming(F.col("sig_a"), F.col("sig_b")).alias("dist"))
            .where(F.col("dist") <= max_dist))


def signature_pairs(sigs: DataFrame, max_dist: int) -> DataFrame:
    """G7 on signatures: (sig_a < sig_b, dist); copies of a signature are the
    rows of ``sigs`` that hold it."""
    return band_join(sigs, sigs, max_dist).where(F.col("sig_a") < F.col("sig_b"))


def similar_pairs(sigs: DataFrame, max_dist: int) -> DataFrame:
    """All id pairs (id_a < id_b) with distance <= max_dist (as DOUBLE,
    the reference's distance type)."""
    ids = sigs.select("id", "sig")
    cross_sig = (signature_pairs(sigs, max_dist).join(ids.select(F.col("id").alias("id_x"), F.col("sig").alias("sig_a")), "sig_a")
                 .join(ids.select(F.col("id").alias("id_y"), F.col("sig").alias("sig_b")), "sig_b")
                 .select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"), "dist"))
    # same signature, different ids: distance 0; the ids of a hot one in blocks
    hot = ids.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select(
        "sig", F.ceil(F.col("c") / ID_BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = ids.join(hot, "sig").withColumn("own", own).withColumn("b", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("sig", "id", "own", F.least("own", "b").alias("i"), F.greatest("own", "b").alias("j"))
    x, y = met.alias("x"), met.alias("y")
    same = (x.join(y, ["sig", "i", "j"]).where("x.id < y.id and (x.own != y.own or i = j)")
            .select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"), F.lit(0).alias("dist")))
    return cross_sig.unionByName(same).withColumn("dist", F.col("dist").cast("double"))


def similar_to(sigs: DataFrame, targets: DataFrame, max_dist: int) -> DataFrame:
    """For each target (id, sig), the other ids within ``max_dist`` and
    their distance.  Up to LITERAL_TARGETS targets are compared in one scan of
    ``sigs``; more go through the band join as the probe side."""
    few = targets.select("id", "sig").limit(LITERAL_TARGETS + 1).collect()
    if len(few) <= LITERAL_TARGETS:
        one = F.array(*[F.struct(F.lit(r["id"]).alias("target"), F.lit(r["sig"]).alias("sig_a")) for r in few])
        if not few:
            one = F.array().cast("array<struct<target: bigint, sig_a: bigint>>")
        near = F.filter(one, lambda t: (S.hamming(F.col("sig"), t["sig_a"]) <= max_dist) & (t["target"] != F.col("id")))
        hits = sigs.select("id", "sig", F.explode(near).alias("t"))
        return hits.select("t.target", "id", S.hamming(F.col("sig"), F.col("t.sig_a")).cast("double").alias("dist"))
    t = targets.select(F.col("id").alias("target"), F.col("sig").alias("sig_a"))
    pairs = band_join(targets, sigs, max_dist)
    return (pairs.join(t, "sig_a").join(sigs.select("id", F.col("sig").alias("sig_b")), "sig_b")
            .where(F.col("id") != F.col("target"))
            .select("target", "id", F.col("dist").cast("double").alias("dist")))
