"""Operator 7: benchmark decontamination (DataFrame functions only).

A document is contaminated by an item if some item-sized window of its words is
at least ``SIMILAR`` similar to the item: weighted Jaccard of the multisets of
five-word shingles, a shingle weighing ``ln(1 + items / items that have it)``.

1. *Windows.*  A window can reach ``SIMILAR`` only if the shingles in it that the item
   has weigh ``SIMILAR`` of the item at least, wherever in the item they stand.  A
   document that has one of the item's heaviest shingles (the others weigh less than
   that) is swept along all its places of the item's shingles, and every window of the
   item's length that holds so much weight is cut out.  Equal windows are kept once, so
   a passage that many documents share is judged once.
2. *Fingerprints.*  Windows and items get weighted 64-bit SimHashes.
3. *Multi-index.*  Fingerprints are cut in 4 blocks of 16 bits.  Each item is
   entered under all values within 3 bits of each of its blocks; two
   fingerprints within ``RADIUS`` = 15 bits always meet in a block (15 < 4 * 4).
4. *Verification* computes the exact similarity of the pairs that meet.

At similarity 0.8 the expected distance is about 10 bits and 15 is nearly two
standard deviations away; closer copies are safer.

Words are maximal runs of letters and digits, lower-cased.  The shingles of the
benchmark are broadcast only while there are at most ``BROADCAST_SHINGLES``.

Defined cases: items without words are ignored; an item of fewer than five
words is one shingle; null or blank texts have no windows; repeated rows are
one document; a null doc_id is kept as null; a shorter window at the end of a
text is compared as it is.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import cut, sized

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
BROADCAST_SHINGLES = 500_000


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles of a list, in order; fewer words: none."""
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def own_shingles(words: Column) -> Column:
    """Shingles of an item or window: the whole list if it is short."""
    return F.coalesce(*[F.when((F.size(words) >= k) if k == SHINGLE else (F.size(words) == k), shingles(words, k))
                        for k in range(SHINGLE, 0, -1)])


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, n: items that have words."""
    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_list(F.col("text").cast("string")).alias("words"))
            .where(F.size("words") > 0).withColumn("n", F.size("words")).dropDuplicates(["item_id", "words"]))


def _windows(docs: DataFrame, items: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, text_hash, win, n: the distinct windows per document that hold enough
    of an item's weight."""
    kinds = cut(cut(items.select("words", "n").distinct()).withColumn("kind", F.monotonically_increasing_id()))
    own = (kinds.select("kind", "n", F.explode(own_shingles(F.col("words"))).alias("h")).groupBy("kind", "n", "h")
           .agg(F.count("*").alias("tf")).join(weights, "h"))
    mass = F.col("tf") * F.col("w")
    heavy = Window.partitionBy("kind").orderBy(F.desc("w"), "h").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("kind")
    slack = F.col("total") * 1e-9
    own = cut(own.select("kind", "n", "h", "w", F.sum(mass).over(whole).alias("total"),
                         F.coalesce(F.sum(mass).over(heavy), F.lit(0.0)).alias("before"))
              .withColumn("first", F.col("before") <= (1 - SIMILAR) * F.col("total") + slack))
    hashes = own.select("h", F.least("n", F.lit(SHINGLE)).alias("k")).distinct()
    lists = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_list(F.col("text")).alias("words"))
    sizes = [r[0] for r in items.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect()]
    small = own.count() <= BROADCAST_SHINGLES

    def fixed(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    found = None
    for k in sizes:
        at = lists.select("doc_id", "text_hash", F.posexplode(shingles(F.col("words"), k)).alias("pos", "h"))
        at = at.join(fixed(hashes.where(F.col("k") == k).select("h")), "h")
        found = at if found is None else found.unionByName(at)
    if found is None:
        return None
    # A null doc_id equals itself in a grouping, but not in a join.
    doc = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "text_hash"]
    key = ["id", "none", "text_hash"]
    found = cut(found.select(*doc, "pos", "h").distinct())
    pairs = found.join(fixed(own.where("first").select("h", "kind")), "h").select(*key, "kind").distinct()
    places = found.join(pairs, key).join(fixed(own.select("kind", "h", "n", "w", "total")), ["kind", "h"])
    # A place weighs in the windows that start from pos - (n - k) to pos.
    ends = F.array(F.struct((F.col("pos") - F.greatest(F.col("n") - SHINGLE, F.lit(0))).alias("s"), F.col("w").alias("d")),
                   F.struct((F.col("pos") + 1).alias("s"), (-F.col("w")).alias("d")))
    step = (places.select(*key, "kind", "n", "total", F.explode(ends).alias("e"))
            .groupBy(*key, "kind", "n", "total", F.col("e.s").alias("s")).agg(F.sum("e.d").alias("d")))
    along = Window.partitionBy(*key, "kind", "n", "total").orderBy("s")
    level = (step.withColumn("held", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("next", F.lead("s").over(along))
             .where((F.col("held") >= SIMILAR * F.col("total") - F.col("total") * 1e-6) & (F.col("next") > 0)))
    starts = level.select(*key, "n", F.explode(F.sequence(F.greatest("s", F.lit(0)), F.col("next") - 1)).alias("s"))
    starts = cut(starts.groupBy(*key).agg(F.collect_set(F.struct("s", "n")).alias("starts"))).hint("shuffle_hash")
    rows = (docs.withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text", *doc).join(starts, key)
            .select("doc_id", "text_hash", word_list(F.col("text")).alias("words"), "starts"))
    return (rows.select("doc_id", "text_hash", "words", F.explode("starts").alias("x"))
            .select("doc_id", "text_hash", F.concat_ws(" ", F.slice("words", F.col("x.s") + 1, F.col("x.n"))).alias("win"),
                    F.col("x.n").alias("n")).distinct())


def _fingerprints(weighted: DataFrame, key: str) -> DataFrame:
    """key, fp, total weight."""
    mass = F.col("tf") * F.col("w")
    sums = weighted.groupBy(key).agg(F.sum(mass).alias("total"), *[
        F.sum(F.when(F.getbit("h", F.lit(b)) == 1, mass).otherwise(-mass)).alias(f"b{b}") for b in range(64)])
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(key, "total", fp.alias("fp"))


def _blocks(fp: DataFrame, key: str) -> DataFrame:
    part = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", i * BLOCK_BITS)
                              .bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("bits")) for i in range(BLOCKS)])
    return fp.select(key, "fp", "n", F.explode(part).alias("p")).select(key, "fp", "n", "p.block", "p.bits")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) -> doc_id,
    text_hash, item_id, similarity: the contaminated documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = cut(_items(benchmark))
    n_items = items.count()
    weights = cut(items.select("item_id", F.explode(own_shingles(F.col("words"))).alias("h")).distinct()
                  .groupBy("h").agg(F.log1p(n_items / F.count("*")).alias("w")))
    hits = _windows(docs, items, weights)
    if hits is None:
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(0).cast("long").alias("item_id"),
                           F.lit(0.0).alias("similarity")).where(F.lit(False))
    hits = cut(hits)
    rare = F.log1p(F.lit(float(n_items)))
    entry = cut(items.withColumn("entry", F.monotonically_increasing_id()))
    wins = hits.groupBy("win", "n").agg(F.count("*").alias("docs"))
    wins = cut(cut(wins).select("win", "n", F.monotonically_increasing_id().alias("id"), F.split("win", " ").alias("words")))

    def weigh(rows: DataFrame, key: str) -> DataFrame:
        found = (rows.select(key, F.explode(own_shingles(F.col("words"))).alias("h")).groupBy(key, "h")
                 .agg(F.count("*").alias("tf")))
        return cut(found.join(weights, "h", "left").select(key, "h", "tf", F.coalesce("w", rare).alias("w")))

    win_sh, item_sh = weigh(wins, "id"), weigh(entry, "entry")
    win_fp = cut(_fingerprints(win_sh, "id").join(wins.select("id", "n"), "id"))
    item_fp = cut(_fingerprints(item_sh, "entry").join(entry.select("entry", "n"), "entry"))
    masks = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << BLOCK_BITS) - 1).cast("long")),
                               lambda m: F.bit_count(m) <= RADIUS // BLOCKS))  # 697 of them
    index = (_blocks(item_fp, "entry").select("*", masks.alias("mask"))
             .select("entry", F.col("fp").alias("item_fp"), "n", "block", F.col("bits").bitwiseXOR(F.col("mask")).alias("bits")))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    cand = _blocks(win_fp, "id").join(index, ["n", "block", "bits"]).where(near).select("id", "entry").distinct()
    shared = (cand.join(win_sh, "id").join(item_sh.select("entry", "h", F.col("tf").alias("item_tf")), ["entry", "h"])
              .groupBy("id", "entry").agg(F.sum(F.least("tf", "item_tf") * F.col("w")).alias("shared")))
    both = (shared.join(win_fp.select("id", F.col("total").alias("a")), "id")
            .join(item_fp.select("entry", F.col("total").alias("b")), "entry"))
    same = (both.withColumn("similarity", F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")))
            .where(F.col("similarity") >= SIMILAR - 1e-9))
    verdict = cut(same.join(wins.select("id", "win", "n"), "id").join(entry.select("entry", "item_id"), "entry")
                  .select("win", "n", "item_id", "similarity"))
    return (hits.join(verdict, ["win", "n"]).groupBy("doc_id", "text_hash", "item_id")
            .agg(F.max("similarity").alias("similarity")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without a leaked item."""
    bad = sized(leaks(docs, benchmark).select("doc_id", "text_hash").distinct())
    same = docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity of every contaminated document."""
    return (leaks(docs, benchmark).groupBy("doc_id", "item_id")
            .agg(F.round(F.max("similarity"), 9).alias("similarity")))
