"""Operator 3: exact Jaccard self-join on word n-grams by T-occurrence search.

Two documents link when ``den * overlap >= num * union`` of their sets of
k-word shingles.

1. *Order.* Shingles seen in two documents of one Arrow batch are counted; the most
   frequent (more than ``LONG_LIST``, at most ``ORDER_TABLE`` of them, a fixed size) are
   broadcast.  The table only orders what follows: links do not depend on it.
2. *Classes.* Equal sets collapse to one representative before any join.
3. *Inverted lists* of parts of sets.  Sizes are cut into classes, so that sizes that can link
   lie in one class or in neighbouring ones; a group is a class and the one above it.  Linked sets
   of a group differ in at most H shingles (``_groups``).  Shingles are dealt by hash to
   ``PARTS * (H + 1)`` parts; a set's parts are ordered by their rarest shingle, then by size, and
   the first H + 1 are its marks.  Of the parts that two linked sets have alike the
   first in this order stands behind at most H others, which they do not have alike, so it
   is a mark of both.  A mark holds several shingles, so sets that only share a passage or
   frequent shingles seldom meet.  The sets of a list are chained to its first: rows grow with the
   marks and not with their squares.  Marks move as packed bytes, in buckets of a bounded size.
4. Connected candidates form a cluster.  A cluster of more than ``BLOCK_SHINGLES`` shingles is
   cut into blocks by size class, of at most that size; blocks meet where their
   classes can link.  Inside, each set runs
   the DivideSkip search: the short inverted lists are merged and
   counted, the L longest are binary-probed for the survivors, and documents
   that reach the required overlap are linked.  A block returns a spanning
   forest and link counts, never its pairs.

Defined cases: a null or blank text has an empty set and links with nothing;
fewer than k words are one shingle; exactly repeated rows are copies of each other;
rows that share a doc_id and differ in text are nodes of their own, each with its own result row;
rows without doc_id keep their own row, take part in no link and have a null
component_id.  Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm import textcore as T
from webloom.llm.common import cut, shuffle_partitions, thinned
from webloom.llm.graph import components
from webloom.session import ship_package

ORDER_TABLE = 1 << 20
LONG_LIST = 16
BLOCK_SHINGLES = 1 << 18
PARTS = 2
BUCKET_MARKS = 1 << 17
HELD_MARKS = 1 << 21
KEY = (1 << 48) - 1
MOST = 1 << 40


def _up(a, num: int, den: int):
    return -(-a * num // den)


def _repeated(k: int):
    """Shingles that at least two documents of a batch have, with their count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [x for s in T.slices(b.column(0)) for x in T.shingle_sets(s, k)]
            toks = np.concatenate([np.zeros(0, np.uint64), *sets])
            del sets
            toks.sort()
            again = np.flatnonzero(toks[1:] == toks[:-1])  # one place less than the shingle has documents
            u, c = np.unique(toks[again], return_counts=True)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64) + 1)], ["token", "c"])
    return run


def _order_table(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, with their counts."""
    seen = cut(docs.select("text").mapInArrow(_repeated(k), "token long, c long")
               .groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") > LONG_LIST))
    sizes = sorted(((r["c"], r["n"]) for r in
                    seen.groupBy(F.least("c", F.lit(4096)).alias("c")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for c, n in sizes:
        if total + n > ORDER_TABLE:
            break
        least, total = c, total + n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = seen.where(F.col("c") >= least).toArrow()
    tok = got.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tok)
    return tok[order], np.minimum(got.column("c").to_numpy()[order], MOST)


def _profiles(k: int):
    """Per document: id, set size, two digests of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(1)):
                sets = T.shingle_sets(s, k)
                da, db = zip(*(_digest(x) for x in sets), strict=True)
                yield pa.record_batch([b.column(0).slice(s.lo, s.hi - s.lo), pa.array([len(x) for x in sets], pa.int64()),
                                       pa.array(da, pa.int64()), pa.array(db, pa.int64())], ["doc_id", "n", "da", "db"])
    return run


def _digest(x: np.ndarray) -> tuple[int, int]:
    m = T.mix(x + np.uint64(0x5851F42D4C957F2D))
    two = np.array([m.sum(dtype=np.uint64), np.bitwise_xor.reduce(T.mix(m), initial=np.uint64(0))], np.uint64)
    a, b = two.view(np.int64)
    return int(a), int(b)


def _groups(most: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size classes up to the size ``most``: the least size of each; of the group of
    a class and the next one: the largest size that links with one of the class, and
    in how many shingles linked sets of the group can differ."""
    low, high, differ = [1], [], []
    while low[-1] <= most:
        last = low[-1] * den // num
        low.append(last + 1)
        high.append(last * den // num)
        differ.append((last + high[-1]) * (den - num) // (den + num))
    return np.array(low, np.int64), np.array(high, np.int64), np.array(differ, np.int64)


def _rarity(tok: np.ndarray, hot: np.ndarray, freq: np.ndarray) -> np.ndarray:
    out = np.full(len(tok), MOST, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tok), len(hot) - 1)
        known = hot[at] == tok
        out[known] -= freq[at[known]]
    return out


def _marks_of(sets: list[np.ndarray], groups, hot: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, mark) of sets that are not empty: the marks in the group of each set's class and in that of the class below."""
    low, high, differ = groups
    size = np.array([len(x) for x in sets], np.int64)
    cls = np.searchsorted(low, size, side="right") - 1
    tok = np.concatenate(sets)
    value, place = T.mix(tok + np.uint64(0xA0761D6478BD642F)), T.mix(tok ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)
    rare = _rarity(tok, hot, freq)
    owner, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for g in (cls, cls - 1):
        ok = (g >= 0) & (size <= high[g]) & (differ[g] > 0)  # sets that differ in nothing are one class
        parts = np.where(ok, PARTS * (differ[g] + 1), 0)
        base = np.cumsum(parts) - parts
        at = np.flatnonzero(np.repeat(ok, size))
        of = np.repeat(np.arange(len(sets)), size)[at]
        part = base[of] + ((place[at] * parts[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=int(parts.sum()))
        end = np.cumsum(count)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[at[order]], dtype=np.uint64)])
        content = total[end] - total[end - count]
        weight = np.zeros(len(count), np.int64)
        full = np.flatnonzero(count)
        if len(full):
            weight[full] = np.maximum.reduceat(rare[at[order]], (end - count)[full]) * 64 + np.minimum(count[full], 63)
        whose = np.repeat(np.arange(len(sets)), parts)
        first = np.lexsort((-weight, whose))  # equal ones in the order of the parts
        first = first[np.arange(len(first)) - base[whose] <= differ[g][whose]]
        whose = whose[first]
        where = g[whose].astype(np.uint64) << np.uint64(40) | (first - base[whose]).astype(np.uint64)
        owner.append(whose)
        marks.append(T.fold_hash(T.mix(where), content[first]))
    return np.concatenate(owner), np.concatenate(marks)


def _packed(bucket: np.ndarray, mark: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """One row per bucket; a mark and its set take 48 bits each."""
    order = np.argsort(bucket, kind="stable")
    both = np.empty((len(order), 12), np.uint8)
    for i, x in enumerate((mark, key)):
        both[:, 6 * i: 6 * i + 6] = x[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    off = np.r_[first, len(order)].astype(np.int32) * 12
    rows = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(off), pa.py_buffer(both)])
    return pa.record_batch([pa.array(bucket[order][first]), rows], ["bucket", "marks"])


def _marks(k: int, groups, buckets: int, table):
    """Texts -> (bucket, packed marks and sets)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            mark, key = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = ((mark >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            return _packed(bucket, mark, key)

        for b in batches:
            for s in T.slices(b.column(0)):
                sets = [x for x in T.shingle_sets(s, k) if len(x)]
                if not sets:
                    continue
                owner, mark = _marks_of(sets, groups, *table.value)
                keys = np.array([_digest(x)[0] for x in sets], np.int64).view(np.uint64) & np.uint64(KEY)
                held.append((mark, keys[owner]))
                n += len(mark)
                if n >= HELD_MARKS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
    return run


def _chains(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The lists of one bucket -> edges from the first set of a list to its others."""
    both = np.frombuffer(b"".join(x.as_py() for x in table.column("marks")), np.uint8).reshape(-1, 12)
    mark, node = np.zeros((2, len(both), 8), np.uint8)
    mark[:, :6], node[:, :6] = both[:, :6], both[:, 6:]
    mark, node = mark.view("<u8").ravel(), node.view("<u8").ravel()
    order = np.lexsort((node, mark))
    mark, node = mark[order], node[order]
    first = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
    head = np.repeat(node[first], np.diff(np.r_[first, len(mark)]))
    at = np.flatnonzero(head != node)
    u, v = head[at], node[at]
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]
    return pa.table({"u": u[new].astype(np.int64), "v": v[new].astype(np.int64)})


def _required(nx, ny, num: int, den: int):
    """Overlap that two sets of these sizes need."""
    return _up(nx + ny, num, num + den)


def divide_skip(query: np.ndarray, uniq: np.ndarray, start: np.ndarray, lists: np.ndarray, sizes: np.ndarray,
                num: int, den: int) -> np.ndarray:
    """Documents of the index that link with ``query``.

    uniq: sorted tokens; token i has the sorted documents
    lists[start[i]:start[i + 1]]; sizes: set size of each document.
    """
    n, docs = len(query), len(sizes)
    least = _up(n, num, den)  # T: no partner needs a smaller overlap
    at = np.searchsorted(uniq, query)
    at = at[(at < len(uniq)) & (uniq[np.minimum(at, len(uniq) - 1)] == query)]
    length = start[at + 1] - start[at]
    if len(at) < least:
        return np.zeros(0, np.int64)
    longest = int(length.max())
    n_long = min(least - 1, int(least / (0.0085 * np.log2(longest + 1) + 1)))
    order = np.argsort(length, kind="stable")
    short, long_ = at[order[: len(at) - n_long]], at[order[len(at) - n_long:]]
    spans = [lists[start[i]: start[i + 1]] for i in short]
    merged = np.sort(np.concatenate(spans), kind="stable")  # merges the sorted runs
    first = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
    count = np.diff(np.r_[first, len(merged)])
    cand = merged[first]
    fits = (sizes[cand] * den >= n * num) & (n * den >= sizes[cand] * num)
    need = _required(n, sizes[cand], num, den)
    ok = fits & (count >= need - len(long_))
    cand, count, need = cand[ok], count[ok], need[ok]
    if len(cand) and len(long_):
        step = max(1, 250_000 // len(cand))
        for lo in range(0, len(long_), step):
            count = count + _probe(long_[lo: lo + step], cand, start, lists, docs)
    return cand[count >= need]


def _probe(tokens, cand, start, lists, docs):
    """How many of the tokens' lists hold each candidate, by binary search."""
    hits = np.zeros(len(cand), np.int64)
    lo = np.repeat(start[tokens][:, None], len(cand), 1)
    hi = np.repeat(start[tokens + 1][:, None], len(cand), 1)
    end = hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = open_ & (lists[np.minimum(mid, len(lists) - 1)] < cand)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    found = (lo < end) & (lists[np.minimum(lo, len(lists) - 1)] == cand)
    return hits + found.sum(0)


def index_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    return flat[first], np.r_[first, len(flat)], doc


def _search(num: int, den: int):
    """One cluster, or two blocks of one: links as a forest, with counts."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        both = np.stack([table.column("side").to_numpy(), table.column("node").to_numpy()])
        table = table.take(pa.array(np.unique(both, axis=1, return_index=True)[1]))  # one row per set
        side, node = table.column("side").to_numpy(), table.column("node").to_numpy()
        weight = table.column("size").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("tokens")]
        cluster, ci, bi, cj, bj, split = (k.as_py() for k in key)
        two = (ci, bi) != (cj, bj)
        inner = np.flatnonzero(side == (1 if two else 0))
        outer = np.flatnonzero(side == 0)
        if not len(inner) or not len(outer):  # a block without documents
            return pa.table({"node": node, "root": node, "links": np.zeros(len(node), np.int64),
                             "split": np.full(len(node), split)})
        uniq, start, lists = index_of([sets[i] for i in inner])
        sizes = np.array([len(sets[i]) for i in inner], np.int64)
        parent, links = list(range(len(node))), np.zeros(len(node), np.int64)

        def root(a: int) -> int:
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        for q in outer:
            for hit in inner[divide_skip(sets[q], uniq, start, lists, sizes, num, den)]:
                if hit == q:
                    continue
                links[q] += weight[hit]
                if two:
                    links[hit] += weight[q]
                a, b = root(q), root(hit)
                if a != b:
                    if node[a] > node[b]:
                        a, b = b, a
                    parent[b] = a
        top = np.array([node[root(i)] for i in range(len(node))], np.int64)
        return pa.table({"node": node, "root": top, "links": links, "split": np.full(len(node), split)})
    return run


def _sets_of(k: int):
    """Texts -> shingle sets, where the set is the one that ``da``, ``db`` name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drop = {b.schema.get_field_index(c) for c in ("text", "da", "db")}
            rest = [i for i in range(b.num_columns) if i not in drop]
            da, db = b.column("da").to_pylist(), b.column("db").to_pylist()
            for s in T.slices(b.column("text")):
                sets = T.shingle_sets(s, k)
                own = [i for i, x in enumerate(sets) if _digest(x) == (da[s.lo + i], db[s.lo + i])]
                at = pa.array([s.lo + i for i in own], pa.int64())
                yield pa.record_batch([*(b.column(i).take(at) for i in rest), T.blob([sets[i] for i in own])],
                                      [*(b.schema.names[i] for i in rest), "tokens"])
    return run


def _size_class(n: str, num: int, den: int) -> Column:
    """Sizes that can link lie in one class or in neighbouring ones."""
    width = max(math.log(den / num), 1e-6) * (1 + 1e-6)
    return F.floor(F.log(n) / width).cast("int")


def _candidates(docs: DataFrame, classes: DataFrame, table, k: int, num: int, den: int) -> DataFrame:
    """Edges (u, v) over the keys of classes; every two classes that link are connected."""
    spark = docs.sparkSession
    most, total = classes.agg(F.max("n"), F.sum(F.col("n") * F.col("size"))).first()
    if not most or num == den:
        return spark.createDataFrame([], "u long, v long")
    buckets = _up(2 * total * (den - num), 1, num * BUCKET_MARKS)
    return (docs.where("doc_id is not null").select("text")
            .mapInArrow(_marks(k, _groups(most, num, den), buckets, table), "bucket long, marks binary")
            .repartition(max(shuffle_partitions(spark), buckets // 8), "bucket")
            .groupBy("bucket").applyInArrow(_chains, "u long, v long"))


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """docs (doc_id bigint, text string, ...) -> one row per document:
    doc_id, n_shingles, component_id (smallest doc_id reachable by links),
    n_links (documents that link with it directly)."""
    spark = ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(_order_table(docs, k))
    prof = cut(docs.mapInArrow(_profiles(k), "doc_id long, n long, da long, db long"))
    # A class of equal sets is a node; its number is fixed by the checkpoint.  Two classes of one key stay together.
    classes = cut(prof.where("n > 0 and doc_id is not null").groupBy("n", "da", "db")
                  .agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
                  .select("*", F.monotonically_increasing_id().alias("node"), _size_class("n", num, den).alias("cls"),
                          F.col("da").bitwiseAND(KEY).alias("key")))
    found = cut(_links(docs, components(_candidates(docs, classes, table, k, num, den)), classes, k, num, den))
    split = cut(found.where("split").select(F.col("node").alias("u"), F.col("root").alias("v")))
    joined = components(split).select("node", F.col("root").alias("wide"))
    linked = (found.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.when(~F.col("split"), F.col("root"))).alias("root"))
              .where("links > 0").join(joined, "node", "left").select("node", F.coalesce("wide", "root", "node").alias("root"), "links"))
    linked = cut(linked.join(classes.select("node", "rep"), "node"))
    tops = linked.groupBy("root").agg(F.min("rep").alias("component"))
    linked = linked.join(tops, "root").select("node", "component", "links")
    final = cut(classes.select("n", "da", "db", "rep", "size", "node").join(linked, "node", "left")
                .select("n", "da", "db", F.coalesce("component", "rep").alias("component"),
                        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")))
    named = F.col("doc_id").isNotNull()
    return (prof.select("doc_id", "n", "da", "db").join(final, ["n", "da", "db"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(named, F.coalesce("component", "doc_id")).alias("component_id"),
                    F.when(named, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links")))


def _links(docs: DataFrame, clusters: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, root, links, split) from the search inside each cluster."""
    spark = docs.sparkSession
    member = cut(clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster")).join(classes, "key").drop("key"))
    whole, up = Window.partitionBy("cluster"), Window.partitionBy("cluster").orderBy("cls")
    large = F.col("total") > BLOCK_SHINGLES
    parts = (member.groupBy("cluster", "cls").agg(F.sum("n").alias("tokens"))
             .withColumn("total", F.sum("tokens").over(whole))
             .withColumn("blocks", F.when(large, F.ceil(F.col("tokens") / BLOCK_SHINGLES)).otherwise(1).cast("int"))
             .select("cluster", "cls", large.alias("split"), "blocks",
                     F.when(large & (F.lag("cls").over(up) == F.col("cls") - 1), F.lag("blocks").over(up)).otherwise(0).alias("below"),
                     F.when(large & (F.lead("cls").over(up) == F.col("cls") + 1), F.lead("blocks").over(up)).otherwise(0).alias("above")))
    member = (member.join(cut(parts), ["cluster", "cls"])
              .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("cls", F.when(F.col("split"), F.col("cls")).otherwise(0)).drop("n"))
    hint = member.hint("shuffle_hash")
    docs = thinned(docs, "doc_id", member, "rep")
    texts = (docs.join(hint, docs.doc_id == hint.rep)
             .withColumn("same", F.xxhash64("text")).dropDuplicates(["rep", "node", "same"])
             .select("node", "cluster", "size", "split", "cls", "own", "blocks", "below", "above", "da", "db", "text"))
    sets = texts.mapInArrow(_sets_of(k), "node long, cluster long, size long, split boolean, cls int, own int, blocks int, "
                                         "below int, above int, tokens binary")
    # A set meets its own class's blocks, those of the class above (as side 0) and of the class below (as side 1).
    ways = F.expr("""concat(
        transform(sequence(0, blocks - 1), b -> struct(cls as ci, least(b, own) as bi, cls as cj, greatest(b, own) as bj,
                                                       if(b < own, 1, 0) as side)),
        if(above > 0, transform(sequence(0, above - 1), b -> struct(cls as ci, own as bi, cls + 1 as cj, b as bj, 0 as side)),
           array()),
        if(below > 0, transform(sequence(0, below - 1), b -> struct(cls - 1 as ci, b as bi, cls as cj, own as bj, 1 as side)),
           array()))""")
    key = ["cluster", "ci", "bi", "cj", "bj", "split"]
    dealt = sets.withColumn("w", F.explode(ways)).select("cluster", "split", "node", "size", "tokens", "w.*")
    return (dealt.repartition(shuffle_partitions(spark), *key).groupBy(*key)
            .applyInArrow(_search(num, den), "node long, root long, links long, split boolean"))
