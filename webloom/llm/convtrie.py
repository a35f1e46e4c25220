"""Operator 13: the trie of conversation prefixes, by a splitter skeleton.

1. Each turn becomes a digest of (role, text) and its length in code points; texts go no
   further.  Conversations are rebuilt from their own turns and the first turns of the
   head of their hundred (dealt by that head: one shuffle of digests).  A conversation's
   path is the sequence of its digests: byte order puts the members of a node side by side.
2. Splitter keys (path, conv_id) are drawn from a bounded sample, each cut to the
   shortest path that parts its neighbours, and broadcast.  They deal the paths to
   sorted shards; a large group of equal paths is parted by conv_id.
3. A node that is no prefix of a splitter path lies in one shard, which finishes it in a single
   run over its rows with a stack of open nodes.  The prefixes of splitter paths form
   the skeleton; a shard gives partial sums for those it meets.
4. Partial sums are reduced on the cluster, then rolled up over the skeleton, which is no larger
   than the splitters.  Ids that end at a skeleton node come as blocks
   of text in key order; one pass per node hashes them, without holding them.

Turns are ordered by turn (null first), rows of one turn number by their digest; a null role or text
is empty.  Node identity goes by 128-bit digests.

Defined cases: rows without a conv_id belong to no conversation and are left out; repeated rows
are turns of their own; a conversation rebuilt without turns ends at the root; an empty table has no
conversations and no nodes; other columns are ignored.  One conversation is one
row of 20 bytes a turn, held by one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import cut, shuffle_partitions
from webloom.session import ship_package

DIGEST = 16
SHARD_BYTES = 8 << 20
SAMPLE_PER_SHARD = 24
SAMPLE_BYTES = 64 << 20
SPLIT_TURNS = 1024
BLOCK_IDS = 4096
BATCH = 16_384
NONE = hashlib.sha256().hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, " \
       "saved_tokens long, ends_sha256 string"
# kind 0: a finished node; 1: a part of a skeleton node; 2: a block of ids that end at one
SHARD = f"kind int, skeleton long, chars long, block binary, {NODE}"


def paths(turns: DataFrame, shared: int = 6, hundred: int = 100) -> DataFrame:
    """turns (conv_id, turn, role, text, ...) -> conv_id, path, chars: the digests of the rebuilt
    conversation, one after the other, and the code points of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    one = (turns.where(conv.isNotNull())
           .select(conv.alias("conv_id"), (conv - conv % hundred).alias("head"),
                   F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
                            F.length(text).alias("chars")).alias("t"))
           .repartition("head"))
    convs = one.groupBy("head", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    heads = convs.where("conv_id = head").select("head", F.slice("own", 1, shared - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    empty = F.slice("own", 1, 0)
    rebuilt = F.concat(F.slice(F.coalesce("first", empty), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    return (convs.join(heads, "head", "left").select("conv_id", rebuilt.alias("t"))
            .select("conv_id", F.unhex(F.array_join(F.col("t.digest"), "")).alias("path"), F.col("t.chars").alias("chars")))


def splitters(rows: DataFrame, shards: int | None = None) -> list[tuple[bytes, int]]:
    """Sorted keys that part the rows of :func:`paths` into shards of about SHARD_BYTES."""
    size = F.length("path") * 2 + 16
    n, total, cut_total = rows.agg(F.count("*"), F.sum(size), F.sum(F.least(size, F.lit(SPLIT_TURNS * DIGEST * 2)))).first()
    if not n:
        return []
    shards = shards or max(shuffle_partitions(rows.sparkSession), -(-total // SHARD_BYTES))
    want = min(shards * SAMPLE_PER_SHARD, max(1, SAMPLE_BYTES * n // cut_total))
    scale = 1 << 30
    mark = F.pmod(F.xxhash64("conv_id", F.lit(13)), F.lit(scale))
    found = (rows.where(mark < scale * want // n if want < n else F.lit(True))
             .select(F.substring("path", 1, SPLIT_TURNS * DIGEST).alias("path"), "conv_id", size.alias("size")).collect())
    keys = sorted((bytes(r["path"]), r["conv_id"], r["size"]) for r in found)
    upto = list(accumulate(k[2] for k in keys))
    out = set()
    for i in range(1, shards):
        at = bisect_right(upto, i * upto[-1] // shards) if upto else 0
        if 0 < at < len(keys):
            out.add(_between(keys[at - 1][:2], keys[at][:2]))
    return sorted(out)


def _between(a: tuple[bytes, int], b: tuple[bytes, int]) -> tuple[bytes, int]:
    """The key with the shortest path that is above a and not above b."""
    if a[0] == b[0]:
        return b
    k = 0
    while a[0][k: k + DIGEST] == b[0][k: k + DIGEST]:
        k += DIGEST
    return b[0][: k + DIGEST], -(1 << 63)


class Skeleton:
    """The prefixes of all splitter paths: number of each, parents before children."""

    def __init__(self, marks: list[tuple[bytes, int]]):
        every = {p[:k] for p, _ in marks for k in range(0, len(p) + 1, DIGEST)}
        self.paths = sorted(every, key=lambda p: (len(p), p))
        self.number = {p: i for i, p in enumerate(self.paths)}

    def parent(self, i: int) -> int:
        return self.number[self.paths[i][:-DIGEST]] if self.paths[i] else -1


def _deal(marks: list[tuple[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)
            shard = pa.array([bisect_right(marks, k) for k in keys], pa.int32())
            yield pa.record_batch([*b.columns, shard], [*b.schema.names, "shard"])
    return run


class _Open:
    """A node whose members are being read."""
    __slots__ = ("skeleton", "chars", "low", "members", "children", "leaves", "saved", "ends", "block", "pending")

    def __init__(self, skeleton: int | None, chars: int):
        self.skeleton, self.chars = skeleton, chars
        self.low, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = None
        self.block: list[int] = []
        self.pending: list[tuple] = []  # finished children, until the smallest member is known

    def seen(self, low: int, members: int) -> None:
        self.low = low if self.low is None else min(self.low, low)
        self.members += members


class _Shard:
    """One run over the sorted rows of a shard; ``rows`` fills with what is finished."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton = skeleton
        self.stack: list[_Open] = []
        self.rows: list[tuple] = []
        self.last: bytes | None = None

    def add(self, path: bytes, conv_id: int, chars: list[int]) -> None:
        if path != self.last:
            common, last = 0, self.last or b""
            top = min(len(path), len(last))
            while common < top and path[common: common + DIGEST] == last[common: common + DIGEST]:
                common += DIGEST
            self.close(common // DIGEST + 1)
            for k in range(len(self.stack) * DIGEST, len(path) + 1, DIGEST):
                known = not k or self.stack[-1].skeleton is not None
                self.stack.append(_Open(self.skeleton.number.get(path[:k]) if known else None,
                                        chars[k // DIGEST - 1] if k else 0))
            self.last = path
        node = self.stack[-1]
        node.seen(conv_id, 1)
        node.block.append(conv_id)
        if len(node.block) == BLOCK_IDS:
            self.flush(node)

    def flush(self, node: _Open) -> None:
        """Pass on the ids that end here, ascending, as text."""
        text = ",".join(map(str, node.block)).encode()
        if node.skeleton is not None:
            self.rows.append((2, node.skeleton, None, text, node.block[0], *[None] * 7))
        elif node.ends is None:
            node.ends = hashlib.sha256(text)
        else:
            node.ends.update(b"," + text)
        node.block = []

    def close(self, keep: int = 0) -> None:
        """Finish the open nodes of depth ``keep`` and more."""
        while len(self.stack) > keep:
            node = self.stack.pop()
            depth, up = len(self.stack), self.stack[-1] if self.stack else None
            if node.block:
                self.flush(node)
            if node.skeleton is not None:
                self.rows.append((1, node.skeleton, node.chars, None, node.low, depth, None, node.members, node.children,
                                  node.leaves, node.saved, None))
            else:
                node.saved += (node.members - 1) * node.chars
                node.leaves += not node.children
                self.rows += [(0, None, None, None, c[0], depth + 1, node.low, *c[1:]) for c in node.pending]
                done = (node.low, node.members, node.children, node.leaves, node.saved,
                        node.ends.hexdigest() if node.ends else NONE)
                if up is None:
                    self.rows.append((0, None, None, None, done[0], depth, None, *done[1:]))
                elif up.skeleton is None:
                    up.pending.append(done)
                else:
                    self.rows.append((0, up.skeleton, None, None, done[0], depth, None, *done[1:]))
                if up is not None:
                    up.children += 1
            if up is not None:
                up.seen(node.low, node.members)
                up.leaves += node.leaves
                up.saved += node.saved
        if not keep:
            self.last = None


def _run_shards(skeleton: Skeleton):
    schema = pa.schema([("kind", pa.int32()), ("skeleton", pa.int64()), ("chars", pa.int64()), ("block", pa.binary()),
                        *((c.split()[0], pa.int64()) for c in NODE.split(", ")[:-1]), ("ends_sha256", pa.string())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, now = _Shard(skeleton), None
        for b in batches:
            for shard, path, conv_id, chars in zip(b.column("shard").to_pylist(), b.column("path").to_pylist(),
                                                   b.column("conv_id").to_pylist(), b.column("chars").to_pylist(), strict=True):
                if shard != now:
                    work.close()
                    now = shard
                work.add(path, conv_id, chars)
                if len(work.rows) >= BATCH:
                    yield out(work.rows)
                    work.rows = []
        work.close()
        if work.rows:
            yield out(work.rows)
    return run


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by (skeleton, conv_id) -> skeleton, ends_sha256."""
    now, state = None, None
    for b in batches:
        for number, block in zip(b.column("skeleton").to_pylist(), b.column("block").to_pylist(), strict=True):
            if number == now:
                state.update(b",")
            else:
                if state is not None:
                    yield pa.record_batch([pa.array([now]), pa.array([state.hexdigest()])], ["skeleton", "ends_sha256"])
                now, state = number, hashlib.sha256()
            state.update(block)
    if state is not None:
        yield pa.record_batch([pa.array([now]), pa.array([state.hexdigest()])], ["skeleton", "ends_sha256"])


def _roll_up(skeleton: Skeleton, parts: list, ends: dict[int, str]) -> list[tuple]:
    """(number, *NODE) of each skeleton node, from its reduced parts."""
    got = {r["skeleton"]: r for r in parts}
    more = {i: [0, 0, 0] for i in got}  # children, leaves, saved that lie in the skeleton
    rows = []
    for i in sorted(got, reverse=True):  # children have larger numbers
        r, (children, leaves, saved) = got[i], more[i]
        children += r["n_children"]
        leaves += r["n_leaves"] + (not children)
        saved += r["saved_tokens"] + (r["n_convs"] - 1) * r["chars"]
        up = skeleton.parent(i)
        if up >= 0:
            own = more[up]
            own[0] += 1
            own[1] += leaves - r["n_leaves"]
            own[2] += saved - r["saved_tokens"]
        rows.append((i, r["conv_id"], r["depth"], got[up]["conv_id"] if up >= 0 else None, r["n_convs"], children, leaves,
                     saved, ends.get(i, NONE)))
    return rows


def prefix_trie(turns: DataFrame, shared: int = 6, hundred: int = 100, shards: int | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text, ...) -> one row per node, columns NODE."""
    spark: SparkSession = ship_package(turns.sparkSession)
    rows = cut(paths(turns, shared, hundred))
    marks = splitters(rows, shards)
    skeleton = Skeleton(marks)
    schema = "conv_id long, path binary, chars array<int>, shard int"
    dealt = (rows.mapInArrow(_deal(marks), schema).repartitionById(len(marks) + 1, "shard")
             .sortWithinPartitions("shard", "path", "conv_id"))
    found = cut(dealt.mapInArrow(_run_shards(skeleton), SHARD))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = (found.where("kind = 1").groupBy("skeleton")
             .agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), *sums).collect())
    blocks = (found.where("kind = 2").select("skeleton", "conv_id", "block").repartition("skeleton")
              .sortWithinPartitions("skeleton", "conv_id").mapInArrow(_hash_blocks, "skeleton long, ends_sha256 string"))
    ends = {r[0]: r[1] for r in blocks.collect()}
    columns = [c.split()[0] for c in NODE.split(", ")]
    top = spark.createDataFrame(_roll_up(skeleton, parts, ends), f"skeleton long, {NODE}")
    low = top.select("skeleton", F.col("conv_id").alias("low"))
    nodes = (found.where("kind = 0").join(low, "skeleton", "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "low")).select(*columns))
    return nodes.unionByName(top.select(*columns))
