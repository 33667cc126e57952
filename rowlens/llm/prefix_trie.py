"""The trie of conversation prefixes, over range-partitioned shards and a skeleton.

A conversation is a path of turns; a turn stands there as 128 bits of the
SHA-256 of its role and text, so texts are never shuffled. Rows are ordered by
path and then by conversation, and cut into shards by splitters, which are
themselves (path, conversation), so that even equal paths spread over shards. All
nodes on the paths of splitters are the skeleton; it is broadcast. A node
off the skeleton has all its members in one shard, and a scan of that sorted
shard with a stack of open nodes finishes it. A skeleton node may span shards:
each shard gives what it has of it, and these partial aggregates are
reduced, added up along the skeleton, and joined to the children they name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowlens.llm.common import staged

STEP = 16  # bytes of a turn in a path
SHARD_BYTES = 32 << 20
# Sampled rows per shard, and the longest path that can be a splitter, in turns.
SAMPLED, SPLITTER_TURNS = 8, 256
# Conversations in one piece of a list of ends.
PIECE = 4_096
OUT_ROWS = 8_192
HEAD_TURNS, GROUP = 6, 100
_STEPS = "array<struct<turn:bigint,step:string,chars:int>>"


def step(role: Column, text: Column) -> Column:
    """32 hex digits for a turn; the length of the role keeps it apart from the text."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * STEP)


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, steps``: each conversation's turns in order, as hash and code points of the text.

    Null roles and texts are empty, null turns come first, turns that tie are ordered by hash.
    Rows without a conversation belong to none and are left out.
    """
    empty = F.lit("")
    role, text = (F.coalesce(F.col(c).cast("string"), empty) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), step(role, text).alias("step"), F.length(text).alias("chars")).alias("one"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("steps"))


def as_paths(steps: DataFrame) -> DataFrame:
    """``conv_id, path, chars`` for ``conv_id, steps``."""
    return steps.select(
        "conv_id",
        F.unhex(F.array_join(F.col("steps.step"), "")).alias("path"),
        F.col("steps.chars").alias("chars"),
    )


def regrafted(steps: DataFrame) -> DataFrame:
    """Each conversation ``c`` with its first ``h`` turns taken from ``c - c % 100``; ``h`` is the CRC-32 of ``c``, modulo 6."""
    head = F.slice("steps", 1, HEAD_TURNS - 1)
    bases = steps.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), head.alias("head"))
    own = steps.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(bases, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).cast("int")
    first = F.slice(F.coalesce("head", F.array().cast(_STEPS)), F.lit(1), h)
    rest = F.slice("steps", h + 1, F.greatest(F.size("steps") - h, F.lit(0)))
    return own.select("conv_id", F.concat(first, rest).alias("steps"))


# -- shards and skeleton ---------------------------------------------------


def splitters(paths: DataFrame, shards: int, rows: int) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` keys (path, conversation) in order, from a bounded sample."""
    wanted = SAMPLED * shards
    share = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(rows, 1)))
    short = F.octet_length("path") <= SPLITTER_TURNS * STEP
    sample = sorted((bytes(r["path"]), r["conv_id"]) for r in paths.where(share & short).select("path", "conv_id").collect())
    places = sorted({i * len(sample) // shards for i in range(1, shards)})
    return [sample[i] for i in places if sample]


def skeleton_of(keys: list[tuple[bytes, int]]) -> tuple[list[dict[bytes, int]], list[int]]:
    """Children by step, and the parent, of every node on the paths of the keys; the root is node 0."""
    children: list[dict[bytes, int]] = [{}]
    parents = [-1]
    for path, _ in keys:
        at = 0
        for i in range(0, len(path), STEP):
            now = path[i : i + STEP]
            if now not in children[at]:
                children[at][now] = len(children)
                children.append({})
                parents.append(at)
            at = children[at][now]
    return children, parents


class _Node:
    __slots__ = ("bone", "chars", "n", "least", "children", "leaves", "saved", "ends", "held")

    def __init__(self, bone: int, chars: int):
        self.bone, self.chars = bone, chars
        self.n = self.children = self.leaves = self.saved = 0
        self.least = None
        self.ends = None  # a hash, or a list of ids on the skeleton
        self.held: list[tuple] = []  # finished children that wait for the least member


_FOUND = (
    "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, chars int, bone int, parent_bone int, shard int, piece long"
)
_TYPES = [
    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
    pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(),
]
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
NO_ENDS = hashlib.sha256().hexdigest()


class _Scan:
    """Sorted rows in, finished nodes, parts of skeleton nodes and pieces of their ends out."""

    def __init__(self, skeleton: list[dict[bytes, int]]):
        self.skeleton = skeleton
        self.stack: list[_Node] = []
        self.path = b""
        self.out: list[tuple] = []
        self.pieces = 0
        self.shard = 0

    def add(self, shard: int, path: bytes, conv_id: int, chars: list[int]) -> None:
        if not self.stack:
            self.stack.append(_Node(0, 0))
        before = self.path
        shared = min(len(path), len(before)) // STEP
        if before[: shared * STEP] != path[: shared * STEP]:
            low, high = 0, shared  # the longest common prefix, by halving
            while low < high:
                middle = (low + high + 1) // 2
                if before[: middle * STEP] == path[: middle * STEP]:
                    low = middle
                else:
                    high = middle - 1
            shared = low
        while len(self.stack) - 1 > shared:
            self.close()
        if shard != self.shard:
            for node in self.stack:
                self.give(node)
            self.shard = shard
        for d in range(shared, len(path) // STEP):
            parent = self.stack[-1]
            bone = self.skeleton[parent.bone].get(path[d * STEP : (d + 1) * STEP], -1) if parent.bone >= 0 else -1
            self.stack.append(_Node(bone, chars[d]))
        self.path = path
        node = self.stack[-1]
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if node.bone >= 0:
            node.ends = node.ends or []
            node.ends.append(conv_id)
            if len(node.ends) >= PIECE:
                self.give(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv_id).encode())
        else:
            node.ends.update(f",{conv_id}".encode())

    def give(self, node: _Node) -> None:
        """A piece of the conversations that end at a skeleton node."""
        if node.bone >= 0 and node.ends:
            text = ",".join(map(str, node.ends))
            self.out.append((None,) * 7 + (text, None, node.bone, None, self.shard, self.pieces))
            self.pieces += 1
            node.ends = []

    def close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        parent = self.stack[-1] if self.stack else None
        if parent is not None:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
        if node.bone >= 0:
            self.give(node)
            self.out.append(
                (node.least, depth, None, node.n, node.children, node.leaves, node.saved, None, node.chars, node.bone)
                + (None, None, None)
            )
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.chars
        ends = node.ends.hexdigest() if node.ends else NO_ENDS
        row = (node.least, depth, None, node.n, node.children, leaves, saved, ends, None, None)
        for child in node.held:
            self.out.append((*child[:2], node.least, *child[3:], None, None, None))
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        if parent.bone >= 0:
            self.out.append((*row, parent.bone, None, None))
        else:
            parent.held.append(row)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out))
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bone, ends``: one hash over the pieces of each skeleton node, read in order."""
    bone, digest, done = None, None, []
    for batch in batches:
        for now, text in zip(batch.column("bone").to_pylist(), batch.column("ends").to_pylist()):
            if now != bone:
                if digest:
                    done.append((bone, digest.hexdigest()))
                bone, digest = now, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if digest:
        done.append((bone, digest.hexdigest()))
    if done:
        bones, ends = zip(*done)
        yield pa.RecordBatch.from_arrays([pa.array(bones, pa.int32()), pa.array(ends)], ["bone", "ends"])


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """All nodes of the trie of ``paths(conv_id long, path binary, chars array<int>)``; see :func:`as_paths`.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``, one row per distinct prefix. A conversation
    with an empty path is a member of the root. ``conv_id`` is unique and not null.
    An empty table has no nodes. Equal prefixes are one node however many conversations share them.

    A path (16 bytes a turn, no text) goes through a task as one row, and the
    ids that end at one node pass through one hash in order, in pieces. The
    driver sees a sample of eight rows per shard and one row per skeleton node.
    """
    spark = paths.sparkSession
    paths = staged(paths)
    rows, size = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    if not rows:
        return spark.createDataFrame([], _RESULT)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    keys = splitters(paths, shards, rows)
    children, parents = skeleton_of(keys)
    shared = spark.sparkContext.broadcast((keys, children))
    kinds = paths.select("path", "conv_id", "chars")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            shard = [bisect_right(shared.value[0], key) for key in found]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Scan(shared.value[1])
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "chars"))):
                own.add(*row)
                if len(own.out) >= OUT_ROWS:
                    yield own.batch()
        while own.stack:
            own.close()
        if own.out:
            yield own.batch()

    dealt = kinds.mapInArrow(deal, "shard int, path binary, conv_id long, chars array<int>")
    ordered = dealt.repartitionById(len(keys) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = staged(ordered.mapInArrow(scan, _FOUND))

    # The skeleton: parts are reduced where they are, and one row per node is added up from the leaves to the root.
    parts = found.where("bone is not null and piece is null").groupBy("bone")
    reduced = parts.agg(
        F.min("conv_id"), F.first("depth"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("chars")
    )
    bones = {r[0]: list(r[1:]) for r in reduced.collect()}
    for bone in sorted(bones, reverse=True):
        least, _, n, n_children, leaves, saved, chars = bones[bone]
        bones[bone][4] = leaves if n_children else 1
        bones[bone][5] = saved + (n - 1) * chars
        if parents[bone] >= 0:
            above = bones[parents[bone]]
            above[3] += 1
            above[4] += bones[bone][4]
            above[5] += bones[bone][5]
    table = [
        (bone, least, depth, bones[parents[bone]][0] if bone else None, n, n_children, leaves, saved)
        for bone, (least, depth, n, n_children, leaves, saved, _) in bones.items()
    ]
    named = spark.createDataFrame(
        table, "bone int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    )
    pieces = found.where("piece is not null").select("bone", "shard", "piece", "ends")
    pieces = pieces.repartition("bone").sortWithinPartitions("bone", "shard", "piece")
    ends = pieces.mapInArrow(_joined_ends, "bone int, ends string")
    spine = named.join(ends, "bone", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))
    above = named.select(F.col("bone").alias("parent_bone"), F.col("conv_id").alias("above"))
    local = found.where("bone is null").join(above, "parent_bone", "left")
    local = local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    columns.append(F.col("ends").alias("ends_sha256"))
    return local.select(*columns).unionByName(spine.select(*columns))


_RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


def conversation_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """:func:`prefix_trie` of ``turns(conv_id, turn, role, text)`` as they are."""
    return prefix_trie(as_paths(conversations(turns)), shards)
