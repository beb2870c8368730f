"""Trie of conversation prefixes by a splitter skeleton (operator 11).

A node is a distinct sequence of first turns; its members are the conversations that start with it. Texts are read once: a
turn becomes 16 bytes of a hash of role and text and the text's length, and a conversation's path is one row. Paths (with the
conversation id, for equal ones) are then put in order, in which every node's members are neighbours:

1. Splitters are taken from a sample of at most ``SAMPLE`` rows a shard and cut the order into shards of about ``SHARD_BYTES``. A
   node whose members lie in more than one shard is a prefix of a splitter's path. The trie of these paths, the skeleton, is
   broadcast; splitters count with their first ``SPLITTER_TURNS`` turns, and are thinned out until the skeleton has at most
   ``SKELETON_NODES`` nodes, so its size is bounded and checked. The sample decides only how even the shards are.
2. Each shard, sorted, is read once with a stack of open nodes. Nodes outside the skeleton are finished there. For a
   skeleton node the shard gives a partial aggregate: members, least id, children, leaves and savings below it.
3. Partial aggregates are combined by a reduction. A skeleton node's own part of the savings and of the leaves needs all
   shards and follows from the combined counts and constants of the skeleton.

Equal conversations are ordered by id and split over shards like others. The ids that end at one node are hashed as one text,
so those of a skeleton node pass one task, in order and in pieces, without being held there together.

Turns are ordered by ``turn`` (null first), equal ones by role and a hash of the text; repeated rows are turns of their own. Null
roles and texts are empty. Rows with a null conversation id belong to no conversation and are left out. Very long texts
only count; a very long conversation is one row of 24 bytes a turn. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHARD_BYTES = 32_000_000
MOST_SHARDS = 20_000
SAMPLE = 16
SPLITTER_TURNS = 512
SKELETON_NODES = 1_000_000
KEY = 16  # bytes of a turn in a path
ENDS_PIECE = 8192  # ids in one piece of a skeleton node's text

_FIRST = -(2**63)


# --- paths ----------------------------------------------------------------------------------

def turn_lists(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as (turn, role, key, length)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    return (turns.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.struct(
        F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"), key.alias("key"), F.length(text).cast("bigint").alias("n")).alias("t"))
        .where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def with_path(lists: DataFrame, turns: Column) -> DataFrame:
    """(conv_id, path, lengths) of conversations with these turns."""
    return lists.select("conv_id", F.unhex(F.array_join(F.transform(turns, lambda t: t["key"]), "")).alias("path"),
                        F.transform(turns, lambda t: t["n"]).alias("lengths"))


def rebuilt_paths(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Paths of conversations rebuilt on the head of their group: the first h turns of the conversation whose id is
    the multiple of ``group`` below, then their own after the first h; h is crc32 of the decimal id modulo ``most``."""
    lists = written(turn_lists(conversations, "conv_id", "turn", "role", "text"), "turns")
    heads = lists.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("head"), F.slice("turns", 1, most).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = lists.withColumn("head", F.col("conv_id") - F.col("conv_id") % group).join(heads, "head", "left")
    first = F.when(F.col("first").isNull(), F.slice("turns", F.lit(1), F.lit(0))).otherwise(F.slice("first", F.lit(1), h))
    own = F.slice("turns", h + 1, F.size("turns"))
    return with_path(joined.withColumn("turns", F.concat(first, own)), F.col("turns"))


# --- the skeleton ---------------------------------------------------------------------------

@dataclass
class Skeleton:
    """Splitters in order and the trie of their paths; node 0 is the root."""

    splitters: list[tuple[bytes, int]]
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    length: list[int] = field(default_factory=lambda: [0])

    def add(self, path: bytes, lengths: list[int]) -> None:
        node = 0
        for d in range(len(path) // KEY):
            edge = (node, path[d * KEY:(d + 1) * KEY])
            if edge not in self.child:
                self.child[edge] = len(self.parent)
                self.parent.append(node)
                self.depth.append(d + 1)
                self.length.append(lengths[d])
            node = self.child[edge]

    def constants(self) -> list[tuple]:
        """(skel, parent, depth, children, lengths below and own, chain): ``chain`` lists a node without skeleton
        children and all above it, else it is null."""
        children, below = [0] * len(self.parent), list(self.length)
        for node in range(len(self.parent) - 1, 0, -1):  # children come after their parents
            children[self.parent[node]] += 1
            below[self.parent[node]] += below[node]
        out = []
        for node, parent in enumerate(self.parent):
            chain = None
            if not children[node]:
                chain, at = [], node
                while at >= 0:
                    chain.append(at)
                    at = self.parent[at]
            out.append((node, parent, self.depth[node], children[node], below[node], chain))
        return out


def make_skeleton(paths: DataFrame, shard_bytes: int = SHARD_BYTES, skeleton_nodes: int = SKELETON_NODES,
                  least_shards: int | None = None) -> Skeleton:
    """Splitters of even shards, from a bounded sample of ``paths``, a written table."""
    rows, size = paths.agg(F.count(F.lit(1)), F.sum(F.length("path") + 16)).first()
    least = least_shards or paths.sparkSession.sparkContext.defaultParallelism
    shards = min(MOST_SHARDS, max(least, -(-(size or 0) // shard_bytes)))
    limit = SPLITTER_TURNS * KEY
    long = F.length("path") > limit
    sample = (paths.sample(fraction=min(1.0, SAMPLE * shards / max(1, rows)), seed=11)
              .select(F.substring("path", 1, limit).alias("path"), F.when(long, _FIRST).otherwise(F.col("conv_id")).alias("conv_id"),
                      F.slice("lengths", 1, SPLITTER_TURNS).alias("lengths")).collect())
    at = sorted((bytes(r.path), r.conv_id, r.lengths) for r in sample)
    while True:
        places = sorted({len(at) * k // shards for k in range(1, shards)}) if len(at) else []
        chosen = [at[p] for p in places]
        skeleton = Skeleton(sorted({(path, conv) for path, conv, _ in chosen}))
        for path, _, lengths in chosen:
            skeleton.add(path, lengths)
        if len(skeleton.parent) <= skeleton_nodes:
            return skeleton
        shards = shards // 2


# --- shards ---------------------------------------------------------------------------------

class _Node:
    __slots__ = ("key", "depth", "length", "skel", "least", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, key: bytes, depth: int, length: int, skel: int):
        self.key, self.depth, self.length, self.skel = key, depth, length, skel
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = None      # a skeleton node: ids not yet given out; another: the hash of its ids so far
        self.waiting = []     # finished children, until the least member is known

    def joined(self, least: int, n: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


_EMPTY_HASH = hashlib.sha256().hexdigest()
_SHARD_ROWS = pa.schema([("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                         ("skel", pa.int32()), ("shard", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                         ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())])


class ShardFinisher:
    """Reads paths in order and gives out finished nodes (kind ``node``; ``skel`` is the skeleton node above if the parent is
    one), partial aggregates (``part``) and pieces of a skeleton node's ids (``ends``; ``depth`` numbers the pieces)."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard, self.out = skeleton, shard, []
        self.path, self.stack, self.pieces = b"", [_Node(b"", 0, 0, 0)], {}

    def add(self, conv: int, path: bytes, lengths: list[int]) -> None:
        depth = len(path) // KEY
        if path != self.path:
            same = 0
            while same < min(depth, len(self.stack) - 1) and path[same * KEY:(same + 1) * KEY] == self.stack[same + 1].key:
                same += 1
            self.close(same)
            for d in range(same, depth):
                key, above = path[d * KEY:(d + 1) * KEY], self.stack[-1].skel
                self.stack.append(_Node(key, d + 1, lengths[d], self.skeleton.child.get((above, key), -1) if above >= 0 else -1))
            self.path = path
        node = self.stack[-1]
        node.joined(conv, 1)
        if node.skel >= 0:
            if node.ends is None:
                node.ends = []
            node.ends.append(str(conv))
            if len(node.ends) >= ENDS_PIECE:
                self.give_ends(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv).encode())
        else:
            node.ends.update(f",{conv}".encode())

    def give_ends(self, node: _Node) -> None:
        if node.ends:
            piece = self.pieces[node.skel] = self.pieces.get(node.skel, -1) + 1
            self.out.append(("ends", None, piece, None, node.skel, self.shard, None, None, None, None, ",".join(node.ends)))
            node.ends = []

    def close(self, depth: int) -> None:
        """Finish the open nodes deeper than ``depth``."""
        while len(self.stack) - 1 > depth:
            node = self.stack.pop()
            self.finish(node, self.stack[-1])

    def finish(self, node: _Node, above: _Node | None) -> None:
        if node.skel >= 0:
            self.give_ends(node)
            node.saved += node.n * node.length
            self.out.append(("part", node.least, node.depth, None, node.skel, self.shard, node.n, node.children, node.leaves, node.saved, None))
        else:
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.length
            self.out.extend((*row[:3], node.least, *row[4:]) for row in node.waiting)
            row = ("node", node.least, node.depth, None, above.skel if above.skel >= 0 else None, None, node.n, node.children,
                   node.leaves, node.saved, node.ends.hexdigest() if node.ends else _EMPTY_HASH)
            above.children += 1
            (self.out if above.skel >= 0 else above.waiting).append(row)
        if above is not None:
            above.joined(node.least, node.n)
            above.leaves += node.leaves
            above.saved += node.saved

    def end(self) -> None:
        self.close(0)
        self.finish(self.stack.pop(), None)


def finished_shards(paths: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The shards' rows: finished nodes, partial aggregates of skeleton nodes and their ids."""
    sent = paths.sparkSession.sparkContext.broadcast(skeleton)
    shards = len(skeleton.splitters) + 1

    def dealt(batches):
        splitters = sent.value.splitters
        for batch in batches:
            conv, path = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shard = [bisect_right(splitters, (p, c)) for p, c in zip(path, conv)]
            yield pa.record_batch([pa.array(shard, pa.int32()), *batch.columns], names=["shard", "conv_id", "path", "lengths"])

    def table_of(rows: list) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(_SHARD_ROWS)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SHARD_ROWS)], schema=_SHARD_ROWS)

    def finish(batches):
        at = None
        for batch in batches:
            for shard, conv, path, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at.shard != shard:
                    if at is not None:
                        at.end()
                        yield table_of(at.out)
                    at = ShardFinisher(sent.value, shard)
                at.add(conv, path, lengths)
            if at is not None and at.out:
                yield table_of(at.out)
                at.out = []
        if at is not None:
            at.end()
            yield table_of(at.out)

    keyed = paths.select("conv_id", "path", "lengths").mapInArrow(
        dealt, "shard int, conv_id bigint, path binary, lengths array<bigint>")
    ordered = keyed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    return written(ordered.mapInArrow(finish, "kind string, conv_id bigint, depth bigint, parent_conv_id bigint, skel int, shard int, "
                                              "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"), "shards")


def _ends_hashes(pieces: DataFrame) -> DataFrame:
    """(skel, ends_sha256): the hash of each skeleton node's ids, read in order."""

    def run(batches):
        node, digest = None, None
        for batch in batches:
            out = []
            for skel, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if skel == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = skel, hashlib.sha256()
                digest.update(text.encode())
            yield pa.record_batch([pa.array([s for s, _ in out], pa.int32()), pa.array([t for _, t in out], pa.string())],
                                  names=["skel", "ends_sha256"])
        if node is not None:
            yield pa.record_batch([pa.array([node], pa.int32()), pa.array([digest.hexdigest()])], names=["skel", "ends_sha256"])

    return (pieces.select("skel", "shard", "depth", "ends").repartition("skel").sortWithinPartitions("skel", "shard", "depth")
            .mapInArrow(run, "skel int, ends_sha256 string"))


def trie_nodes(paths: DataFrame, shard_bytes: int = SHARD_BYTES, skeleton_nodes: int = SKELETON_NODES,
               least_shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, path, lengths): conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    paths = written(paths, "paths")
    skeleton = make_skeleton(paths, shard_bytes, skeleton_nodes, least_shards)
    done = finished_shards(paths, skeleton)
    fixed = spark.createDataFrame(skeleton.constants(), "skel int, parent int, depth bigint, inner bigint, lengths bigint, chain array<int>")
    parts = (done.where("kind = 'part'").groupBy("skel")
             .agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]))
    whole = written(parts.join(fixed, "skel").withColumn("n_children", F.col("n_children") + F.col("inner")), "skeleton", few=True)
    leaves = (whole.where("n_children = 0").select(F.explode("chain").alias("skel")).groupBy("skel").agg(F.count(F.lit(1)).alias("own")))
    above = whole.select(F.col("skel").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = (whole.join(leaves, "skel", "left").join(_ends_hashes(done.where("kind = 'ends'")), "skel", "left").join(above, "parent", "left")
           .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("own", F.lit(0)))
           .withColumn("saved_tokens", F.col("saved_tokens") - F.col("lengths"))
           .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY_HASH))).select(columns))
    bounded = F.broadcast(above.select(F.col("parent").alias("skel"), F.col("parent_conv_id").alias("_above")))  # the skeleton's size
    rest = (done.where("kind = 'node'").withColumnRenamed("ends", "ends_sha256").join(bounded, "skel", "left")
            .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above")).select(columns))
    return top.unionByName(rest)


def conversation_trie(conversations: DataFrame, **options) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie_nodes(rebuilt_paths(conversations), **options)
