"""The trie of conversations by their turns: a broadcast skeleton of splitter paths, and sorted shards for all else.

A turn is 16 bytes of a digest of its role and text, a path the digests of a conversation's turns. Conversations are
dealt to shards by range of (path, conv_id), so copies of one conversation spread as well. A node whose members lie in
several shards has a splitter between two of them and is a prefix of that splitter's path; these nodes are the skeleton.
Every other node lies in one shard, where one walk over the sorted paths finishes it with a stack of the open nodes.
For skeleton nodes shards give partial sums, which are reduced and then added up along the skeleton.

Bounds: there are at most ``MAX_SHARDS`` shards, and a splitter keeps at most ``SPLITTER_TURNS`` turns, so the skeleton
has at most 262,144 nodes; shards are read as sorted streams. A path is one cell of 24 bytes a turn. The digest of a
skeleton node's ends reads their ids in order, as any digest of one list does.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import keep

MAX_SHARDS, SPLITTER_TURNS = 4096, 64
SHARD_BYTES = 16 << 20
SAMPLES = 32  # paths looked at for each shard when splitters are chosen
TURN = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_PIECE = 8192  # ids in a piece of a skeleton node's ends
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, parent_node int, node int, n_ends long, bytes long, piece long, ids string")


def first_turns(conversations: DataFrame, *more: Column) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, role, digest, bytes).

    Rows come by turn, null first; rows of equal turn by role, then by digest. Null roles and texts count as empty.
    Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TURN)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"),
                 F.octet_length(text).cast("long").alias("bytes")).alias("row"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Give every conversation c the first h turns of conversation c - c % family in place of its own first h.

    h is crc32 of c in decimals, modulo ``most``. A conversation that is absent gives no turns; ``%`` keeps c's sign.
    """
    own = keep(first_turns(conversations), "turns")
    heads = own.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    none = F.slice("turns", 1, 0)
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    return joined.select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


class Skeleton:
    """The trie of the splitter paths; node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), TURN):
                step = (node, path[at:at + TURN])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[step]

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))

    def along(self, path: bytes) -> list[int]:
        """The skeleton nodes on a path, the root first."""
        nodes = [0]
        for at in range(0, len(path), TURN):
            node = self.child.get((nodes[-1], path[at:at + TURN]))
            if node is None:
                break
            nodes.append(node)
        return nodes


def _path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [b"".join(x) for x in batch.column("digests").to_pylist()]
        sizes = [np.array(x, np.int64).tobytes() for x in batch.column("sizes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.binary()), pa.array(sizes, pa.binary())],
                                         ["conv_id", "path", "sizes"])


def _dealt(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = skeleton.value
        for batch in batches:
            rows = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([trie.shard(p, c) for p, c in rows], pa.int32()), *batch.columns],
                                             ["shard", *batch.schema.names])
    return run


def _agreeing(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n, at, step = min(len(a), len(b)) // TURN, 0, 1
    while at < n and a[at * TURN:(at + step) * TURN] == b[at * TURN:(at + step) * TURN]:
        at, step = at + step, 2 * step
    if at >= n:
        return n
    while step > 1:
        step //= 2
        if a[at * TURN:(at + step) * TURN] == b[at * TURN:(at + step) * TURN]:
            at += step
    return min(at, n)


class _Node:
    """An open node: what of its subtree has been seen."""

    __slots__ = ("conv", "count", "children", "leaves", "saved", "ends", "ids", "n_ends", "rows")

    def __init__(self):
        self.conv, self.count, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.ids, self.n_ends, self.rows = None, [], 0, []

    def add(self, conv: int, count: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.count += count


def _trie_rows(skeleton):
    """Finish the nodes of sorted shards; skeleton nodes give partial rows, and pieces of their ends."""
    names = [c.split()[0] for c in _NODE.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _NODE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, stack = skeleton.value, [], []
        path, sizes, nodes, shard = b"", np.zeros(0, np.int64), [0], None

        def pieces(node: _Node, number: int, rest: int = 0) -> None:
            while len(node.ids) > rest:
                ids, node.ids = node.ids[:_PIECE], node.ids[_PIECE:]
                out.append((None,) * 9 + (number, None, None, (shard << 40) + node.n_ends - len(node.ids), ",".join(map(str, ids))))

        def close(depth: int) -> None:
            while len(stack) > depth:
                node, d = stack.pop(), len(stack)
                size = int(sizes[d - 1]) if d else 0
                if d < len(nodes):
                    pieces(node, nodes[d])
                    out.append((node.conv, d, None, node.count, node.children, node.leaves, node.saved, None, None, nodes[d],
                                node.n_ends, size, None, None))
                    continue
                leaves, saved = node.leaves or 1, node.saved + (node.count - 1) * size
                above = stack[-1]
                above.add(node.conv, node.count)
                above.children += 1
                above.leaves += leaves
                above.saved += saved
                own = (node.count, node.children, leaves, saved, node.ends.hexdigest() if node.ends else _EMPTY)
                if d - 1 < len(nodes):
                    out.append((node.conv, d, None, *own, nodes[d - 1], None, None, None, None, None))
                else:
                    above.rows.append((node.conv, own))
                out.extend((conv, d + 1, node.conv, *values, None, None, None, None, None, None) for conv, values in node.rows)

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) > least:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, schema.field(n).type) for n, x in zip(names, columns, strict=True)], schema=schema)
                out.clear()

        for batch in batches:
            for number, conv, own, own_sizes in zip(
                    *(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "sizes")), strict=True):
                if number != shard:  # a task may read several shards
                    close(0)
                    shard, path, nodes, stack = number, b"", trie.along(own), [_Node()]
                alike = _agreeing(path, own)
                close(alike + 1)
                if own != path:
                    path, sizes, nodes = own, np.frombuffer(own_sizes, np.int64), trie.along(own)
                stack.extend(_Node() for _ in range(len(own) // TURN + 1 - len(stack)))
                end = stack[-1]
                end.add(conv, 1)
                end.n_ends += 1
                if len(stack) <= len(nodes):
                    end.ids.append(conv)
                    if len(end.ids) > _PIECE:
                        pieces(end, nodes[len(stack) - 1], _PIECE)
                elif end.ends is None:
                    end.ends = hashlib.sha256(b"%d" % conv)
                else:
                    end.ends.update(b",%d" % conv)
            yield from flush(20_000)
        close(0)
        yield from flush(0)
    return run


def _ends_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the ends of skeleton nodes, whose pieces come in order."""
    node, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    for batch in batches:
        for number, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if number != node:
                if node is not None:
                    yield done()
                node, digest = number, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node is not None:
        yield done()


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, turns), turns being (…, digest, bytes) in order.

    A node is a distinct sequence of first turns, the root the empty one; conversations that begin with it are its
    members, and one without turns ends at the root. Columns: conv_id (smallest member), depth, parent_conv_id (the
    parent node's, null at the root), n_convs, n_children, n_leaves (childless nodes at or below), saved_tokens (bytes of
    last texts times members less one, over the subtree), ends_sha256 (digest of the ascending ids of the members that
    end here). No conversations give no rows. ``shards`` is planned from the paths' size unless it is given.
    """
    spark = paths.sparkSession
    table = keep(paths.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.bytes").alias("sizes"))
                 .mapInArrow(_path_rows, "conv_id long, path binary, sizes binary"), "paths")
    count, size = table.agg(F.count("*"), F.sum(F.length("path") + F.length("sizes") + 64)).first()
    if not count:
        return spark.createDataFrame([], ", ".join(_NODE.split(", ")[:8]))
    shards = shards or min(MAX_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES)))
    every = max(1, count // (SAMPLES * shards))
    seen = sorted((bytes(r.path), r.conv_id) for r in table.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select(
        F.expr(f"substring(path, 1, {SPLITTER_TURNS * TURN})").alias("path"), "conv_id").limit(4 * SAMPLES * shards).collect())
    chosen = sorted({seen[i * len(seen) // shards] for i in range(1, shards)}) if seen else []
    trie = Skeleton(chosen)
    broadcast = spark.sparkContext.broadcast(trie)

    dealt = table.mapInArrow(_dealt(broadcast), "shard int, conv_id long, path binary, sizes binary")
    walked = keep(dealt.repartition(len(chosen) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
                  .mapInArrow(_trie_rows(broadcast), _NODE), "trie")

    # The skeleton: partial sums reduced, then added up from the deepest nodes to the root.
    sums = walked.where("node is not null and depth is not null").groupBy("node").agg(
        F.min("conv_id").alias("conv"), F.sum("n_convs").alias("count"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("bytes").alias("bytes"))
    total = {r.node: [r.conv, r["count"], r.children, r.leaves, r.saved, r.bytes] for r in sums.collect()}
    finished = []
    for node in range(len(trie.parent) - 1, -1, -1):  # children have higher numbers than their parents
        conv, members, children, leaves, saved, last = total[node]
        leaves, saved = leaves or 1, saved + (members - 1) * last
        if node:
            above = total[trie.parent[node]]
            above[0] = conv if above[0] is None else min(above[0], conv)
            for k, value in ((1, members), (2, 1), (3, leaves), (4, saved)):
                above[k] += value
        finished.append((node, trie.parent[node], conv, trie.depth[node], members, children, leaves, saved))
    skeleton = spark.createDataFrame(
        finished, "node int, parent_node int, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    known = F.broadcast(skeleton.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("above")))
    ends = walked.where("ids is not null").select("node", "piece", "ids").repartition("node").sortWithinPartitions(
        "node", "piece").mapInArrow(_ends_rows, "node int, ends_sha256 string")
    columns = [c.split()[0] for c in _NODE.split(", ")[:8]]
    # One row per skeleton node on both sides of these joins.
    top = skeleton.join(known, "parent_node", "left").join(ends, "node", "left").withColumn(
        "parent_conv_id", F.col("above")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    rest = walked.where("node is null").join(known, "parent_node", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return rest.select(*columns).unionByName(top.select(*columns))
