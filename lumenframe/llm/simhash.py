"""Near-duplicates by SimHash: fingerprints of word shingles, linked through shard trees keyed by Hamming distance.

Fingerprints within two bits of each other agree in at least two of four 16-bit blocks. Each distinct
fingerprint goes to the buckets of its six block pairs; a bucket keeps a BK-tree, in which a child hangs under
its parent at the edge of their Hamming distance, so a search within radius r follows only the edges from
d - r to d + r. Trees are sent to the queries of their own bucket by the shuffle, never collected. Buckets above
``HOT`` fingerprints are split by further blocks of the remaining bits, of which again some must agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components, unite
from .shared import keep, text_slices

HOT = 2048  # fingerprints of a bucket above which it is split once more
BIN_ROWS = 100_000  # fingerprints a task gets at once


def text_fingerprint(text: bytes, shingle: int) -> int:
    """Bits set in over half of the shingles' XXH64 hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones = np.zeros(64, np.int64)
    total = len(words) - shingle + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, total, 65_536):
        part = words[start:min(start + 65_536, total) + shingle - 1]
        hashes = np.array([digest(join(x), 42) for x in zip(*(part[i:] for i in range(shingle)), strict=False)], "<u8")
        ones += _bit_counts(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, lowest first."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(octets), 255):
        bits = np.unpackbits(octets[start:start + 255], axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return counts


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Add (doc_id, fp) of every whole text; texts that are null or have no words get 0, shorter ones one shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                values = np.array([text_fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(values)], ["doc_id", "fp"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- linking -------------------------------------------------------------------------------------------------

def build_forest(values: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all buckets at once: a root for each tree, and a sorted map of (parent, edge) to child.

    Level by level, the first member of each group becomes a node and the others move on to its child at their
    distance from it.
    """
    roots = np.full(int(tree.max()) + 1 if len(tree) else 0, -1)
    rest, group = np.arange(len(values)), tree.astype(np.int64)
    keys, children = [], []
    first_level = True
    while len(rest):
        order = np.argsort(group, kind="stable")
        rest, group = rest[order], group[order]
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        parent = rest[heads]
        if first_level:
            roots[group[heads]] = parent
        else:
            keys.append(group[heads])
            children.append(parent)
        first_level = False
        of = np.repeat(parent, np.diff(np.r_[heads, len(rest)]))
        apart = np.bitwise_count(values[rest] ^ values[of]).astype(np.int64)
        left = np.ones(len(rest), bool)
        left[heads] = False
        rest, group = rest[left], of[left] * 65 + apart[left]
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    children = np.concatenate(children) if children else np.zeros(0, np.int64)
    order = np.argsort(keys)
    return roots, keys[order], children[order]


def search_forest(values: np.ndarray, tree: np.ndarray, radius: int, block: int = 65_536) -> Iterator[np.ndarray]:
    """Pairs (query, node) within the radius, each query searching the tree of its own bucket, in blocks."""
    roots, keys, children = build_forest(values, tree)
    for start in range(0, len(values), block):
        query = np.arange(start, min(start + block, len(values)))
        stack = [(query, roots[tree[query]])]
        while stack:
            query, node = stack.pop()
            if len(query) > 4 * block:  # bounded memory: the halves take turns
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            apart = np.bitwise_count(values[query] ^ values[node]).astype(np.int64)
            hit = (apart <= radius) & (query != node)
            if hit.any():
                yield np.stack([query[hit], node[hit]])
            below_q, below_n = [], []
            for step in range(-radius, radius + 1):
                wanted = node * 65 + apart + step
                legal = (apart + step >= 0) & (apart + step <= 64)
                at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                found = legal & (keys[at] == wanted) if len(keys) else np.zeros(len(query), bool)
                below_q.append(query[found])
                below_n.append(children[at[found]] if len(keys) else np.zeros(0, np.int64))
            query = np.concatenate(below_q)
            if len(query):
                stack.append((query, np.concatenate(below_n)))


def local_stars(values: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Join what the searches link into stars, at most one edge for each fingerprint of a bucket."""
    parent = np.arange(len(values))
    for a, b in search_forest(values, tree, radius):
        parent = unite(parent, a, b)
    moved = np.flatnonzero(parent != np.arange(len(values)))
    return moved, parent[moved]


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal blocks of the given bit positions."""
    return [sum(1 << bit for bit in chunk.tolist()) for chunk in np.array_split(np.array(bits), parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucketed(distinct: DataFrame, radius: int) -> DataFrame:
    """(node, fp, key): every fingerprint in each bucket where its neighbours within the radius must meet it."""
    blocks = _blocks(list(range(64)), radius + 2)
    masks = [a | b for a, b in combinations(blocks, 2)]
    wide = distinct.select("node", "fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part"))
        for i, m in enumerate(masks)])).alias("at")).select("node", "fp", "at.mask", "at.part")
    hot = wide.groupBy("mask", "part").agg(F.count("*").alias("size")).where(F.col("size") > HOT)
    marked = wide.join(hot, ["mask", "part"], "left")
    # A hot bucket: of radius + 1 blocks of its free bits, one must agree as well. Looked up by mask, so the plan stays small.
    finer = F.array(*[F.array(*[F.lit(_signed(sub)) for sub in _blocks([b for b in range(64) if not m >> b & 1], radius + 1)])
                      for m in masks])
    whole = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("rest")))
    cut = F.transform(F.get(finer, F.col("mask")), lambda sub, j: F.struct(
        (j + 1).alias("sub"), F.col("fp").bitwiseAND(sub).alias("rest")))
    split = marked.select("node", "fp", "mask", "part", F.explode(F.when(F.col("size").isNull(), whole).otherwise(cut)).alias("at"))
    return split.select("node", "fp", F.xxhash64("mask", "part", "at.sub", "at.rest").alias("key"))


def near_edges(distinct: DataFrame, radius: int, rows: int) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints differ in at most ``radius`` bits, as stars within buckets."""
    keys = (radius + 2) * (radius + 1) // 2
    bins = max(1, -(-rows * keys // BIN_ROWS))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame["fp"].to_numpy(np.int64).view(np.uint64)
        order = np.lexsort((values, frame["key"].to_numpy()))
        key = frame["key"].to_numpy()[order]
        tree = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        sizes = np.bincount(tree)
        shared = sizes[tree] > 1  # a fingerprint alone in its bucket has nobody to meet
        kept = order[shared]
        tree = np.unique(tree[shared], return_inverse=True)[1]
        moved, root = local_stars(values[kept], tree, radius)
        node = frame["node"].to_numpy()[kept]
        return pd.DataFrame({"a": node[moved], "b": node[root]})

    spread = bucketed(distinct, radius).withColumn("bin", F.pmod("key", F.lit(bins)))
    node_type = distinct.schema["node"].dataType.simpleString()
    return spread.groupBy("bin").applyInPandas(run, f"a {node_type}, b {node_type}").distinct()


def near_pairs(marked: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes that the trees propose, from (node, fp) without nulls.

    Every node meets the smallest one of its fingerprint; of different fingerprints, those that a bucket links within
    ``radius`` bits meet as stars. So a group of any size makes a few pairs a node.
    """
    heads = keep(marked.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = marked.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return equal.unionByName(near_edges(heads.withColumnRenamed("head", "node"), radius, heads.count()))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): texts whose fingerprints differ in at most ``radius`` bits, transitively.

    Works on whole texts, A-Z lower-cased. Null and empty texts have fingerprint zero and are linked like any
    other. Equal fingerprints are one node, named by their smallest doc_id, before anything is compared; rows
    without doc_id keep their fingerprint and get no component from themselves. Other columns are ignored.
    """
    marked = keep(fingerprints(docs, shingle), "fingerprints")
    nodes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    named = nodes.where("node is not null")
    linked = components(near_edges(named, radius, named.count()))
    classes = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
