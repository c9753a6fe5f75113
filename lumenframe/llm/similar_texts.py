"""Groups of texts whose sets of word shingles agree to a wanted Jaccard similarity.

Candidates come from SimHash first: fingerprints that differ in at most ``BITS`` bits meet through BK-trees. Every link is
decided by the true similarity of its two sets; equal sets are one node. A 64-bit fingerprint shows only a part of the pairs
at similarity 0.8, so what it leaves apart goes on to MinHash: ``BANDS`` keys of ``ROWS`` minima each, of which a pair at 0.8
shares none in one case of eight million (0.9: one in 10^15). In ``LEADER_ROUNDS`` rounds all nodes of a bucket are compared with one leader, first the one that meets most
others. What this leaves apart is not compared pair by pair: of a node's shingles only those count that other groups hold too,
and two nodes are compared if one of their rarest such shingles agrees, at a place that leaves room for the similarity.
So members of a group make no pairs among themselves, and texts that are mostly their own, or of their group, make none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import simhash
from .components import components
from .shared import HashSet, Words, hash_set, keep, mix, text_slices

BITS = 6  # of 64, by which the fingerprints of texts may differ that SimHash proposes
BANDS, ROWS = 40, 5
LEADER_ROUNDS = 2
CHUNK = 256  # shingles whose minima are taken at once, so that the products stay in the cache
_random = np.random.default_rng(8)
FLIPS = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
FACTORS = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``shingle`` words; a shorter text is one run."""
    width = min(shingle, len(words))
    total = len(words) - width + 1 if width else 0
    hashes = np.zeros(total, np.uint64)
    for j in range(width):
        hashes = mix(hashes + words[j:j + total])
    return np.unique(hashes)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; an empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), CHUNK):
        least = np.minimum(least, ((hashes[start:start + CHUNK] ^ FLIPS) * FACTORS).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys + row)
    return keys


def _shingled(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, texts in text_slices(batch):
        words = Words(texts, lower=True)
        yield rows, [shingle_set(words.hashes[a:b], shingle)
                     for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, digest, size, keys): a 128-bit digest of the set of every text, its size and its band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in _shingled(batch, shingle):
                digests = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "digest", "size", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, size long, keys array<bigint>")


def _sets(docs: DataFrame, wanted: HashSet, shingle: int) -> DataFrame:
    """(node, set): the sets of the wanted texts as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = wanted.reader()
        for batch in batches:
            own = batch.filter(pa.array(wanted.contains(reader, batch.column("doc_id").to_numpy())))
            for rows, sets in _shingled(own, shingle):
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, set binary").groupBy("node").agg(
        F.first("set").alias("set"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _proposed(docs: DataFrame, nodes: DataFrame, shingle: int, bits: int) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash proposes; a set's fingerprint is that of the text that names its node."""
    marked = simhash.fingerprints(docs, shingle).withColumnRenamed("doc_id", "node").join(nodes.select("node"), "node")
    return simhash.near_pairs(keep(marked, "fingerprints"), bits)


def _sizes_allow(one: Column, other: Column, similarity: float) -> Column:
    return F.least(one, other) >= similarity * F.greatest(one, other)


def _grouped(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (node, group) of all nodes after the pairs (a, b) of nodes have joined their groups.

    Only the groups that a pair joins are contracted, so later rounds do not go through the earlier links again.
    """
    ends = pairs.join(groups.select(F.col("node").alias("a"), F.col("group").alias("x")), "a").join(
        groups.select(F.col("node").alias("b"), F.col("group").alias("y")), "b")
    joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "group")
    return keep(groups.join(joined, "group", "left").select("node", F.coalesce("component", "group").alias("group")), "groups")


def _labelled(buckets: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Buckets with the group of each node, without those that hold one group only."""
    named = buckets.withColumn("group", F.col("node")) if groups is None else buckets.join(groups, "node")
    mixed = named.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
    return named.join(mixed.select("key"), "key").select("key", "node", "size", "group")


def _with_leaders(named: DataFrame, seed: int, similarity: float) -> DataFrame:
    """Pairs of each node and the leader of its bucket, if that is in another group.

    Seed 0 leads by the number of nodes met in all buckets, as the middle of a group does; others by chance.
    """
    ranked = named.withColumn("weight", F.lit(0))
    if not seed:
        counts = named.groupBy("key").agg(F.count("*").alias("n"))
        ranked = named.join(named.join(counts, "key").groupBy("node").agg(F.sum("n").alias("weight")), "node")
    leaders = ranked.groupBy("key").agg(F.max(F.struct(
        "weight", F.xxhash64(F.lit(seed), "node").alias("order"), "node", "size", "group")).alias("leader"))
    return named.join(leaders, "key").where(F.col("group") != F.col("leader.group")).where(
        _sizes_allow(F.col("size"), F.col("leader.size"), similarity)).select(
        F.col("node").alias("a"), F.col("leader.node").alias("b")).distinct()


def _flat(sets: DataFrame) -> DataFrame:
    """(shingle, node, group, size) from (node, group, size, set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("set").to_pylist()
            times = np.array([len(s) // 8 for s in held], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(held), np.int64)),
                 *(pa.array(np.repeat(batch.column(c).to_numpy(), times)) for c in ("node", "group", "size"))],
                ["shingle", "node", "group", "size"])

    return sets.select("node", "group", "size", "set").mapInArrow(run, "shingle long, node long, group long, size long")


def _enough(common: str, x: str, y: str, similarity: float) -> Column:
    """Whether so many common shingles can make sets of x and y shingles as similar as wanted."""
    return F.col(common) * (1 + similarity) + 1e-6 >= similarity * (F.col(x) + F.col(y))


def _rarest(named: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, group, size, have): the shingles by which a node can meet one of another group.

    A node's shingles that several groups hold are taken rarest first; ``have`` counts those from this one on, and they
    end where fewer are left than any partner needs. Two sets as similar as wanted agree in one of them: the first
    they have in common leaves all their common ones behind it in both.
    """
    everything = _flat(named.select("node", "group", "size").distinct().join(sets, "node"))
    held = everything.groupBy("shingle").agg(
        F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    from_common = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("shingle"))
    return everything.join(held.select("shingle", "n"), "shingle").withColumn("have", F.row_number().over(from_common)).where(
        F.col("have") + 1e-6 >= similarity * F.col("size")).select("shingle", "node", "group", "size", "have")


def _across(rarest: DataFrame, similarity: float) -> DataFrame:
    """Pairs of nodes of different groups that a rare shingle brings together; rows of a group and size meet as one."""
    kinds = rarest.groupBy("shingle", "group", "size").agg(F.max("have").alias("have"))
    one, other = (kinds.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("group", "size", "have"))) for side in "ab")
    meet = one.join(other, "shingle").where("group_a < group_b").where(
        _enough("have_a", "size_a", "size_b", similarity) & _enough("have_b", "size_a", "size_b", similarity)).select(
        "shingle", "group_a", "size_a", "group_b", "size_b")
    for side in "ab":
        members = rarest.select("shingle", F.col("group").alias(f"group_{side}"), F.col("size").alias(f"size_{side}"),
                                F.col("node").alias(side), "have")
        meet = meet.join(members, ["shingle", f"group_{side}", f"size_{side}"]).where(
            _enough("have", "size_a", "size_b", similarity)).drop("have")
    return meet.select("a", "b").distinct()


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = BITS) -> DataFrame:
    """(doc_id, component_id): texts whose sets of shingles have at least this Jaccard similarity, transitively.

    doc_id is a long, never null, and tells texts apart. Works on whole texts, A-Z lower-cased, split at ASCII white
    space; texts without words are one group. Shingles are compared by 64-bit hashes. Other columns are ignored. Pairs whose
    fingerprints differ in at most ``bits`` bits are looked at first; the groups do not depend on it.
    """
    marked = keep(_sketches(docs, shingle), "sketches")
    nodes = keep(marked.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("keys").alias("keys")), "sets")
    buckets = keep(_labelled(nodes.select("node", "size", F.explode("keys").alias("key")), None).drop("group"), "buckets")
    proposed = keep(_proposed(docs, nodes, shingle, bits), "proposed")
    wanted = buckets.select("node").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("node")))
    sets = keep(_sets(docs, hash_set(wanted, "node", "wanted"), shingle), "wanted")
    groups = _grouped(nodes.select("node", F.col("node").alias("group")), _verified(proposed, sets, similarity))
    for seed in range(LEADER_ROUNDS):
        named = keep(_labelled(buckets, groups), "named")
        groups = _grouped(groups, _verified(_with_leaders(named, seed, similarity), sets, similarity))
    rarest = keep(_rarest(_labelled(buckets, groups), sets, similarity), "rarest")
    groups = _grouped(groups, _verified(_across(rarest, similarity), sets, similarity))
    linked = nodes.select("digest", "node").join(groups, "node")
    return marked.select("doc_id", "digest").join(linked, "digest").select("doc_id", F.col("group").alias("component_id"))
