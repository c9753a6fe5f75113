"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F

from .shared import keep


def components(edges: DataFrame) -> DataFrame:
    """Give (node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Each round links every neighbourhood to its smallest member, first upwards, then downwards, until
    nothing moves; both steps only group and explode neighbours through minima, so a hub's neighbours are
    never gathered in one cell. Rounds are logarithmic in practice; each is cut from the lineage by a table
    in the shared folder. Null ends are ignored; repeated edges and loops change nothing; without edges no round is made.
    """
    links = keep(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                 .where("a is not null and b is not null and a <> b").distinct(), "edges")
    state, before = _state(links), None
    while state[0] and state != before:
        links = keep(_stars(keep(_stars(links, upwards=True), "edges"), upwards=False), "edges")
        state, before = _state(links), state
    return links.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node").unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))


def _state(links: DataFrame) -> Row:
    """Number and sum of hashes of the edges, by which a round that moved nothing is told."""
    return links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def _stars(links: DataFrame, upwards: bool) -> DataFrame:
    """Link a node's larger neighbours (or, downwards, itself and its smaller ones) to its smallest neighbour."""
    if upwards:
        around = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(
            links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
    else:
        around = links.select(F.col("hi").alias("n"), F.col("lo").alias("m"))
    least = around.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("least", "n"))
    joined = around.join(least, "n")
    if upwards:
        moved = joined.where("m > n").select(F.col("m").alias("hi"), F.col("least").alias("lo"))
    else:
        moved = joined.where("m <> least").select(F.col("m").alias("hi"), F.col("least").alias("lo")).unionByName(
            least.select(F.col("n").alias("hi"), F.col("least").alias("lo")))
    return moved.where("hi <> lo").distinct()


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of a[i] and b[i] in an array in which every member points to its set's smallest one."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not ((up := parent[parent]) == parent).all():
            parent = up
    return parent
