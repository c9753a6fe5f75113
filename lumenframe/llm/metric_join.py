"""Exact cosine range join: pivots cut the vectors of a label into cells that are joined independently.

Unit vectors with cosine >= t are at most eps = sqrt(2 - 2t) apart. A vector belongs to the cell of its nearest
pivot p, and visits the cell of pivot q when the triangle inequality leaves room for a partner there: its distance
to the plane between p and q, (d(x, q)^2 - d(x, p)^2) / 2 d(p, q), is at most eps, and d(x, q) at most q's radius
plus eps. Every linked pair so meets in the home cell of each of its ends. A cell above ``CELL_ROWS`` is joined in
blocks of homes and guests, so no task holds a cell whole. Equal vectors are compared once and counted as often as
they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components, unite
from .shared import keep

CELL_ROWS = 4096
MAX_PIVOTS = 256
SLACK = 1e-9  # for rounding in distances; what it lets in is compared like anything else


def choose_pivots(vectors: DataFrame) -> np.ndarray:
    """At most MAX_PIVOTS vectors, those with the smallest hashes; one per CELL_ROWS rows of the largest label."""
    largest = vectors.groupBy("label", "width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    wanted = min(MAX_PIVOTS, -(-largest["n"] // CELL_ROWS)) if largest else 0
    if wanted < 2:
        return np.zeros((0, 0))
    width = largest["width"]
    taken = vectors.where(F.col("width") == width).orderBy(F.xxhash64("unit"), "vec").limit(wanted).collect()
    return np.array([r.unit for r in taken])


def _assign(pivots: np.ndarray):
    """Nearest pivot of each vector and its distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            fits = np.flatnonzero(batch.column("width").to_numpy() == pivots.shape[1])
            if len(fits):
                away = _distances(_matrix(batch.column("unit"), fits), pivots)
                home[fits], far[fits] = away.argmin(1), away.min(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home), pa.array(far)], [*batch.schema.names, "home", "far"])
    return run


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    return np.array(column.take(pa.array(rows)).to_pylist(), np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


def _visits(pivots: np.ndarray, radii: np.ndarray, eps: float):
    """Cells that each vector must be seen in, its home among them."""
    between = np.maximum(_distances(pivots, pivots), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = batch.column("home").to_numpy()
            cells = [[h] for h in home.tolist()]
            fits = np.flatnonzero(batch.column("width").to_numpy() == pivots.shape[1])
            if len(fits):
                away, own = _distances(_matrix(batch.column("unit"), fits), pivots), home[fits]
                near = away[np.arange(len(fits)), own]
                gap = (away ** 2 - near[:, None] ** 2) / (2 * between[own])
                room = (gap <= eps + SLACK) & (away <= radii + eps + SLACK)
                room[np.arange(len(fits)), own] = True
                for i, row in zip(fits.tolist(), room, strict=True):
                    cells[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int64()))], [*batch.schema.names, "cells"])
    return run


def _join_block(threshold: float):
    """Compare the homes of a block with its guests: partners per home, and the links joined into stars."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        homes, guests = frame[frame["is_home"]], frame[~frame["is_home"]]
        a_ids, b_ids = homes["vec"].to_numpy(), guests["vec"].to_numpy()
        copies = guests["copies"].to_numpy(np.float64)
        if not len(a_ids) or not len(b_ids):
            return pd.DataFrame({"vec": [], "links": [], "other": []})
        left, right = np.stack(homes["unit"].to_list()), np.stack(guests["unit"].to_list())
        links = np.zeros(len(a_ids))
        ids, place = np.unique(np.r_[a_ids, b_ids], return_inverse=True)
        a_at, b_at, parent = place[:len(a_ids)], place[len(a_ids):], np.arange(len(ids))
        for start in range(0, len(a_ids), 512):
            rows = slice(start, start + 512)
            near = (left[rows] @ right.T >= threshold) & (a_ids[rows, None] != b_ids[None, :])
            links[rows] = near @ copies
            some = near.any(1)  # one partner each first, then only what that has not joined yet
            parent = unite(parent, a_at[rows][some], b_at[near.argmax(1)[some]])
            i, j = np.nonzero(near & (parent[a_at[rows]][:, None] != parent[b_at][None, :]))
            parent = unite(parent, a_at[rows][i], b_at[j])
        guest = np.flatnonzero((parent != np.arange(len(ids))) & ~np.isin(ids, a_ids))
        return pd.DataFrame({
            "vec": np.r_[a_ids, ids[guest]], "links": np.r_[links.astype(np.int64), np.zeros(len(guest), np.int64)],
            "other": ids[np.r_[parent[a_at], parent[guest]]]})
    return run


def range_join(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links of each row by cosine >= threshold among rows of equal label.

    Vectors that are null, zero, or hold null or non-finite components, and rows without a label, link with nothing;
    nor do vectors of different width. Cosines are products of vectors scaled to length one in double precision.
    Repeated rows link with each other. Extra columns are ignored. ``component_id`` is the smallest vec_id
    reachable, and ``kept`` marks it.
    """
    array = F.transform("embedding", lambda x: x.cast("double"))
    # Scaling by the largest component first keeps squares of very large or small ones finite.
    top = F.array_max(F.transform(array, F.abs))
    scaled = F.transform("raw", lambda x: x / F.col("top"))
    base = vectors.select("vec_id", "label", array.alias("raw"), top.alias("top")).withColumn(
        "sound", F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.col("top") > 0)
                            & ~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
                            F.lit(False)))
    base = base.withColumn("raw", F.when(F.col("sound"), scaled)).withColumn(
        "norm", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x)))
    base = keep(base.select("vec_id", "label", "sound", F.transform("raw", lambda x: x / F.col("norm")).alias("unit")),
                "vectors")
    distinct = keep(base.where("sound").groupBy("label", "unit").agg(
        F.min("vec_id").alias("vec"), F.count("*").alias("copies")).withColumn("width", F.size("unit")), "distinct")
    pivots = choose_pivots(distinct)
    eps = float(np.sqrt(2 - 2 * threshold))
    if len(pivots):
        placed = keep(distinct.mapInArrow(
            _assign(pivots), f"{_ddl(distinct)}, home long, far double"), "placed")
        radii = np.full(len(pivots), -1.0)
        for row in placed.where(F.col("width") == pivots.shape[1]).groupBy("home").agg(F.max("far").alias("far")).collect():
            radii[row.home] = row.far
        seen = placed.mapInArrow(_visits(pivots, radii, eps), f"{_ddl(placed)}, cells array<bigint>")
    else:
        placed = distinct.withColumn("home", F.lit(0).cast("long"))
        seen = placed.withColumn("cells", F.array(F.lit(0).cast("long")))
    cell = ["label", "width", "cell"]
    visits = keep(seen.select("vec", "unit", "copies", "label", "width", "home", F.explode("cells").alias("cell")), "visits")
    sizes = visits.groupBy(*cell).agg(F.count("*").alias("guests"), F.count(F.when(F.col("home") == F.col("cell"), 1)).alias("homes"))
    blocks = sizes.select(*cell, F.ceil(F.col("homes") / CELL_ROWS).cast("int").alias("home_blocks"),
                          F.ceil(F.col("guests") / CELL_ROWS).cast("int").alias("guest_blocks")).where("home_blocks > 0")
    planned = visits.join(blocks, cell).withColumn("h", F.xxhash64("vec"))
    common = ["vec", "unit", "copies", *cell]
    homes = planned.where("home = cell").select(
        *common, F.lit(True).alias("is_home"), F.pmod("h", "home_blocks").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("guest_blocks").cast("long") - 1)).alias("j"))
    guests = planned.select(
        *common, F.lit(False).alias("is_home"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("home_blocks").cast("long") - 1)).alias("i"),
        F.pmod("h", "guest_blocks").alias("j"))
    found = keep(homes.unionByName(guests).groupBy(*cell, "i", "j").applyInPandas(
        _join_block(threshold), "vec long, links long, other long"), "links")
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("vec").alias("a"), F.col("other").alias("b")))
    classes = distinct.select("label", "unit", "vec", "copies").join(links, "vec", "left").join(
        linked.withColumnRenamed("node", "vec"), "vec", "left")
    joined = base.where("sound").join(classes, ["label", "unit"]).select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec").alias("component_id"))
    alone = base.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
