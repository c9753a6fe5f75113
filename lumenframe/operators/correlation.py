"""Pearson, Spearman and Kendall correlation in long form: (column_1, column_2, correlation)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.moments import classify_strength
from .describe import choose_columns
from ..session import ensure_checkpoint_dir, share_package
from .ordered import OrderedRows, Running
from .quantiles import GRID as POINTS, SKETCH_SIZE, quantile_grid

# Fewest columns and rows, reporting threshold, pairs listed.
MIN_COLUMNS = 2
MIN_ROWS = 3
REPORT_THRESHOLD = 0.3
REPORT_PAIRS = 20


def _pair_table(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    return df.sparkSession.createDataFrame(rows, "pair int, column_1 string, column_2 string")


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation of each pair over the rows where both are present -> (column_1, column_2, n, correlation).

    Pairs are expanded inside the scan and reduced before the shuffle: what is exchanged is one partial sum
    per task and pair. A constant column gives NULL.
    """
    def number(c: str) -> Column:
        return F.col(f"`{c}`").cast("double")

    entries = F.array(*[
        F.struct(F.lit(i).alias("pair"), number(a).alias("x"), number(b).alias("y"))
        for i, (a, b) in enumerate(pairs)
    ])
    long = df.select(F.inline(entries)).where("x is not null and y is not null")
    x, y = F.col("x"), F.col("y")
    spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    r = F.covar_pop(x, y) / spread
    found = long.groupBy("pair").agg(F.count("*").alias("n"), r.alias("r"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))
    return _pair_table(df, pairs).join(found, "pair", "left").select(
        "column_1", "column_2", F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("r").isNotNull(), bounded).alias("correlation"),
    )


def _gram_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of columns without missing values from one pass over assembled vectors, at any number of columns.

    Values are centred and scaled first, so large means cost no digits. The driver reads a row of means and the
    k x k result, both as large as the schema. A constant column gives NULL.
    """
    spark = df.sparkSession
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = numbers.columns
    figures = numbers.agg(F.count("*").alias("n"), *[
        f(c).alias(f"{c}_{kind}") for c in names for kind, f in (("mean", F.avg), ("std", F.stddev_pop))]).head()
    values: dict[tuple[int, int], float] = {}
    if figures["n"] > 1:
        scaled = [(F.col(c) - F.lit(figures[f"{c}_mean"])) / F.lit(figures[f"{c}_std"]) if figures[f"{c}_std"]
                  else F.lit(0.0) for c in names]
        assembled = VectorAssembler(inputCols=names, outputCol="v").transform(
            numbers.select(*[v.alias(c) for v, c in zip(scaled, names, strict=True)]))
        matrix = Correlation.corr(assembled, "v").head()[0].toArray()
        values = {(i, j): float(min(max(matrix[i, j], -1.0), 1.0)) for i, j in combinations(range(len(names)), 2)
                  if figures[f"{names[i]}_std"] and figures[f"{names[j]}_std"]}
    rows = [(a, b, figures["n"], values.get((i, j))) for (i, a), (j, b) in combinations(enumerate(columns), 2)]
    return spark.createDataFrame(rows, "column_1 string, column_2 string, n bigint, correlation double")


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles c0, c1, ...; -0.0 is 0.0."""
    return df.select(*[(F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])


def _cells(points: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Cells of values: 2 i + 1 is the i-th point itself, 2 i what lies before it (NaN behind all)."""
    at = np.searchsorted(points, values)
    return (2 * at + (np.append(points, np.nan)[at] == values)).astype(np.int32)


def _cut(numbers: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Points that cut each column into cells, and how many rows each cell holds; the driver reads both.

    The points are values of the data, read from a mergeable sketch: up to ``POINTS`` values are all among them, and
    between two of them lies about a thousandth of the rows, the more frequent values being points.
    """
    names = numbers.columns
    grids = numbers.agg(*[quantile_grid(F.kll_sketch_agg_double(c, F.lit(SKETCH_SIZE))).alias(c) for c in names]).head()
    points = [np.unique(np.array(grid or (), np.float64)) for grid in grids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 * len(p) + 1, np.int64) for p in points]
        for batch in batches:
            for own, p, values in zip(counts, points, batch.columns, strict=True):
                own += np.bincount(_cells(p, values.drop_null().to_numpy()), minlength=len(own))
        for i, own in enumerate(counts):
            held = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), i, np.int32)), pa.array(held.astype(np.int32)), pa.array(own[held])],
                ["cid", "cell", "cnt"])

    counts = [np.zeros(2 * len(p) + 1, np.int64) for p in points]
    for cid, cell, cnt in numbers.mapInArrow(run, "cid int, cell int, cnt long").groupBy("cid", "cell").agg(F.sum("cnt")).collect():
        counts[cid][cell] = cnt
    return points, counts


def _ranks(numbers: DataFrame, points: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> DataFrame:
    """Average ranks of all columns, from cells and their counts."""
    names = numbers.columns
    # The rank of a point; of what lies between two points, the number of rows before it.
    bases = [np.cumsum(n) - n + np.where(np.arange(len(n)) % 2, (n + 1) / 2, 0) for n in counts]
    loose = [i for i, n in enumerate(counts) if n[::2].any()]
    schema = ", ".join([*(f"{c} double" for c in names), *(f"cell{i} int" for i in loose)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, cells = [], []
            for i, values in enumerate(batch.columns):
                missing = values.is_null().to_numpy(zero_copy_only=False)
                cell = _cells(points[i], values.to_numpy(zero_copy_only=False))
                columns.append(values if i in loose else pa.array(bases[i][cell], mask=missing))
                if i in loose:
                    cells.append(pa.array(cell, mask=missing))
            yield pa.RecordBatch.from_arrays([*columns, *cells], [*names, *(f"cell{i}" for i in loose)])

    ranks = numbers.mapInArrow(place, schema)
    for i in loose:
        value, cell = F.col(names[i]), F.col(f"cell{i}")
        base = F.get(F.expr(f"array({', '.join(f'{x!r}D' for x in bases[i].tolist())})"), cell)
        between = F.coalesce(cell % 2 == 0, F.lit(False))
        spread = F.pmod(F.xxhash64(*names), F.lit(POINTS)).cast("int")  # rows with a known rank go anywhere
        within = Window.partitionBy("key").orderBy(value)
        rank = base + F.when(between, (F.rank().over(within) + F.count("*").over(within)) / 2).otherwise(0.0)
        keyed = ranks.withColumn("key", F.when(between, cell).otherwise(-1 - spread))
        ranks = keyed.withColumn(names[i], rank).drop("key", f"cell{i}")
    return ranks


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column's values by their average ranks; nulls stay.

    Each column is cut into cells at some of its values, and one pass counts the cells of all columns. A row on such a
    value has its rank from the counts; the others are ranked inside their cells, by one exchange for each column that
    has any. So a frequent value is never dealt to one task, columns of few values are not dealt at all, and rows are
    neither exploded nor joined nor grouped again. The input is read three times.
    """
    numbers = _numbers(df, columns)
    share_package(df.sparkSession)
    return _ranks(numbers, *_cut(numbers)).toDF(*columns)


def _rank_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of the average ranks of columns without missing values; a constant column gives NULL.

    The mean of such ranks is known, so one pass sums the products of all pairs: a k x k matrix a task, added by Spark.
    """
    spark, numbers = df.sparkSession, _numbers(df, columns)
    share_package(spark)
    points, counts = _cut(numbers)
    n, k = int(counts[0].sum()), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = (np.stack([c.to_numpy() for c in batch.columns]) - (n + 1) / 2) / n
            total += z @ z.T
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    summed = _ranks(numbers, points, counts).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s"))
    sums = {(i, j): s for i, j, s in summed.collect()} if n else {}
    rows = []
    for (i, a), (j, b) in combinations(enumerate(columns), 2):
        spread = math.sqrt(sums[i, i]) * math.sqrt(sums[j, j]) if n else 0.0
        rows.append((a, b, n, float(min(max(sums[i, j] / spread, -1.0), 1.0)) if spread else None))
    return spark.createDataFrame(rows, "column_1 string, column_2 string, n bigint, correlation double")


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two columns -> one row (n, discordant, correlation).

    Discordant pairs are inversions of the dense y-rank in (x, y) order. They are counted bit by bit: among
    points whose ranks agree above a bit, those with the bit clear are passed by the earlier ones with the bit
    set. That is n log n rows through bucketed running sums; no pair of rows is ever formed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    points = df.select(  # kept once: levels, ties and inversions all start from the distinct points
        F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y")
    ).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("c")).checkpoint()
    levels_of = OrderedRows(points.select("y").distinct(), ["y"]).with_position("yrank").rows()
    top = levels_of.agg(F.max("yrank")).head()[0]
    ranked = points.join(levels_of, "y").select("x", "yrank", "c")
    bits = max(1, int(top or 0).bit_length())
    at_bits = F.array(*[
        F.struct(
            F.lit(b).cast("int").alias("bit"),
            F.shiftright("yrank", b + 1).alias("prefix"),
            F.shiftright("yrank", b).bitwiseAND(F.lit(1)).alias("is_set"),
        )
        for b in range(bits)
    ])
    exploded = ranked.select("x", "yrank", "c", F.inline(at_bits))
    passed = OrderedRows(exploded, ["x", "yrank"], ["bit", "prefix"]).with_running(
        ahead=Running("sum", F.when(F.col("is_set") == 1, F.col("c")).otherwise(F.lit(0)), inclusive=False)
    ).rows()
    wide = "decimal(19,0)"
    crossed = F.col("c").cast(wide) * F.col("ahead").cast(wide)
    discordant = passed.where("is_set = 0").agg(
        F.coalesce(F.sum(crossed), F.lit(0)).cast("double").alias("d")
    ).scalar()

    def tied(counts: DataFrame) -> Column:
        c = F.col("c").cast(wide)
        return counts.agg(F.coalesce(F.sum(c * (F.col("c") - 1).cast(wide)), F.lit(0)).cast("double") / 2).scalar()

    tx = tied(ranked.groupBy("x").agg(F.sum("c").alias("c")))
    ty = tied(ranked.groupBy("yrank").agg(F.sum("c").alias("c")))
    txy = tied(ranked)
    n = F.coalesce(F.sum("c"), F.lit(0))
    base = ranked.agg(n.alias("n")).select(
        "n", (F.col("n") * (F.col("n") - 1).cast("double") / 2).alias("t"), tx.alias("tx"), ty.alias("ty"),
        txy.alias("txy"), discordant.alias("discordant"),
    )
    concordance = F.col("t") - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("discordant")
    spread = F.sqrt(F.col("t") - F.col("tx")) * F.sqrt(F.col("t") - F.col("ty"))
    return base.select("n", "discordant", F.try_divide(concordance, spread).alias("correlation"))


def correlations(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Upper triangle over the rows without a missing value in any column -> (column_1, column_2, n, correlation)."""
    chosen = choose_columns(df, columns)
    if len(chosen) < MIN_COLUMNS:
        raise ValueError("Need at least 2 numeric columns for correlation analysis.")
    complete = df.select(*[F.col(f"`{c}`") for c in chosen]).dropna()
    pairs = list(combinations(chosen, 2))
    if method == "kendall":
        parts = [
            kendall_tau(complete, a, b).select(
                F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), "n", "correlation"
            )
            for a, b in pairs
        ]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
    elif method in ("pearson", "spearman"):
        found = _gram_correlations(complete, chosen) if method == "pearson" else _rank_correlations(complete, chosen)
    else:
        raise ValueError(f"Unknown method '{method}'. Supported: pearson, spearman, kendall")
    enough = F.col("n") >= MIN_ROWS
    return found.withColumn("correlation", F.when(enough, F.col("correlation")))


def correlation_matrix(upper: DataFrame) -> DataFrame:
    """Full matrix in long form, diagonal included, rounded to four digits."""
    both = upper.select("column_1", "column_2", "correlation").unionByName(
        upper.select(F.col("column_2").alias("column_1"), F.col("column_1").alias("column_2"), "correlation")
    )
    names = upper.select(F.explode(F.array("column_1", "column_2")).alias("column_1"), "correlation")
    diagonal = names.groupBy("column_1").agg(F.count("correlation").alias("k")).select(
        "column_1", F.col("column_1").alias("column_2"), F.when(F.col("k") > 0, 1.0).alias("correlation")
    )
    return both.unionByName(diagonal).withColumn("correlation", F.round("correlation", 4))


def significant_pairs(
    upper: DataFrame, threshold: float = REPORT_THRESHOLD, limit: int | None = REPORT_PAIRS
) -> DataFrame:
    """Pairs at or beyond the threshold, strongest first, with strength and direction."""
    size = F.abs("correlation")
    kept = upper.where(size >= threshold).select(
        "column_1", "column_2", F.round("correlation", 4).alias("correlation"),
        classify_strength(size).alias("strength"),
        F.when(F.col("correlation") > 0, "positive").otherwise("negative").alias("direction"),
    )
    if limit is None:
        return kept
    return kept.orderBy(F.desc(F.abs("correlation")), "column_1", "column_2").limit(limit)


def strongest(upper: DataFrame, threshold: float = REPORT_THRESHOLD) -> DataFrame:
    """The strongest positive and the strongest negative significant pair (one row each, if any)."""
    pairs = significant_pairs(upper, threshold, None)
    best = F.min(F.struct(
        (-F.abs("correlation")).alias("order"), "column_1", "column_2", "correlation", "strength"))
    return pairs.groupBy("direction").agg(best.alias("b")).select("direction", "b.*").drop("order")
