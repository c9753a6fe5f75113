"""Outliers and impossible values of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.describe import choose_columns
from ..operators.quantiles import exact_quantiles, long_values, named
from ..session import ensure_checkpoint_dir
from .findings import RowRule

# Thresholds, the smallest column that is checked, the share above which fence
# outliers stop being unusual, and the name parts that say a value cannot be negative / is a percentage.
Z_THRESHOLD = 3.0
FENCE_FACTOR = 1.5
MIN_VALUES = 3
FENCE_SHARE = 0.1
POSITIVE_PARTS = (
    "age", "price", "cost", "revenue", "salary", "quantity", "count", "amount", "weight", "height",
)
PERCENT_PARTS = ("percent", "pct", "rate", "ratio", "proportion")


@dataclass(frozen=True)
class Bounds:
    """What outlier rules need to know about one column."""

    n: int
    mean: float
    std_samp: float
    std_pop: float
    q1: float
    q3: float

    def fences(self, factor: float) -> tuple[float, float]:
        spread = self.q3 - self.q1
        return self.q1 - factor * spread, self.q3 + factor * spread


def column_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, Bounds]:
    """Bounds of all columns, read back as one row per column to become literals of the row scan."""
    if not columns:
        return {}
    v = F.col("value")
    moments = named(long_values(df, columns).groupBy("cid").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("ss"), F.stddev_pop(v).alias("sp")
    ), columns)
    quartiles = exact_quantiles(df, columns, (0.25, 0.75)).groupBy("column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("quantile"))).alias("q3"),
    )
    rows = moments.join(F.broadcast(quartiles), "column").where(F.col("n") >= MIN_VALUES).collect()
    found = {r["column"]: Bounds(r["n"], r["mean"], r["ss"], r["sp"], r["q1"], r["q3"]) for r in rows}
    return {c: found[c] for c in columns if c in found}


def _named(columns: Sequence[str], parts: Sequence[str]) -> list[str]:
    return [c for c in columns if any(p in c.lower() for p in parts)]


def impossible_value_rules(columns: Sequence[str]) -> list[RowRule]:
    """Rules that follow from column names alone, so they need no pass over the data.

    The message texts of this and the other rule sets are fixed formats.
    """
    rules = []
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        if _named([c], POSITIVE_PARTS):
            rules.append(RowRule(
                "negative_value", "error", "statistical", c, v < 0, v,
                f"Found {{n}} negative values in '{c}' which should be positive",
                "Look for sign errors or wrongly entered numbers.",
            ))
        if _named([c], PERCENT_PARTS):
            rules.append(RowRule(
                "percent_bounds", "error", "statistical", c, (v < 0) | (v > 100), v,
                f"Found {{n}} values outside [0, 100] in percentage column '{c}'",
                "Make sure the column really holds percentages.",
            ))
    return rules


def statistical_rules(
    columns: Sequence[str],
    bounds: dict[str, Bounds],
    z_threshold: float = Z_THRESHOLD,
    fence_factor: float = FENCE_FACTOR,
) -> list[RowRule]:
    """Per column: z-score, fence, then impossible-value rules."""
    rules = []
    for c in columns:
        if c not in bounds:
            continue
        b, v = bounds[c], F.col(f"`{c}`").cast("double")
        if b.std_pop > 0:
            rules.append(RowRule(
                "zscore_outlier", "warning", "statistical", c,
                F.abs(v - b.mean) / b.std_pop > z_threshold, v,
                f"Found {{n}} outliers in '{c}' (Z-score > {z_threshold})",
                "Check these rows for entry errors; consider capping or dropping extremes.",
                {"method": "zscore", "threshold": str(z_threshold), "column_mean": str(b.mean),
                 "column_std": str(b.std_samp)},
            ))
        low, high = b.fences(fence_factor)
        rules.append(RowRule(
            "iqr_outlier", "info", "statistical", c, (v < low) | (v > high), v,
            f"Found {{n}} IQR outliers in '{c}' (outside [{low:.2f}, {high:.2f}])",
            "Extreme but possibly valid values; look at a few of them.",
            {"method": "iqr", "q1": str(b.q1), "q3": str(b.q3), "iqr": str(b.q3 - b.q1),
             "lower_bound": str(low), "upper_bound": str(high)},
            below_rows=FENCE_SHARE * b.n,
        ))
        rules.extend(impossible_value_rules([c]))
    return rules


def outlier_bounds(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float | None = None,
) -> DataFrame:
    """(column, method, threshold, lower_bound, upper_bound, n) per checked column.

    A z-score limit is also a pair of bounds around the mean, but rows are judged by the z-score itself.
    """
    chosen = choose_columns(df, columns)
    rows = []
    for c, b in column_bounds(df, chosen).items():
        if method in ("iqr", "both"):
            factor = FENCE_FACTOR if threshold is None else float(threshold)
            low, high = b.fences(factor)
            rows.append((c, "iqr", factor, low, high, b.mean, b.std_pop, b.n))
        if method in ("zscore", "both"):
            k = Z_THRESHOLD if threshold is None else float(threshold)
            rows.append((c, "zscore", k, b.mean - k * b.std_pop, b.mean + k * b.std_pop, b.mean, b.std_pop, b.n))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, method string, threshold double, lower_bound double, upper_bound double, "
        "mean double, std_pop double, n bigint",
    )


def outlier_rows(df: DataFrame, bounds: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every outlier -> (key..., column, method, value); ``bounds`` holds one or two rows per column."""
    bounded = {r["column"] for r in bounds.select("column").distinct().collect()}  # one row per column
    columns = [c for c in df.columns if c in bounded]
    if not columns:
        empty = df.select(*key).where(F.lit(False))
        return empty.select(*key, *[F.lit(None).cast(t).alias(c) for c, t in (
            ("column", "string"), ("method", "string"), ("value", "double"))])
    long = df.select(F.struct(*key).alias("__key"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns
    ])))
    v = F.col("value")
    fence = (v < F.col("lower_bound")) | (v > F.col("upper_bound"))
    z = F.try_divide(F.abs(v - F.col("mean")), F.col("std_pop")) > F.col("threshold")
    kept = long.join(F.broadcast(bounds), "column").where(F.when(F.col("method") == "iqr", fence).otherwise(z))
    return kept.select("__key.*", "column", "method", "value")


def detect_outliers(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str] | None = None,
    method: str = "iqr",
    threshold: float | None = None,
) -> DataFrame:
    """Outlier report per column and method: bounds, count, first ten values, first twenty row keys."""
    bounds = outlier_bounds(df, columns, method, threshold)
    ensure_checkpoint_dir(df.sparkSession)
    found = outlier_rows(df, bounds, key).checkpoint()  # counted and ranked from one scan
    counts = found.groupBy("column", "method").agg(F.count("*").alias("outlier_count"))
    order = W.partitionBy("column", "method").orderBy(*key)
    first = found.withColumn("rn", F.row_number().over(order)).where("rn <= 20")
    listed = first.groupBy("column", "method").agg(F.array_sort(F.collect_list(F.struct(
        "rn", "value", F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("row_key")
    ))).alias("shown"))
    return (
        bounds.join(F.broadcast(counts), ["column", "method"], "left")
        .join(F.broadcast(listed), ["column", "method"], "left")
        .select(
            "column", "method", "threshold", "lower_bound", "upper_bound",
            F.coalesce("outlier_count", F.lit(0)).cast("bigint").alias("outlier_count"),
            F.coalesce(F.slice(F.transform("shown", lambda s: s["value"]), 1, 10), F.array().cast("array<double>"))
            .alias("outlier_values"),
            F.coalesce(F.transform("shown", lambda s: s["row_key"]), F.array().cast("array<string>"))
            .alias("row_keys"),
        )
    )
