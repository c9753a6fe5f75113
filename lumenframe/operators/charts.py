"""The numbers behind each chart, reduced to plottable size by Spark."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .correlation import correlation_matrix, pair_correlations
from .describe import value_counts
from .profile import columns_of_kind
from .quantiles import exact_quantiles, value_counts_long
from .sample import SEED

# Bins of a histogram, bars and slices of value counts, aggregations on offer.
HISTOGRAM_BINS = 30
BARS, SLICES = 20, 10
KINDS = ("histogram", "scatter", "line", "bar", "box", "heatmap", "pie")
AGGREGATIONS = ("sum", "mean", "count", "median")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def aggregate_by(df: DataFrame, x: str, y: str, aggregation: str) -> DataFrame:
    """(x, y): sum, mean, count or exact median of y per value of x; rows without x are left out."""
    present = df.where(_c(x).isNotNull())
    if aggregation == "median":
        medians = exact_quantiles(present, [y], [0.5], [x])
        return medians.select(x, F.col("quantile").alias(y))
    functions = {"sum": F.sum, "mean": F.avg, "count": F.count}
    return present.groupBy(x).agg(functions[aggregation](_c(y)).alias(y))


def histogram(df: DataFrame, x: str, color: str | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bucket, lower, upper, [color], count) in equal-width bins; texts are counted by value.

    A bin holds its lower end, the last one its upper end too; rows and ends are laid out by the same width.
    """
    extra = [color] if color else []
    if x not in columns_of_kind(df, "numeric"):
        return df.where(_c(x).isNotNull()).groupBy(_c(x).alias("value"), *extra).agg(F.count("*").alias("count"))
    v = _c(x).cast("double")
    span = df.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high"))).scalar()
    low, high = span["low"], span["high"]
    width = (high - low) / bins
    bucket = F.when(low == high, F.lit(1)).when(v == high, F.lit(bins)).otherwise(
        F.least(F.floor((v - low) / width) + 1, F.lit(bins)))
    counted = df.where(v.isNotNull()).groupBy(bucket.cast("int").alias("bucket"), *extra).agg(
        F.count("*").alias("count")
    )
    return counted.select(
        "bucket", (low + (F.col("bucket") - 1) * width).alias("lower"), (low + F.col("bucket") * width).alias("upper"),
        *extra, "count",
    )


def scatter(
    df: DataFrame, x: str, y: str, key: Sequence[str] = (), color: str | None = None, points: int | None = None
) -> DataFrame:
    """(x, y, [color]) of every row with both values; ``points`` draws that many by a hash of the row key."""
    chosen = df.where(_c(x).isNotNull() & _c(y).isNotNull())
    if points is not None:
        chosen = chosen.orderBy(F.xxhash64(*[F.col(k) for k in key], F.lit(SEED)), *key).limit(points)
    return chosen.select(_c(x), _c(y), *([_c(color)] if color else []))


def line(
    df: DataFrame, x: str, y: str, color: str | None = None, bucket: str | None = None
) -> DataFrame:
    """(x, [color], y) of every row; with a time bucket (``day``, ``month``, ...) its mean and point count."""
    present = df.where(_c(x).isNotNull() & _c(y).isNotNull())
    extra = [color] if color else []
    if bucket is None:
        return present.select(_c(x), *[_c(c) for c in extra], _c(y))
    return present.groupBy(F.date_trunc(bucket, _c(x)).alias(x), *extra).agg(
        F.avg(_c(y).cast("double")).alias(y), F.count("*").alias("points")
    )


def bar(df: DataFrame, x: str, y: str | None = None, color: str | None = None) -> DataFrame:
    """With y the summed heights per x (stacked by color), otherwise the twenty commonest values."""
    if y is None:
        return value_counts(df, x, BARS)
    extra = [color] if color else []
    return df.where(_c(x).isNotNull()).groupBy(x, *extra).agg(F.sum(_c(y)).alias(y))


def box(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, q1, median, q3, whisker_low, whisker_high, outliers) from value counts per group."""
    keys = list(by)
    present = df
    for k in keys:
        present = present.where(_c(k).isNotNull())
    counts = value_counts_long(present, [value], keys)
    quartiles = exact_quantiles(present, [value], [0.25, 0.5, 0.75], keys)
    fences = quartiles.groupBy(*keys, "n").agg(*[
        F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name)
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    v = F.col("value")
    met = counts.join(fences, keys) if keys else counts.join(F.broadcast(fences.withColumn("cid", F.lit(0))), "cid")
    return met.groupBy(*keys, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("cnt"))), F.lit(0)).alias("outliers"),
    )


def heatmap(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix of all numeric columns; each pair uses the rows where both are present."""
    chosen = list(columns) if columns else columns_of_kind(df, "numeric")
    return correlation_matrix(pair_correlations(df, list(combinations(chosen, 2))))


def pie(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """(x, value, share): summed y per x, or the ten commonest values."""
    if y is None:
        slices = value_counts(df, x, SLICES).select(F.col("value").alias(x), F.col("count").alias("value"))
    else:
        slices = df.where(_c(x).isNotNull()).groupBy(x).agg(F.sum(_c(y)).alias("value"))
    total = slices.agg(F.sum("value").alias("t")).scalar()
    return slices.withColumn("share", F.try_divide("value", total))


def chart_data(
    df: DataFrame,
    kind: str,
    x: str,
    y: str | None = None,
    color: str | None = None,
    aggregation: str = "none",
    key: Sequence[str] | None = None,
    points: int | None = None,
    bucket: str | None = None,
) -> DataFrame | None:
    """Data of one chart; None for an unknown kind, a missing column or a kind that lacks its y.

    ``points`` draws that many rows of a scatter chart, ``bucket`` groups the x of a line; both are off unless asked for.
    """
    if kind not in KINDS or x not in df.columns or (y and y not in df.columns):
        return None
    if aggregation in AGGREGATIONS and y:
        df, color = aggregate_by(df, x, y, aggregation), None
    if kind in ("scatter", "line") and not y:
        return None
    if kind == "histogram":
        return histogram(df, x, color)
    if kind == "scatter":
        return scatter(df, x, y, key or (), color, points)
    if kind == "line":
        return line(df, x, y, color, bucket).orderBy(_c(x))
    if kind == "bar":
        return bar(df, x, y, color)
    if kind == "box":
        return box(df, y or x, [c for c in ((x if y else None), color) if c])
    if kind == "heatmap":
        return heatmap(df) if len(columns_of_kind(df, "numeric")) >= 2 else None
    return pie(df, x, y)
