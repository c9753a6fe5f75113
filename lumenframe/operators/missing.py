"""Missing data: amounts, what to fill in, and which columns go missing together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from .describe import categorical_summary
from .profile import TableProfile, missing_summary
from .quantiles import exact_quantiles

# Fixed value: correlation of missing indicators above which a pair is reported.
PATTERN_THRESHOLD = 0.5


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing_count, missing_pct, present_count); by default only columns with holes."""
    summary = missing_summary(df.select(*columns) if columns else df)
    chosen = summary if columns else summary.where("missing_count > 0")
    return chosen.select(
        "column", "missing_count", "missing_pct", (F.col("row_count") - F.col("missing_count")).alias("present_count")
    )


def imputation_plan(df: DataFrame, profile: TableProfile, columns: Sequence[str] | None = None) -> DataFrame:
    """Suggested fill per column: median of numbers, mode of categories, review of the rest."""
    chosen = list(columns) if columns else [c.column for c in profile.columns if c.missing_count]
    # The profile has counted the holes already.
    report = profile.to_df(df.sparkSession).where(F.col("column").isin(chosen)).select(
        "column", "missing_count", "missing_pct", (F.col("row_count") - F.col("missing_count")).alias("present_count"))
    numbers = [c for c in chosen if c in profile.numeric]
    texts = [c for c in chosen if c in profile.categorical]
    way = (
        F.when(F.col("column").isin(numbers), "median").when(F.col("column").isin(texts), "mode")
        .otherwise("review_manually")
    )
    plan = report.withColumn("suggested_imputation", way)
    number = text = None
    if numbers:
        medians = exact_quantiles(df, numbers, [0.5]).select(
            "column", F.col("quantile").alias("imputation_number")
        )
        plan, number = plan.join(F.broadcast(medians), "column", "left"), F.col("imputation_number")
    if texts:
        modes = categorical_summary(df, texts).select("column", F.col("mode").alias("imputation_text"))
        plan, text = plan.join(F.broadcast(modes), "column", "left"), F.col("imputation_text")
    return plan.select(
        "column", "missing_count", "missing_pct", "present_count", "suggested_imputation",
        (number if number is not None else F.lit(None).cast("double")).alias("imputation_number"),
        (text if text is not None else F.lit(None).cast("string")).alias("imputation_text"),
    )


def impute(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Fill the holes of each named column with its value, keeping the column's type."""
    types = dict(df.dtypes)
    return df.withColumns({
        c: F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(types[c])) for c, v in values.items()
    })


def impute_from_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Apply a plan (one row per column, so small enough to read)."""
    values = {
        r["column"]: r["imputation_number"] if r["suggested_imputation"] == "median" else r["imputation_text"]
        for r in plan.where("suggested_imputation <> 'review_manually'").collect()
    }
    return impute(df, {c: v for c, v in values.items() if v is not None})


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(missing array, rows): how often each combination of columns is missing together."""
    chosen = list(columns) if columns else df.columns
    absent = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in chosen]))
    return df.groupBy(absent.alias("missing")).agg(F.count("*").alias("rows"))


def missing_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = PATTERN_THRESHOLD
) -> DataFrame:
    """(column_1, column_2, correlation) of missing indicators beyond the threshold.

    Rows are first reduced to their missing patterns; pairs of columns are formed from patterns, not rows.
    """
    chosen = list(columns) if columns else df.columns
    order = F.array(*[F.lit(c) for c in chosen])
    patterns = missing_patterns(df, chosen)
    total = patterns.agg(F.sum("rows").alias("n")).scalar().cast("double")
    single = patterns.select(F.explode("missing").alias("c"), "rows").groupBy("c").agg(F.sum("rows").alias("k"))
    both = (
        patterns.select(F.explode("missing").alias("column_1"), "missing", "rows")
        .select("column_1", F.explode("missing").alias("column_2"), "rows")
        .where(F.array_position(order, F.col("column_1")) < F.array_position(order, F.col("column_2")))
        .groupBy("column_1", "column_2").agg(F.sum("rows").alias("k12"))
    )
    # Pairs never missing together correlate negatively; they matter only below -threshold, so every pair of
    # columns with holes takes part.
    names = [(a, b) for i, a in enumerate(chosen) for b in chosen[i + 1:]]
    pairs = df.sparkSession.createDataFrame(names, "column_1 string, column_2 string")
    first = single.select(F.col("c").alias("column_1"), F.col("k").alias("k1"))
    second = single.select(F.col("c").alias("column_2"), F.col("k").alias("k2"))
    joined = (
        pairs.join(F.broadcast(first), "column_1").join(F.broadcast(second), "column_2")
        .join(F.broadcast(both), ["column_1", "column_2"], "left")
    )
    k1, k2 = F.col("k1").cast("double"), F.col("k2").cast("double")
    spread = F.sqrt(k1 * (total - k1) * k2 * (total - k2))
    r = F.try_divide(total * F.coalesce("k12", F.lit(0)) - k1 * k2, spread)
    return joined.select("column_1", "column_2", r.alias("r")).where(F.abs("r") > threshold).select(
        "column_1", "column_2", F.round("r", 3).alias("correlation")
    )
