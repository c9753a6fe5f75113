"""Descriptive statistics: numeric summaries, value counts, categorical summaries, normality."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.moments import excess_kurtosis, sample_skewness
from ..functions.special import shapiro_wilk
from .profile import TableProfile, column_kind, columns_of_kind
from .quantiles import exact_quantiles, long_values, named

QUARTILES = (0.25, 0.5, 0.75)
# Sample sizes the normality test accepts and the level it decides at.
NORMALITY_ROWS = (8, 5000)
NORMALITY_LEVEL = 0.05


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def choose_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """Requested columns that exist and are numeric, or every numeric column."""
    numeric = columns_of_kind(df, "numeric")
    return [c for c in columns if c in numeric] if columns else numeric


def moments(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Every statistic one aggregate can produce, per (group, column)."""
    v = F.col("value")
    return named(long_values(df, columns, group).groupBy(*group, "cid").agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        sample_skewness(v).alias("skewness"),
        excess_kurtosis(v).alias("kurtosis"),
        (F.count(F.lit(1)) - F.count(v)).alias("missing_count"),
        (F.count(v) == 0).alias("all_missing"),
    ), columns)


def pivot_quantiles(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = {0.25: "q25", 0.5: "median", 0.75: "q75"}
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name) for p, name in names.items()
    ])


_STATS = ("count", "mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis",
          "missing_count", "all_missing")
_STATS_SCHEMA = (
    "column string, count bigint, mean double, std double, min double, q25 double, median double, q75 double, "
    "max double, skewness double, kurtosis double, missing_count bigint, all_missing boolean"
)


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column (none for an empty table): count, moments, quartiles, range, missing."""
    chosen = choose_columns(df, columns)
    if not chosen:
        return df.sparkSession.createDataFrame([], _STATS_SCHEMA)
    quartiles = pivot_quantiles(exact_quantiles(df, chosen, QUARTILES), ["column"])
    # Both sides hold one row per column.
    return moments(df, chosen).join(F.broadcast(quartiles), "column", "left").select("column", *_STATS)


def grouped_summary(df: DataFrame, group_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The numeric summary within every group; rows without a group are left out."""
    chosen = [c for c in choose_columns(df, columns) if c != group_by]
    if not chosen:
        raise ValueError("No numeric columns to summarise by group.")
    present = df.where(_c(group_by).isNotNull())
    quartiles = pivot_quantiles(
        exact_quantiles(present, chosen, QUARTILES, [group_by]), [group_by, "column"]
    )
    return moments(present, chosen, [group_by]).join(quartiles, [group_by, "column"], "left").select(
        group_by, "column", *_STATS
    )


def compute_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, group_by: str | None = None
) -> DataFrame:
    """Statistics of numeric and categorical columns in one table, a row per column (and group).

    Numeric columns have their summary and, with 8 to 5,000 values, the normality test; categorical (text and boolean)
    ones their number of values, mode and ten most frequent values. Without ``columns`` all numeric ones are taken, as
    within groups, whose categorical columns are left out; unknown columns are passed over.
    """
    numbers = [c for c in choose_columns(df, columns) if c != group_by]
    texts = [] if group_by else [c for c in columns or () if c in df.columns and c not in numbers and column_kind(
        df.schema[c].dataType) in ("string", "boolean")]
    keys = [F.lit(None).cast("string").alias("group")] if not group_by else [_c(group_by).cast("string").alias("group")]
    parts = []
    if numbers:
        summary = grouped_summary(df, group_by, numbers) if group_by else numeric_summary(df, numbers)
        tests = normality(df, numbers, group_by).select(
            *([F.col("group").alias("tested_group")] if group_by else []), F.col("column").alias("tested_column"),
            F.col("statistic").alias("normality_statistic"), F.col("p_value").alias("normality_p"), "is_normal")
        rows = summary.select(*keys, "column", F.lit("numeric").alias("kind"), *_STATS)
        same = F.col("column") == F.col("tested_column")
        if group_by:
            same = same & (F.col("group") == F.col("tested_group"))
        # A row per column and group on both sides.
        parts.append(rows.join(tests, same, "left").drop("tested_column", "tested_group"))
    if texts:
        tops = top_values(df, texts, 10).groupBy("column").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
            lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("top_values"))
        parts.append(categorical_summary(df, texts).join(F.broadcast(tops), "column", "left").select(
            *keys, "column", F.lit("categorical").alias("kind"), "unique_count", "mode", "mode_frequency", "missing_count", "top_values"))
    if not parts:
        raise ValueError("Neither numeric nor categorical columns were asked for.")
    empty = df.sparkSession.createDataFrame([], (
        f"group string, kind string, {_STATS_SCHEMA}, normality_statistic double, normality_p double, is_normal boolean, "
        "unique_count bigint, mode string, mode_frequency bigint, top_values array<struct<value:string,count:bigint>>"))
    for part in parts:
        empty = empty.unionByName(part, allowMissingColumns=True)
    return empty


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Values by frequency (ties by value), NULL left out; ``k`` makes it a top-k."""
    counted = df.where(_c(column).isNotNull()).groupBy(_c(column).alias("value")).agg(F.count("*").alias("count"))
    if k is None:
        return counted
    return counted.orderBy(F.desc("count"), F.asc("value")).limit(k)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """Top-k values of many columns at once -> (column, rank, value, count)."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value")) for c in columns
    ])
    counted = (
        df.select(F.inline(entries)).where("value is not null")
        .groupBy("column", "value").agg(F.count("*").alias("count"))
    )
    order = W.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def categorical_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, unique_count, mode, mode_frequency, missing_count); the smallest value wins a tie."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value")) for c in columns
    ])
    counted = df.select(F.inline(entries)).groupBy("column", "value").agg(F.count("*").alias("n"))
    there = F.col("value").isNotNull()
    most = F.max(F.when(there, F.col("n")))
    # The mode is the smallest of the most frequent values: compare (count, value) in two steps, since
    # text has no negation to sort it backwards inside one struct.
    peaks = counted.groupBy("column").agg(
        F.count_if(there).alias("unique_count"),
        F.coalesce(most, F.lit(0)).alias("mode_frequency"),
        F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("missing_count"),
    )
    modes = (
        counted.where(there).join(F.broadcast(peaks.select("column", "mode_frequency")), "column")
        .where(F.col("n") == F.col("mode_frequency"))
        .groupBy("column").agg(F.min("value").alias("mode"))
    )
    return peaks.join(F.broadcast(modes), "column", "left").select(
        "column", "unique_count", "mode", "mode_frequency", "missing_count"
    )


def describe_dataset(df: DataFrame, profile: TableProfile) -> DataFrame:
    """One row per column: type, missing share, numeric summary, unique count and top ten values."""
    spark = df.sparkSession
    base = profile.to_df(spark).select("ordinal", "column", "dtype", "semantic_class", "missing_pct")
    stats = (
        numeric_summary(df, profile.numeric).select("column", "mean", "std", "min", "q25", "median", "q75", "max")
        if profile.numeric else None
    )
    if stats is not None:
        base = base.join(F.broadcast(stats), "column", "left")
    if profile.categorical:
        tops = top_values(df, profile.categorical, 10).groupBy("column").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
                lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")),
            ).alias("top_values")
        )
        uniques = categorical_summary(df, profile.categorical).select("column", "unique_count")
        base = base.join(F.broadcast(tops), "column", "left").join(F.broadcast(uniques), "column", "left")
    return base


def text_profile(df: DataFrame, profile: TableProfile) -> DataFrame:
    """One descriptive line per column, in column order -> (ordinal, line)."""
    spark = df.sparkSession
    dated = profile.with_datetimes(df)
    base = profile.to_df(spark)
    numbers = [c for c in profile.numeric]
    dates = [c for c in profile.datetime]
    categories = [c for c in profile.categorical if c not in dates]
    parts = []
    if numbers:
        parts.append(dated.agg(F.array(*[
            F.struct(F.lit(c).alias("column"), F.format_string(
                ", mean: %.2f, range: %.2f-%.2f",
                F.avg(_c(c).cast("double")), F.min(_c(c).cast("double")), F.max(_c(c).cast("double")),
            ).alias("detail"), F.count(_c(c)).alias("n"))
            for c in numbers
        ]).alias("r")).select(F.inline("r")).where("n > 0").drop("n"))
    if dates:
        parts.append(dated.agg(F.array(*[
            F.struct(F.lit(c).alias("column"), F.concat(
                F.lit(", range: "), F.date_format(F.min(_c(c)), "yyyy-MM-dd HH:mm:ss"),
                F.lit(" to "), F.date_format(F.max(_c(c)), "yyyy-MM-dd HH:mm:ss"),
            ).alias("detail"))
            for c in dates
        ]).alias("r")).select(F.inline("r")))
    if categories:
        tops = top_values(df, categories, 5).groupBy("column").agg(
            F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]
            ), ", ").alias("top")
        )
        uniques = categorical_summary(df, categories).select("column", "unique_count")
        parts.append(uniques.join(F.broadcast(tops), "column", "left").select("column", F.format_string(
            ", %d unique, top: [%s]", "unique_count", F.coalesce("top", F.lit(""))
        ).alias("detail")))
    for i, part in enumerate(parts):
        base = base.join(F.broadcast(part.withColumnRenamed("detail", f"detail{i}")), "column", "left")
    detail = F.coalesce(*[F.col(f"detail{i}") for i in range(len(parts))], F.lit(""))
    missing = F.when(F.col("missing_pct") > 0, F.format_string(", %.1f%% missing", "missing_pct")).otherwise("")
    return base.select("ordinal", F.concat(
        F.format_string("%s (%s, %s", "column", "dtype", "semantic_class"), detail, missing, F.lit(")")
    ).alias("line"))


def schema_lines(profile: TableProfile, spark) -> DataFrame:
    """Short schema text: one ``- column (type) [x% missing]`` line per column."""
    missing = F.when(F.col("missing_pct") > 0, F.format_string(" [%.1f%% missing]", "missing_pct")).otherwise("")
    return profile.to_df(spark).select("ordinal", F.concat(
        F.format_string("- %s (%s)", "column", "dtype"), missing
    ).alias("line"))


def most_missing(profile: TableProfile, spark, k: int = 5) -> DataFrame:
    """The columns with the largest missing share."""
    return (
        profile.to_df(spark).where("missing_pct > 0").orderBy(F.desc("missing_pct"), "ordinal")
        .select("column", "missing_pct").limit(k)
    )


def normality(df: DataFrame, columns: Sequence[str] | None = None, group_by: str | None = None) -> DataFrame:
    """Shapiro-Wilk test of each column (within each group) holding 8 to 5,000 values.

    Larger groups are removed by an aggregate before any value is gathered, so one Python group never
    exceeds 5,000 numbers; the groups are tested in parallel.
    """
    chosen = [c for c in choose_columns(df, columns) if c != group_by]
    group = _c(group_by).cast("string") if group_by else F.lit("all")
    grouped = df.where(group.isNotNull()).select(group.alias("group"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), _c(c).cast("double").alias("value")) for c in chosen
    ]))).where("value is not null")
    low, high = NORMALITY_ROWS
    sizes = grouped.groupBy("group", "column").agg(F.count("*").alias("n"))
    fit = sizes.where(F.col("n").between(low, high)).select("group", "column")

    def test(key: tuple[str, str], pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["value"].to_numpy())
        return pd.DataFrame([(key[0], key[1], len(pdf), w, p, p > NORMALITY_LEVEL)])

    return grouped.join(fit, ["group", "column"], "left_semi").groupBy("group", "column").applyInPandas(
        test, "group string, column string, n bigint, statistic double, p_value double, is_normal boolean"
    )


def datetime_range(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last moment of every date column."""
    chosen = list(columns) if columns else columns_of_kind(df, "datetime")
    return df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.min(_c(c)).cast("timestamp_ntz").alias("start"),
            F.max(_c(c)).cast("timestamp_ntz").alias("end"), F.count(_c(c)).alias("count"),
        )
        for c in chosen
    ]).alias("r")).select(F.inline("r"))

