"""Automatic exploration: which analyses suit a table, planned as named lazy tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..operators import charts, correlation, describe, trend
from ..operators.lazy import LazyTables
from ..operators.profile import TableProfile, infer_profile

# Histograms and bar charts drawn.
HISTOGRAMS, BAR_CHARTS = 5, 3


def auto_eda(df: DataFrame, key: Sequence[str], profile: TableProfile | None = None) -> LazyTables:
    """Statistics, correlations, distributions, first trend, category counts and a summary, by name.

    The profile decides which there are. Each is planned when it is asked for; persist ``df`` around several of them
    if it is costly to read.
    """
    known = profile or infer_profile(df)
    numeric, dates, categories = known.numeric, known.datetime, known.categorical
    makers: dict[str, Callable[[], DataFrame]] = {}
    if numeric:
        makers["statistics"] = lambda: describe.numeric_summary(df, numeric)
    if len(numeric) >= correlation.MIN_COLUMNS:
        makers["correlations"] = lambda: correlation.significant_pairs(correlation.correlations(df, numeric))
        makers["heatmap"] = lambda: correlation.correlation_matrix(
            correlation.pair_correlations(df, list(combinations(numeric, 2))))
    for c in numeric[:HISTOGRAMS]:
        makers[f"histogram:{c}"] = partial(charts.histogram, df, c)
    if dates and numeric:
        dated = known.with_datetimes(df)
        analyses = trend.detect_trend(dated, dates[0], numeric[0], key)
        makers.update({f"trend:{name}": partial(analyses.__getitem__, name) for name in analyses})
        makers["line"] = lambda: charts.line(dated, dates[0], numeric[0], bucket="day")
    for c in categories[:BAR_CHARTS]:
        makers[f"bar:{c}"] = partial(charts.bar, df, c)
    results = LazyTables(makers)
    return LazyTables({**makers, "summary": lambda: eda_summary(results, df, len(numeric))})


def eda_summary(results: Mapping[str, DataFrame], df: DataFrame, n_columns: int) -> DataFrame:
    """One row: columns analysed, strongest correlation, direction and fit of the trend."""
    base = df.sparkSession.range(1).select(F.lit(f"- Analyzed {n_columns} columns").alias("stats"))
    lines = [F.lit("Automated EDA Summary:"), F.col("stats")]
    if "correlations" in results:
        # Fixed format of the line; ties go to the first names.
        told = F.format_string("- Strongest correlation: %s ↔ %s (%.2f, %s)", "column_1", "column_2", "correlation", "strength")
        top = results["correlations"].agg(F.min(F.struct(
            (-F.abs("correlation")).alias("order"), "column_1", "column_2", told.alias("told")))["told"]).scalar()
        lines.append(top)
    if "trend:linear_trend" in results:
        told = results["trend:linear_trend"].agg(F.max(
            F.format_string("- Overall trend: %s (R²=%.2f)", "direction", "r_squared")
        )).scalar()
        lines.append(told)
    return base.select(F.concat_ws("\n", *lines).alias("summary"))


def explain_eda(results: Mapping[str, DataFrame]) -> DataFrame:
    """The summary as a short text with the number of charts behind it."""
    n_charts = sum(1 for name in results if name.split(":")[0] in ("histogram", "bar", "line", "heatmap"))
    note = F.lit(f"\n*Generated {n_charts} visualization(s) to illustrate the findings.*") if n_charts else F.lit(None)
    return results["summary"].select(
        F.concat_ws("\n", F.lit("**Analysis: auto_eda**\n"), F.col("summary"), note).alias("narrative")
    )
