"""Deterministic rules for meaning: placeholder texts, impossible domains, roundness, mixed units, and
findings delivered as JSON."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.quantiles import exact_quantiles, long_values, named
from .findings import RowRule, empty_findings, table_finding

# Texts standing in for "nothing" (compared lower-case and trimmed), bounds of columns by
# name part, share of round values that is suspicious, and unit factors with their tolerance.
PLACEHOLDERS = ("n/a", "na", "null", "none", "nan", "-", "--", "?", "unknown", "undefined", "tbd", "")
DOMAIN_BOUNDS = (
    ("body_temp", 25.0, 50.0),
    ("temperature_c", -90.0, 60.0),
    ("latitude", -90.0, 90.0),
    ("longitude", -180.0, 180.0),
    ("percentile", 0.0, 100.0),
    ("age", 0.0, 150.0),
)
ROUND_STEP = 10
ROUND_SHARE = 0.95
ROUND_MIN_ROWS = 10
UNIT_FACTORS = (("cents or per-cent scale", 100.0), ("miles against kilometres", 1.609344),
                ("pounds against kilograms", 2.204623), ("thousands", 1000.0))
UNIT_TOLERANCE = 0.02
UNIT_SHARE = 0.05


def placeholder_rules(columns: Sequence[str], tokens: Sequence[str] = PLACEHOLDERS) -> list[RowRule]:
    return [
        RowRule(
            "placeholder", "warning", "semantic", c,
            F.lower(F.trim(F.col(f"`{c}`"))).isin(list(tokens)), F.col(f"`{c}`"),
            f"Found {{n}} placeholder texts used as values in '{c}'", "Store them as missing values.",
        )
        for c in columns
    ]


def domain_rules(columns: Sequence[str]) -> list[RowRule]:
    """Bounds chosen by column name; a name part must be a whole word of the name (``age``, not ``page``)."""
    rules = []
    for c in columns:
        words = f"_{c.lower()}_"
        for part, low, high in DOMAIN_BOUNDS:
            if f"_{part}_" in words:
                v = F.col(f"`{c}`").cast("double")
                rules.append(RowRule(
                    "domain_bounds", "error", "semantic", c, (v < low) | (v > high), v,
                    f"Found {{n}} values outside [{low:g}, {high:g}] in '{c}'", "Such values cannot occur.",
                ))
                break
    return rules


@dataclass(frozen=True)
class DeclaredRule:
    """A business rule stated by the caller: rows where ``expression`` is true break it."""

    rule: str
    severity: str
    expression: str
    message: str = ""


def declared_rules(rules: Sequence[DeclaredRule]) -> list[RowRule]:
    return [
        RowRule(
            r.rule, r.severity, "semantic", r.expression, F.expr(r.expression), F.lit(None),
            r.message or f"Rule '{r.rule}' is broken in {{n}} rows", "Check these rows against the rule.",
        )
        for r in rules
    ]


def events_after_end(
    events: DataFrame, entities: DataFrame, on: str, event_time: str, end_time: str
) -> DataFrame:
    """Events dated after their entity ended (a closed account that still buys); no match is no violation."""
    ends = entities.where(F.col(end_time).isNotNull()).select(on, end_time)
    return events.join(ends, on).where(F.col(event_time) > F.col(end_time))


def roundness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, round_share): share of values that are multiples of ten."""
    v = F.col("value")
    return named(long_values(df, columns).where("value is not null").groupBy("cid").agg(
        F.count(v).alias("n"), F.avg((F.pmod(v, F.lit(float(ROUND_STEP))) == 0).cast("double")).alias("round_share")
    ), columns)


def roundness_findings(df: DataFrame, columns: Sequence[str], start: int = 0) -> DataFrame:
    if not columns:
        return empty_findings(df.sparkSession)
    found = roundness(df, columns).where((F.col("n") >= ROUND_MIN_ROWS) & (F.col("round_share") >= ROUND_SHARE))
    return found.select(*table_finding(
        "roundness", "info", "semantic", F.col("column"), F.col("n"),
        F.format_string("%.1f%% of '%s' are multiples of %d", F.col("round_share") * 100, "column", F.lit(ROUND_STEP)),
        "The values may be estimates.",
        F.create_map(F.lit("round_share"), F.col("round_share").cast("string")), start,
    ))


def unit_mix(df: DataFrame, column: str, group_by: str) -> DataFrame:
    """(group, n, median, factor, n_scaled, share): values about ``factor`` times their group's median.

    Works from value counts, so a hot group is its distinct values; the median is exact at any group size.
    """
    v = F.col(f"`{column}`").cast("double")
    present = df.where(v.isNotNull() & F.col(group_by).isNotNull())
    counts = present.groupBy(F.col(group_by), v.alias("value")).agg(F.count("*").alias("cnt"))
    medians = exact_quantiles(present, [column], [0.5], [group_by]).select(
        group_by, F.col("quantile").alias("median")
    )
    ratio = F.try_divide(F.col("value"), F.col("median"))
    factors = F.explode(F.array(*[F.struct(F.lit(n).alias("unit"), F.lit(f).alias("factor")) for n, f in UNIT_FACTORS]))
    scaled = counts.join(medians, group_by).select(group_by, "cnt", "median", ratio.alias("ratio"), factors.alias("u"))
    near = F.abs(F.col("ratio") / F.col("u.factor") - 1) <= UNIT_TOLERANCE
    return scaled.groupBy(group_by, "median", "u.unit", "u.factor").agg(
        F.sum("cnt").alias("n"), F.coalesce(F.sum(F.when(near, F.col("cnt"))), F.lit(0)).alias("n_scaled")
    ).withColumn("share", F.col("n_scaled") / F.col("n"))


def parse_findings(df: DataFrame, json_column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Findings stored as JSON arrays, one array per row; text that is no such array becomes one info finding."""
    shape = ("array<struct<severity:string,column:string,message:string,suggestion:string,"
             "evidence:map<string,string>>>")
    parsed = F.from_json(F.col(json_column), shape)
    spoiled = parsed.isNull() | ~F.ltrim(F.col(json_column)).startswith("[")
    failure: Column = F.array(F.struct(
        F.lit("info").alias("severity"), F.lit(None).cast("string").alias("column"),
        F.lit("Semantic validation completed but could not parse the response").alias("message"),
        F.lit("Run the semantic validation again.").alias("suggestion"),
        F.create_map().cast("map<string,string>").alias("evidence"),
    ))
    rows = df.select(*keep, F.inline(F.when(spoiled, failure).otherwise(parsed)))
    return rows.select(
        *keep,
        F.coalesce("severity", F.lit("info")).alias("severity"), F.lit("semantic").alias("category"), "column",
        F.coalesce("message", F.lit("")).alias("message"), F.coalesce("suggestion", F.lit("")).alias("suggestion"),
        F.coalesce("evidence", F.create_map().cast("map<string,string>")).alias("evidence"),
    )
