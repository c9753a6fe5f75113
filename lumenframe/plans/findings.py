"""From row rules to violations, and from violations to findings.

All row rules of a table are evaluated in one scan, whose broken rows (key and value) are kept once. A finding lists at most twenty row keys, taken by a
ranked limit that Spark applies inside each partition before the shuffle, so a rule broken by most of the
table costs no more than a count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import ensure_checkpoint_dir

# Row keys and example values shown in a finding.
SHOWN_KEYS = 20
SHOWN_VALUES = 5

FINDING_SCHEMA = (
    "rule string, severity string, category string, column string, n_rows bigint, "
    "row_keys array<string>, message string, suggestion string, evidence map<string,string>, position int"
)


@dataclass(frozen=True)
class RowRule:
    """A predicate on one row and how a finding about it reads; ``{n}`` in the message is the row count."""

    rule: str
    severity: str
    category: str
    column: str
    condition: Column
    value: Column
    message: str
    suggestion: str
    evidence: dict[str, str] = field(default_factory=dict)
    below_rows: float | None = None


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING_SCHEMA)


def _rule_table(spark: SparkSession, rules: Sequence[RowRule], positions: Sequence[int]) -> DataFrame:
    rows = [
        (i, r.rule, r.severity, r.category, r.column, r.message, r.suggestion, r.evidence, r.below_rows, positions[i])
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(
        rows,
        "rule_no int, rule string, severity string, category string, column string, template string, "
        "suggestion string, facts map<string,string>, below_rows double, position int",
    )


def _broken(df: DataFrame, rules: Sequence[RowRule], key: Sequence[str]) -> DataFrame:
    entries = F.array_compact(F.array(*[
        F.when(r.condition, F.struct(F.lit(i).alias("rule_no"), r.value.cast("string").alias("value")))
        for i, r in enumerate(rules)
    ]))
    return df.select(F.struct(*[F.col(k) for k in key]).alias("__key"), F.inline(entries))


def _key_text(c: str, key: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(f"{c}.{k}").cast("string") for k in key])


def violations(df: DataFrame, rules: Sequence[RowRule], key: Sequence[str]) -> DataFrame:
    """Every broken rule of every row -> (rule, column, row_key, value). Works on streams as well."""
    names = F.array(*[F.struct(F.lit(r.rule).alias("rule"), F.lit(r.column).alias("column")) for r in rules])
    broken = _broken(df, rules, key).withColumn("__r", F.get(names, F.col("rule_no")))
    return broken.select("__r.rule", "__r.column", _key_text("__key", key).alias("row_key"), "value")


def row_findings(
    df: DataFrame, rules: Sequence[RowRule], key: Sequence[str], positions: Sequence[int] | None = None
) -> DataFrame:
    """One finding per broken rule with its count, first row keys and example values.

    ``positions`` say where each rule's finding stands in the report (default: the order given).
    """
    spark = df.sparkSession
    if not rules:
        return empty_findings(spark)
    ensure_checkpoint_dir(spark)
    broken = _broken(df, rules, key).checkpoint()  # keys and values only; counted and ranked from one scan of the table
    counts = broken.groupBy("rule_no").agg(F.count("*").alias("n_rows"))
    order = W.partitionBy("rule_no").orderBy("__key")
    shown = (
        broken.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= SHOWN_KEYS)
        .groupBy("rule_no")
        # at most SHOWN_KEYS entries per rule reach this list
        .agg(F.array_sort(F.collect_list(
            F.struct("rn", _key_text("__key", key).alias("row_key"), "value")
        )).alias("shown"))
    )
    table = _rule_table(spark, rules, positions or range(len(rules)))
    joined = counts.join(F.broadcast(table), "rule_no").join(F.broadcast(shown), "rule_no")
    examples = F.array_join(F.slice(F.transform("shown", lambda s: s["value"]), 1, SHOWN_VALUES), ", ")
    return joined.where(F.col("below_rows").isNull() | (F.col("n_rows") < F.col("below_rows"))).select(
        "rule", "severity", "category", "column", "n_rows",
        F.transform("shown", lambda s: s["row_key"]).alias("row_keys"),
        F.replace("template", F.lit("{n}"), F.col("n_rows").cast("string")).alias("message"),
        "suggestion",
        F.map_concat("facts", F.create_map(
            F.lit("count"), F.col("n_rows").cast("string"), F.lit("examples"), examples
        )).alias("evidence"),
        "position",
    )


def table_finding(
    rule: str,
    severity: Column | str,
    category: str,
    column: Column,
    n_rows: Column,
    message: Column,
    suggestion: Column | str,
    evidence: Column,
    position: Column | int,
    row_keys: Column | None = None,
) -> list[Column]:
    """Columns of a finding that is about a column or table rather than single rows."""
    def as_column(x):
        return x if isinstance(x, Column) else F.lit(x)

    keys = row_keys if row_keys is not None else F.lit(None)
    return [
        F.lit(rule).alias("rule"),
        as_column(severity).alias("severity"),
        F.lit(category).alias("category"),
        column.cast("string").alias("column"),
        n_rows.cast("bigint").alias("n_rows"),
        keys.cast("array<string>").alias("row_keys"),
        message.alias("message"),
        as_column(suggestion).alias("suggestion"),
        evidence.cast("map<string,string>").alias("evidence"),
        as_column(position).cast("int").alias("position"),
    ]
