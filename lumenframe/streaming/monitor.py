"""Continuous checking: the stateless row rules applied to a stream, counted per rule and time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.findings import RowRule, _broken, _key_text


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A stream over files arriving in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_violations(stream: DataFrame, rules: Sequence[RowRule], key: Sequence[str], event_time: str) -> DataFrame:
    """(event_time, rule, column, row_key, value) of every broken rule; no state is kept."""
    names = F.array(*[F.struct(F.lit(r.rule).alias("rule"), F.lit(r.column).alias("column")) for r in rules])
    carried = list(dict.fromkeys([*key, event_time]))
    broken = _broken(stream, rules, carried).withColumn("__r", F.get(names, F.col("rule_no")))
    return broken.select(
        F.col(f"__key.{event_time}").alias(event_time), "__r.rule", "__r.column",
        _key_text("__key", key).alias("row_key"), "value",
    )


def rule_counts(
    violations: DataFrame, event_time: str, window: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Violations per rule, column and time window; windows close once the watermark passes them."""
    stamped = violations.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return (
        stamped.withWatermark(event_time, lateness)
        .groupBy(F.window(event_time, window), "rule", "column").agg(F.count("*").alias("n_rows"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rule", "column", "n_rows")
    )
