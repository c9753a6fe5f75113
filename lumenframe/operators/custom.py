"""Custom analyses stated as a specification or as SQL over the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F

from .sample import head, tail

# Fixed value: rows of a table result before it is shortened to its first and last half.
TABLE_ROWS = 30


@dataclass(frozen=True)
class Analysis:
    """Filter, then calculated columns, then grouping (optionally pivoted), then sort and limit."""

    where: str | None = None
    columns: Mapping[str, str] = field(default_factory=dict)
    group_by: Sequence[str] = ()
    aggregates: Mapping[str, str] = field(default_factory=dict)
    pivot: str | None = None
    pivot_values: Sequence[Any] | None = None
    having: str | None = None
    select: Sequence[str] = ()
    order_by: Sequence[str] = ()
    limit: int | None = None


def _sort_key(text: str) -> Column:
    name, _, way = text.strip().rpartition(" ")
    if way.lower() in ("asc", "desc") and name:
        return F.expr(name).desc() if way.lower() == "desc" else F.expr(name).asc()
    return F.expr(text)


def pivot_values(df: DataFrame, column: str) -> list:
    """The values of a pivot column in order, each of which becomes a column; Spark's own limit for that holds."""
    k = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(k + 1).collect()]
    if len(found) > k:
        raise ValueError(f"'{column}' has more than {k} values to pivot on; name the wanted ones")
    return sorted(found)


def analyze(df: DataFrame, spec: Analysis) -> DataFrame:
    """Run a specification; every part is an ordinary expression, so filters and pruning reach the scan."""
    result = df
    if spec.where:
        result = result.where(spec.where)
    for name, expression in spec.columns.items():
        result = result.withColumn(name, F.expr(expression))
    if spec.aggregates:
        measures = [F.expr(e).alias(name) for name, e in spec.aggregates.items()]
        grouped = result.groupBy(*spec.group_by)
        if spec.pivot:
            values = list(spec.pivot_values) if spec.pivot_values else pivot_values(result, spec.pivot)
            grouped = grouped.pivot(spec.pivot, values)
        result = grouped.agg(*measures)
    if spec.having:
        result = result.where(spec.having)
    if spec.order_by:
        result = result.orderBy(*[_sort_key(k) for k in spec.order_by])
    if spec.limit is not None:
        result = result.limit(spec.limit)
    return result.select(*spec.select) if spec.select else result


def sql(df: DataFrame, text: str, name: str = "data", **parameters: Any) -> DataFrame:
    """Run SQL over the table, referred to as ``{data}``; values go in as named parameters."""
    view = f"{name}_{uuid4().hex}"
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(text.replace("{" + name + "}", view), args=parameters or None)


def as_scalar(result: DataFrame) -> DataFrame:
    """A result of one row and one column, named ``value``; anything else is an error at run time."""
    column = result.columns[0]
    return result.agg(F.when(F.count(F.lit(1)) == 1, F.first(F.col(f"`{column}`"))).otherwise(
        F.raise_error(F.lit("the result is not a single row"))
    ).alias("value"))


def as_series(result: DataFrame) -> DataFrame:
    """The first two columns as (label, value)."""
    label, value = result.columns[:2]
    return result.select(F.col(f"`{label}`").alias("label"), F.col(f"`{value}`").alias("value"))


def as_table(result: DataFrame, key: Sequence[str], max_rows: int = TABLE_ROWS) -> DataFrame:
    """The first and last half of a long result, whole if it is short (rows counted by the plan itself)."""
    half = max_rows // 2
    long = head(result, max_rows + 1, key).agg((F.count(F.lit(1)) > max_rows).alias("long")).scalar()
    whole = head(result, max_rows, key).where(~long)
    return whole.unionByName(head(result, half, key).where(long)).unionByName(tail(result, half, key).where(long))
