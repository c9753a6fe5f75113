"""Named queries over the standard tables, each with SQL that computes the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.nulls import normalize_nulls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return normalize_nulls(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round result columns so that summation order does not show."""
    return df.withColumns({c: near(F.col(f"`{c}`"), d) for c, d in digits.items()})


def near(c: Column, digits: int) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def r(expression: str, digits: int) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)
