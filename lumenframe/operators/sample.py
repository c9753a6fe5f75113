"""Projections, previews and representative samples, all planned as top-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .profile import TableProfile

SEED = 42
# Rows of the default sample, most rows of a preview request.
SAMPLE_ROWS = 50
PREVIEW_LIMIT = 50


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"Columns not found: {unknown}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def head(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    return df.orderBy(*key).limit(n)


def tail(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """The last n rows in key order, in ascending order again."""
    return df.orderBy(*[F.desc(k) for k in key]).limit(n).orderBy(*key)


def random_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Exactly n rows (or all), drawn by hashing the row key: repeatable whatever the partitioning."""
    draw = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    return df.orderBy(draw, *key).limit(n)


def head_tail(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    return head(df, n // 2, key).unionByName(tail(df, n - n // 2, key))


def stratified_quotas(df: DataFrame, column: str, n: int) -> DataFrame:
    """(column value, stratum_rows, quota): each stratum's share of n, at least one row."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("stratum_rows"))
    total = counts.agg(F.sum("stratum_rows").alias("t")).scalar()
    share = F.col("stratum_rows") / total
    return counts.withColumn("quota", F.greatest(F.lit(1), F.floor(share * n)).cast("bigint"))


def stratified_sample(df: DataFrame, column: str, n: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Proportional sample per value of a categorical column, commonest strata first, n rows at most.

    Only the n commonest strata can reach the result, so the quota table is bounded by n; joined first, it keeps the
    rows of all other strata out of the shuffle. No stratum keeps more than n rows: the window runs behind a
    per-partition group limit.
    """
    quotas = stratified_quotas(df, column, n).orderBy(F.desc("stratum_rows"), column).limit(n)
    draw = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    order = W.partitionBy(column).orderBy("__draw", *key)
    wanted = df.join(F.broadcast(quotas), column).withColumn("__draw", draw)
    ranked = wanted.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= n)
    kept = ranked.where(F.col("__rn") <= F.col("quota"))
    return (
        kept.orderBy(F.desc("stratum_rows"), column, "__rn").limit(n)
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


def sample_table(
    df: DataFrame,
    key: Sequence[str],
    n: int = SAMPLE_ROWS,
    strategy: str = "stratified",
    stratify_by: str | None = None,
    n_rows: int | None = None,
    profile: TableProfile | None = None,
) -> DataFrame:
    """Dispatch on strategy; a table known to be no larger than the sample is returned whole.

    Unless told by which column to stratify, the profile's first categorical column is taken; without one the
    sample is random.
    """
    if n_rows is not None and n_rows <= n:
        return df
    by = stratify_by or next(iter(profile.categorical if profile else ()), None)
    if strategy == "stratified" and by:
        return stratified_sample(df, by, n, key)
    if strategy == "head_tail":
        return head_tail(df, n, key)
    return random_sample(df, n, key)


def data_sample(
    df: DataFrame, key: Sequence[str], n_rows: int = 10, columns: Sequence[str] | None = None, strategy: str = "head"
) -> DataFrame:
    """The sample a user asks for by name: head, tail or random, at most 50 rows."""
    n = min(n_rows, PREVIEW_LIMIT)
    chosen = {"random": random_sample, "tail": tail}.get(strategy, head)(df, n, key)
    return select_columns(chosen, columns) if columns else chosen


def rank_by_magnitude(df: DataFrame, score: str, names: Sequence[str], k: int) -> DataFrame:
    """The k rows of largest absolute score, ties by name."""
    return df.orderBy(F.desc(F.abs(F.col(score))), *names).limit(k)
