"""Feature importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import importance, profile
from .registry import query, r, rounded, table, union_all

_FEATURES = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus")


def _binned(c: str) -> str:
    if c in ("l_returnflag", "l_linestatus"):
        return c
    return f"""(SELECT CASE WHEN low = high THEN '0' ELSE least(floor(({c} - low) / (high - low) * 32), 31)::INT::VARCHAR END
    FROM (SELECT min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM lineitem))"""


def _mi_sql(features, target: str) -> str:
    return union_all([
        f"""SELECT '{f}' AS feature, {r('greatest(0.0, sum(nxy / n * ln(nxy * n / (nx * ny))))', 4)} AS score FROM (
        SELECT x, y, nxy, sum(nxy) OVER (PARTITION BY x) AS nx, sum(nxy) OVER (PARTITION BY y) AS ny, sum(nxy) OVER () AS n
        FROM (SELECT {_binned(f)} AS x, {_binned(target)} AS y, count(*)::DOUBLE AS nxy FROM lineitem GROUP BY 1, 2))"""
        for f in features
    ])


@query("mi_returnflag", _mi_sql(_FEATURES, "l_returnflag"))
def mi_returnflag(spark, sf_dir):
    numeric = [f for f in _FEATURES if f != "l_linestatus"]
    found = importance.mutual_information(
        table(spark, sf_dir, "lineitem"), _FEATURES, "l_returnflag", numeric, binning="width"
    )
    return rounded(found, score=4)


@query("mi_price", _mi_sql(("l_quantity", "l_discount", "l_linestatus"), "l_extendedprice"))
def mi_price(spark, sf_dir):
    found = importance.mutual_information(
        table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_linestatus"], "l_extendedprice",
        ["l_quantity", "l_discount", "l_extendedprice"], binning="width",
    )
    return rounded(found, score=4)


@query("mi_quantile_bins")
def mi_quantile_bins(spark, sf_dir):
    return importance.mutual_information(
        table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_linestatus"], "l_extendedprice",
        ["l_quantity", "l_discount", "l_extendedprice"],
    )


@query("rf_importance")
def rf_importance(spark, sf_dir):
    """The forest of the importance report on parts: which columns predict the list price."""
    return importance.forest_importance(
        table(spark, sf_dir, "part"), ["p_size", "p_brand", "p_type"], "p_retailprice", ["p_size", "p_retailprice"]
    )


@query("label_codes", """SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part""")
def label_codes(spark, sf_dir):
    return importance.label_encode(table(spark, sf_dir, "part"), "p_type", "code").select("p_partkey", "p_type", "code")


_NUMBERS = ("l_linenumber", "l_quantity", "l_discount", "l_tax")


def _score_sql(target: str, features=_NUMBERS) -> str:
    return union_all([
        f"SELECT '{f}' AS feature, {r(f'corr({f}, {target})', 4)} AS score FROM lineitem" for f in features
    ])


@query("corr_importance", _score_sql("l_extendedprice"))
def corr_importance(spark, sf_dir):
    found = importance.target_correlations(
        table(spark, sf_dir, "lineitem"), _NUMBERS, "l_extendedprice", _NUMBERS
    )
    return rounded(found, score=4)


@query("combined_rank", f"""SELECT feature, round(avg(place), 4) + 0.0 AS avg_score FROM (
SELECT feature, 1.0 - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY method) AS place FROM (
SELECT method, feature, row_number() OVER (PARTITION BY method ORDER BY abs(score) DESC, feature) AS rank FROM (
SELECT 'correlation' AS method, * FROM ({_score_sql("l_extendedprice")})
UNION ALL SELECT 'mutual_information', * FROM ({_mi_sql((*_NUMBERS, "l_linestatus"), "l_extendedprice")})))) GROUP BY feature""")
def combined_rank(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    numeric = (*_NUMBERS, "l_extendedprice")
    by_correlation = importance.target_correlations(lines, _NUMBERS, "l_extendedprice", numeric)
    by_information = importance.mutual_information(
        lines, (*_NUMBERS, "l_linestatus"), "l_extendedprice", numeric, binning="width"
    )
    stacked = by_correlation.select(F.lit("correlation").alias("method"), "feature", "score").unionByName(
        by_information.select(F.lit("mutual_information").alias("method"), "feature", "score")
    )
    return rounded(importance.combine_rankings(stacked), avg_score=4)


@query("importance_report")
def importance_report(spark, sf_dir):
    """All methods together for the account balance of customers."""
    customer = table(spark, sf_dir, "customer")
    known = profile.infer_profile(customer, {"c_acctbal": "numeric", "c_nationkey": "categorical"})
    return importance.feature_importance(customer, known, "c_acctbal")["combined_ranking"]
