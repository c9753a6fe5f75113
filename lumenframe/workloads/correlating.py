"""Correlations by three methods."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.moments import safe_corr
from ..operators import charts, correlation
from .derived import FULFILLMENT_SQL, fulfillment
from .registry import near, query, r, rounded, table, union_all

_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax")
_PART_NUMBERS = ("p_partkey", "p_size", "p_retailprice")
_ORDER_NUMBERS = ("o_totalprice", "first_quantity", "shipped_value")


def _corr_sql(source: str, pairs, digits: int = 6) -> str:
    return union_all([
        f"""SELECT '{a}' AS column_1, '{b}' AS column_2, count(*) AS n, {r(f'corr({a}, {b})', digits)} AS correlation
        FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
        for a, b in pairs
    ])


@query("pearson_lineitem", _corr_sql("lineitem", combinations(_LINE_NUMBERS, 2)))
def pearson_lineitem(spark, sf_dir):
    return rounded(correlation.correlations(table(spark, sf_dir, "lineitem")), correlation=6)


_COMPLETE_SQL = f"""(SELECT * FROM {FULFILLMENT_SQL} WHERE o_totalprice IS NOT NULL AND first_quantity IS NOT NULL
  AND shipped_value IS NOT NULL)"""


@query("pearson_listwise", _corr_sql(_COMPLETE_SQL, combinations(_ORDER_NUMBERS, 2)))
def pearson_listwise(spark, sf_dir):
    return rounded(correlation.correlations(fulfillment(spark, sf_dir), list(_ORDER_NUMBERS)), correlation=6)


_RANKED_LINES = f"""(SELECT {", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _LINE_NUMBERS
)} FROM lineitem)"""


@query("spearman_lineitem", _corr_sql(_RANKED_LINES, combinations(_LINE_NUMBERS, 2)))
def spearman_lineitem(spark, sf_dir):
    return rounded(correlation.correlations(table(spark, sf_dir, "lineitem"), method="spearman"), correlation=6)


@query("kendall_part", """SELECT (SELECT count(*) FROM part) AS n, d AS discordant, round((c - d) / (sqrt(t - tx) * sqrt(t - ty)), 6) + 0.0
AS correlation FROM (SELECT count(*) FILTER ((a.p_size - b.p_size) * (a.p_retailprice - b.p_retailprice) > 0)::DOUBLE AS c,
count(*) FILTER ((a.p_size - b.p_size) * (a.p_retailprice - b.p_retailprice) < 0)::DOUBLE AS d, count(*)::DOUBLE AS t,
count(*) FILTER (a.p_size = b.p_size)::DOUBLE AS tx, count(*) FILTER (a.p_retailprice = b.p_retailprice)::DOUBLE AS ty
FROM part a JOIN part b ON a.p_partkey < b.p_partkey)""")
def kendall_part(spark, sf_dir):
    tau = correlation.kendall_tau(table(spark, sf_dir, "part"), "p_size", "p_retailprice")
    return rounded(tau, correlation=6)


@query("kendall_matrix", union_all([
    f"""SELECT '{a}' AS column_1, '{b}' AS column_2, (SELECT count(*) FROM part) AS n, round((count(*) FILTER (
    (a.{a} - b.{a}) * (a.{b} - b.{b}) > 0) - count(*) FILTER ((a.{a} - b.{a}) * (a.{b} - b.{b}) < 0))
    / (sqrt(count(*) FILTER (a.{a} <> b.{a})) * sqrt(count(*) FILTER (a.{b} <> b.{b}))), 6) + 0.0 AS correlation
    FROM part a JOIN part b ON a.p_partkey < b.p_partkey"""
    for a, b in combinations(_PART_NUMBERS, 2)
]))
def kendall_matrix(spark, sf_dir):
    found = correlation.correlations(table(spark, sf_dir, "part"), method="kendall")
    return rounded(found, correlation=6)


@query("correlation_matrix", union_all([
    f"""SELECT '{a}' AS column_1, '{b}' AS column_2, {r(f'corr({a}, {b})', 4)} AS correlation FROM part"""
    for a in _PART_NUMBERS for b in _PART_NUMBERS
]))
def correlation_matrix(spark, sf_dir):
    full = correlation.correlation_matrix(correlation.correlations(table(spark, sf_dir, "part")))
    return rounded(full, correlation=4)


_SIGNIFICANT_SQL = f"""(SELECT column_1, column_2, round(correlation, 4) + 0.0 AS correlation, CASE
  WHEN abs(correlation) >= 0.8 THEN 'very strong' WHEN abs(correlation) >= 0.6 THEN 'strong'
  WHEN abs(correlation) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction
  FROM ({union_all([
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, corr({a}, {b}) AS correlation FROM {_COMPLETE_SQL}"
    for a, b in combinations(_ORDER_NUMBERS, 2)])}) WHERE abs(correlation) >= 0.01)"""


@query("significant_correlations", f"SELECT * FROM {_SIGNIFICANT_SQL}")
def significant_correlations(spark, sf_dir):
    upper = correlation.correlations(fulfillment(spark, sf_dir), list(_ORDER_NUMBERS))
    return rounded(correlation.significant_pairs(upper, 0.01), correlation=4)


@query("strongest_correlations", f"""SELECT direction, column_1, column_2, correlation, strength FROM (SELECT *, row_number() OVER (
PARTITION BY direction ORDER BY abs(correlation) DESC) AS rn FROM {_SIGNIFICANT_SQL}) WHERE rn = 1""")
def strongest_correlations(spark, sf_dir):
    upper = correlation.correlations(fulfillment(spark, sf_dir), list(_ORDER_NUMBERS))
    return rounded(correlation.strongest(upper, 0.01), correlation=4)


@query("heatmap", union_all([
    f"""SELECT '{a}' AS column_1, '{b}' AS column_2, {r(f'corr({a}, {b})', 4)} AS correlation
    FROM {FULFILLMENT_SQL}""" for a in _ORDER_NUMBERS for b in _ORDER_NUMBERS
]))
def heatmap(spark, sf_dir):
    return rounded(charts.heatmap(fulfillment(spark, sf_dir), list(_ORDER_NUMBERS)), correlation=4)


@query("correlation_by_group", f"""SELECT l_returnflag, {r('corr(l_quantity, l_extendedprice)', 6)} AS correlation,
NULL::DOUBLE AS against_constant FROM lineitem GROUP BY l_returnflag""")
def correlation_by_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    return lines.groupBy("l_returnflag").agg(
        near(safe_corr(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("correlation"),
        safe_corr(F.col("l_quantity"), F.col("one")).alias("against_constant"),
    )
