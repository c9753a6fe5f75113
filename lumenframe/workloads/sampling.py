"""Samples, previews and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import normalize_nulls
from ..operators import sample
from ..sources import writers
from .registry import query, table, union_all


@query("head_rows", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def head_rows(spark, sf_dir):
    return sample.data_sample(table(spark, sf_dir, "customer"), ["c_custkey"])


@query("tail_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 25")
def tail_rows(spark, sf_dir):
    return sample.data_sample(table(spark, sf_dir, "customer"), ["c_custkey"], 25, ["c_custkey", "c_name"], "tail")


@query("head_tail", """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn,
count(*) OVER () AS n FROM orders) WHERE rn <= 25 OR rn > n - 25""")
def head_tail(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return sample.sample_table(orders, ["o_orderkey"], 50, "head_tail").select("o_orderkey", "o_totalprice")


@query("random_rows")
def random_rows(spark, sf_dir):
    return sample.data_sample(table(spark, sf_dir, "customer"), ["c_custkey"], 50, strategy="random")


def _invariants(drawn, source, key):
    """What any correct draw shows, whichever rows it holds: size, distinct keys, and rows that are really the table's."""
    members = drawn.join(source, source.columns, "left_semi").agg(F.count("*")).scalar()
    return drawn.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys")).withColumn("n_members", members)


@query("random_rows_invariants", """SELECT least(50, count(*)) AS n, least(50, count(*)) AS n_keys,
least(50, count(*)) AS n_members FROM customer""")
def random_rows_invariants(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return _invariants(sample.data_sample(customers, ["c_custkey"], 50, strategy="random"), customers, "c_custkey")


@query("stratified_sample_invariants", """SELECT sum(q)::BIGINT AS n, sum(q)::BIGINT AS n_keys, sum(q)::BIGINT AS n_members
FROM (SELECT greatest(1, floor(n / t * 50)) AS q FROM (SELECT event_type, count(*)::DOUBLE AS n, sum(count(*)) OVER () AS t
FROM events GROUP BY 1))""")
def stratified_sample_invariants(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return _invariants(sample.stratified_sample(events, "event_type", 50, ["event_id"]), events, "event_id")


@query("stratified_quotas", """SELECT event_type, n AS stratum_rows, greatest(1, floor(n / t * 50))::BIGINT AS quota FROM (
SELECT event_type, count(*)::DOUBLE AS n, sum(count(*)) OVER () AS t FROM events GROUP BY 1)""")
def stratified_quotas(spark, sf_dir):
    return sample.stratified_quotas(table(spark, sf_dir, "events"), "event_type", 50)


@query("stratified_sample")
def stratified_sample(spark, sf_dir):
    return sample.sample_table(table(spark, sf_dir, "events"), ["event_id"], 50, "stratified", "event_type")


@query("stratified_counts", """SELECT event_type, greatest(1, floor(n / t * 50))::BIGINT AS n FROM (
SELECT event_type, count(*)::DOUBLE AS n, sum(count(*)) OVER () AS t FROM events GROUP BY 1)""")
def stratified_counts(spark, sf_dir):
    drawn = sample.stratified_sample(table(spark, sf_dir, "events"), "event_type", 50, ["event_id"])
    return drawn.groupBy("event_type").agg(F.count("*").alias("n"))


@query("ranked_by_magnitude", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def ranked_by_magnitude(spark, sf_dir):
    balances = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return sample.rank_by_magnitude(balances, "c_acctbal", ["c_custkey"], 20)


@query("json_export", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS json
FROM events""")
def json_export(spark, sf_dir):
    return writers.json_rows(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))


@query("csv_lines", """SELECT CASE WHEN rn <= 15 THEN 0 ELSE 2 END AS part, s_suppkey || ',' || s_name || ',' || s_nationkey AS line
FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS rn, count(*) OVER () AS n FROM supplier) WHERE rn <= 15 OR rn > n - 15""")
def csv_lines(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return writers.csv_preview(suppliers, ["s_suppkey"]).select("part", "line")


@query("markdown_table", """SELECT '| s_suppkey | s_name |' || chr(10) || '|---|---|' || chr(10) || string_agg(
'| ' || s_suppkey || ' | ' || s_name || ' |', chr(10) ORDER BY s_suppkey) || CASE WHEN any_value(n) > 30 THEN chr(10) || chr(10)
|| '... (' || any_value(n) - 30 || ' rows omitted) ...' ELSE '' END AS "text" FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS rn,
count(*) OVER () AS n FROM supplier) WHERE n <= 30 OR rn <= 15 OR rn > n - 15""")
def markdown_table(spark, sf_dir):
    return writers.markdown_preview(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@query("null_unification", union_all([
    f"""SELECT '{c}' AS "column", count(x) AS present FROM (SELECT CASE WHEN NOT isnan({c}) THEN {c} END AS x FROM (
    SELECT CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE ELSE l_extendedprice / l_discount END AS price_per_discount,
    l_tax FROM lineitem))""" for c in ("price_per_discount", "l_tax")
]))
def null_unification(spark, sf_dir):
    """Not-a-number results of a division become missing values."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(
            F.try_divide("l_extendedprice", "l_discount")).alias("price_per_discount"), "l_tax",
    )
    clean = normalize_nulls(lines)
    return clean.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("present")) for c in clean.columns
    ]).alias("r")).select(F.inline("r"))
