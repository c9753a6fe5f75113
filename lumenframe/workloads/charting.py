"""Chart data and custom analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, custom
from ..sources.readers import infer_text_types
from .registry import query, r, rounded, table


def _bucket(c: str, bins: int = 30) -> str:
    return f"least(floor(({c} - low) / ((high - low) / {bins})), {bins - 1})::INT + 1"


def _histogram_sql(c: str, source: str, color: str = "") -> str:
    lead = f"{color}, " if color else ""
    return f"""SELECT {lead}b AS bucket, {r('low + (b - 1) * ((high - low) / 30)', 4)} AS lower,
    {r('low + b * ((high - low) / 30)', 4)} AS upper, count(*) AS "count" FROM (SELECT {lead}low, high, {_bucket(c)} AS b
    FROM {source}, (SELECT min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM {source}) WHERE {c} IS NOT NULL)
    GROUP BY {lead}b, low, high"""


@query("histogram_price", _histogram_sql("l_extendedprice", "lineitem"))
def histogram_price(spark, sf_dir):
    return rounded(charts.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"), lower=4, upper=4)


@query("histogram_by_flag", _histogram_sql("l_extendedprice", "lineitem", "l_returnflag"))
def histogram_by_flag(spark, sf_dir):
    found = charts.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")
    return rounded(found, lower=4, upper=4)


@query("histogram_of_text", """SELECT o_orderpriority AS value, count(*) AS "count" FROM orders GROUP BY 1""")
def histogram_of_text(spark, sf_dir):
    return charts.histogram(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("scatter_parts", "SELECT p_size, p_retailprice, p_type FROM part")
def scatter_parts(spark, sf_dir):
    return charts.chart_data(table(spark, sf_dir, "part"), "scatter", "p_size", "p_retailprice", "p_type")


@query("scatter_drawn")
def scatter_drawn(spark, sf_dir):
    return charts.scatter(table(spark, sf_dir, "part"), "p_size", "p_retailprice", ["p_partkey"], points=500)


@query("line_orders", "SELECT o_orderdate, o_totalprice FROM orders")
def line_orders(spark, sf_dir):
    return charts.chart_data(table(spark, sf_dir, "orders"), "line", "o_orderdate", "o_totalprice")


@query("line_daily", f"""SELECT date_trunc('day', ts) AS ts, event_type, {r('avg(value)', 9)} AS value, count(*) AS points
FROM events GROUP BY ALL""")
def line_daily(spark, sf_dir):
    found = charts.line(table(spark, sf_dir, "events"), "ts", "value", "event_type", bucket="day")
    return rounded(found.withColumn("ts", F.col("ts").cast("timestamp_ntz")), value=9)


@query("bar_counts", """SELECT p_brand AS value, count(*) AS "count" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def bar_counts(spark, sf_dir):
    return charts.bar(table(spark, sf_dir, "part"), "p_brand")


@query("bar_sums", f"""SELECT l_returnflag, l_linestatus, {r('sum(l_quantity)', 2)} AS l_quantity FROM lineitem GROUP BY ALL""")
def bar_sums(spark, sf_dir):
    found = charts.bar(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus")
    return rounded(found, l_quantity=2)


def _box_sql(source: str, value: str, by: str) -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    join = f"USING ({by})" if by else "ON true"
    return f"""SELECT {lead}n, {r('q1', 4)} AS q1, {r('median', 4)} AS median, {r('q3', 4)} AS q3,
    min({value}) FILTER ({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
    max({value}) FILTER ({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (NOT ({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
    FROM {source} JOIN (SELECT {lead}count({value}) AS n, quantile_cont({value}, 0.25) AS q1,
    quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3 FROM {source} {group}) {join}
    GROUP BY {lead}n, q1, median, q3"""


@query("box_quantity", _box_sql("lineitem", "l_quantity", "l_returnflag"))
def box_quantity(spark, sf_dir):
    found = charts.box(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])
    return rounded(found, q1=4, median=4, q3=4)


@query("box_values", _box_sql("events", "value", ""))
def box_values(spark, sf_dir):
    found = charts.box(table(spark, sf_dir, "events"), "value").drop("column")
    return rounded(found, q1=4, median=4, q3=4)


@query("pie_segment", f"""SELECT c_mktsegment, n AS value, {r('n / sum(n) OVER ()', 6)} AS share FROM (SELECT c_mktsegment,
count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""")
def pie_segment(spark, sf_dir):
    return rounded(charts.pie(table(spark, sf_dir, "customer"), "c_mktsegment"), share=6)


@query("pie_sums", f"""SELECT o_orderstatus, {r('v', 2)} AS value, {r('v / sum(v) OVER ()', 6)} AS share FROM (
SELECT o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY 1)""")
def pie_sums(spark, sf_dir):
    return rounded(charts.pie(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice"), value=2, share=6)


for _name, _call in (("sum", "sum(l_extendedprice)"), ("mean", "avg(l_extendedprice)"),
                     ("median", "quantile_cont(l_extendedprice, 0.5)")):
    def _aggregated(spark, sf_dir, kind=_name):
        found = charts.chart_data(
            table(spark, sf_dir, "lineitem"), "bar", "l_suppkey", "l_extendedprice", aggregation=kind
        )
        return rounded(found, l_extendedprice=2)

    query(f"agg_{_name}", f"SELECT l_suppkey, {r(_call, 2)} AS l_extendedprice FROM lineitem GROUP BY 1")(_aggregated)


@query("agg_count", "SELECT l_suppkey, count(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1")
def agg_count(spark, sf_dir):
    return charts.aggregate_by(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "count")


@query("pivot_status", f"""SELECT l_returnflag, {r("sum(l_quantity) FILTER (l_linestatus = 'F')", 2)} AS "F",
{r("sum(l_quantity) FILTER (l_linestatus = 'O')", 2)} AS "O" FROM lineitem GROUP BY 1""")
def pivot_status(spark, sf_dir):
    spec = custom.Analysis(
        group_by=["l_returnflag"], aggregates={"quantity": "sum(l_quantity)"}, pivot="l_linestatus"
    )
    return rounded(custom.analyze(table(spark, sf_dir, "lineitem"), spec), F=2, O=2)


@query("calc_filter_sort", f"""SELECT l_returnflag, count(*) AS n, {r('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 10 GROUP BY 1 HAVING count(*) > 100""")
def calc_filter_sort(spark, sf_dir):
    spec = custom.Analysis(
        where="l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AND l_quantity > 10",
        columns={"net": "l_extendedprice * (1 - l_discount)"},
        group_by=["l_returnflag"], aggregates={"n": "count(*)", "revenue": "sum(net)"}, having="n > 100",
        order_by=["revenue desc"],
    )
    return rounded(custom.analyze(table(spark, sf_dir, "lineitem"), spec), revenue=2)


@query("calculated_columns", """SELECT o_orderkey, year(o_orderdate) AS order_year, round(o_totalprice / 1000, 3) AS thousands
FROM orders WHERE o_orderstatus = 'O'""")
def calculated_columns(spark, sf_dir):
    spec = custom.Analysis(
        where="o_orderstatus = 'O'",
        columns={"order_year": "year(o_orderdate)", "thousands": "round(o_totalprice / 1000, 3)"},
        select=["o_orderkey", "order_year", "thousands"],
    )
    return custom.analyze(table(spark, sf_dir, "orders"), spec)


@query("sql_rollup", f"""SELECT o_orderstatus, o_orderpriority, count(*) AS n, {r('avg(o_totalprice)', 4)} AS mean_price
FROM orders WHERE o_totalprice > 1000 GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def sql_rollup(spark, sf_dir):
    found = custom.sql(
        table(spark, sf_dir, "orders"),
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean_price FROM {data} "
        "WHERE o_totalprice > :floor GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", floor=1000,
    )
    return rounded(found, mean_price=4)


@query("scalar_result", f"SELECT {r('avg(o_totalprice)', 4)} AS value FROM orders")
def scalar_result(spark, sf_dir):
    mean = custom.analyze(table(spark, sf_dir, "orders"), custom.Analysis(aggregates={"m": "avg(o_totalprice)"}))
    return rounded(custom.as_scalar(mean), value=4)


@query("series_result", "SELECT p_type AS label, count(*) AS value FROM part GROUP BY 1")
def series_result(spark, sf_dir):
    spec = custom.Analysis(group_by=["p_type"], aggregates={"n": "count(*)"})
    return custom.as_series(custom.analyze(table(spark, sf_dir, "part"), spec))


@query("table_result", """SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS rn,
count(*) OVER () AS n FROM supplier) WHERE n <= 30 OR rn <= 15 OR rn > n - 15""")
def table_result(spark, sf_dir):
    return custom.as_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@query("inferred_types", f"""SELECT {r('sum(o_totalprice)', 2)} AS price_sum, sum(o_custkey)::BIGINT AS key_sum, count(open) AS open_known,
'bigint,double,boolean,string' AS kinds FROM (SELECT *, o_orderstatus = 'O' AS open FROM orders)""")
def inferred_types(spark, sf_dir):
    """Orders as a delimited file would hold them, all text, given back their types."""
    texts = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string"),
        (F.col("o_orderstatus") == "O").cast("string").alias("open"), "o_orderpriority",
    )
    typed = infer_text_types(texts)
    kinds = ",".join(kind for _, kind in typed.dtypes)
    return rounded(typed.agg(
        F.sum("o_totalprice").alias("price_sum"), F.sum("o_custkey").alias("key_sum"),
        F.count("open").alias("open_known"),
    ).withColumn("kinds", F.lit(kinds)), price_sum=2)
