"""Profiles, statistics and missing data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe, missing, profile
from .derived import FULFILLMENT_SQL, LABELED_SQL, fulfillment, labeled_documents
from .registry import near, query, r, rounded, table, union_all

_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax")
_LINE_COLUMNS = (*_LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate")


def _missing_sql(source: str, columns) -> str:
    return union_all([
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS missing_count,
        round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS missing_pct FROM {source}"""
        for c in columns
    ])


@query("profile_lineitem", _missing_sql("lineitem", _LINE_COLUMNS))
def profile_lineitem(spark, sf_dir):
    return profile.missing_summary(table(spark, sf_dir, "lineitem"))


@query("boolean_profile", union_all([
    f"""SELECT '{c}' AS "column", 'boolean' AS dtype, 'boolean' AS semantic_class, count(*) AS row_count, count(*) - count(x) AS missing_count,
    round(100.0 * (count(*) - count(x)) / count(*), 2)::DOUBLE AS missing_pct FROM (SELECT {x} AS x FROM documents)"""
    for c, x in (("is_long", "n_chars > 500"), ("is_even", "CASE WHEN n_chars % 3 <> 0 THEN n_chars % 2 = 0 END"))
]))
def boolean_profile(spark, sf_dir):
    flags = table(spark, sf_dir, "documents").select(
        (F.col("n_chars") > 500).alias("is_long"), F.when(F.col("n_chars") % 3 != 0, F.col("n_chars") % 2 == 0).alias("is_even"))
    return profile.infer_profile(flags).to_df(spark).where("is_boolean").select(
        "column", "dtype", "semantic_class", "row_count", "missing_count", "missing_pct")


@query("missing_summary", _missing_sql(LABELED_SQL, ("doc_id", "lang", "source", "n_chars", "quality", "toxic")))
def missing_summary(spark, sf_dir):
    return profile.missing_summary(labeled_documents(spark, sf_dir))


# Order dates written in ten ways: Spark's pattern and the layout it must be recognised in.
_WRITTEN = {
    "iso_zone": ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-M-d'T'H:mm[:ss[.SSSSSSSSS]][ ][XXX][XX]"),
    "iso_offset": ("yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-M-d'T'H:mm[:ss[.SSSSSSSSS]][ ][XXX][XX]"),
    "millis": ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-M-d H:mm[:ss[.SSSSSSSSS]][ ][XXX][XX]"),
    "minutes": ("yyyy-MM-dd HH:mm", "yyyy-M-d H:mm[:ss[.SSSSSSSSS]][ ][XXX][XX]"),
    "plain": ("yyyy-MM-dd", "yyyy-M-d"), "unpadded": ("M/d/yyyy", "M/d/yyyy[ H:mm[:ss[.SSSSSSSSS]]]"),
    "dotted": ("d.M.yyyy", "d.M.yyyy[ H:mm[:ss[.SSSSSSSSS]]]"), "slashed": ("yyyy/M/d", "yyyy/M/d[ H:mm[:ss[.SSSSSSSSS]]]"),
    "short_name": ("MMM d, yyyy", "MMM d[,] yyyy[ H:mm[:ss[.SSSSSSSSS]]]"),
    "day_first": ("d MMM yyyy", "d MMM yyyy[ H:mm[:ss[.SSSSSSSSS]]]"),
}


def _written_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*[
        F.date_format("o_orderdate", pattern).alias(name) for name, (pattern, _) in _WRITTEN.items()])


@query("date_layouts", union_all([
    f"""SELECT '{name}' AS "column", count(*) AS row_count, 'datetime' AS semantic_class,
    min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders""" for name in _WRITTEN]))
def date_layouts(spark, sf_dir):
    written = _written_dates(spark, sf_dir)
    found = profile.infer_profile(written)
    dated = found.with_datetimes(written)
    spans = [F.struct(
        F.lit(c.column).alias("column"), F.count(F.lit(1)).alias("row_count"), F.lit(c.semantic_class).alias("semantic_class"),
        F.min(F.col(c.column).cast("timestamp_ntz")).alias("first_date"),
        F.max(F.col(c.column).cast("timestamp_ntz")).alias("last_date")) for c in found.columns]
    return dated.agg(F.array(*spans).alias("s")).select(F.inline("s"))


_CLASS_COLUMNS = {
    "customer": (("c_custkey", "num"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "num"),
                 ("c_mktsegment", "text")),
    "documents": (("doc_id", "num"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "num")),
    "events": (("event_id", "num"), ("ts", "time"), ("user_id", "num"), ("event_type", "text"), ("value", "num"),
               ("props", "text")),
}


def _class_sql(name: str) -> str:
    parts = []
    for c, kind in _CLASS_COLUMNS[name]:
        if any(p in c for p in profile.IDENTIFIER_PARTS):
            chosen = "'identifier'"
        elif kind == "time":
            chosen = "'datetime'"
        elif kind == "int":
            chosen = "'numeric'"
        elif kind == "num":
            chosen = f"CASE WHEN count(*) > 10 AND count(DISTINCT {c}) = count(*) THEN 'identifier' ELSE 'numeric' END"
        else:
            chosen = f"""CASE WHEN count(*) > 10 AND count(DISTINCT {c}) > 0.9 * count(*) THEN 'identifier'
            WHEN avg(length({c})) > 50 THEN 'text' ELSE 'categorical' END"""
        parts.append(f"""SELECT '{name}' AS "table", '{c}' AS "column", {chosen} AS semantic_class,
        count(*) - count({c}) AS missing_count FROM {name}""")
    return union_all(parts)


@query("semantic_types", union_all([_class_sql(name) for name in _CLASS_COLUMNS]))
def semantic_types(spark, sf_dir):
    parts = [
        profile.infer_profile(table(spark, sf_dir, name)).to_df(spark).select(
            F.lit(name).alias("table"), "column", "semantic_class", "missing_count"
        )
        for name in _CLASS_COLUMNS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("distinct_counts", union_all([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM orders"""
    for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
]))
def distinct_counts(spark, sf_dir):
    columns = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    found = profile.exact_distinct(table(spark, sf_dir, "orders"), columns)
    return spark.createDataFrame(list(found.items()), "column string, n_distinct bigint")


def _stats_sql(source: str, columns, by: str = "") -> str:
    group, lead = (f" GROUP BY {by}", f"{by}, ") if by else ("", "")
    return union_all([
        f"""SELECT {lead}'{c}' AS "column", count({c}) AS "count", {r(f'avg({c})', 4)} AS mean,
        {r(f'stddev_samp({c})', 4)} AS std, min({c})::DOUBLE AS "min", {r(f'quantile_cont({c}::DOUBLE, 0.25)', 4)} AS q25,
        {r(f'quantile_cont({c}::DOUBLE, 0.5)', 4)} AS median, {r(f'quantile_cont({c}::DOUBLE, 0.75)', 4)} AS q75,
        max({c})::DOUBLE AS "max",
        CASE WHEN min({c}) = max({c}) AND count({c}) >= 3 THEN 0.0 ELSE {r(f'skewness({c})', 5)} END AS skewness,
        CASE WHEN min({c}) = max({c}) AND count({c}) >= 4 THEN 0.0 ELSE {r(f'kurtosis({c})', 5)} END AS kurtosis,
        count(*) - count({c}) AS missing_count, count({c}) = 0 AS all_missing FROM {source}{group}"""
        for c in columns
    ])


_DIGITS = {"mean": 4, "std": 4, "q25": 4, "median": 4, "q75": 4, "skewness": 5, "kurtosis": 5}


@query("describe_lineitem", _stats_sql("lineitem", _LINE_NUMBERS))
def describe_lineitem(spark, sf_dir):
    return rounded(describe.numeric_summary(table(spark, sf_dir, "lineitem")), **_DIGITS)


@query("describe_fulfillment", _stats_sql(FULFILLMENT_SQL, ("o_totalprice", "first_quantity", "shipped_value")))
def describe_fulfillment(spark, sf_dir):
    columns = ["o_totalprice", "first_quantity", "shipped_value"]
    return rounded(describe.numeric_summary(fulfillment(spark, sf_dir), columns), **_DIGITS)


@query("grouped_stats_returnflag", _stats_sql("lineitem", _LINE_NUMBERS, "l_returnflag"))
def grouped_stats_returnflag(spark, sf_dir):
    return rounded(describe.grouped_summary(table(spark, sf_dir, "lineitem"), "l_returnflag"), **_DIGITS)


def _top_sql(source: str, columns, k: int) -> str:
    return union_all([
        f"""SELECT '{c}' AS "column", rank, value, "count" FROM (SELECT {c} AS value, count(*) AS "count",
        row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})
        WHERE rank <= {k}"""
        for c in columns
    ])


@query("top_values_orders", _top_sql("orders", ("o_orderstatus", "o_orderpriority"), 10))
def top_values_orders(spark, sf_dir):
    top = describe.top_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], 10)
    return top.select("column", F.col("rank").cast("bigint").alias("rank"), "value", "count")


@query("top_values_parts", _top_sql("part", ("p_name", "p_brand", "p_type"), 5))
def top_values_parts(spark, sf_dir):
    top = describe.top_values(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], 5)
    return top.select("column", F.col("rank").cast("bigint").alias("rank"), "value", "count")


def _category_sql(source: str, columns) -> str:
    return union_all([
        f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {source}) AS unique_count, m.{c} AS mode,
        m.n AS mode_frequency, (SELECT count(*) - count({c}) FROM {source}) AS missing_count
        FROM (SELECT {c}, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1) m"""
        for c in columns
    ])


@query("categorical_summary", _category_sql(FULFILLMENT_SQL, ("o_orderpriority", "carrier")))
def categorical_summary(spark, sf_dir):
    return describe.categorical_summary(fulfillment(spark, sf_dir), ["o_orderpriority", "carrier"])


@query("datetime_ranges", union_all([
    f"""SELECT '{c}' AS "column", min({c}) AS "start", max({c}) AS "end", count({c}) AS "count" FROM {t}"""
    for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
]))
def datetime_ranges(spark, sf_dir):
    parts = [describe.datetime_range(table(spark, sf_dir, t)) for t in ("orders", "lineitem", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("schema_columns", union_all([
    f"SELECT {i} AS ordinal, '{c}' AS \"column\", count(*) AS row_count FROM part"
    for i, c in enumerate(("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))
]))
def schema_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return profile.schema_table(part).join(profile.missing_summary(part), "column").select(
        "ordinal", "column", "row_count"
    )


@query("stored_size")
def stored_size(spark, sf_dir):
    return profile.stored_size_mb(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query("describe_events")
def describe_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return describe.describe_dataset(events, profile.infer_profile(events))


_PROFILE_LINES = union_all([
    """SELECT 0 AS ordinal, 'o_orderkey (bigint, identifier, mean: ' || printf('%.2f', avg(o_orderkey)) || ', range: '
    || printf('%.2f', min(o_orderkey)::DOUBLE) || '-' || printf('%.2f', max(o_orderkey)::DOUBLE) || ')' AS line FROM orders""",
    """SELECT 1, 'o_custkey (bigint, identifier, mean: ' || printf('%.2f', avg(o_custkey)) || ', range: '
    || printf('%.2f', min(o_custkey)::DOUBLE) || '-' || printf('%.2f', max(o_custkey)::DOUBLE) || ')' FROM orders""",
    *[f"""SELECT {i}, '{c} (string, categorical, ' || (SELECT count(DISTINCT {c}) FROM orders) || ' unique, top: ['
    || string_agg(v, ', ' ORDER BY n DESC, v) || '])' FROM (SELECT {c} AS v, count(*) AS n FROM orders
    GROUP BY {c} ORDER BY n DESC, v LIMIT 5)""" for i, c in ((2, "o_orderstatus"), (5, "o_orderpriority"))],
    """SELECT 3, 'o_totalprice (double, ' || CASE WHEN count(DISTINCT o_totalprice) = count(*) THEN 'identifier'
    ELSE 'numeric' END || ', mean: ' || printf('%.2f', avg(o_totalprice)) || ', range: '
    || printf('%.2f', min(o_totalprice)) || '-' || printf('%.2f', max(o_totalprice)) || ')' FROM orders""",
    """SELECT 4, 'o_orderdate (timestamp_ntz, datetime, range: ' || strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S')
    || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') || ')' FROM orders""",
])


@query("text_profile_orders", _PROFILE_LINES)
def text_profile_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return describe.text_profile(orders, profile.infer_profile(orders))


@query("schema_lines", union_all([
    f"""SELECT {i} AS ordinal, '- {c} ({t})' || CASE WHEN count({c}) < count(*) THEN
    ' [' || printf('%.1f', round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE) || '% missing]' ELSE '' END AS line
    FROM {LABELED_SQL}"""
    for i, (c, t) in enumerate((("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
                                ("quality", "int"), ("toxic", "int")))
]))
def schema_lines(spark, sf_dir):
    return describe.schema_lines(profile.infer_profile(labeled_documents(spark, sf_dir)), spark)


@query("most_missing", f"""SELECT "column", missing_pct FROM ({_missing_sql(LABELED_SQL, ("quality", "toxic"))})
WHERE missing_pct > 0""")
def most_missing(spark, sf_dir):
    return describe.most_missing(profile.infer_profile(labeled_documents(spark, sf_dir)), spark)


@query("normality")
def normality(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return describe.normality(customer, ["c_acctbal"], "c_nationkey")


_HOLES = ("first_quantity", "shipped_value", "carrier")


_TESTED_SQL = f"""count(x) AS count, {r('avg(x)', 6)} AS mean, {r('quantile_cont(x, 0.5)', 6)} AS median,
  CASE WHEN count(x) BETWEEN 8 AND 5000 THEN 1 ELSE 0 END AS tested, count(*) - count(x) AS missing_count"""


# The test's figures have no SQL (they are compared with tables in the tests); whether it was made has.
@query("statistics_one_call", f"""SELECT 'c_acctbal' AS "column", 'numeric' AS kind, {_TESTED_SQL}, NULL::BIGINT AS unique_count,
NULL::VARCHAR AS mode, NULL::BIGINT AS mode_frequency, NULL::VARCHAR AS top FROM (SELECT c_acctbal AS x FROM customer)
UNION ALL SELECT 'c_mktsegment', 'categorical', NULL, NULL, NULL, 0, count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment),
(SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)),
(SELECT string_agg(c_mktsegment || '=' || n, ', ' ORDER BY n DESC, c_mktsegment) FROM (SELECT c_mktsegment, count(*) AS n FROM customer
 WHERE c_mktsegment IS NOT NULL GROUP BY 1)) FROM customer""")
def statistics_one_call(spark, sf_dir):
    found = describe.compute_statistics(table(spark, sf_dir, "customer"), ["c_acctbal", "c_mktsegment", "no_such_column"])
    return rounded(found, mean=6, median=6).select(
        "column", "kind", "count", "mean", "median", F.col("is_normal").isNotNull().cast("int").alias("tested"), "missing_count",
        "unique_count", "mode", "mode_frequency", F.array_join(F.transform(
            "top_values", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))), ", ").alias("top"))


@query("statistics_by_group", f"""SELECT c_mktsegment AS "group", {_TESTED_SQL} FROM (SELECT c_mktsegment, c_acctbal AS x FROM customer)
WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def statistics_by_group(spark, sf_dir):
    found = describe.compute_statistics(table(spark, sf_dir, "customer"), ["c_acctbal", "c_mktsegment"], "c_mktsegment")
    return rounded(found, mean=6, median=6).select(
        "group", "count", "mean", "median", F.col("is_normal").isNotNull().cast("int").alias("tested"), "missing_count")


@query("missing_report", union_all([
    f"""SELECT * FROM (SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
    round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS missing_pct, count({c}) AS present_count
    FROM {FULFILLMENT_SQL}) WHERE missing_count > 0"""
    for c in ("o_orderkey", "o_orderpriority", "o_totalprice", *_HOLES)
]))
def missing_report(spark, sf_dir):
    return missing.missing_report(fulfillment(spark, sf_dir))


def _plan_sql() -> str:
    parts = []
    for c in _HOLES:
        number = c != "carrier"
        value = f"quantile_cont({c}, 0.5)" if number else "NULL::DOUBLE"
        text = "NULL::VARCHAR" if number else f"""(SELECT {c} FROM {FULFILLMENT_SQL} WHERE {c} IS NOT NULL
        GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        parts.append(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS missing_pct, count({c}) AS present_count,
        '{"median" if number else "mode"}' AS suggested_imputation, {r(value, 4)} AS imputation_number,
        {text} AS imputation_text FROM {FULFILLMENT_SQL}""")
    return union_all(parts)


@query("impute_plan", _plan_sql())
def impute_plan(spark, sf_dir):
    df = fulfillment(spark, sf_dir)
    plan = missing.imputation_plan(df, profile.infer_profile(df), list(_HOLES))
    return plan.withColumn("imputation_number", near(F.col("imputation_number"), 4))


@query("imputed_totals", f"""SELECT count(*) AS rows_filled, {r('avg(coalesce(first_quantity, m1))', 4)} AS mean_quantity,
{r('avg(coalesce(shipped_value, m2))', 2)} AS mean_value, count(coalesce(carrier, m3)) AS carriers
FROM {FULFILLMENT_SQL}, (SELECT quantile_cont(first_quantity, 0.5) AS m1, quantile_cont(shipped_value, 0.5) AS m2
  FROM {FULFILLMENT_SQL}), (SELECT carrier AS m3 FROM {FULFILLMENT_SQL} WHERE carrier IS NOT NULL GROUP BY carrier
  ORDER BY count(*) DESC, carrier LIMIT 1)""")
def imputed_totals(spark, sf_dir):
    df = fulfillment(spark, sf_dir)
    filled = missing.impute_from_plan(df, missing.imputation_plan(df, profile.infer_profile(df), list(_HOLES)))
    return filled.agg(
        F.count("*").alias("rows_filled"), near(F.avg("first_quantity"), 4).alias("mean_quantity"),
        near(F.avg("shipped_value"), 2).alias("mean_value"), F.count("carrier").alias("carriers"),
    )


@query("missing_corr", union_all([
    f"""SELECT '{a}' AS column_1, '{b}' AS column_2, round(c, 3) AS correlation FROM (
    SELECT corr(({a} IS NULL)::INT, ({b} IS NULL)::INT) AS c FROM {FULFILLMENT_SQL})
    WHERE NOT isnan(c) AND abs(c) > 0.5"""
    for a, b in (("first_quantity", "shipped_value"), ("first_quantity", "carrier"), ("shipped_value", "carrier"))
]))
def missing_corr(spark, sf_dir):
    return missing.missing_correlations(fulfillment(spark, sf_dir))


@query("missing_patterns", f"""SELECT CASE WHEN quality IS NULL AND toxic IS NULL THEN 'quality,toxic' WHEN quality IS NULL
THEN 'quality' WHEN toxic IS NULL THEN 'toxic' ELSE '' END AS missing, count(*) AS "rows" FROM {LABELED_SQL} GROUP BY 1""")
def missing_patterns(spark, sf_dir):
    found = missing.missing_patterns(labeled_documents(spark, sf_dir))
    return found.select(F.array_join("missing", ",").alias("missing"), "rows")
