"""Rules, violations, findings, scores and reports."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F


from ..plans import cross_column, report, schema, semantic, statistical, temporal, validate as validation
from ..plans.findings import row_findings, violations
from ..streaming import file_stream, rule_counts, stream_violations
from ..session import ensure_checkpoint_dir
from .derived import LABELED_SQL, labeled_documents
from .registry import query, r, rounded, table, union_all

_EVENT_NUMBERS = ("event_id", "user_id", "value")


def _fences(c: str, source: str = "events", factor: float = 1.5) -> str:
    return f"""(SELECT q1 - {factor} * (q3 - q1) AS low, q3 + {factor} * (q3 - q1) AS high, q1, q3, m, sp, ss, n FROM (
    SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, avg({c}) AS m,
    stddev_pop({c}) AS sp, stddev_samp({c}) AS ss, count({c}) AS n FROM {source}))"""


@query("iqr_outliers_events", union_all([
    f"""SELECT event_id, '{c}' AS "column", 'iqr' AS method, {c}::DOUBLE AS value FROM events, {_fences(c)}
    WHERE {c} < low OR {c} > high""" for c in _EVENT_NUMBERS
]))
def iqr_outliers_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return statistical.outlier_rows(events, statistical.outlier_bounds(events), ["event_id"])


@query("zscore_outliers_events", union_all([
    f"""SELECT event_id, '{c}' AS "column", 'zscore' AS method, {c}::DOUBLE AS value FROM events, {_fences(c)}
    WHERE sp > 0 AND abs({c} - m) / sp > 3.0""" for c in _EVENT_NUMBERS
]))
def zscore_outliers_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return statistical.outlier_rows(events, statistical.outlier_bounds(events, method="zscore"), ["event_id"])


def _detect_sql() -> str:
    parts = []
    for c in _EVENT_NUMBERS:
        for method, threshold, low, high, test in (
            ("iqr", 2.0, "low", "high", f"{c} < low OR {c} > high"),
            ("zscore", 2.0, "m - 2.0 * sp", "m + 2.0 * sp", f"sp > 0 AND abs({c} - m) / sp > 2.0"),
        ):
            parts.append(f"""SELECT '{c}' AS "column", '{method}' AS method, {threshold}::DOUBLE AS threshold,
            {r(f'any_value({low})', 4)} AS lower_bound, {r(f'any_value({high})', 4)} AS upper_bound,
            count(*) FILTER ({test}) AS outlier_count, (SELECT coalesce(string_agg(k, ',' ORDER BY i), '') FROM (
            SELECT event_id AS i, event_id::VARCHAR AS k FROM events, {_fences(c, factor=2.0)} WHERE {test}
            ORDER BY event_id LIMIT 20)) AS row_keys
            FROM events, {_fences(c, factor=2.0)}""")
    return union_all(parts)


@query("outlier_report_events", _detect_sql())
def outlier_report_events(spark, sf_dir):
    found = statistical.detect_outliers(
        table(spark, sf_dir, "events"), ["event_id"], method="both", threshold=2.0
    )
    return rounded(found, lower_bound=4, upper_bound=4).select(
        "column", "method", "threshold", "lower_bound", "upper_bound", "outlier_count",
        F.array_join("row_keys", ",").alias("row_keys"),
    )


@query("negative_values_customer", """SELECT 'negative_value' AS rule, 'amount' AS "column", c_custkey::VARCHAR AS row_key
FROM customer WHERE c_acctbal < 0""")
def negative_values_customer(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("amount"))
    rules = statistical.impossible_value_rules(["amount"])
    return violations(customer, rules, ["c_custkey"]).select("rule", "column", "row_key")


_PRICED_SQL = """(SELECT l.*, l_extendedprice / l_quantity / p_retailprice * 100 AS retail_ratio,
  p_retailprice AS unit_min, l_extendedprice / l_quantity AS unit_max, l_extendedprice AS line_goods,
  l_extendedprice * l_tax AS line_tax, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS line_total
  FROM lineitem l JOIN part ON l_partkey = p_partkey)"""


def _priced(spark, sf_dir):
    """Lines with what they cost per unit against the list price, and a total beside its parts."""
    price, unit = F.col("l_extendedprice"), F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return lines.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        (unit / F.col("p_retailprice") * 100).alias("retail_ratio"),
        F.col("p_retailprice").alias("unit_min"), unit.alias("unit_max"), price.alias("line_goods"),
        (price * F.col("l_tax")).alias("line_tax"),
        (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("line_total"),
    )


_LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LINE_KEY_SQL = "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)"


@query("percent_bounds_lineitem", f"""SELECT 'percent_bounds' AS rule, 'retail_ratio' AS "column", {_LINE_KEY_SQL} AS row_key
FROM {_PRICED_SQL} WHERE retail_ratio < 0 OR retail_ratio > 100""")
def percent_bounds_lineitem(spark, sf_dir):
    rules = statistical.impossible_value_rules(["retail_ratio"])
    return violations(_priced(spark, sf_dir), rules, _LINE_KEY).select("rule", "column", "row_key")


def _row_finding_sql(rule: str, severity: str, column: str, source: str, test: str, key: str, order: str) -> str:
    return f"""SELECT '{rule}' AS rule, '{severity}' AS severity, '{column}' AS "column", count(*) AS n_rows,
    (SELECT string_agg(k, ',' ORDER BY rn) FROM (SELECT {key} AS k, row_number() OVER (ORDER BY {order}) AS rn
    FROM {source} WHERE {test} ORDER BY {order} LIMIT 20)) AS row_keys FROM {source} WHERE {test} HAVING count(*) > 0"""


def _short(findings):
    return findings.select("rule", "severity", "column", "n_rows", F.array_join("row_keys", ",").alias("row_keys"))


_LINE_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("sum_consistency", _row_finding_sql(
    "sum_mismatch", "error", "line_total", _PRICED_SQL, "abs(line_goods + line_tax - line_total) > 0.01",
    _LINE_KEY_SQL, _LINE_ORDER,
))
def sum_consistency(spark, sf_dir):
    rules = cross_column.sum_rules(["line_goods", "line_tax", "line_total"])
    return _short(row_findings(_priced(spark, sf_dir), rules, _LINE_KEY))


@query("min_max_consistency", _row_finding_sql(
    "min_above_max", "error", "unit_min, unit_max", _PRICED_SQL, "unit_min > unit_max", _LINE_KEY_SQL, _LINE_ORDER,
))
def min_max_consistency(spark, sf_dir):
    return _short(row_findings(_priced(spark, sf_dir), cross_column.range_rules(["unit_min", "unit_max"]), _LINE_KEY))


_SHIPMENT_SQL = """(SELECT l.*, o_orderdate AS order_date, l_shipdate AS ship_date
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"""


def _shipments(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_KEY, F.col("l_shipdate").alias("ship_date"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("order_date"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("date_order_ship", _row_finding_sql(
    "date_order", "error", "order_date, ship_date", _SHIPMENT_SQL, "order_date > ship_date", _LINE_KEY_SQL, _LINE_ORDER,
))
def date_order_ship(spark, sf_dir):
    return _short(row_findings(_shipments(spark, sf_dir), temporal.ordering_rules(["order_date", "ship_date"]), _LINE_KEY))


@query("future_dates", """SELECT 'future_date' AS rule, 'o_orderdate' AS "column", o_orderkey::VARCHAR AS row_key,
strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01'""")
def future_dates(spark, sf_dir):
    rules = temporal.future_rules(["o_orderdate"], "2001-01-01 00:00:00")
    return violations(table(spark, sf_dir, "orders"), rules, ["o_orderkey"])


def _gaps_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", (SELECT count({column}) FROM {source}) AS n_dates, m AS median_gap_us,
    count(*) FILTER (g > 5 * m) AS n_gaps, max(g) FILTER (g > 5 * m) AS largest_gap_us FROM
    (SELECT date_diff('microsecond', lag({column}) OVER (ORDER BY {column}), {column}) AS g FROM {source}) s,
    (SELECT median(g)::DOUBLE AS m FROM (SELECT date_diff('microsecond', lag({column}) OVER (ORDER BY {column}), {column}) AS g
    FROM {source})) WHERE m > 0 GROUP BY m"""


@query("date_gaps_events", _gaps_sql("ts", "events"))
def date_gaps_events(spark, sf_dir):
    return temporal.gap_summary(temporal.date_steps(table(spark, sf_dir, "events"), ["ts"]))


@query("date_gap_rows", """SELECT ts AS moment, previous, date_diff('microsecond', previous, ts) AS gap_us, event_id::VARCHAR AS row_key
FROM (SELECT ts, event_id, lag(ts) OVER (ORDER BY ts, event_id) AS previous FROM events)
WHERE date_diff('microsecond', previous, ts) > 5 * (SELECT median(g) FROM (
  SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS g FROM events))""")
def date_gap_rows(spark, sf_dir):
    steps = temporal.date_steps(table(spark, sf_dir, "events"), ["ts"], ["event_id"])
    limit = temporal.gap_summary(steps).agg(F.max("median_gap_us")).scalar() * temporal.GAP_FACTOR
    return steps.where(F.col("gap_us") > limit).select(
        "moment", "previous", "gap_us", F.col("first_key.event_id").cast("string").alias("row_key")
    )


_STAMPED_SQL = """(SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 'O' THEN o_custkey::VARCHAR ELSE o_orderpriority END AS note, o_orderpriority, o_custkey::VARCHAR AS custkey_text FROM orders)"""


def _stamped(spark, sf_dir):
    """Orders with a text column that holds dates, numbers or words depending on the status."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(status == "O", F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("note"),
        "o_orderpriority", F.col("o_custkey").cast("string").alias("custkey_text"),
    )


def _mix_sql() -> str:
    number = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[nN][aA][nN]|[iI][nN][fF])\s*$"
    return union_all([
        f"""SELECT '{c}' AS "column", count(*) FILTER (k = 'n') AS "numeric", count(*) FILTER (k = 'd') AS "datetime",
        count(*) FILTER (k = 's') AS "string" FROM (SELECT CASE WHEN regexp_matches({c}, '{number}') THEN 'n'
        WHEN try_strptime({c}, '%Y-%m-%d') IS NOT NULL THEN 'd' ELSE 's' END AS k FROM {_STAMPED_SQL})"""
        for c in ("note", "o_orderpriority", "custkey_text")
    ])


@query("type_mix_orders", _mix_sql())
def type_mix_orders(spark, sf_dir):
    return schema.type_mix(_stamped(spark, sf_dir))


_DATE_TEXTS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm", "M/d/yyyy", "MMM d, yyyy", "d.M.yyyy")


@query("type_mix_dates", """SELECT 'note' AS "column", count(*) FILTER (o_orderkey % 7 = 6) AS "numeric",
count(*) FILTER (o_orderkey % 7 < 5) AS "datetime", count(*) FILTER (o_orderkey % 7 = 5) AS "string" FROM orders""")
def type_mix_dates(spark, sf_dir):
    """Dates in five layouts between words and numbers of one column."""
    kind = F.col("o_orderkey") % 7
    note = F.when(kind == 5, F.col("o_orderpriority")).when(kind == 6, F.col("o_orderkey").cast("string"))
    for i, pattern in enumerate(_DATE_TEXTS):
        note = note.when(kind == i, F.date_format("o_orderdate", pattern))
    return schema.type_mix(table(spark, sf_dir, "orders").select(note.alias("note")))


@query("mixed_types", f"""SELECT 'mixed_types' AS rule, 'warning' AS severity, "column",
concat_ws(', ', CASE WHEN "numeric" > 0 THEN 'numeric' END, CASE WHEN "datetime" > 0 THEN 'datetime' END,
CASE WHEN "string" > 0 THEN 'string' END) AS types_found FROM ({_mix_sql()})
WHERE ("numeric" > 0)::INT + ("datetime" > 0)::INT + ("string" > 0)::INT > 1""")
def mixed_types(spark, sf_dir):
    found = schema.mixed_type_findings(_stamped(spark, sf_dir))
    return found.select("rule", "severity", "column", F.col("evidence")["types_found"].alias("types_found"))


_COPIES_SQL = "(SELECT text, lang, source, n_chars, count(*) AS copies FROM documents GROUP BY ALL)"
_REPEATS_SQL = """(SELECT *, row_number() OVER (PARTITION BY text, lang, source, n_chars ORDER BY doc_id) AS rn
  FROM documents)"""


@query("duplicate_summary", f"""SELECT sum(copies)::BIGINT AS row_count, sum(copies - 1)::BIGINT AS duplicate_count,
round(100.0 * sum(copies - 1) / sum(copies), 2)::DOUBLE AS duplicate_pct FROM {_COPIES_SQL}""")
def duplicate_summary(spark, sf_dir):
    return schema.duplicate_summary(table(spark, sf_dir, "documents"), ["doc_id"], ["doc_id"])


@query("duplicate_rows", f"SELECT doc_id, lang, source, n_chars FROM {_REPEATS_SQL} WHERE rn > 1")
def duplicate_rows(spark, sf_dir):
    return schema.duplicate_rows(table(spark, sf_dir, "documents"), ["doc_id"], ["doc_id"]).drop("text")


def _duplicate_finding_sql(source: str, surplus: str, key: str) -> str:
    return f"""SELECT 'duplicate_rows' AS rule,
    CASE WHEN 100.0 * count(*) / (SELECT count(*) FROM {source}) < 5 THEN 'warning' ELSE 'error' END AS severity,
    count(*) AS n_rows, (SELECT string_agg({key}::VARCHAR, ',' ORDER BY {key}) FROM (
      SELECT {key} FROM {surplus} WHERE rn > 1 ORDER BY {key} LIMIT 20)) AS row_keys
    FROM {surplus} WHERE rn > 1 HAVING count(*) > 0"""


def _listed(found):
    return found.select("rule", "severity", "n_rows", F.array_join("row_keys", ",").alias("row_keys"))


@query("duplicate_findings", _duplicate_finding_sql("documents", _REPEATS_SQL, "doc_id"))
def duplicate_findings(spark, sf_dir):
    return _listed(schema.duplicate_findings(table(spark, sf_dir, "documents"), ["doc_id"], 0, ["doc_id"]))


# A load that was repeated in part: every seventh order comes twice and every 35th three times, keys included.
_LOADED_TWICE_SQL = """(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT * FROM orders WHERE o_orderkey % 35 = 0)"""
_LOADED_SURPLUS_SQL = f"(SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY 1) AS rn FROM {_LOADED_TWICE_SQL})"


def _loaded_twice(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.unionByName(orders.where("o_orderkey % 7 = 0")).unionByName(orders.where("o_orderkey % 35 = 0"))


@query("duplicates_repeated_load", _duplicate_finding_sql(_LOADED_TWICE_SQL, _LOADED_SURPLUS_SQL, "o_orderkey"))
def duplicates_repeated_load(spark, sf_dir):
    return _listed(schema.duplicate_findings(_loaded_twice(spark, sf_dir), ["o_orderkey"]))


@query("duplicate_rows_repeated_load", f"SELECT * EXCLUDE (rn) FROM {_LOADED_SURPLUS_SQL} WHERE rn > 1")
def duplicate_rows_repeated_load(spark, sf_dir):
    return schema.duplicate_rows(_loaded_twice(spark, sf_dir), ["o_orderkey"])


@query("duplicates_equal_attributes", """SELECT count(*) AS row_count, (count(*) - count(DISTINCT (p_partkey, p_brand, p_size)))
AS duplicate_count, round(100.0 * (count(*) - count(DISTINCT (p_partkey, p_brand, p_size))) / count(*), 2)::DOUBLE
AS duplicate_pct FROM part""")
def duplicates_equal_attributes(spark, sf_dir):
    """Parts of one brand and size under different keys are different rows."""
    return schema.duplicate_summary(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_partkey"])


_CALENDAR = ("event_id", "event_year", "event_month", "event_day")
_CALENDAR_SQL = """(SELECT event_id, year(ts) AS event_year, month(ts) AS event_month, day(ts) AS event_day FROM events)"""


@query("constant_columns", union_all([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values FROM {_CALENDAR_SQL}
    HAVING count(DISTINCT {c}) <= 1 AND count(*) > 1""" for c in _CALENDAR
]))
def constant_columns(spark, sf_dir):
    calendar = table(spark, sf_dir, "events").select(
        "event_id", F.year("ts").alias("event_year"), F.month("ts").alias("event_month"), F.day("ts").alias("event_day")
    )
    return schema.constant_columns(calendar)


@query("missing_findings", union_all([
    f"""SELECT 'missing_values' AS rule, CASE WHEN pct >= 30 THEN 'error' ELSE 'warning' END AS severity,
    '{c}' AS "column", n AS n_rows FROM (SELECT round(100.0 * (count(*) - count({c})) / count(*), 2) AS pct,
    count(*) - count({c}) AS n FROM {LABELED_SQL}) WHERE pct >= 5"""
    for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")
]))
def missing_findings(spark, sf_dir):
    return schema.missing_findings(labeled_documents(spark, sf_dir)).select("rule", "severity", "column", "n_rows")


_EXPORT_SQL = f"""(SELECT doc_id, coalesce(quality::VARCHAR, 'N/A') AS quality_text, source FROM {LABELED_SQL})"""


@query("placeholder_tokens", f"""SELECT 'placeholder' AS rule, 'warning' AS severity, 'quality_text' AS "column",
count(*) AS n_rows, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM {_EXPORT_SQL}
WHERE quality_text = 'N/A' ORDER BY doc_id LIMIT 20)) AS row_keys FROM {_EXPORT_SQL} WHERE quality_text = 'N/A'""")
def placeholder_tokens(spark, sf_dir):
    exported = labeled_documents(spark, sf_dir).select(
        "doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("N/A")).alias("quality_text"), "source"
    )
    return _short(row_findings(exported, semantic.placeholder_rules(["quality_text", "source"]), ["doc_id"]))


@query("domain_bounds", _row_finding_sql(
    "domain_bounds", "error", "shipping_age", """(SELECT l.*, date_diff('day', o_orderdate, l_shipdate) AS shipping_age
    FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)""", "shipping_age < 0 OR shipping_age > 150",
    _LINE_KEY_SQL, _LINE_ORDER,
))
def domain_bounds(spark, sf_dir):
    aged = _shipments(spark, sf_dir).withColumn("shipping_age", F.datediff("ship_date", "order_date"))
    return _short(row_findings(aged, semantic.domain_rules(["shipping_age"]), _LINE_KEY))


@query("roundness", union_all([
    f"""SELECT '{c}' AS "column", count({c}) AS n, {r(f'avg(CASE WHEN {c} % 10 = 0 THEN 1.0 ELSE 0.0 END)', 6)} AS round_share
    FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_linenumber")
]))
def roundness(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_linenumber"]
    return rounded(semantic.roundness(table(spark, sf_dir, "lineitem"), columns), round_share=6)


@query("unit_mix", f"""SELECT event_type, {r('median', 4)} AS median, unit, count(*) AS n,
count(*) FILTER (abs(value / median / factor - 1) <= 0.02) AS n_scaled FROM events JOIN (
  SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type) USING (event_type),
(VALUES ('cents or per-cent scale', 100.0::DOUBLE), ('miles against kilometres', 1.609344::DOUBLE),
 ('pounds against kilograms', 2.204623::DOUBLE), ('thousands', 1000.0::DOUBLE)) u(unit, factor)
GROUP BY event_type, median, unit""")
def unit_mix(spark, sf_dir):
    found = semantic.unit_mix(table(spark, sf_dir, "events"), "value", "event_type")
    return rounded(found, median=4).select("event_type", "median", "unit", "n", "n_scaled")


@query("business_rules", union_all([
    """SELECT 'late_shipment' AS rule, 'error' AS severity, count(*) AS n_rows FROM lineitem
    WHERE l_linestatus = 'F' AND l_shipdate > TIMESTAMP '2000-01-01'""",
    """SELECT 'returned_untaxed' AS rule, 'warning' AS severity, count(*) AS n_rows FROM lineitem
    WHERE l_returnflag = 'R' AND l_tax = 0""",
]))
def business_rules(spark, sf_dir):
    declared = [
        semantic.DeclaredRule("late_shipment", "error", "l_linestatus = 'F' AND l_shipdate > TIMESTAMP_NTZ '2000-01-01'"),
        semantic.DeclaredRule("returned_untaxed", "warning", "l_returnflag = 'R' AND l_tax = 0"),
    ]
    found = row_findings(table(spark, sf_dir, "lineitem"), semantic.declared_rules(declared), _LINE_KEY)
    return found.select("rule", "severity", "n_rows")


@query("events_after_end", """SELECT o_orderkey AS orderkey, l_linenumber, l_shipdate AS shipped, o_orderdate AS ordered
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_shipdate > o_orderdate""")
def events_after_end(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), "l_linenumber", F.col("l_shipdate").alias("shipped")
    )
    closed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").alias("ordered")
    )
    return semantic.events_after_end(lines, closed, "orderkey", "shipped", "ordered")


@query("json_findings", f"""SELECT doc_id, CASE WHEN quality IS NULL THEN 'info' WHEN toxic = 1 THEN 'error' ELSE 'info' END
AS severity, CASE WHEN quality IS NULL THEN NULL ELSE 'quality' END AS "column",
CASE WHEN quality IS NULL THEN 'Semantic validation completed but could not parse the response'
ELSE 'quality is ' || quality END AS message FROM {LABELED_SQL}""")
def json_findings(spark, sf_dir):
    head, tail = '[{"column":"quality","message":"quality is ', '"}]'
    response = F.when(F.col("quality").isNull(), F.concat(F.lit("no answer from "), F.col("source"))).when(
        F.col("toxic") == 1, F.concat(F.lit(head), F.col("quality").cast("string"), F.lit('","severity":"error"}]'))
    ).otherwise(F.concat(F.lit(head), F.col("quality").cast("string"), F.lit(tail)))
    responses = labeled_documents(spark, sf_dir).select("doc_id", response.alias("response"))
    found = semantic.parse_findings(responses, "response", ["doc_id"])
    return found.select("doc_id", "severity", "column", "message")


def _statistical_sql() -> str:
    parts = []
    for c in _EVENT_NUMBERS:
        parts.append(f"""SELECT 'zscore_outlier' AS rule, 'warning' AS severity, '{c}' AS "column", count(*) AS n_rows,
        'Found ' || count(*) || ' outliers in ''{c}'' (Z-score > 3.0)' AS message FROM events, {_fences(c)}
        WHERE sp > 0 AND abs({c} - m) / sp > 3.0 HAVING count(*) > 0""")
        parts.append(f"""SELECT 'iqr_outlier', 'info', '{c}', count(*),
        'Found ' || count(*) || ' IQR outliers in ''{c}'' (outside [' || printf('%.2f', any_value(low)) || ', '
        || printf('%.2f', any_value(high)) || '])' FROM events, {_fences(c)}
        WHERE {c} < low OR {c} > high HAVING count(*) > 0 AND count(*) < 0.1 * any_value(n)""")
    return union_all(parts)


@query("statistical_findings", _statistical_sql())
def statistical_findings(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    columns = list(_EVENT_NUMBERS)
    rules = statistical.statistical_rules(columns, statistical.column_bounds(events, columns))
    return row_findings(events, rules, ["event_id"]).select("rule", "severity", "column", "n_rows", "message")


_AS_OF = "2024-01-20 00:00:00"
_EVENT_FINDINGS_SQL = f"""(SELECT rule, severity, "column", n_rows FROM ({_statistical_sql()})
UNION ALL SELECT 'future_date', 'warning', 'ts', count(*) FROM events WHERE ts > TIMESTAMP '{_AS_OF}' HAVING count(*) > 0
UNION ALL SELECT 'date_gap', 'info', 'ts', n_gaps FROM ({_gaps_sql("ts", "events")}) WHERE n_gaps > 0
UNION ALL SELECT 'duplicate_rows', CASE WHEN sum(c - 1) * 100.0 / sum(c) < 5 THEN 'warning' ELSE 'error' END, NULL,
  sum(c - 1)::BIGINT FROM (SELECT event_id, ts, user_id, event_type, value, props, count(*) AS c FROM events GROUP BY ALL)
  HAVING sum(c - 1) > 0)"""


def _event_findings(spark, sf_dir):
    return validation.validate(table(spark, sf_dir, "events"), ["event_id"], as_of=_AS_OF)


@query("validation_findings", f"SELECT * FROM {_EVENT_FINDINGS_SQL}")
def validation_findings(spark, sf_dir):
    return _event_findings(spark, sf_dir).select("rule", "severity", "column", "n_rows")


_COUNTS_SQL = f"""(SELECT count(*) AS finding_count, count(*) FILTER (severity = 'error') AS error_count,
count(*) FILTER (severity = 'warning') AS warning_count, count(*) FILTER (severity = 'info') AS info_count
FROM {_EVENT_FINDINGS_SQL})"""


@query("severity_counts", f"SELECT * FROM {_COUNTS_SQL}")
def severity_counts(spark, sf_dir):
    return report.severity_counts(_event_findings(spark, sf_dir))


@query("quality_score", f"""SELECT *, greatest(0.0, least(100.0, 100.0 - 10 * error_count - 3 * warning_count - info_count))::DOUBLE
AS score FROM {_COUNTS_SQL}""")
def quality_score(spark, sf_dir):
    return report.quality_score(_event_findings(spark, sf_dir))


@query("validation_summary", f"""SELECT finding_count, 'Data Quality Score: ' || printf('%.0f', greatest(0.0, least(100.0,
100.0 - 10 * error_count - 3 * warning_count - info_count))::DOUBLE) || '/100' AS first_line,
'Found ' || finding_count || ' issues: ' || error_count || ' errors, ' || warning_count || ' warnings, ' || info_count
|| ' informational.' AS second_line FROM {_COUNTS_SQL}""")
def validation_summary(spark, sf_dir):
    told = report.summary_text(_event_findings(spark, sf_dir))
    lines = F.split("summary", "\n")
    return told.select("finding_count", lines[0].alias("first_line"), lines[1].alias("second_line"))


@query("validation_narrative")
def validation_narrative(spark, sf_dir):
    return report.narrative(_event_findings(spark, sf_dir))


_RULE_TABLES = (
    ("customer", "amount", "c_acctbal", "c_custkey"), ("supplier", "amount", "s_acctbal", "s_suppkey"),
)


@query("scores_by_table", union_all([
    f"""SELECT '{t}' AS "table", 1 AS finding_count, 1 AS error_count, 0 AS warning_count, 0 AS info_count,
    90.0::DOUBLE AS score FROM {t} WHERE {c} < 0 HAVING count(*) > 0""" for t, _, c, _ in _RULE_TABLES
]))
def scores_by_table(spark, sf_dir):
    parts = []
    for name, shown, column, key in _RULE_TABLES:
        source = table(spark, sf_dir, name).select(key, F.col(column).alias(shown))
        found = row_findings(source, statistical.impossible_value_rules([shown]), [key])
        parts.append(found.select(F.lit(name).alias("table"), "*"))
    return report.quality_score(parts[0].unionByName(parts[1]), ["table"])


@query("top_findings", f"""SELECT severity, CASE rule WHEN 'zscore_outlier' THEN 'statistical' WHEN 'iqr_outlier' THEN 'statistical'
WHEN 'duplicate_rows' THEN 'schema' ELSE 'temporal' END AS category, "column" FROM {_EVENT_FINDINGS_SQL}""")
def top_findings(spark, sf_dir):
    return report.top_findings(_event_findings(spark, sf_dir)).select("severity", "category", "column")


@query("stream_rule_counts", """SELECT date_trunc('hour', ts) AS "start", date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end",
'future_date' AS rule, 'ts' AS "column", count(*) AS n_rows FROM events WHERE ts > TIMESTAMP '2024-01-20'
AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def stream_rule_counts(spark, sf_dir):
    """The event table read as a stream; windows that the watermark has closed are appended to files."""
    schema_of = table(spark, sf_dir, "events").schema
    name, folder = f"rule_counts_{uuid4().hex}", ensure_checkpoint_dir(spark)
    stream = file_stream(spark, f"{sf_dir}/events.parquet*", schema_of)
    rules = temporal.future_rules(["ts"], _AS_OF)
    counted = rule_counts(stream_violations(stream, rules, ["event_id"], "ts"), "ts")
    running = (
        counted.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/{name}")
        .option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{folder}/{name}").select(
        F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"),
        "rule", "column", "n_rows",
    )
