"""Trends, patterns and change points of the order and event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trend
from ..operators.ordered import Running
from ..plans import eda
from .derived import DAILY_ORDERS_SQL, EVENT_SERIES_SQL
from .registry import query, r, rounded, table


def _daily_orders(spark, sf_dir) -> trend.Series:
    return trend.daily_series(table(spark, sf_dir, "orders"), "o_orderdate", F.count("*"))


def _event_values(spark, sf_dir, by=()) -> trend.Series:
    return trend.series(table(spark, sf_dir, "events"), "ts", "value", ["event_id"], by)


def _fit_sql(source: str, lead: str = "", group: str = "") -> str:
    return f"""SELECT {lead} count(*) AS n, {r('regr_slope(v, pos)', 8)} AS slope, {r('regr_intercept(v, pos)', 5)} AS intercept,
    {r('regr_r2(v, pos)', 7)} AS r_squared, CASE WHEN regr_slope(v, pos) > 0 THEN 'increasing' WHEN regr_slope(v, pos) < 0
    THEN 'decreasing' ELSE 'flat' END AS direction FROM {source} {group}"""


_FIT = {"slope": 8, "intercept": 5, "r_squared": 7}


def _fit(s: trend.Series):
    return rounded(trend.linear_trend(s), **_FIT).drop("p_value", "is_significant")


@query("linear_trend_orders", _fit_sql(DAILY_ORDERS_SQL))
def linear_trend_orders(spark, sf_dir):
    return _fit(_daily_orders(spark, sf_dir))


@query("linear_trend_events", _fit_sql(EVENT_SERIES_SQL))
def linear_trend_events(spark, sf_dir):
    return _fit(_event_values(spark, sf_dir))


_TYPED_EVENTS = """(SELECT event_type, ts AS d, value AS v, event_id, count(*) OVER (PARTITION BY event_type) AS n,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events)"""


@query("linear_trend_by_type", _fit_sql(_TYPED_EVENTS, "event_type,", "GROUP BY event_type"))
def linear_trend_by_type(spark, sf_dir):
    return _fit(_event_values(spark, sf_dir, ["event_type"]))


# Fixed value: the two-sided 5 % point of the t distribution for the thousands of events of a type.
_T_LIMIT = 1.96


@query("trend_pvalue", f"""SELECT event_type, n, {r('t', 5)} AS t, abs(t) > {_T_LIMIT} AS is_significant,
t = 0 OR abs(t) > {_T_LIMIT} AS below_five_percent FROM (SELECT event_type, count(*) AS n,
corr(v, pos) * sqrt((count(*) - 2) / (1 - corr(v, pos) ** 2)) AS t FROM {_TYPED_EVENTS} GROUP BY event_type)""")
def trend_pvalue(spark, sf_dir):
    """The tested slope by its t value; the p-value must fall below five percent exactly where t is beyond its limit."""
    found = trend.linear_trend(_event_values(spark, sf_dir, ["event_type"]))
    t = F.signum("slope") * F.sqrt(F.col("r_squared") * (F.col("n") - 2) / (1 - F.col("r_squared")))
    return rounded(found.select("event_type", "n", t.alias("t"), "is_significant",
                                (F.col("p_value") < 0.05).alias("below_five_percent")), t=5)


@query("time_range", """SELECT min(ts) AS "start", max(ts) AS "end", count(*) AS data_points FROM events""")
def time_range(spark, sf_dir):
    return trend.time_range(_event_values(spark, sf_dir))


@query("value_summary", f"""SELECT a AS start_value, b AS end_value, lo AS min_value, hi AS max_value, {r('m', 4)} AS mean,
{r('b - a', 4)} AS total_change, {r('(b - a) / nullif(a, 0) * 100', 4)} AS pct_change FROM (
SELECT (SELECT value FROM events ORDER BY ts, event_id LIMIT 1) AS a,
(SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS b, min(value) AS lo, max(value) AS hi, avg(value) AS m
FROM events)""")
def value_summary(spark, sf_dir):
    found = trend.value_summary(_event_values(spark, sf_dir))
    return rounded(found, mean=4, total_change=4, pct_change=4)


def _latest_sql(source: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT {w} AS "window", {r(f'avg(v) FILTER (pos >= n - {w})', 4)} AS latest_value,
        CASE WHEN avg(v) FILTER (pos >= n - {w}) > avg(v) THEN 'above' ELSE 'below' END AS trend_vs_mean
        FROM {source} HAVING count(*) >= {w}""" for w in trend.AVERAGE_WINDOWS
    )


@query("moving_averages", _latest_sql(EVENT_SERIES_SQL))
def moving_averages(spark, sf_dir):
    return rounded(trend.moving_averages(_event_values(spark, sf_dir)), latest_value=4)


@query("rolling_mean", f"""SELECT d, pos, {r('CASE WHEN pos >= 6 THEN avg(v) OVER (ORDER BY d, event_id ROWS 6 PRECEDING) END', 4)}
AS rolling_mean FROM {EVENT_SERIES_SQL}""")
def rolling_mean(spark, sf_dir):
    found = trend.rolling_mean(_event_values(spark, sf_dir), 7)
    return rounded(found.select("d", "pos", "rolling_mean"), rolling_mean=4)


# One type of events has lost its name: its rows are a series of their own.
_HOLED_EVENTS = """(SELECT nullif(event_type, 'click') AS kind, ts AS d, value AS v, event_id, event_id::DOUBLE AS id,
  count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""


def _holed_series(spark, sf_dir, value="value") -> trend.Series:
    events = table(spark, sf_dir, "events").withColumn("kind", F.nullif("event_type", F.lit("click")))
    return trend.series(events, "ts", value, ["event_id"], ["kind"])


@query("rolling_mean_by_type", f"""SELECT kind, d, pos, {r("""CASE WHEN pos >= 6 THEN avg(v) OVER (
PARTITION BY kind ORDER BY d, event_id ROWS 6 PRECEDING) END""", 4)} AS rolling_mean FROM {_HOLED_EVENTS}""")
def rolling_mean_by_type(spark, sf_dir):
    found = trend.rolling_mean(_holed_series(spark, sf_dir), 7)
    return rounded(found.select("kind", "d", "pos", "rolling_mean"), rolling_mean=4)


@query("moving_averages_by_type", "\nUNION ALL\n".join(
    f"""SELECT kind, {w} AS "window", {r(f'avg(v) FILTER (pos >= n - {w})', 4)} AS latest_value,
    CASE WHEN avg(v) FILTER (pos >= n - {w}) > avg(v) THEN 'above' ELSE 'below' END AS trend_vs_mean
    FROM {_HOLED_EVENTS} GROUP BY kind HAVING count(*) >= {w}""" for w in trend.AVERAGE_WINDOWS))
def moving_averages_by_type(spark, sf_dir):
    return rounded(trend.moving_averages(_holed_series(spark, sf_dir)), latest_value=4)


def _pattern_sql(source: str, part: str, points: int, least: float) -> str:
    return f"""SELECT found AS detected, CASE WHEN found THEN strongest END AS strongest, CASE WHEN found THEN weakest END AS weakest,
    CASE WHEN found THEN round(sd / abs(m) * 100, 2) END AS variation_pct FROM (
    SELECT *, m <> 0 AND sd / abs(m) > {least} AS found FROM (SELECT avg(v) AS m, count(*) AS n FROM {source}),
    (SELECT stddev_samp(pm) AS sd, max_by(p, (pm, -p)) AS strongest, min_by(p, (pm, p)) AS weakest FROM (
      SELECT {part} AS p, avg(v) AS pm FROM {source} GROUP BY 1))) WHERE n >= {points}"""


@query("weekly_pattern", _pattern_sql(EVENT_SERIES_SQL, "(isodow(d) - 1)", 14, 0.05))
def weekly_pattern(spark, sf_dir):
    return trend.weekly_pattern(_event_values(spark, sf_dir))


@query("monthly_pattern", _pattern_sql(DAILY_ORDERS_SQL, "month(d)", 60, 0.1))
def monthly_pattern(spark, sf_dir):
    return trend.monthly_pattern(_daily_orders(spark, sf_dir))


@query("weekly_pattern_by_status", f"""SELECT o_orderstatus, found AS detected, CASE WHEN found THEN strongest END AS strongest,
CASE WHEN found THEN weakest END AS weakest, CASE WHEN found THEN round(sd / abs(m) * 100, 2) END AS variation_pct FROM (
SELECT *, m <> 0 AND sd / abs(m) > 0.05 AS found FROM (SELECT o_orderstatus, avg(o_totalprice) AS m, count(*) AS n FROM orders
GROUP BY 1) JOIN (SELECT o_orderstatus, stddev_samp(pm) AS sd, max_by(p, (pm, -p)) AS strongest, min_by(p, (pm, p)) AS weakest
FROM (SELECT o_orderstatus, isodow(o_orderdate) - 1 AS p, avg(o_totalprice) AS pm FROM orders GROUP BY 1, 2) GROUP BY 1)
USING (o_orderstatus)) WHERE n >= 14""")
def weekly_pattern_by_status(spark, sf_dir):
    s = trend.series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", ["o_orderkey"], ["o_orderstatus"])
    return trend.weekly_pattern(s)


def _change_sql(source: str, order: str) -> str:
    return f"""(SELECT pos, d, w AS "window", round(shift, 2) AS shift_pct, CASE WHEN rm > lm THEN 'increase' ELSE 'decrease' END
    AS direction FROM (SELECT *, abs(rm - lm) / abs(lm) * 100 AS shift FROM (SELECT *, (e - el) / w AS lm, (er - e) / w AS rm FROM (
      SELECT a.pos, a.d, a.n, a.w, a.e, l.e AS el, x.e AS er FROM s a JOIN s l ON l.pos = a.pos - a.w
      JOIN s x ON x.pos = a.pos + a.w)) WHERE lm <> 0 AND pos >= w AND pos < n - w) WHERE shift > 20)"""


def _with_sums(source: str, order: str, body: str) -> str:
    return f"""WITH s AS (SELECT pos, d, n, greatest(5, n // 10) AS w, coalesce(sum(v) OVER (ORDER BY {order}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS e FROM {source}) {body}"""


_EVENT_IDS = """(SELECT ts AS d, event_id::DOUBLE AS v, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos,
  count(*) OVER () AS n FROM events)"""
_GROWING = """(SELECT d, sum(v) OVER (ORDER BY d) AS v, pos, n FROM (SELECT d, v, row_number() OVER (ORDER BY d) - 1 AS pos,
  count(*) OVER () AS n FROM (SELECT date_trunc('day', o_orderdate) AS d, count(*) AS v FROM orders GROUP BY 1)))"""


def _event_ids(spark, sf_dir) -> trend.Series:
    """Identifiers as values: every row is a point and the series climbs from end to end."""
    return trend.series(table(spark, sf_dir, "events"), "ts", "event_id", ["event_id"])


def _growing_orders(spark, sf_dir) -> trend.Series:
    """Orders placed up to each day."""
    daily = _daily_orders(spark, sf_dir)
    total = daily.positioned().with_running(total=Running("sum", F.col("v"))).rows()
    return trend.Series(total.select("d", F.col("total").alias("v")), [], [])


@query("change_points", _with_sums(_EVENT_IDS, "pos", f"SELECT * FROM {_change_sql('s', 'd')}"))
def change_points(spark, sf_dir):
    return trend.change_candidates(_event_ids(spark, sf_dir))


@query("change_points_orders", _with_sums(_GROWING, "d", f"SELECT * FROM {_change_sql('s', 'd')}"))
def change_points_orders(spark, sf_dir):
    return trend.change_candidates(_growing_orders(spark, sf_dir))


def _thin_sql(source: str, order: str) -> str:
    return f"""WITH RECURSIVE {_with_sums(source, order, "")[5:]},
    c AS (SELECT d, "window", c.shift_pct, c.direction, row_number() OVER (ORDER BY d) AS rn FROM (
      SELECT d, "window", max_by({{'shift_pct': shift_pct, 'direction': direction}}, (shift_pct, -pos)) AS c
      FROM {_change_sql('s', 'd')} GROUP BY ALL)),
    f AS (SELECT rn, 1 AS slot, d, shift_pct, direction FROM c WHERE rn = 1
      UNION ALL SELECT c.rn, slot + CASE WHEN far THEN 1 ELSE 0 END, CASE WHEN take THEN c.d ELSE f.d END,
      CASE WHEN take THEN c.shift_pct ELSE f.shift_pct END, CASE WHEN take THEN c.direction ELSE f.direction END
      FROM f JOIN c ON c.rn = f.rn + 1,
      LATERAL (SELECT floor((epoch_us(c.d) - epoch_us(f.d)) / 86400000000) > c."window" AS far),
      LATERAL (SELECT far OR c.shift_pct > f.shift_pct AS take))
    SELECT max_by(d, rn) AS d, max_by(shift_pct, rn) AS shift_pct, max_by(direction, rn) AS direction FROM f
    WHERE slot <= 5 GROUP BY slot"""


@query("change_points_thinned", _thin_sql(_GROWING, "d"))
def change_points_thinned(spark, sf_dir):
    return trend.thin_changes(trend.change_candidates(_growing_orders(spark, sf_dir)))


@query("change_points_thinned_events", _thin_sql(_EVENT_IDS, "pos"))
def change_points_thinned_events(spark, sf_dir):
    return trend.thin_changes(trend.change_candidates(_event_ids(spark, sf_dir)))


_THIN_BY_TYPE_SQL = f"""WITH RECURSIVE s AS (SELECT coalesce(kind, '?') AS kind, pos, d, n, greatest(5, n // 10) AS w,
    coalesce(sum(id) OVER (PARTITION BY kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS e
    FROM {_HOLED_EVENTS}),
  found AS (SELECT kind, pos, d, w, round(abs(rm - lm) / abs(lm) * 100, 2) AS shift_pct,
    CASE WHEN rm > lm THEN 'increase' ELSE 'decrease' END AS direction, abs(rm - lm) / abs(lm) * 100 AS shift FROM (
      SELECT a.kind, a.pos, a.d, a.w, (a.e - l.e) / a.w AS lm, (x.e - a.e) / a.w AS rm FROM s a
      JOIN s l ON l.kind = a.kind AND l.pos = a.pos - a.w JOIN s x ON x.kind = a.kind AND x.pos = a.pos + a.w
      WHERE a.pos >= a.w AND a.pos < a.n - a.w) WHERE lm <> 0),
  c AS (SELECT kind, d, w, c.shift_pct, c.direction, row_number() OVER (PARTITION BY kind ORDER BY d) AS rn FROM (
    SELECT kind, d, w, max_by({{'shift_pct': shift_pct, 'direction': direction}}, (shift_pct, -pos)) AS c
    FROM found WHERE shift > 20 GROUP BY ALL)),
  f AS (SELECT kind, rn, 1 AS slot, d, shift_pct, direction FROM c WHERE rn = 1
    UNION ALL SELECT c.kind, c.rn, slot + CASE WHEN far THEN 1 ELSE 0 END, CASE WHEN take THEN c.d ELSE f.d END,
    CASE WHEN take THEN c.shift_pct ELSE f.shift_pct END, CASE WHEN take THEN c.direction ELSE f.direction END
    FROM f JOIN c ON c.kind = f.kind AND c.rn = f.rn + 1,
    LATERAL (SELECT floor((epoch_us(c.d) - epoch_us(f.d)) / 86400000000) > c.w AS far),
    LATERAL (SELECT far OR c.shift_pct > f.shift_pct AS take))
  SELECT nullif(kind, '?') AS kind, max_by(d, rn) AS d, max_by(shift_pct, rn) AS shift_pct,
  max_by(direction, rn) AS direction FROM f WHERE slot <= 5 GROUP BY kind, slot"""


@query("change_points_thinned_by_type", _THIN_BY_TYPE_SQL)
def change_points_thinned_by_type(spark, sf_dir):
    return trend.thin_changes(trend.change_candidates(_holed_series(spark, sf_dir, "event_id")))


# No two of the numeric event columns correlate to 0.3, so the summary has no line about correlations.
_EDA_SQL = """SELECT 'Automated EDA Summary:' || chr(10) || '- Analyzed {columns} columns' || chr(10) || '- Overall trend: '
|| CASE WHEN regr_slope(v, pos) > 0 THEN 'increasing' WHEN regr_slope(v, pos) < 0 THEN 'decreasing' ELSE 'flat' END
|| ' (R²=' || printf('%.2f', regr_r2(v, pos)) || ')' AS {name} FROM {source}"""
_ORDER_IDS = """(SELECT o_orderkey::DOUBLE AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)"""


@query("eda_summary", _EDA_SQL.format(columns=3, name="summary", source=_EVENT_IDS))
def eda_summary(spark, sf_dir):
    return eda.auto_eda(table(spark, sf_dir, "events"), ["event_id"])["summary"]


@query("eda_narrative", "SELECT '**Analysis: auto_eda**' || chr(10) || chr(10) || summary || chr(10) || chr(10) || "
       "'*Generated 7 visualization(s) to illustrate the findings.*' AS narrative FROM ("
       + _EDA_SQL.format(columns=3, name="summary", source=_ORDER_IDS) + ")")
def eda_narrative(spark, sf_dir):
    return eda.explain_eda(eda.auto_eda(table(spark, sf_dir, "orders"), ["o_orderkey"]))
