"""Tables the queries share, derived from the standard ones, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import table

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]

LABELED_SQL = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def labeled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most have none, so quality and toxic are missing together."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


FULFILLMENT_SQL = """(SELECT o.o_orderkey, o.o_orderpriority, o.o_totalprice, s.first_quantity, s.shipped_value, s.carrier
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, min(l_quantity) AS first_quantity, round(sum(l_extendedprice), 2) AS shipped_value,
           min(l_returnflag) AS carrier
    FROM lineitem GROUP BY l_orderkey) s ON o.o_orderkey = s.l_orderkey)"""


def fulfillment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what was shipped; orders without a line have holes."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_quantity").alias("first_quantity"), F.round(F.sum("l_extendedprice"), 2).alias("shipped_value"),
        F.min("l_returnflag").alias("carrier"),
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(shipped, orders.o_orderkey == shipped.l_orderkey, "left").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", "first_quantity", "shipped_value", "carrier"
    )


DAILY_ORDERS_SQL = """(SELECT d, v, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS n FROM (
  SELECT date_trunc('day', o_orderdate) AS d, count(*) AS v FROM orders GROUP BY 1))"""

EVENT_SERIES_SQL = """(SELECT ts AS d, value AS v, event_id, event_type,
  row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"""
