"""Tables written as text files in the shared folder and read back: CSV, CSV whose values span lines, JSON layouts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.readers import read_csv, read_json
from .registry import query, table

_CSV = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@query("csv_multiline", "SELECT doc_id, lang, length(text) AS n, md5(text) AS digest FROM documents")
def csv_multiline(spark, sf_dir):
    path = scratch_path(spark, "documents-csv")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.options(**_CSV).csv(path)
    found = read_csv(spark, path, schema="doc_id bigint, lang string, text string", multiline=True)
    return found.select("doc_id", "lang", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query("csv_inferred", """SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS customers, min(o_orderkey) AS first_key
FROM orders GROUP BY 1""")
def csv_inferred(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.options(**_CSV).csv(path)
    # Sums and minima are of bigint only if the types were told from the texts.
    return read_csv(spark, path).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.sum("o_custkey").alias("customers"), F.min("o_orderkey").alias("first_key"))


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a task as the lines of one JSON array."""
    before = "["
    for batch in batches:
        lines = []
        for record in batch.column("value").to_pylist():
            lines.append(before + record)
            before = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if before == "," else "[]"])], ["value"])


@query("json_array", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def json_array(spark, sf_dir):
    path = scratch_path(spark, "conversations-json")
    rows = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    rows.mapInArrow(_as_array, "value string").write.text(path)
    return read_json(spark, path, lines=False).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("json_lines", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def json_lines(spark, sf_dir):
    path = scratch_path(spark, "part-json")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.json(path)
    return read_json(spark, path, lines=True).select("p_partkey", "p_name", F.col("p_size").cast("bigint").alias("p_size"))
