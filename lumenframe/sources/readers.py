"""Tables from CSV, JSON, Parquet and Excel files or folders."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.nulls import NULL_TOKENS, normalize_nulls, null_tokens_to_null
from .records import array_records, csv_records
from .workbook import sheet_rows

# File endings and the readers they lead to.
FORMATS = {".csv": "csv", ".xlsx": "excel", ".json": "json", ".parquet": "parquet"}
# Types tried on text columns, narrowest first.
_TRIED = ("bigint", "double", "boolean")


def format_of(path: str) -> str:
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending not in FORMATS:
        raise ValueError(f"Unsupported format '{ending}'. Supported: {sorted(FORMATS)}")
    return FORMATS[ending]


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by ending (or ``fmt`` for a folder) with missing values unified; nothing is computed yet
    unless column types have to be inferred from text."""
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet, "excel": read_excel}
    chosen = fmt or format_of(path)
    if chosen not in readers:
        raise ValueError(f"Unsupported format '{chosen}'. Supported: {sorted(readers)}")
    return readers[chosen](spark, path, **options)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalize_nulls(spark.read.parquet(path))


def with_row_id(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with a stable row identity: file and position in it."""
    raw = spark.read.parquet(path)
    placed = raw.select("*", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_no"))
    return normalize_nulls(placed)


def _shaped(c, kind: str):
    """Value of a text in a type, NULL where it does not read as one."""
    if kind == "bigint":
        return F.when(c.rlike(r"^[+-]?\d{1,19}$"), c.try_cast("bigint"))
    if kind == "double":
        return F.when(c.rlike(r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)$"), c.try_cast("double"))
    if kind == "timestamp_ntz":
        return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), c.try_cast("timestamp_ntz"))
    return F.when(F.lower(c).isin("true", "false"), F.lower(c).try_cast("boolean"))


def infer_text_types(df: DataFrame, keep: Sequence[str] = (), tried: Sequence[str] = _TRIED) -> DataFrame:
    """Give each text column (but those of ``keep``) the narrowest type all its values read as: one aggregate over
    every row."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not texts:
        return df
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in texts
    ]))).where("v is not null")
    fits = long.groupBy("column").agg(
        F.count("*").alias("n"), *[F.count(_shaped(F.trim("v"), t)).alias(t) for t in tried]
    ).collect()  # one row per column
    chosen = {r["column"]: next((t for t in tried if r[t] == r["n"]), None) for r in fits}
    return df.select(*[
        _shaped(F.trim(F.col(f"`{c}`")), chosen[c]).alias(c) if chosen.get(c) else F.col(f"`{c}`")
        for c in df.columns
    ])


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False,
    tokens: Sequence[str] = NULL_TOKENS,
) -> DataFrame:
    """CSV with a header. Without a schema everything is read as text, null markers are removed and types
    are inferred from all rows; a schema names and types the columns in their order. Files are split among tasks, with
    ``multiline`` (values that hold line ends) as well."""
    if multiline:
        raw = _multiline_csv(spark, path)
    else:
        raw = spark.read.option("header", True).option("escape", '"').option("inferSchema", False).csv(path)
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if len(raw.columns) != len(wanted):
            raise ValueError(f"the file has {len(raw.columns)} columns, the schema {len(wanted)}")
        raw = raw.toDF(*wanted.fieldNames())
    cleaned = null_tokens_to_null(raw, tokens)
    if schema is None:
        return infer_text_types(cleaned)
    return normalize_nulls(cleaned.select(*[
        F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType)
        else F.col(f"`{f.name}`") for f in wanted]))


def _multiline_csv(spark: SparkSession, path: str) -> DataFrame:
    records = csv_records(spark, path)
    options = {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    # Every file's first record is its header; the names are taken from the first file.
    first = records.where("block = 0 and number = 0").orderBy("file").select("record").first()
    if first is None:
        return spark.createDataFrame([], "value string").select()
    header = next(csv.reader(io.StringIO(first.record)))
    schema = ", ".join(f"`_{i}` string" for i in range(len(header)))
    rows = records.where("block > 0 or number > 0").select(F.from_csv("record", schema, options).alias("r"))
    return rows.select(*[F.col(f"r._{i}").alias(name) for i, name in enumerate(header)])


def json_layout(spark: SparkSession, path: str) -> str:
    """lines, records or columns, told from how the text begins: an array holds records; an object that ends on its
    line is one of many lines, unless all it holds is objects, which makes it a table by columns."""
    begun = spark.read.text(path).where(F.trim("value") != "").limit(1).select(
        F.trim("value").alias("v"), F.from_json("value", "map<string,string>").isNotNull().alias("whole"),
        F.from_json("value", _BY_COLUMN).isNotNull().alias("nested")).first()
    if begun is None or begun.v.startswith("["):
        return "records" if begun else "lines"
    if begun.whole:
        cells = spark.read.text(path).limit(1).select(F.map_values(F.from_json("value", "map<string,variant>")).alias("v"))
        objects = cells.select(F.forall("v", lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))).first()
        return "columns" if objects and objects[0] and begun.nested else "lines"
    by_column = spark.read.text(path, wholetext=True).limit(1).select(F.from_json("value", _BY_COLUMN).isNotNull()).first()
    return "columns" if by_column[0] else "records"


_BY_COLUMN = "map<string,map<string,string>>"


def read_json(
    spark: SparkSession, path: str, lines: bool | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """JSON lines, files holding one array of records each (``lines=False``; both are split among tasks), or tables by
    columns; unless told, the layout is looked up."""
    layout = json_layout(spark, path) if lines is None else "lines" if lines else "records"
    if layout == "columns":
        found = read_column_json(spark, path)
        return found if schema is None else found.select(*[
            F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name)
            for f in (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))])
    reader = spark.read if schema is None else spark.read.schema(schema)
    if layout == "records":
        return normalize_nulls(reader.json(array_records(spark, path).select("record").rdd.map(lambda r: r.record)))
    return normalize_nulls(reader.json(path))


def read_column_json(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Column-oriented JSON objects ``{column: {row: value}}``, one per file, with inferred types."""
    files = spark.read.text(path, wholetext=True)
    cells = files.select(
        F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("column", "cells")
    ).select("column", F.explode("cells").alias("row", "cell"))
    names = list(columns) if columns else [
        r[0] for r in cells.groupBy("column").count().select("column").collect()  # one row per column
    ]
    table = cells.groupBy("row").pivot("column", sorted(names) if not columns else names).agg(F.first("cell"))
    typed = infer_text_types(table.select(F.col("row").alias("row_label"), *[F.col(f"`{c}`") for c in names]))
    return typed


def read_excel(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sheet: int = 0, header: bool = True
) -> DataFrame:
    """First sheet of each workbook in a folder or pattern -> (file, row_no, columns...).

    One workbook is one task's unit of work; a folder of them is read in parallel. Without a schema, the header gives
    the names and all cells the types; date cells become timestamps.
    """
    return workbook_table(spark.read.format("binaryFile").load(path).select("path", "content"), schema, sheet, header)


def workbook_table(
    files: DataFrame, schema: T.StructType | str | None = None, sheet: int = 0, header: bool = True
) -> DataFrame:
    """The same from a table of workbooks (path, content)."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(content, sheet, header)
                yield pd.DataFrame({"file": [file] * len(rows), "row_no": range(len(rows)),
                                    "cells": [list(row.items()) for row in rows]})

    pairs = files.mapInPandas(unpack, "file string, row_no bigint, cells array<struct<name:string,text:string>>")
    rows = pairs.select("file", "row_no", F.map_from_entries("cells").alias("cells"), F.transform(
        "cells", lambda c: c["name"]).alias("names"))
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return normalize_nulls(rows.select("file", "row_no", *[
            F.try_element_at("cells", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in wanted]))
    # One row per column: where it stands first, and its name.
    found = rows.select(F.posexplode("names").alias("place", "name")).groupBy("name").agg(
        F.min("place").alias("place")).orderBy("place", "name").collect()
    texts = rows.select("file", "row_no", *[F.try_element_at("cells", F.lit(r.name)).alias(r.name) for r in found])
    return normalize_nulls(infer_text_types(texts, keep=["file"], tried=(*_TRIED, "timestamp_ntz")))
