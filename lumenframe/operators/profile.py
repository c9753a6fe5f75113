"""What each column means: semantic classes and the per-column profile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Name parts that mark an identifier, and whole names that do.
IDENTIFIER_PARTS = ("_id", "id_", "identifier", "key", "index", "uuid")
IDENTIFIER_NAMES = ("id", "pk")
# Share of distinct values above which a column identifies rows (needs more rows than
# the minimum), share of parseable texts for a date column, mean length for free text.
IDENTIFIER_SHARE = 0.9
IDENTIFIER_MIN_ROWS = 10
DATETIME_SHARE = 0.8
TEXT_LENGTH = 50
# Date layouts tried on text columns, each with the shape a text must have to be parsed in it, so ordinary words cost
# a comparison or two. Days, months and hours may lack their leading zero; seconds, fractions and offsets may be absent.
_CLOCK = r"\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)? ?(Z|[+-]\d{2}:?\d{2})?"
_TIME, _TIME_SHAPE = "[ H:mm[:ss[.SSSSSSSSS]]]", r"( \d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?"
_MONTH = r"[A-Za-z]{3,9}"
DATETIME_LAYOUTS = (
    ("yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}"),
    ("yyyy-M-d H:mm[:ss[.SSSSSSSSS]][ ][XXX][XX]", r"\d{4}-\d{1,2}-\d{1,2} " + _CLOCK),
    ("yyyy-M-d'T'H:mm[:ss[.SSSSSSSSS]][ ][XXX][XX]", r"\d{4}-\d{1,2}-\d{1,2}T" + _CLOCK),
    ("yyyy/M/d" + _TIME, r"\d{4}/\d{1,2}/\d{1,2}" + _TIME_SHAPE),
    ("M/d/yyyy" + _TIME, r"\d{1,2}/\d{1,2}/\d{4}" + _TIME_SHAPE),
    ("d/M/yyyy" + _TIME, r"\d{1,2}/\d{1,2}/\d{4}" + _TIME_SHAPE),
    ("d-M-yyyy" + _TIME, r"\d{1,2}-\d{1,2}-\d{4}" + _TIME_SHAPE),
    ("d.M.yyyy" + _TIME, r"\d{1,2}\.\d{1,2}\.\d{4}" + _TIME_SHAPE),
    ("MMM d[,] yyyy" + _TIME, _MONTH + r" \d{1,2},? \d{4}" + _TIME_SHAPE),
    ("MMMM d[,] yyyy" + _TIME, _MONTH + r" \d{1,2},? \d{4}" + _TIME_SHAPE),
    ("d MMM yyyy" + _TIME, r"\d{1,2} " + _MONTH + r" \d{4}" + _TIME_SHAPE),
    ("d MMMM yyyy" + _TIME, r"\d{1,2} " + _MONTH + r" \d{4}" + _TIME_SHAPE),
    ("d-MMM-yyyy" + _TIME, r"\d{1,2}-" + _MONTH + r"-\d{4}" + _TIME_SHAPE),
)
# Any date has a year of four digits beside another part.
_DATE_LIKE = r"^\s*(\d{4}[-/]\d|\d{1,2}[-/. ][\dA-Za-z]+[-/. ]\d{4}|[A-Za-z]{3,9} \d{1,2},? \d{4})"
# The kinds of text told apart.
TEXT_KINDS = ("numeric", "datetime", "string")
# Texts that read as numbers.
NUMBER_SHAPE = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
_SKETCH_ERROR = 0.02

PROFILE_SCHEMA = (
    "column string, ordinal int, dtype string, is_numeric boolean, is_boolean boolean, "
    "is_datetime boolean, is_identifier boolean, is_text boolean, is_categorical boolean, "
    "is_nested boolean, semantic_class string, row_count bigint, missing_count bigint, "
    "missing_pct double, n_distinct bigint"
)


def parse_datetime(c: Column, layout: str) -> Column:
    """Timestamp of a text in one layout, known or a caller's own, NULL where it does not fit."""
    text = F.trim(c)
    moment = F.try_to_timestamp(text, F.lit(layout))
    shape = dict(DATETIME_LAYOUTS).get(layout)
    return F.when(text.rlike(f"^(?:{shape})$"), moment) if shape else moment


def with_date_layouts(df: DataFrame, text: str) -> DataFrame:
    """Add ``layouts``: the date layouts a text really reads in (empty for anything but a date)."""
    c = F.col(text)
    fits = F.array_compact(F.array(*[
        F.when(parse_datetime(c, layout).isNotNull(), F.lit(layout)) for layout, _ in DATETIME_LAYOUTS
    ]))
    return df.withColumn("layouts", F.when(c.rlike(_DATE_LIKE), fits))


def value_kind(text: str) -> Column:
    """numeric, datetime or string, for a text column that has its ``layouts`` beside it."""
    c = F.col(text)
    kind = F.when(c.rlike(NUMBER_SHAPE), "numeric").when(F.size("layouts") > 0, "datetime").otherwise("string")
    return F.when(c.isNotNull(), kind)


@dataclass
class ColumnProfile:
    column: str
    ordinal: int
    dtype: str
    is_numeric: bool = False
    is_boolean: bool = False
    is_datetime: bool = False
    is_identifier: bool = False
    is_text: bool = False
    is_categorical: bool = False
    is_nested: bool = False
    row_count: int = 0
    missing_count: int = 0
    n_distinct: int | None = None
    layout: str | None = None
    kinds: tuple[str, ...] = ()
    maybe_constant: bool = False

    @property
    def missing_pct(self) -> float:
        return round(100.0 * self.missing_count / self.row_count, 2) if self.row_count else 0.0

    @property
    def semantic_class(self) -> str:
        order = ("identifier", "datetime", "numeric", "categorical", "text", "boolean", "nested")
        return next((name for name in order if getattr(self, f"is_{name}")), "unknown")


@dataclass
class TableProfile:
    """One entry per column: as large as the schema, whatever the table's size."""

    row_count: int
    columns: list[ColumnProfile] = field(default_factory=list)

    def _where(self, flag: str) -> list[str]:
        return [c.column for c in self.columns if getattr(c, flag)]

    @property
    def numeric(self) -> list[str]:
        return self._where("is_numeric")

    @property
    def categorical(self) -> list[str]:
        return self._where("is_categorical")

    @property
    def datetime(self) -> list[str]:
        return self._where("is_datetime")

    @property
    def identifier(self) -> list[str]:
        return self._where("is_identifier")

    @property
    def text(self) -> list[str]:
        return self._where("is_text")

    @property
    def boolean(self) -> list[str]:
        return self._where("is_boolean")

    def get(self, column: str) -> ColumnProfile:
        return next(c for c in self.columns if c.column == column)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c.column, c.ordinal, c.dtype, c.is_numeric, c.is_boolean, c.is_datetime, c.is_identifier,
             c.is_text, c.is_categorical, c.is_nested, c.semantic_class, c.row_count, c.missing_count,
             c.missing_pct, c.n_distinct)
            for c in self.columns
        ]
        return spark.createDataFrame(rows, PROFILE_SCHEMA)

    def with_datetimes(self, df: DataFrame) -> DataFrame:
        """Give text date columns their timestamp type; other columns pass through."""
        layouts = {c.column: c.layout for c in self.columns if c.layout}
        if not layouts:
            return df
        return df.withColumns({c: parse_datetime(F.col(f"`{c}`"), layout) for c, layout in layouts.items()})


def column_kind(dtype: T.DataType) -> str:
    """Class that follows from the storage type alone."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "nested"
    return "other"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema if column_kind(f.dataType) == kind]


def identifier_by_name(name: str) -> bool:
    lower = name.lower()
    return lower in IDENTIFIER_NAMES or any(part in lower for part in IDENTIFIER_PARTS)


def _distinct_token(c: Column, kind: str) -> Column:
    """What is counted as one value: the value itself, or a 96-bit digest of a long text."""
    if kind == "string":
        return F.concat_ws(":", F.xxhash64(c), F.crc32(c))
    return c.cast("string")


def infer_profile(df: DataFrame, overrides: dict[str, str] | None = None) -> TableProfile:
    """Classify every column: one aggregate, plus one exact distinct count over the few columns
    whose sketched cardinality comes near the identifier bound.

    ``overrides`` maps a column to the class it must get (numeric, identifier, datetime, ...).
    """
    kinds = {f.name: column_kind(f.dataType) for f in df.schema}
    eligible = [
        f.name for f in df.schema
        if isinstance(f.dataType, (T.LongType, T.DoubleType, T.StringType)) and not identifier_by_name(f.name)
    ]
    rows, measured = _measure_columns(df, kinds, eligible)
    candidates = [
        name for name in eligible
        if rows > IDENTIFIER_MIN_ROWS
        and measured[name]["approx"] > (IDENTIFIER_SHARE - 4 * _SKETCH_ERROR) * rows
    ]
    exact = exact_distinct(df, candidates) if candidates else {}

    profile = TableProfile(rows)
    for i, f in enumerate(df.schema):
        name, kind = f.name, kinds[f.name]
        entry = ColumnProfile(name, i, f.dataType.simpleString(), row_count=rows)
        present = measured[name]["present"] if rows else 0
        entry.missing_count = rows - present
        entry.is_numeric, entry.is_boolean = kind == "numeric", kind == "boolean"
        entry.is_datetime, entry.is_nested = kind == "datetime", kind == "nested"
        if rows:
            entry.maybe_constant = bool(measured[name]["one_token"]) and kind not in ("nested", "other")
            entry.kinds = tuple(k for k, n in zip(TEXT_KINDS, measured[name]["kinds"]) if n)
        if kind == "string" and present:
            hits = measured[name]["dates"]
            best = max(range(len(hits)), key=lambda j: (hits[j], -j))
            if hits[best] > DATETIME_SHARE * present:
                entry.is_datetime, entry.layout = True, DATETIME_LAYOUTS[best][0]
        if name in eligible and rows:
            entry.n_distinct = exact.get(name, measured[name]["approx"])
        share_ok = name in exact and (
            exact[name] > IDENTIFIER_SHARE * rows if kind == "string" else exact[name] == rows
        )
        entry.is_identifier = identifier_by_name(name) or share_ok
        if kind == "string" and not entry.is_datetime and not entry.is_identifier:
            entry.is_text = ((measured[name]["length"] if rows else None) or 0) > TEXT_LENGTH
            entry.is_categorical = not entry.is_text
        if overrides and name in overrides:
            for flag in ("numeric", "boolean", "datetime", "identifier", "text", "categorical"):
                setattr(entry, f"is_{flag}", flag == overrides[name])
        profile.columns.append(entry)
    return profile


def _measure_columns(df: DataFrame, kinds: dict[str, str], eligible: Sequence[str]) -> tuple[int, dict]:
    """Row count and, per column, presence, text length, kinds of text, date-layout hits, sketched
    cardinality and whether all values share one hash: everything the rules need from a single scan."""
    entries = []
    for i, (name, kind) in enumerate(kinds.items()):
        c = F.col(f"`{name}`")
        hashed = F.lit(None).cast("bigint") if kind in ("nested", "other") else F.xxhash64(c)
        entries.append(F.struct(
            F.lit(i).alias("cid"),
            F.when(c.isNotNull(), hashed).alias("token"),
            c.isNotNull().alias("there"),
            (c if kind == "string" else F.lit(None).cast("string")).alias("text"),
            F.lit(name in eligible).alias("counted"),
        ))
    long = df.select(F.inline(F.array(*entries)))
    typed = with_date_layouts(long, "text").withColumn("kind", value_kind("text"))
    found = typed.groupBy("cid").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("there").alias("present"),
        F.avg(F.length("text")).alias("length"),
        F.approx_count_distinct(F.when(F.col("counted"), F.col("token")), _SKETCH_ERROR).alias("approx"),
        F.min("token").eqNullSafe(F.max("token")).alias("one_token"),
        F.array(*[F.count_if(F.col("kind") == k) for k in TEXT_KINDS]).alias("kinds"),
        F.array(*[F.count_if(F.array_contains("layouts", layout)) for layout, _ in DATETIME_LAYOUTS]).alias("dates"),
    ).collect()  # one row per column
    names = list(kinds)
    return (found[0]["rows"] if found else 0), {names[r["cid"]]: r for r in found}


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts (NULL not counted) in one job: values are deduplicated in the shuffle."""
    kinds = {f.name: column_kind(f.dataType) for f in df.schema}
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), _distinct_token(F.col(f"`{c}`"), kinds[c]).alias("token"),
                 F.col(f"`{c}`").isNotNull().alias("there"))
        for c in columns
    ])
    counted = (
        df.select(F.inline(entries)).where("there").select("column", "token").distinct()
        .groupBy("column").agg(F.count("*").alias("n"))
    )
    found = {r["column"]: r["n"] for r in counted.collect()}  # one row per column
    return {c: found.get(c, 0) for c in columns}


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, row_count, missing_count, missing_pct) of every column from one aggregate."""
    rows = F.count(F.lit(1))
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            rows.alias("row_count"),
            (rows - F.count(F.col(f"`{c}`"))).alias("missing_count"),
        )
        for c in df.columns
    ]
    long = df.agg(F.array(*entries).alias("r")).select(F.inline("r"))
    pct = F.round(F.try_divide(F.col("missing_count") * 100.0, F.col("row_count")), 2)
    return long.withColumn("missing_pct", F.coalesce(pct, F.lit(0.0)))


def schema_table(df: DataFrame) -> DataFrame:
    """Ordered column names and types."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, dtype string")


def stored_size_mb(df: DataFrame) -> DataFrame:
    """Stored megabytes of the files a file-based table is read from."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.round(F.coalesce(F.sum("file_size"), F.lit(0)) / (1024.0 * 1024.0), 2).alias("size_mb"))
