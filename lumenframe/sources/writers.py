"""Tables to JSON, CSV and short text previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import normalize_nulls
from ..operators.sample import head, tail

# Fixed value: rows of a preview; longer tables show their first and last half.
PREVIEW_ROWS = 30


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row in column ``json``: NaN as null, moments in ISO format."""
    clean = normalize_nulls(df)
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns]), options).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    normalize_nulls(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def _ends(df: DataFrame, key: Sequence[str], max_rows: int, line: Column) -> DataFrame:
    """(part, place, line) of the first and last rows; a short table is whole in the first part."""
    half = max_rows // 2
    many = head(df, max_rows + 1, key).agg((F.count(F.lit(1)) > max_rows).alias("many")).scalar()
    place = F.struct(*[F.col(k) for k in key])
    shape = [place.alias("place"), line.alias("line")]
    whole = head(df, max_rows, key).where(~many).select(F.lit(0).alias("part"), *shape)
    first = head(df, half, key).where(many).select(F.lit(0).alias("part"), *shape)
    last = tail(df, half, key).where(many).select(F.lit(2).alias("part"), *shape)
    return whole.unionByName(first).unionByName(last)


def csv_preview(df: DataFrame, key: Sequence[str], max_rows: int = PREVIEW_ROWS) -> DataFrame:
    """(part, place, line): CSV lines of the shown rows, ordered by part and place."""
    return _ends(df, key, max_rows, F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def markdown_preview(df: DataFrame, key: Sequence[str], max_rows: int = PREVIEW_ROWS) -> DataFrame:
    """One row: a Markdown table of the shown rows and a note on how many were left out."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    shown = _ends(df, key, max_rows, line)
    # At most max_rows short lines meet here.
    body = shown.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "place", "line"))), lambda r: r["line"]
    ), "\n").alias("body")).scalar()
    header = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    omitted = df.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") - max_rows).alias("omitted"))
    note = F.when(F.col("omitted") > 0, F.format_string("\n\n... (%d rows omitted) ...", "omitted"))
    return omitted.select(F.concat(F.concat_ws("\n", F.lit(header), body), F.coalesce(note, F.lit(""))).alias("text"))
