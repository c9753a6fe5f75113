"""One notion of "missing": NULL. NaN and textual null markers are folded into it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

# Texts a delimited file uses for "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def normalize_nulls(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL on every float column; tables without floats come back unchanged."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`")
        for c in df.columns
    ])


def null_tokens_to_null(df: DataFrame, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """Replace the textual null markers of string columns by NULL."""
    tokens = list(tokens)
    return df.select(*[
        F.when(~F.trim(F.col(f"`{f.name}`")).isin(tokens), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])
