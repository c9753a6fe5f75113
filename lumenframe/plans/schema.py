"""Mixed types, missing values, duplicate rows and constant columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.profile import TEXT_KINDS, TableProfile, columns_of_kind, missing_summary, value_kind, with_date_layouts
from .findings import SHOWN_KEYS, empty_findings, table_finding

# Missing shares (percent) that warn and that are errors, duplicate share that is an error.
MISSING_WARNING = 5.0
MISSING_CRITICAL = 30.0
DUPLICATE_ERROR = 5.0


def type_mix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, numeric, datetime, string) value counts of the text columns, over all rows."""
    chosen = list(columns) if columns else columns_of_kind(df, "string")
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in chosen
    ]))).where("value is not null")
    typed = with_date_layouts(long, "value").select("column", value_kind("value").alias("kind"))
    return typed.groupBy("column").agg(*[
        F.count_if(F.col("kind") == kind).alias(kind) for kind in TEXT_KINDS
    ])


def mixed_type_findings(df: DataFrame, start: int = 0, profile: TableProfile | None = None) -> DataFrame:
    """Text columns of more than one kind; a profile already knows the kinds and saves the scan."""
    texts = columns_of_kind(df, "string")
    if not texts:
        return empty_findings(df.sparkSession)
    if profile:
        known = [(c.column, list(c.kinds)) for c in profile.columns if len(c.kinds) > 1]
        mixed = df.sparkSession.createDataFrame(known, "column string, kinds array<string>")
    else:
        kinds = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in TEXT_KINDS]))
        mixed = type_mix(df, texts).withColumn("kinds", kinds).where(F.size("kinds") > 1)
    position = F.lit(start) + F.array_position(F.array(*[F.lit(c) for c in texts]), F.col("column")) - 1
    return mixed.select(*table_finding(
        "mixed_types", "warning", "schema", F.col("column"), F.lit(None),
        F.format_string("Column '%s' contains mixed types: %s", "column", F.array_join("kinds", ", ")),
        "Convert the column to one type; stray texts among numbers are usually entry errors.",
        F.create_map(F.lit("types_found"), F.array_join("kinds", ", ")), position,
    ))


def missing_findings(
    df: DataFrame, warning: float = MISSING_WARNING, critical: float = MISSING_CRITICAL, start: int = 0,
    profile: TableProfile | None = None,
) -> DataFrame:
    """Columns missing beyond the warning share; a profile already holds the counts and saves the scan."""
    counted = profile.to_df(df.sparkSession) if profile else missing_summary(df)
    summary = counted.where(F.col("missing_pct") >= warning)
    severe = F.col("missing_pct") >= critical
    position = F.lit(start) + F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column")) - 1
    return summary.select(*table_finding(
        "missing_values", F.when(severe, "error").otherwise("warning"), "schema", F.col("column"),
        F.col("missing_count"),
        F.when(severe, F.format_string(
            f"Column '%s' has %.1f%% missing values (critical threshold: {critical}%%)", "column", "missing_pct"
        )).otherwise(F.format_string("Column '%s' has %.1f%% missing values", "column", "missing_pct")),
        F.when(severe, "Drop the column or find out why it is so empty.").otherwise(
            "Fill the holes with a median or mode, or leave them out."),
        F.create_map(
            F.lit("missing_pct"), F.col("missing_pct").cast("string"),
            F.lit("threshold"), F.when(severe, str(critical)).otherwise(str(warning)),
        ),
        position,
    ))


def _digests(df: DataFrame, key: Sequence[str], surrogate: Sequence[str]) -> DataFrame:
    """Each row as its key and two hashes of the compared columns: all but the named surrogates.

    Whether a value is missing is hashed as well, so a hole in one column never looks like a hole in another.
    """
    left_out = set(surrogate)
    parts: list[Column] = []
    for field in df.schema:
        if field.name not in left_out:
            c = F.col(f"`{field.name}`")
            nested = field.dataType.typeName() in ("array", "map", "struct")
            parts += [c.isNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if nested else c]
    return df.withColumns({
        "__d1": F.xxhash64(F.lit(1), *parts), "__d2": F.xxhash64(F.lit(2), *parts),
        "__key": F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`") for k in key]),
    })


def duplicate_groups(df: DataFrame, key: Sequence[str] = (), surrogate: Sequence[str] = ()) -> DataFrame:
    """Rows that agree in all compared columns, by their hashes: (__d1, __d2, copies, first_key).

    Copies are merged before the shuffle, so even a row held by a third of the table moves once per task, and only
    hashes and keys move.
    """
    return _digests(df, key, surrogate).groupBy("__d1", "__d2").agg(
        F.count("*").alias("copies"), F.min("__key").alias("first_key"))


def duplicate_summary(df: DataFrame, key: Sequence[str] = (), surrogate: Sequence[str] = ()) -> DataFrame:
    """(row_count, duplicate_count, duplicate_pct): rows beyond the first of their kind."""
    totals = duplicate_groups(df, key, surrogate).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count"),
    )
    pct = F.coalesce(F.try_divide(F.col("duplicate_count") * 100.0, F.col("row_count")), F.lit(0.0))
    return totals.withColumn("duplicate_pct", F.round(pct, 2))


def _surplus(df: DataFrame, key: Sequence[str], surrogate: Sequence[str]) -> DataFrame:
    """(__d1, __d2, __key, surplus): how many rows with a key repeat an earlier one; of a group's first key one is none."""
    counted = _digests(df, key, surrogate).groupBy("__d1", "__d2", "__key").agg(F.count("*").alias("rows"))
    groups = duplicate_groups(df, key, surrogate).where("copies > 1").drop("copies")
    surplus = F.col("rows") - (F.col("__key") == F.col("first_key")).cast("int")
    return counted.join(groups, ["__d1", "__d2"]).select("__d1", "__d2", "__key", surplus.alias("surplus")).where("surplus > 0")


def duplicate_rows(df: DataFrame, key: Sequence[str], surrogate: Sequence[str] = ()) -> DataFrame:
    """Every row that repeats an earlier one (in key order), with all its columns, as often as it does.

    Whole rows are shuffled once, to meet the hashes of the repeated ones; a row repeated with its key comes back
    once for each surplus copy.
    """
    extra = _surplus(df, key, surrogate)
    met = _digests(df, key, surrogate).join(extra, ["__d1", "__d2", "__key"])
    one = met.groupBy("__d1", "__d2", "__key", "surplus").agg(
        F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
    return one.select("row", F.explode(F.sequence(F.lit(1), F.col("surplus").cast("int")))).select("row.*")


def duplicate_findings(
    df: DataFrame, key: Sequence[str], start: int = 0, surrogate: Sequence[str] = ()
) -> DataFrame:
    """One finding about rows that agree in all columns but the named surrogates, with the keys of the first surplus."""
    summary = duplicate_summary(df, key, surrogate).where("duplicate_count > 0")
    first = _surplus(df, key, surrogate).select("__key", F.explode(
        F.sequence(F.lit(1), F.least("surplus", F.lit(SHOWN_KEYS)).cast("int")))).orderBy("__key").limit(SHOWN_KEYS)
    listed = first.agg(F.transform(
        F.array_sort(F.collect_list("__key")),
        lambda k: F.concat_ws("|", *[k[name].cast("string") for name in key]),
    ).alias("keys"))
    n, pct = F.col("duplicate_count"), F.col("duplicate_pct")
    share = n * 100.0 / F.col("row_count")
    return summary.select(*table_finding(
        "duplicate_rows", F.when(share < DUPLICATE_ERROR, "warning").otherwise("error"), "schema", F.lit(None), n,
        F.format_string("Found %d duplicate rows (%.1f%% of dataset)", n, share),
        "Remove the copies unless they are meant.",
        F.create_map(F.lit("count"), n.cast("string"), F.lit("percentage"), pct.cast("string")),
        start, listed.scalar(),
    ))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, unique_values): columns with no more than one distinct value, in tables of two rows or more.

    Smallest equals largest says the same as a distinct count of one, without the distinct.
    """
    plain = [
        c for c, t in df.dtypes
        if not t.startswith(("map", "array", "struct", "variant")) and (columns is None or c in columns)
    ]
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(F.count(F.col(f"`{c}`")) == 0, 0)
            .when(F.min(F.col(f"`{c}`")) == F.max(F.col(f"`{c}`")), 1).alias("unique_values"),
            F.count(F.lit(1)).alias("n"),
        )
        for c in plain
    ]
    found = df.agg(F.array(*entries).alias("r")).select(F.inline("r"))
    return found.where("n > 1 and unique_values is not null").select("column", "unique_values")


def constant_findings(df: DataFrame, start: int = 0, profile: TableProfile | None = None) -> DataFrame:
    """Columns without variation; with a profile only columns whose values share one hash are looked at again."""
    likely = [c.column for c in profile.columns if c.maybe_constant] if profile else None
    if likely == [] or (profile and profile.row_count < 2):
        return empty_findings(df.sparkSession)
    position = F.lit(start) + F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column")) - 1
    return constant_columns(df, likely).select(*table_finding(
        "constant_column", "info", "schema", F.col("column"), F.lit(None),
        F.format_string(
            "Column '%s' has only %d unique value(s) — provides no analytical value", "column", "unique_values"
        ),
        "Leave the column out of the analysis.",
        F.create_map(F.lit("unique_values"), F.col("unique_values").cast("string")), position,
    ))
