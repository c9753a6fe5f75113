"""Semantic classes and the profile."""

import pytest
from pyspark.sql import functions as F

from lumenframe.functions.nulls import normalize_nulls
from lumenframe.operators import describe, profile
from lumenframe.operators.profile import parse_datetime, with_date_layouts


def test_classes(spark):
    rows = [
        (1.5 * (i % 7), f"u{i}", "long repeated text " * 4, "low" if i % 2 else "high", f"2024-01-{i % 10 + 1:02d}", i % 2 == 0, [i])
        for i in range(20)
    ]
    df = spark.createDataFrame(
        rows, "paid_amount double, uid string, note string, level string, `when` string, flag boolean, arr array<int>"
    )
    found = profile.infer_profile(df)
    assert {c.column: c.semantic_class for c in found.columns} == {
        "paid_amount": "identifier", "uid": "identifier", "note": "text", "level": "categorical",
        "when": "datetime", "flag": "boolean", "arr": "nested",
    }
    assert "paid_amount" in found.numeric and found.get("when").layout == "yyyy-M-d"
    assert dict(found.with_datetimes(df).dtypes)["when"] == "timestamp"
    forced = profile.infer_profile(df, {"paid_amount": "numeric"})
    assert "paid_amount" not in forced.identifier
    assert found.to_df(spark).count() == 7


def test_numeric_identifier_needs_all_distinct(spark):
    df = spark.range(100).select(
        F.col("id").cast("double").alias("all"), F.least(F.col("id"), F.lit(98)).cast("double").alias("almost"),
        F.col("id").cast("int").alias("small"),
    )
    assert profile.infer_profile(df).identifier == ["all"]


def test_datetime_share(spark):
    rows = [("2024-01-05",)] * 8 + [("01/06/2024",)] * 2
    assert profile.infer_profile(spark.createDataFrame(rows, "d string")).datetime == []
    rows = [("2024-01-05",)] * 9 + [("01/06/2024",)] * 2
    assert profile.infer_profile(spark.createDataFrame(rows, "d string")).datetime == ["d"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, s string")
    found = profile.infer_profile(df)
    assert found.row_count == 0 and found.get("a").missing_pct == 0.0
    assert {r["missing_pct"] for r in profile.missing_summary(df).collect()} == {0.0}
    assert describe.numeric_summary(df).count() == 0


def test_nan_is_missing(spark):
    df = normalize_nulls(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, y int"))
    assert {r["column"]: r["missing_count"] for r in profile.missing_summary(df).collect()} == {"x": 1, "y": 0}


def test_text_profile_mentions_missing(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "level string")
    line = describe.text_profile(df, profile.infer_profile(df)).head()["line"]
    assert line == "level (string, categorical, 2 unique, top: [a, b], 25.0% missing)"


@pytest.mark.parametrize(("text", "moment"), [
    ("2024-01-05T10:00:00Z", "2024-01-05 10:00:00"), ("2024-01-05T10:00:00+02:00", "2024-01-05 08:00:00"),
    ("2024-01-05T10:00:00+0200", "2024-01-05 08:00:00"), ("2024-01-05 10:00:00.123", "2024-01-05 10:00:00.123000"),
    ("2024-01-05 10:30", "2024-01-05 10:30:00"), ("1/5/2024", "2024-01-05 00:00:00"), ("Jan 5, 2024", "2024-01-05 00:00:00"),
    ("January 5, 2024", "2024-01-05 00:00:00"), ("5 Jan 2024 7:05", "2024-01-05 07:05:00"), ("05-Jan-2024", "2024-01-05 00:00:00"),
    (" 2024/1/5 ", "2024-01-05 00:00:00"), ("15.1.2024", "2024-01-15 00:00:00"), ("2024-02-30", None), ("Janx 5, 2024", None),
    ("5", None), ("2024", None), ("12-34-5678 and more", None), ("may 5 come", None),
])
def test_date_texts(spark, text, moment):
    rows = with_date_layouts(spark.createDataFrame([(text,)], "t string"), "t")
    layouts = rows.head()["layouts"] or []
    assert bool(layouts) == (moment is not None)
    if moment:
        got = rows.select(parse_datetime(F.col("t"), layouts[0]).cast("string").alias("m")).head()["m"]
        assert got == moment.replace(".123000", ".123")
