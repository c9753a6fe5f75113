"""Descriptive statistics, quantiles and distribution functions."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lumenframe.functions.special import correlation_p_value, regularized_beta, shapiro_wilk
from lumenframe.functions.text import estimate_tokens, fits_budget, truncate_to_budget
from lumenframe.operators import describe, quantiles


def _by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_one_to_ten(spark):
    row = _by_column(describe.numeric_summary(spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")))["v"]
    assert row["mean"] == 5.5 and math.isclose(row["std"], 3.0276503540974917)
    assert (row["q25"], row["median"], row["q75"]) == (3.25, 5.5, 7.75)
    assert abs(row["skewness"]) < 1e-12 and math.isclose(row["kurtosis"], -1.2)


def test_constant_null_and_short_columns(spark):
    df = spark.createDataFrame(
        [(1.0, None, 1), (1.0, None, 2), (1.0, None, 3), (1.0, None, 5)], "k double, empty double, v int"
    )
    rows = _by_column(describe.numeric_summary(df))
    assert rows["k"]["skewness"] == 0 and rows["k"]["kurtosis"] == 0
    assert rows["empty"]["all_missing"] and rows["empty"]["count"] == 0 and rows["empty"]["median"] is None
    two = _by_column(describe.numeric_summary(df.limit(2)))["v"]
    assert two["skewness"] is None and two["kurtosis"] is None


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_moments_match_pandas(spark, parts):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.lognormal(size=400), "b": rng.integers(0, 5, 400).astype(float), "g": rng.integers(0, 3, 400)})
    df = spark.createDataFrame(pdf).repartition(parts)
    rows = _by_column(describe.numeric_summary(df, ["a", "b"]))
    for c in ("a", "b"):
        assert math.isclose(rows[c]["skewness"], pdf[c].skew(), rel_tol=1e-9)
        assert math.isclose(rows[c]["kurtosis"], pdf[c].kurtosis(), rel_tol=1e-9)
        assert math.isclose(rows[c]["q75"], pdf[c].quantile(0.75), rel_tol=1e-12)
    grouped = {(r["g"], r["column"]): r for r in describe.grouped_summary(df, "g", ["a"]).collect()}
    for g, part in pdf.groupby("g"):
        assert math.isclose(grouped[(g, "a")]["median"], part.a.median(), rel_tol=1e-12)
        assert math.isclose(grouped[(g, "a")]["std"], part.a.std(), rel_tol=1e-9)


@pytest.mark.parametrize("shape", ["spread", "ties", "hot"])
def test_sketched_quantiles_are_exact(spark, shape):
    n = 150_000
    df = spark.range(n, numPartitions=6)
    value = {
        "spread": F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double"),
        "ties": F.pmod(F.xxhash64("id"), F.lit(7)).cast("double"),
        "hot": F.when(F.col("id") % 3 == 0, 42.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(90_001)).cast("double")),
    }[shape]
    df = df.select(value.alias("v"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.p: r["quantile"] for r in quantiles.exact_quantiles(df, ["v"], probs).collect()}
    values = df.toPandas().v
    for p in probs:
        assert math.isclose(got[p], values.quantile(p), rel_tol=1e-12), p


def test_weighted_quantiles_of_groups(spark):
    counts = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("value"),
                                     (F.col("id") % 4 + 1).alias("cnt"))
    got = {(r.g, r.p): r["quantile"] for r in quantiles.weighted_quantiles(counts, [0.3, 0.5], ["g"]).collect()}
    pdf = counts.toPandas()
    for g, own in pdf.groupby("g"):
        values = own.loc[own.index.repeat(own.cnt)].value
        for p in (0.3, 0.5):
            assert math.isclose(got[g, p], values.quantile(p), rel_tol=1e-12)


@pytest.mark.parametrize("rows", [1, 3, 40, 60_000])
def test_grouped_quantiles_take_one_path(spark, rows):
    df = spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 40))
        .alias("g"), F.pmod(F.xxhash64("id"), F.lit(4001)).cast("double").alias("v"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("w"))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.column, r.p): r["quantile"] for r in quantiles.exact_quantiles(df, ["v", "w"], probs, ["g"]).collect()}
    want = {(g, c, p): own[c].astype(float).quantile(p) for g, own in df.toPandas().groupby("g") for c in ("v", "w")
            for p in probs if own[c].notna().any()}
    assert set(got) == set(want)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)


def test_categories_and_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "s string")
    row = describe.categorical_summary(df, ["s"]).head()
    assert (row["unique_count"], row["mode"], row["mode_frequency"], row["missing_count"]) == (3, "a", 2, 1)
    top = [(r["value"], r["count"]) for r in describe.value_counts(df, "s", 2).collect()]
    assert top == [("a", 2), ("b", 2)]


def test_normality_sizes(spark):
    rng = np.random.default_rng(0)
    rows = [("few", float(i)) for i in range(7)] + [("fit", float(x)) for x in rng.normal(size=60)]
    rows += [("many", float(i)) for i in range(5001)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["group"]: r for r in describe.normality(df, ["v"], "g").collect()}
    assert set(got) == {"fit"} and got["fit"]["is_normal"]


def test_shapiro_against_published_example():
    # Weights of 11 men, the standard textbook sample of the test.
    sample = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float)
    w, p = shapiro_wilk(sample)
    assert abs(w - 0.79) < 0.01 and abs(p - 0.0067) < 0.001


def test_p_values_against_closed_forms():
    assert math.isclose(regularized_beta(0.3, 1.0, 1.0), 0.3, rel_tol=1e-12)
    assert math.isclose(regularized_beta(0.4, 2.0, 3.0), 0.5248, rel_tol=1e-9)
    # One degree of freedom: t is Cauchy.
    t = 2.0
    r = t / math.sqrt(t * t + 1)
    assert math.isclose(correlation_p_value(r, 3), 1 - 2 * math.atan(t) / math.pi, rel_tol=1e-9)
    assert correlation_p_value(1.0, 10) == 0.0


@settings(max_examples=50, deadline=None)
@given(st.floats(0.01, 0.99), st.floats(0.5, 50), st.floats(0.5, 50))
def test_beta_symmetry(x, a, b):
    assert math.isclose(regularized_beta(x, a, b) + regularized_beta(1 - x, b, a), 1.0, abs_tol=1e-9)


def test_token_budget(spark):
    df = spark.createDataFrame([("abcdefgh",)], "s string")
    c = F.col("s")
    row = df.select(estimate_tokens(c).alias("n"), fits_budget(c, 2).alias("fits"),
                    truncate_to_budget(c, 2).alias("two"), truncate_to_budget(c, 1).alias("one")).head()
    assert (row.n, row.fits, row.two) == (2, True, "abcdefgh")
    assert row.one == "abcd\n... (truncated to fit context window)"


def test_tables_without_numbers(spark):
    from lumenframe.plans import statistical

    df = spark.createDataFrame([("a", "b")], "k string, s string")
    assert describe.numeric_summary(df).count() == 0
    assert statistical.detect_outliers(df, ["k"]).count() == 0
    with pytest.raises(ValueError):
        describe.grouped_summary(df, "k")
