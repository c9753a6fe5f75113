"""Correlations against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import correlation


def _pairs(df):
    return {(r["column_1"], r["column_2"]): r["correlation"] for r in df.collect()}


def test_perfect_lines(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 6.0 - i) for i in range(1, 6)], "x double, y double, z double")
    got = _pairs(correlation.correlations(df))
    assert math.isclose(got[("x", "y")], 1) and math.isclose(got[("x", "z")], -1)
    report = correlation.significant_pairs(correlation.correlations(df)).collect()
    assert {r["strength"] for r in report} == {"very strong"} and len(report) == 3
    best = {r["direction"]: r["correlation"] for r in correlation.strongest(correlation.correlations(df)).collect()}
    assert best == {"positive": 1.0, "negative": -1.0}


def test_small_ranks(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double")
    assert math.isclose(_pairs(correlation.correlations(df))[("x", "y")], 0.8528028654224417, rel_tol=1e-9)
    assert math.isclose(_pairs(correlation.correlations(df, method="spearman"))[("x", "y")], 5 / 6, rel_tol=1e-9)
    assert math.isclose(_pairs(correlation.correlations(df, method="kendall"))[("x", "y")], 0.8, rel_tol=1e-9)


def _tau(x, y):
    c = d = tx = ty = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        c += a * b > 0
        d += a * b < 0
        tx += a == 0
        ty += b == 0
    t = len(x) * (len(x) - 1) / 2
    return (c - d) / math.sqrt((t - tx) * (t - ty)), d


@pytest.mark.parametrize("seed,parts", [(0, 1), (1, 4), (2, 37)])
def test_kendall_brute_force(spark, seed, parts):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 12, 90), rng.integers(0, 9, 90)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(parts)
    row = correlation.kendall_tau(df, "x", "y").head()
    tau, discordant = _tau(x, y)
    assert row["discordant"] == discordant and math.isclose(row["correlation"], tau, rel_tol=1e-12)


def test_missing_rows_and_constants(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 5.0), (2.0, None, 5.0), (3.0, 2.0, 5.0), (5.0, 9.0, 5.0), (None, 4.0, 5.0)], "a double, b double, k double"
    )
    upper = {(r["column_1"], r["column_2"]): r for r in correlation.correlations(df).collect()}
    assert upper[("a", "b")]["n"] == 3 and upper[("a", "k")]["correlation"] is None
    pairwise = correlation.pair_correlations(df, [("a", "k")]).head()
    assert pairwise["n"] == 4 and pairwise["correlation"] is None
    assert correlation.correlations(df.limit(2)).head()["correlation"] is None


def test_gram_path_equals_pair_path(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(300, 45)), columns=[f"c{i}" for i in range(45)])
    got = _pairs(correlation.correlations(spark.createDataFrame(pdf)))
    want = pdf.corr()
    assert len(got) == 45 * 44 // 2
    assert all(math.isclose(v, want.loc[a, b], abs_tol=1e-9) for (a, b), v in got.items())


def test_spearman_with_a_hot_value(spark):
    df = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(50)).cast("double")).alias("a"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400)).cast("double").alias("b"),
    )
    want = df.toPandas().rank().corr().loc["a", "b"]
    assert math.isclose(_pairs(correlation.correlations(df, method="spearman"))[("a", "b")], want, rel_tol=1e-9)


def test_average_ranks_of_many_and_frequent_values(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"many": rng.normal(size=9000), "some": rng.integers(0, 3000, 9000) * 1.0, "few": rng.integers(0, 4, 9000) * 1.0})
    pdf.loc[rng.random(9000) < 0.4, "many"] = 0.25  # a value that holds much of a column of many values
    pdf.loc[::7, "some"], pdf.loc[::11, "many"], pdf.loc[:3, "few"] = None, -0.0, None
    pdf.loc[5::11, "many"] = 0.0
    entries = [tuple(None if np.isnan(v) else float(v) for v in row) for row in pdf.itertuples(index=False)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(entries)], "id long, many double, some double, few double")
    got = correlation.average_ranks(df.repartition(7), ["id", "many", "some", "few"]).toPandas().sort_values("id", ignore_index=True)
    assert (got["id"] == np.arange(1, 9001)).all()
    pd.testing.assert_frame_equal(got.drop(columns="id"), pdf.rank())
    not_numbers = spark.createDataFrame([(math.nan,), (1.0,), (math.nan,), (None,), (math.inf,)], "x double")
    assert sorted(r[0] or 0 for r in correlation.average_ranks(not_numbers, ["x"]).collect()) == [0, 1, 2, 3.5, 3.5]
    assert correlation.average_ranks(df.limit(0), ["many", "few"]).collect() == []


def test_ranks_move_rows_once_for_each_column_of_many_values(spark, capsys):
    df = spark.range(20_000).select(  # few values, many, many
        (F.col("id") % 5).alias("a"), F.col("id").alias("b"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("c"))
    for columns, moves in ((["a"], 0), (["a", "b"], 1), (["a", "b", "c"], 2)):
        correlation.average_ranks(df, columns).explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange") == moves and not any(x in plan for x in ("Join", "Generate", "Aggregate"))


def test_needs_two_columns(spark):
    with pytest.raises(ValueError):
        correlation.correlations(spark.range(5).toDF("only"))
