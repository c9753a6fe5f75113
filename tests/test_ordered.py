"""The bucketed running aggregates against pandas, whatever the partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators.ordered import BUCKET, OrderedRows, Running


def _frame(n=700, groups=5, hot=0.4, seed=3):
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < hot, 0, rng.integers(0, groups, n))
    return pd.DataFrame({
        "g": group, "t": rng.integers(0, 40, n), "id": np.arange(n),
        "v": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n).round(3)),
    }).sample(frac=1, random_state=1)


@pytest.mark.parametrize("parts,buckets", [(1, 1), (4, 3), (37, 9)])
def test_grouped_running_values(spark, parts, buckets):
    pdf = _frame()
    df = spark.createDataFrame(pdf).repartition(parts).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    ordered = OrderedRows(df, ["t", "id"], ["g"], buckets=buckets).with_position().with_previous(prev="v")
    ordered = ordered.with_running(
        total=Running("sum", F.col("v")), before=Running("sum", F.col("v"), inclusive=False),
        top=Running("max", F.col("v")), low=Running("min", F.col("v")), seen=Running("last", F.col("v")),
    )
    assert ordered.df.select(BUCKET).distinct().count() <= buckets
    got = ordered.rows().toPandas().sort_values(["g", "t", "id"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "t", "id"]).reset_index(drop=True)
    v = want.groupby("g").v
    assert (got.pos == want.groupby("g").cumcount()).all()
    filled = want.v.fillna(0).groupby(want.g).cumsum()
    assert np.allclose(got.total, filled)
    assert np.allclose(got.before, filled - want.v.fillna(0))
    assert np.allclose(got.prev.astype(float), v.shift(), equal_nan=True)
    assert np.allclose(got.top.astype(float), v.cummax().groupby(want.g).ffill(), equal_nan=True)
    assert np.allclose(got.low.astype(float), v.cummin().groupby(want.g).ffill(), equal_nan=True)
    assert np.allclose(got.seen.astype(float), v.ffill(), equal_nan=True)


def test_one_group_spanning_every_bucket(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    got = OrderedRows(df, ["k", "id"], buckets=8).with_position().rows().orderBy("k", "id").toPandas()
    assert (got.pos == np.arange(1000)).all()


def test_null_groups_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 1, 5.0)], "g string, t int, v double")
    got = {(r.g, r.t): r.s for r in OrderedRows(df, ["t"], ["g"], buckets=3).with_running(
        s=Running("sum", F.col("v"))).rows().collect()}
    assert got == {(None, 1): 2.0, (None, 2): 5.0, ("a", 1): 5.0}
    assert OrderedRows(df.where("false"), ["t"], ["g"]).with_position().rows().count() == 0


def test_no_single_task_sort_of_the_rows(spark):
    df = spark.range(2000).withColumn("v", F.rand(1))
    ordered = OrderedRows(df, ["id"], buckets=6).with_running(s=Running("sum", F.col("v")))
    plan = ordered.rows()._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
