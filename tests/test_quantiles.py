import itertools

import numpy as np
import pytest

from lumenframe.operators import quantiles

PROBS = (0.0, 0.1, 0.5, 0.75, 1.0)


def expected(values):
    values = np.array([v for v in values if v is not None and not np.isnan(v)])
    return {} if not len(values) else {p: float(np.quantile(values, p)) for p in PROBS}


def table():
    rng = np.random.default_rng(0)
    ties = rng.integers(0, 5, 6000).astype(float)
    heavy = np.where(rng.random(6000) < 0.7, 3.25, rng.normal(size=6000))
    spread = rng.normal(size=6000) ** 3
    rows = []
    for i in range(6000):
        group = ["hot", "hot", "b", "c", None][i % 5] if i % 7 else f"small{i % 3}"
        rows.append((group, float(ties[i]), None if i % 11 == 0 else float(heavy[i]), float(spread[i]) if i % 13 else float("nan"), None))
    return rows + [("one", 1.0, -np.inf, 2.0, None), ("one", 2.0, np.inf, 2.0, None), ("none", None, None, None, None)]


@pytest.mark.parametrize(("gathered", "driver_rows"), [(1 << 16, 2000), (0, 2000), (0, 3), (1 << 16, 3)])
@pytest.mark.parametrize("grouped", [False, True])
def test_equal_to_sorting(spark, monkeypatch, gathered, driver_rows, grouped):
    for name, value in (("SKETCH_SIZE", 200), ("GRID", 64), ("GATHERED", gathered), ("DRIVER_ROWS", driver_rows), ("SALTS", 3)):
        monkeypatch.setattr(quantiles, name, value)
    columns = ["ties", "heavy value", "spread", "empty"]
    rows = table()
    df = spark.createDataFrame(rows, "g string, ties double, `heavy value` double, spread double, empty double").repartition(4)
    got = quantiles.exact_quantiles(df, columns, PROBS, ["g"] if grouped else []).collect()
    groups = sorted({r[0] for r in rows if r[0]}) if grouped else [None]
    want = {}
    for group, (i, column) in itertools.product(groups, enumerate(columns)):
        values = [r[i + 1] for r in rows if not grouped or r[0] == group]
        for p, q in expected(values).items():
            want[group, column, p] = q
    found = {(r.g if grouped else None, r.column, r.p): r.quantile for r in got}
    assert found.keys() == want.keys()
    for key, value in want.items():
        assert found[key] == pytest.approx(value, rel=1e-12, abs=1e-12, nan_ok=True), key


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact_quantiles(df, ["v"], [0.5]).collect() == []
    assert quantiles.exact_quantiles(df, ["v"], [0.5], ["g"]).collect() == []


def test_no_sort_of_the_input(spark):
    """The input is only aggregated: nothing is dealt by range and no row of it is checkpointed."""
    df = spark.range(5000).selectExpr("id % 3 AS g", "cast(id AS double) AS v")
    plan = quantiles.exact_quantiles(df, ["v"], [0.5], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan
