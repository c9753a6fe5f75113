"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry_points


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    result = QUERIES[name](spark, sf_dir)
    assert len(set(result.columns)) == len(result.columns)
    if name in ORACLES:
        assert compare.difference(result, con, ORACLES[name]) is None
    else:
        result.collect()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
