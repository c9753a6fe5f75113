import compare
import pytest

from lumenframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark):
    folder = "/root/testdata/sf0.01"
    assert compare.difference(QUERIES[name](spark, folder), compare.connect(folder), ORACLES[name]) is None
