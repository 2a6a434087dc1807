"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from tests.compare import connect, difference

SF = os.environ.get("WORDLOOM_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, con, name):
    result = entry_point.queries()[name](spark, SF)
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert result.count() > 0
    else:
        assert difference(result, con, sql) is None


def test_entry(spark):
    assert entry_point.entry(spark).limit(1).count() == 1
