"""Every query with SQL returns what the SQL returns; the others return rows."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    fn = entry.queries()[name]
    if name in SQL:
        assert differences(spark, con, SF, name, fn, SQL[name]) is None
    else:
        assert fn(spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
