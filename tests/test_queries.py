"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, entry.queries()[name], ORACLES.get(name), SF)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() >= 2
