"""Every registered query against DuckDB on the same tables."""

import pytest

import __spark_entry__ as contract
from check_queries import compare, connect
from tabbridge.coverage import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(request):
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    assert compare(spark, duck, sf, name) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    frame = contract.entry(spark)
    assert frame.columns == [
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
    ]
    assert frame.count() > 0
