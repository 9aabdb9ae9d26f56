"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query(spark, con, key):
    got = entry.queries()[key](spark, SF).toArrow()
    want = con.sql(entry.oracle_sql()[key]).to_arrow_table()
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
