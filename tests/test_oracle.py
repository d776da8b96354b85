"""Every registered query at the smallest scale, against its SQL where it has one."""

import pytest

import __spark_entry__ as contract
from tests.oracle import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    sql = contract.oracle_sql().get(name)
    if sql:
        bad = [b for b in differences(df, con, sql) if b != "both empty"]
        assert not bad
    else:
        assert df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
