"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import oracle
import pytest

import sparkloom.queries as Q

FOLDER = "/root/testdata/sf0.001"
Q.load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, con, name):
    assert oracle.differences(spark, con, FOLDER, Q.QUERIES[name], Q.ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
