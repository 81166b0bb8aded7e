"""Queries on nearest neighbours over tables of more than one block, against their SQL."""

import duckdb
import oracle
import pytest

import sparkloom.queries as Q

SOURCE = "/root/testdata/sf0.1"
Q.load()


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """3000 customers of different balances, and the suppliers three times under other keys."""
    folder = str(tmp_path_factory.mktemp("blocks"))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SOURCE}/customer.parquet' WHERE c_custkey <= 3000) TO '{folder}/customer.parquet'")
    con.execute(f"COPY (SELECT s.* REPLACE (s_suppkey + 10000 * i AS s_suppkey) FROM '{SOURCE}/supplier.parquet' s, (SELECT unnest(range(3)) AS i)) TO '{folder}/supplier.parquet'")
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con, folder


@pytest.mark.parametrize("name", ["analyze_local_outlier_factor", "analyze_outlier", "anomaly_lof"])
def test_equals_sql(spark, tables, name):
    con, folder = tables
    assert oracle.differences(spark, con, folder, Q.QUERIES[name], Q.ORACLES[name]) is None
