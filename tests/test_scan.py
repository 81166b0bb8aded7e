"""Chunks of a scan, counted where the rows are."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom import queries
from sparkloom.operators import relational as R


def test_chunks_are_those_of_the_cursor(spark):
    df = spark.range(0, 1003, 1, 7).where("id % 10 < 8")
    want = [[r.id for r in x] for x in R.chunks(df, 100)]
    rows = R.numbered_chunks(df, 100).groupBy("chunk").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy("chunk").collect()
    assert [r.chunk for r in rows] == list(range(len(want))) and [r.ids for r in rows] == want
    assert R.numbered_chunks(df.where("false"), 100).count() == 0


def test_the_scan_sends_no_rows_to_the_driver(spark, monkeypatch):
    queries.load()
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("rows sent to the driver"))
    (r,) = queries.QUERIES["scan_chunks"](spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert (r.n_rows, r.n_chunks) == (n, -(-n // 10_000))
