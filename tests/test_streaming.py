"""Streams against the same computation in batch."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import streams as S

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four files in time order, two keys, one far-later row to close the windows."""
    base = tmp_path_factory.mktemp("events")
    rows = [(f"k{i % 2}", START + timedelta(minutes=7 * i), float(i % 13) + (100.0 if i == 90 else 0.0)) for i in range(120)]
    rows.append(("k0", START + timedelta(days=30), 0.0))
    for p in range(4):
        part = rows[p * 31 : (p + 1) * 31]
        spark.createDataFrame(part, "key string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"file://{base}/d")
    return f"file://{base}/d"


def stream(spark, folder):
    return S.file_stream(spark, folder, spark.read.parquet(folder).schema)


def test_append_windows_close_by_watermark(spark, folder):
    got = S.drain(S.downsample(stream(spark, folder), "ts", "v", "1 hour", "SUM", ("key",), late="10 minutes")).collect()
    batch = S.downsample(spark.read.parquet(folder), "ts", "v", "1 hour", "SUM", ("key",)).where(F.col("start") < F.lit(START + timedelta(days=20))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and got


def test_state_gives_the_batch_alarms(spark, folder):
    got = S.drain(S.adaptive_alarms(stream(spark, folder), "key", "ts", "v", 3.0)).where("alarm").collect()
    batch = S.adaptive_alarms(spark.read.parquet(folder), "key", "ts", "v", 3.0).where("alarm").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    assert [r.v for r in batch] == [112.0]


def test_complete_mode_and_candles(spark, folder):
    got = S.drain(S.candles(stream(spark, folder), "ts", "v", "1 day", ("key",)), "complete")
    batch = S.candles(spark.read.parquet(folder), "ts", "v", "1 day", ("key",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    run = S.drain(S.running_statistics(stream(spark, folder), "v"), "complete").first()
    assert run.n == 121 and run.high == 112.0


def test_gap_anchored_windows(spark):
    t = [0, 1, 4, 11, 12, 30]
    df = spark.createDataFrame(pd.DataFrame({"ts": [START + timedelta(seconds=x) for x in t], "v": [1.0, 3.0, 5.0, 7.0, 9.0, 2.0]}))
    got = [((r.label - START).total_seconds(), r.value, r.n) for r in S.gap_anchored(df, "ts", "v", 10.0).collect()]
    assert sorted(got) == [(5.0, 3.0, 3), (16.0, 8.0, 2), (35.0, 2.0, 1)]


def test_rate_source_is_a_stream(spark):
    assert S.rate_stream(spark).isStreaming


def test_every_nth_row_of_a_stream_equals_the_batch(spark):
    t = S.file_stream(spark, "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema, glob="events.parquet")
    got = S.drain(S.every_n(t, "ts", 7, ("event_type",), "event_id"))
    want = S.every_n(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts", 7, ("event_type",), "event_id")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_live_simulation_is_a_stream_of_seeded_returns(spark):
    from pyspark.sql import functions as F

    live = S.live_simulation(spark, 100.0, 0.001, 0.02, seed=5)
    assert live.isStreaming and live.columns == ["timestamp", "step", "log_return", "start"]
    # the return is a function of the step's number: the same expression over a batch of steps is normal and repeats
    step = spark.range(4000).withColumnRenamed("id", "value").withColumn("timestamp", F.current_timestamp())
    expr = lambda: step.select("value", (F.lit(0.001) + F.lit(0.02) * F.sqrt(-2 * F.log((F.pmod(F.xxhash64("value", F.lit(5), F.lit(1)), F.lit(1_000_003)) + 1) / 1_000_005)) * F.cos(2 * F.pi() * (F.pmod(F.xxhash64("value", F.lit(5), F.lit(2)), F.lit(1_000_003)) + 1) / 1_000_005)).alias("r"))
    r = [x.r for x in expr().collect()]
    assert r == [x.r for x in expr().collect()] and abs(sum(r) / len(r) - 0.001) < 0.002


def test_runs_on_disk_give_the_rows_in_order():
    class Small(S._Sorted):
        RUN, SLICE = 50, 20

    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"t": rng.integers(0, 90, 330), "i": rng.permutation(330), "v": rng.normal(size=330)})
    got = list(Small((rows[a : a + 30] for a in range(0, 330, 30)), ("t", "i", "v")))
    want = rows.sort_values(["t", "i"])
    assert np.concatenate([t for t, _ in got]).tolist() == want["t"].tolist() and np.concatenate([v for _, v in got]).tolist() == want["v"].tolist()
    assert max(len(t) for t, _ in got) <= 20


def test_alarms_take_ties_in_order_and_count_rows_without_a_value(spark):
    rows = [("a", 9 - i // 2, i, float(i * i % 7)) for i in range(20)] + [("a", 3, 99, None), (None, 1, 1, 5.0), (None, 1, 0, 4.0)]
    df = spark.createDataFrame(rows, "k string, s int, i long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r.k or "", r.ts, r.v is None, r.v or 0.0, None if r.z is None else round(r.z, 9)) for r in S.adaptive_alarms(df, "k", "ts", "v", 2.0, tie="i").collect())
    seen, want = {}, []
    for k, s, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        x = [a for a in seen.setdefault(k, []) if a is not None]
        sd = np.std(x, ddof=1) if len(x) > 1 else 0.0
        want.append((k or "", s, v is None, v or 0.0, 0.0 if sd == 0 else None if v is None else round(abs(v - np.mean(x)) / sd, 9)))
        seen[k].append(v)
    assert [(k, t.second, *x) for k, t, *x in got] == sorted(want)


def test_gap_anchored_windows_across_batches_and_keys(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), float(t), float(v)) for k, t, v in zip(rng.integers(0, 3, 900), rng.integers(0, 4000, 900), rng.normal(size=900))]
    df = spark.createDataFrame(rows, "k int, s double, v double").withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = sorted((r.k, r.a, round(r.value, 9), r.n) for r in S.gap_anchored(df, "ts", "v", 60.0, ("k",)).withColumn("a", F.unix_seconds("label")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for key in range(3):
        start, held = None, []
        for s, v in [*sorted((s, v) for k, s, v in rows if k == key), (1e9, 0.0)]:
            if start is None or s >= start + 60:
                if held:
                    want.append((key, int(start) + 30, round(float(np.mean(held)), 9), len(held)))
                start, held = s, []
            held.append(v)
    assert got == want


def test_a_walk_holds_a_slice_of_a_key(spark):
    # both walks are narrow maps over sorted rows, not groups that a task has to hold
    df = spark.createDataFrame([("a", START, 1.0)], "k string, ts timestamp, v double")
    for d in (S.adaptive_alarms(df, "k", "ts", "v"), S.gap_anchored(df, "ts", "v", 10.0, ("k",))):
        plan = d._jdf.queryExecution().toString()
        assert "FlatMapGroupsInPandas" not in plan and d.count() == 1
