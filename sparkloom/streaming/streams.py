"""Structured Streaming: sources, windowed sampling, candles, running statistics and keyed detectors.

Every transformation takes a streaming or a batch DataFrame: tests run both and compare.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.plans.ordering import running
from sparkloom.plans.staging import shared_dir

DOWNSAMPLES = ("AVERAGE", "MAX", "MIN", "LAST", "SUM", "COUNT", "EVERY_N")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """New files of a folder, a few a trigger; each row arrives once (the checkpoint remembers files)."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.format(kind).load(path)


def rate_stream(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def _timed(df: DataFrame, time: str) -> DataFrame:
    """Event time as TIMESTAMP, which watermarks ask for (zone-less values are taken in the session's zone)."""
    return df if isinstance(df.schema[time].dataType, T.TimestampType) else df.withColumn(time, F.col(time).cast("timestamp"))


def downsample(df: DataFrame, time: str, value: str, width: str, how: str = "AVERAGE", keys: tuple[str, ...] = (), late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aligned tumbling (or sliding) windows: keys, start, value. State lives until the watermark passes."""
    agg = {"AVERAGE": F.avg(value), "MAX": F.max(value), "MIN": F.min(value), "LAST": F.max_by(value, time), "SUM": F.sum(value), "COUNT": F.count(value).cast("double")}[how.upper()]
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = _timed(df, time).withWatermark(time, late).groupBy(*keys, w.alias("__w")).agg(agg.alias("value"))
    return out.select(*keys, F.col("__w.start").alias("start"), "value")


def every_n(df: DataFrame, time: str, n: int, keys: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """The first row in time order of each key, and every n-th after it.

    A batch counts places by ranges of the order, so that no task needs all rows; a stream counts the rows of a key as
    they arrive, in time order within a trigger.
    """
    if n < 1:
        raise ValueError("every n-th row, from 1 on")
    if not df.isStreaming:
        order = [time, tie] if tie else [time]
        return running(df, order, before="__before", total="__total", keys=keys).where(F.col("__before") % n == 0).drop("__before", "__total")

    def keep(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([time, tie] if tie else [time], kind="stable")
        seen = state.get[0] if state.exists else 0
        state.update((seen + len(rows),))
        yield rows[[(seen + i) % n == 0 for i in range(len(rows))]]

    d = _timed(df, time)
    by = d.groupBy(*keys) if keys else d.groupBy(F.lit(0).alias("__all"))
    return by.applyInPandasWithState(keep, d.schema, "seen long", "append", "NoTimeout")


def sessions(df: DataFrame, time: str, gap: str, keys: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """Session windows: keys, start, end, n."""
    out = _timed(df, time).withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("__w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), "n")


def candles(df: DataFrame, time: str, price: str, width: str, keys: tuple[str, ...] = (), volume: str | None = None, tie: str | None = None, late: str = "1 hour") -> DataFrame:
    """Open, high, low, close, volume per aligned window."""
    at = F.struct(time, tie) if tie else F.col(time)
    out = _timed(df, time).withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("__w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), (F.sum(volume) if volume else F.count("*").cast("double")).alias("volume"))
    return out.select(*keys, F.col("__w.start").alias("start"), "open", "high", "low", "close", "volume")


def running_statistics(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Complete-mode totals: n, total, low, high, mean."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))


def history(df: DataFrame, time: str, keep: str, late: str = "0 seconds") -> DataFrame:
    """Rows of the last `keep` before the newest row of a batch frame; on a stream the watermark evicts."""
    if df.isStreaming:
        return _timed(df, time).withWatermark(time, keep)
    newest = df.agg(F.max(time).alias("__t"))
    return df.join(newest).where(F.col(time) >= F.col("__t") - F.expr(f"INTERVAL {keep}")).drop("__t")


def gap_anchored(df: DataFrame, time: str, value: str, seconds: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Windows that begin at the first row past the previous window, labelled by their middle; missing times are left out.

    A key's windows follow from one another, so one task walks its rows, which come sorted and a batch at a time: that
    task's Python holds a batch and the window that is open.
    """
    width = round(seconds * 1e6)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, total, valued, n = None, None, 0.0, 0, 0
        for b in batches:
            t = b.column("__t").to_numpy()
            v = b.column("__v")
            has = v.is_valid().to_numpy(zero_copy_only=False)
            x = np.where(has, v.to_numpy(zero_copy_only=False), 0.0)
            # places where a key's rows begin
            new = np.zeros(len(t), bool)
            new[:1] = True
            for i in range(len(keys)):
                code = b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            cuts, made = np.flatnonzero(new).tolist(), []
            for lo, hi in zip(cuts, [*cuts[1:], len(t)]):
                at = tuple(b.column(i)[lo].as_py() for i in range(len(keys)))
                if key != at:
                    if n:
                        made.append((key, start, total, valued, n))
                    key, start, total, valued, n = at, None, 0.0, 0, 0
                while lo < hi:
                    if start is None or t[lo] >= start + width:
                        if n:
                            made.append((key, start, total, valued, n))
                        start, total, valued, n = int(t[lo]), 0.0, 0, 0
                    end = lo + int(np.searchsorted(t[lo:hi], start + width))
                    total, valued, n = total + float(x[lo:end].sum()), valued + int(has[lo:end].sum()), n + end - lo
                    lo = end
            yield as_batch(made)
        if n:
            yield as_batch([(key, start, total, valued, n)])

    def as_batch(made: list[tuple]) -> pa.RecordBatch:
        held = [pa.array([k[i] for k, *_ in made], kind) for i, kind in enumerate(kinds)]
        mean = [total / valued if valued else None for _, _, total, valued, _ in made]
        return pa.RecordBatch.from_arrays([*held, pa.array([s + width // 2 for _, s, *_ in made], pa.int64()), pa.array(mean, pa.float64()), pa.array([m[4] for m in made], pa.int64())], names=[*keys, "__t", "value", "n"])

    kinds = [to_arrow_type(df.schema[k].dataType) for k in keys]
    d = df.where(F.col(time).isNotNull()).select(*keys, F.unix_micros(F.col(time).cast("timestamp")).alias("__t"), F.col(value).cast("double").alias("__v"))
    d = (d.repartition(*keys) if keys else d.repartition(1)).sortWithinPartitions(*keys, "__t")
    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    out = d.mapInArrow(walk, fields + "__t long, value double, n long")
    return out.select(*keys, F.timestamp_micros("__t").alias("label"), "value", "n")


class _Sorted:
    """Rows of (time as a number, tie, value) in order with bounded memory: sorted runs on the task's disk, merged by ranges of time."""

    RUN, SLICE = 500_000, 50_000

    def __init__(self, frames: Iterator[pd.DataFrame], columns: tuple[str, str, str]):
        self.frames, self.columns = frames, columns

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Times and values, a slice at a time."""
        with tempfile.TemporaryDirectory(prefix="sparkloom-runs-") as folder:
            runs, held, rows = [], [], 0
            for f in self.frames:
                time, tie, value = (f[c] for c in self.columns)
                held.append(np.rec.fromarrays([time.to_numpy("int64"), tie.to_numpy("int64"), value.to_numpy("float64")], names="t,tie,v"))
                rows += len(f)
                if rows >= self.RUN:
                    runs.append(self._keep(held, f"{folder}/{len(runs)}.npy"))
                    held, rows = [], 0
            if held:
                runs.append(self._order(held))
            yield from self._merge(runs)

    def _order(self, held: list[np.ndarray]) -> np.ndarray:
        a = np.concatenate(held)
        return a[np.lexsort((a["tie"], a["t"]))]

    def _keep(self, held: list[np.ndarray], path: str) -> str:
        np.save(path, self._order(held), allow_pickle=False)
        return path

    def _merge(self, runs: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # a file is mapped anew for every slice, so that no pages of it stay with the process
        at, size = [0] * len(runs), [len(self._open(r)) for r in runs]
        step = max(1, self.SLICE // max(1, len(runs)))
        while any(a < n for a, n in zip(at, size)):
            heads = [np.array(self._open(r)[a : a + step]) for r, a in zip(runs, at)]
            # rows up to the least last row of a slice are all here, except of runs that end in it
            last = min(((h["t"][-1], h["tie"][-1]) for h, a, n in zip(heads, at, size) if a + len(h) < n), default=None)
            parts = []
            for i, h in enumerate(heads):
                k = len(h) if last is None else int(((h["t"] < last[0]) | ((h["t"] == last[0]) & (h["tie"] <= last[1]))).sum())
                parts.append(h[:k])
                at[i] += k
            a = self._order(parts)
            yield a["t"], a["v"]

    def _open(self, run) -> np.ndarray:
        return np.load(run, mmap_mode="r") if isinstance(run, str) else run


def adaptive_alarms(df: DataFrame, key: str, time: str, value: str, z: float = 3.0, warm: int = 10, tie: str | None = None) -> DataFrame:
    """Per key a running mean and variance (Welford) as state; rows beyond z deviations of what came before are alarms.

    Rows are taken in the order of time, then of tie (an integer column). A row without a value counts as a row, moves
    nothing and has no score. On a stream this is applyInPandasWithState in append mode, rows of a trigger in that order. One
    task walks a key's rows and holds a slice of them: a batch sorts them in Spark, a trigger in runs on the task's disk.
    """
    out = f"{key} {df.schema[key].dataType.simpleString()}, __t long, {value} double, z double, alarm boolean"
    never = F.lit(2**63 - 1)  # a missing time comes after all others

    def step(t: np.ndarray, v: np.ndarray, state: tuple) -> tuple[pd.DataFrame, tuple]:
        n, c, m, s = state
        scores, alarms = [], []
        for x in v.tolist():
            sd = (s / (c - 1)) ** 0.5 if c > 1 else 0.0
            if x != x:
                scores.append(float("nan") if sd > 0 else 0.0)
                alarms.append(False)
                n += 1
                continue
            score = abs(x - m) / sd if sd > 0 else 0.0
            scores.append(score)
            alarms.append(n >= warm and score > z)
            n += 1
            c += 1
            d = x - m
            m += d / c
            s += d * (x - m)
        return pd.DataFrame({"__t": t, value: v, "z": np.array(scores, float), "alarm": alarms}), (n, c, m, s)

    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), never)
    d = df.select(key, at.alias("__t"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("__tie"), F.col(value).cast("double").alias(value))
    timed = lambda x: x.select(key, F.when(F.col("__t") != never, F.timestamp_micros("__t")).alias(time), value, "z", "alarm")
    if not df.isStreaming:

        def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state = None, (0, 0, 0.0, 0.0)
            for f in frames:
                # the rows of a key are together: a new number where the key changes, NULL equal to NULL
                k = f[key]
                new = ((k != k.shift()) & ~(k.isna() & k.shift().isna())).cumsum()
                for _, g in f.groupby(new, sort=False):
                    first = g[key].iloc[0]
                    first = None if pd.isna(first) else first
                    if now != (first,):
                        now, state = (first,), (0, 0, 0.0, 0.0)
                    made, state = step(g["__t"].to_numpy("int64"), g[value].to_numpy("float64"), state)
                    made.insert(0, key, g[key].to_numpy())
                    yield made

        return timed(d.repartition(key).sortWithinPartitions(key, "__t", "__tie").mapInPandas(walk, out))

    def keep(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, 0.0, 0.0)
        for t, v in _Sorted(frames, ("__t", "__tie", value)):
            made, now = step(t, v, now)
            made.insert(0, key, k[0])
            yield made
        state.update(now)

    return timed(d.groupBy(key).applyInPandasWithState(keep, out, "n long, c long, m double, s double", "append", "NoTimeout"))


def incremental_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Complete-mode profile of numeric columns from mergeable aggregates: a row of n, nulls, mean, deviation, ends each."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}_n"), F.count_if(x.isNull()).alias(f"{c}_nulls"), F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_stddev"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    return df.groupBy().agg(*aggs)


def live_simulation(spark: SparkSession, start: float, drift: float, sd: float, steps_per_second: int = 1, seed: int = 1) -> DataFrame:
    """An endless price walk on the rate source: each step's log return is a function of its number, so reruns agree."""
    u = lambda k: (F.pmod(F.xxhash64("value", F.lit(seed), F.lit(k)), F.lit(1_000_003)) + 1) / 1_000_005
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    return rate_stream(spark, steps_per_second).select("timestamp", F.col("value").alias("step"), (F.lit(drift) + F.lit(sd) * normal).alias("log_return"), F.lit(float(start)).alias("start"))


def realtime_plot(df: DataFrame, width: str | None = None, how: str = "AVERAGE", n: int = 1) -> DataFrame:
    """The frame of a live plot: the first time-like column is x, numeric ones are series, text columns are groups."""
    from sparkloom.operators.plotdata import classify

    roles = classify(df)
    x = next((c for c, r in roles.items() if r == "datetime"), None)
    ys = [c for c, r in roles.items() if r in ("numeric", "integer")]
    groups = [c for c, r in roles.items() if r == "categorical"]
    if x is None or not ys:
        raise ValueError("a live plot needs a time and a number")
    long = df.select(F.col(x).alias("x"), *groups, F.explode(F.array(*[F.struct(F.lit(y).alias("series"), F.col(y).cast("double").alias("value")) for y in ys])).alias("p")).select("x", *groups, "p.*")
    if how.upper() == "EVERY_N":
        return every_n(long, "x", n, (*groups, "series"))
    return long if width is None else downsample(long, "x", "value", width, how, (*groups, "series")).withColumnRenamed("start", "x")


def drain(df: DataFrame, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all available input into Parquet (append) or the last complete result, and read it."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/sparkloom/stream-{uuid.uuid4().hex}"
    out, last = f"{base}/out", {}
    if mode == "append":
        w = df.writeStream.format("parquet").option("path", out).outputMode("append")
    else:

        def put(batch: DataFrame, i: int) -> None:
            last["path"] = f"{out}/{i}"
            batch.write.mode("overwrite").parquet(last["path"])

        w = df.writeStream.foreachBatch(put).outputMode(mode)
    w.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    path = out if mode == "append" else last.get("path")
    got = spark.read.schema(df.schema).parquet(path) if path else spark.createDataFrame([], df.schema)
    return transform(got) if transform else got
