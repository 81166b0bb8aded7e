"""Time-series preparation: ordered features as window expressions, one partition per series key."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.stats.timeseries import acf
from sparkloom.plans.ordering import running
from sparkloom.plans.staging import stage

AUTO_LAGS, AUTO_WINDOWS = (1, 2, 3, 7, 14, 30), (7, 14, 30)


def _w(time: str, keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(time)


def lag_features(df: DataFrame, time: str, y: str, lags: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    return df.select("*", *[F.lag(y, k).over(_w(time, keys)).alias(f"{y}_lag_{k}") for k in lags])


def rolling_features(df: DataFrame, time: str, y: str, windows: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Trailing mean and sample deviation with the current row; partial at the head, deviation 0 below two rows."""
    cols = []
    for k in windows:
        w = _w(time, keys).rowsBetween(-(k - 1), 0)
        cols += [F.avg(y).over(w).alias(f"{y}_mean_{k}"), F.coalesce(F.stddev_samp(y).over(w), F.lit(0.0)).alias(f"{y}_std_{k}")]
    return df.select("*", *cols)


def difference(df: DataFrame, time: str, y: str, d: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(f"{y}_diff_{d}", F.col(y) - F.lag(y, d).over(_w(time, keys)))


def percent_change(df: DataFrame, time: str, y: str, d: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    prev = F.lag(y, d).over(_w(time, keys))
    return df.withColumn(f"{y}_pct_{d}", F.when(F.abs(prev) > 1e-10, (F.col(y) - prev) / F.abs(F.nullif(prev, F.lit(0.0)))))


def datetime_features(df: DataFrame, time: str) -> DataFrame:
    """year .. hour, day_of_week (0 = Sunday), weekend, and the cycles of hour and day of week."""
    t, dow = F.col(time), F.dayofweek(time) - 1
    cycle = lambda x, n: (F.sin(x * (2 * math.pi / n)), F.cos(x * (2 * math.pi / n)))
    hs, hc = cycle(F.hour(t), 24)
    ds, dc = cycle(dow, 7)
    return df.select("*", F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), dow.alias("day_of_week"), dow.isin(0, 6).alias("weekend"), hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("dow_sin"), dc.alias("dow_cos"))


def ewma(df: DataFrame, time: str, y: str, alpha: float, keys: Sequence[str] = ()) -> DataFrame:
    """s = alpha * y + (1 - alpha) * s, from the first value; a series must fit one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        pdf[f"{y}_ewma"] = pdf[y].astype(float).ewm(alpha=alpha, adjust=False).mean()
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{y}_ewma` double"
    return df.groupBy(*keys).applyInPandas(run, schema)


def split(df: DataFrame, time: str, train: float = 0.7, validation: float = 0.15, keys: Sequence[str] = ()) -> DataFrame:
    """Adds part: train, validation or test, by position in time."""
    share = (F.row_number().over(_w(time, keys)) - 1) / F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("part", F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test"))


def walk_forward(df: DataFrame, time: str, folds: int, test_size: int, gap: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """Expanding training windows with a gap before each test window, by position in time."""
    # places by ranges of time: no task has all rows, and folds read what is staged
    d = stage(running(df, [time], before="__b", total="__t").withColumn("__i", F.col("__b") + 1).drop("__b", "__t"), "folds")
    n = d.count()
    out = []
    for k in range(folds, 0, -1):
        start = n - k * test_size
        out.append((d.where(F.col("__i") <= start - gap).drop("__i"), d.where((F.col("__i") > start) & (F.col("__i") <= start + test_size)).drop("__i")))
    return out


def stationarity(df: DataFrame, time: str, y: str, theta: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """Halves agree: relative difference of means below theta and variance ratio above 1 - theta, from 30 rows on."""
    h = df.where(F.col(y).isNotNull()).withColumn("__h", F.ntile(2).over(_w(time, keys)))
    g = lambda f, k: f(F.when(F.col("__h") == k, F.col(y)))
    m = h.groupBy(*keys).agg(F.count("*").alias("n"), g(F.avg, 1).alias("m1"), g(F.avg, 2).alias("m2"), g(F.var_samp, 1).alias("v1"), g(F.var_samp, 2).alias("v2"))
    shift = F.abs(F.col("m1") - F.col("m2")) / F.greatest(F.abs(F.col("m1")), F.lit(1e-10))
    ratio = F.coalesce(F.least("v1", "v2") / F.nullif(F.greatest("v1", "v2"), F.lit(0.0)), F.lit(1.0))
    return m.select(*keys, "n", shift.alias("mean_shift"), ratio.alias("variance_ratio"), ((F.col("n") >= 30) & (shift < theta) & (ratio > 1 - theta)).alias("stationary"))


def detect_seasonality(df: DataFrame, time: str, y: str, max_lag: int = 40, keys: Sequence[str] = (), threshold: float = 0.3) -> DataFrame:
    """period, strength: local maxima of the autocorrelation above the threshold, strongest first."""
    a = acf(df, time, y, max_lag, tuple(keys))
    w = Window.partitionBy(*keys).orderBy("lag")
    a = a.withColumn("l", F.lag("acf").over(w)).withColumn("r", F.lead("acf").over(w))
    peak = (F.col("lag") >= 2) & (F.col("acf") > threshold) & (F.col("acf") > F.col("l")) & (F.col("acf") >= F.coalesce("r", F.lit(-1.0)))
    return a.where(peak).select(*keys, F.col("lag").alias("period"), F.col("acf").alias("strength")).orderBy(*keys, F.desc("strength"))


def seasonal_strengths(df: DataFrame, time: str, y: str, periods: Sequence[int] = (7, 30, 365), keys: Sequence[str] = ()) -> DataFrame:
    a = acf(df, time, y, max(periods), tuple(keys)).where(F.col("lag").isin(*periods))
    return a.select(*keys, F.col("lag").alias("period"), "acf", (F.col("acf") > 0.3).alias("seasonal"))


def prepare(
    df: DataFrame, time: str, y: str, keys: Sequence[str] = (), lags: Sequence[int] | None = None, windows: Sequence[int] | None = None, datetime: bool = False,
    make_stationary: bool = False, seasonal: int | None = None, parts: tuple[float, float] | None = None, auto: bool = True,
) -> DataFrame:
    """PREPARE TIME SERIES: explicit options win over automatic ones; all take effect."""
    if auto and lags is None and windows is None:
        lags, windows = AUTO_LAGS, AUTO_WINDOWS
        make_stationary = make_stationary or not stationarity(df, time, y, keys=keys).agg(F.every("stationary")).first()[0]
    out = lag_features(df, time, y, lags or (), keys)
    out = rolling_features(out, time, y, windows or (), keys)
    if make_stationary:
        out = difference(out, time, y, 1, keys)
    if seasonal:
        out = difference(out, time, y, seasonal, keys)
    if datetime:
        out = datetime_features(out, time)
    return split(out, time, *parts, keys) if parts else out


def interval_seconds(text: str) -> int:
    """Seconds of 30s, 5m, 4h, 1d."""
    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400}.get(text[-1:].lower())
    if unit is None or not text[:-1].isdigit():
        raise ValueError(f"bad interval {text!r}")
    return int(text[:-1]) * unit


def interval_column(text: str) -> Column:
    return F.make_dt_interval(secs=F.lit(interval_seconds(text)))
