"""Univariate outlier rules: bounds from one aggregation, then a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.stats.descriptive import mad
from sparkloom.plans.ordering import matched, quantiles


def iqr_outliers(df: DataFrame, x: str, k: float = 1.5, keys: tuple[str, ...] = ()) -> DataFrame:
    b = quantiles(df, x, {"__a": 0.25, "__b": 0.75}, keys)
    r = k * (F.col("__b") - F.col("__a"))
    return matched(df, b, keys).where((F.col(x) < F.col("__a") - r) | (F.col(x) > F.col("__b") + r)).drop("__a", "__b")


def zscore_outliers(df: DataFrame, x: str, z: float = 3.0, keys: tuple[str, ...] = ()) -> DataFrame:
    b = df.groupBy(*keys).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    return matched(df, b, keys).where(F.abs(F.col(x) - F.col("__m")) > z * F.col("__s")).drop("__m", "__s")


def mad_outliers(df: DataFrame, x: str, z: float = 3.5, keys: tuple[str, ...] = ()) -> DataFrame:
    b = matched(quantiles(df, x, {"__m": 0.5}, keys), mad(df, x, keys).withColumnRenamed("mad", "__d"), keys)
    return matched(df, b, keys).where(0.6745 * F.abs(F.col(x) - F.col("__m")) > z * F.col("__d")).drop("__m", "__d")
