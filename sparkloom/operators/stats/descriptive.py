"""Descriptive statistics. One-pass ones are column expressions; those that need an order use cumulative counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans import ordering
from sparkloom.plans.ordering import cumulative, matched, value_counts


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def quantiles(df: DataFrame, x: str, ps: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and q, an array: linear interpolation at p * (n - 1)."""
    named = {f"q{i}": p for i, p in enumerate(ps)}
    return ordering.quantiles(df, x, named, keys).select(*keys, F.array(*named).alias("q"))


def median(df: DataFrame, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return ordering.quantiles(df, x, {"median": 0.5}, keys)


def variance(x: Column, sample: bool = True) -> Column:
    """0 below two values."""
    return F.when(F.count(x) < 2, 0.0).otherwise((F.var_samp if sample else F.var_pop)(x))


def stddev(x: Column, sample: bool = True) -> Column:
    return F.sqrt(variance(x, sample))


def value_range(x: Column) -> Column:
    return F.max(x) - F.min(x)


def iqr(df: DataFrame, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return ordering.quantiles(df, x, {"a": 0.25, "b": 0.75}, keys).select(*keys, (F.col("b") - F.col("a")).alias("iqr"))


def coefficient_of_variation(x: Column) -> Column:
    return F.when(F.avg(x) == 0, 0.0).otherwise(stddev(x) / F.nullif(F.avg(x), F.lit(0.0)))


def skewness(x: Column) -> Column:
    """Third moment over the sample deviation cubed, bias-adjusted above three values."""
    n = F.count(x).cast("double")
    g = F.skewness(x) * F.pow((n - 1) / n, 1.5)
    adjust = F.when(n > 3, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).otherwise(1.0)
    return F.when((n < 2) | (F.var_pop(x) == 0), 0.0).otherwise(g * adjust)


def kurtosis(x: Column) -> Column:
    """Excess kurtosis on the sample deviation."""
    n = F.count(x).cast("double")
    return F.when((n < 2) | (F.var_pop(x) == 0), 0.0).otherwise((F.kurtosis(x) + 3) * F.pow((n - 1) / n, 2) - 3)


def raw_moment(x: Column, k: int) -> Column:
    return F.avg(F.pow(x, k))


def central_moment(df: DataFrame, x: str, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Two passes: the mean, then the mean of powered deviations."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("__m"))
    both = df.join(m, list(keys)) if keys else df.join(m)
    return both.groupBy(*keys).agg(F.avg(F.pow(F.col(x) - F.col("__m"), k)).alias("moment"))


def standardized_moment(df: DataFrame, x: str, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    m = df.groupBy(*keys).agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"))
    both = df.join(m, list(keys)) if keys else df.join(m)
    return both.groupBy(*keys).agg(F.avg(F.pow((F.col(x) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)), k)).alias("moment"))


def mad(df: DataFrame, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median of absolute deviations from the median."""
    m = ordering.quantiles(df, x, {"__m": 0.5}, keys)
    off = matched(df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x")), m, keys)
    return ordering.quantiles(off.withColumn("__d", F.abs(F.col("__x") - F.col("__m"))), "__d", {"mad": 0.5}, keys)


def modes(df: DataFrame, x: str) -> DataFrame:
    """All most frequent values; their minimum is the mode."""
    counts = value_counts(df, x)
    return counts.join(counts.agg(F.max("n").alias("m")), F.col("n") == F.col("m")).select(F.col("v").alias("mode"), "n")


def trimmed_mean(df: DataFrame, x: str, p: float) -> DataFrame:
    """floor(p * n) values dropped on either side."""
    k = F.floor(F.lit(p) * F.col("total"))
    take = F.greatest(F.lit(0), F.least(F.col("before") + F.col("n"), F.col("total") - k) - F.greatest(F.col("before"), k))
    return cumulative(df, x).agg((F.sum(F.col("v") * take) / F.sum(take)).alias("trimmed_mean"))


def winsorized_mean(df: DataFrame, x: str, p: float) -> DataFrame:
    """floor(p * n) values on either side replaced by the nearest that stays."""
    c = cumulative(df, x).withColumn("k", F.floor(F.lit(p) * F.col("total")))
    ends = c.agg(F.min(F.when(F.col("before") + F.col("n") > F.col("k"), F.col("v"))).alias("lo"), F.max(F.when(F.col("before") <= F.col("total") - 1 - F.col("k"), F.col("v"))).alias("hi"))
    return c.join(ends).agg((F.sum(F.col("n") * F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi"))) / F.sum("n")).alias("winsorized_mean"))


def l_moments(df: DataFrame, x: str) -> DataFrame:
    """l1 .. l4 from probability-weighted moments; a tied value's places are summed in closed form."""
    a, n, t = F.col("before").cast("double"), F.col("n").cast("double"), F.col("total").cast("double")

    def falling(j: Column, k: int) -> Column:
        out = F.lit(1.0)
        for i in range(k):
            out = out * (j - i)
        return out

    def places(k: int) -> Column:  # sum of falling(j, k) for j = a .. a + n - 1
        return (falling(a + n, k + 1) - falling(a, k + 1)) / (k + 1)

    b = [(F.sum(F.col("v") * places(k)) / F.max(t * falling(t - 1, k))).alias(f"b{k}") for k in range(4)]
    m = cumulative(df, x).agg(*b)
    b0, b1, b2, b3 = (F.col(f"b{k}") for k in range(4))
    return m.select(b0.alias("l1"), (2 * b1 - b0).alias("l2"), (6 * b2 - 6 * b1 + b0).alias("l3"), (20 * b3 - 30 * b2 + 12 * b1 - b0).alias("l4"))


def summary(df: DataFrame, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count to quartiles: moments in one aggregation, quartiles by places."""
    c = F.col(x)
    base = df.groupBy(*keys).agg(F.count(c).alias("n"), mean(c).alias("mean"), variance(c).alias("variance"), stddev(c).alias("stddev"), value_range(c).alias("range"), coefficient_of_variation(c).alias("cv"), skewness(c).alias("skewness"), kurtosis(c).alias("kurtosis"))
    q = ordering.quantiles(df, x, {"a": 0.25, "median": 0.5, "b": 0.75}, keys)
    return matched(base, q, keys, "left").select(*keys, "n", "mean", "median", "variance", "stddev", "range", (F.col("b") - F.col("a")).alias("iqr"), "cv", "skewness", "kurtosis")
