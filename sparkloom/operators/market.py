"""Candles, technical indicators, regimes and risk metrics as window expressions over one partition per symbol."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.plans.ordering import matched, quantiles

REGIMES = ("strong bull", "bull", "weak bull", "volatile", "sideways", "quiet", "weak bear", "bear", "strong bear")


def _w(time: str, keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(time)


def candles(df: DataFrame, time: str, price: str, volume: str | None, interval: str, keys: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Open, high, low, close, volume and n per aligned interval; `tie` orders rows of one instant."""
    at = F.struct(time, tie) if tie else F.col(time)
    vol = F.sum(volume) if volume else F.count("*").cast("double")
    out = df.groupBy(*keys, F.window(time, interval).alias("__w")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), vol.alias("volume"), F.count("*").alias("n"))
    return out.select(*keys, F.col("__w.start").alias("start"), "open", "high", "low", "close", "volume", "n")


def sma(df: DataFrame, time: str, x: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Full windows only."""
    w = _w(time, keys)
    return df.withColumn(f"sma_{k}", F.when(F.row_number().over(w) >= k, F.avg(x).over(w.rowsBetween(-(k - 1), 0))))


def rsi(df: DataFrame, time: str, x: str, k: int = 14, keys: Sequence[str] = ()) -> DataFrame:
    """Simple averages of gains and losses; 100 without losses."""
    w = _w(time, keys)
    d = df.withColumn("__d", F.col(x) - F.lag(x).over(w))
    back = w.rowsBetween(-(k - 1), 0)
    gain, loss = F.avg(F.greatest("__d", F.lit(0.0))).over(back), F.avg(F.greatest(-F.col("__d"), F.lit(0.0))).over(back)
    value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return d.withColumn(f"rsi_{k}", F.when(F.row_number().over(w) > k, value)).drop("__d")


def bollinger(df: DataFrame, time: str, x: str, k: int = 20, width: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and bands of `width` population deviations."""
    w = _w(time, keys)
    back, full = w.rowsBetween(-(k - 1), 0), F.row_number().over(w) >= k
    m, s = F.avg(x).over(back), F.stddev_pop(x).over(back)
    return df.select("*", F.when(full, m).alias("bb_middle"), F.when(full, m + width * s).alias("bb_upper"), F.when(full, m - width * s).alias("bb_lower"))


def ema(df: DataFrame, time: str, x: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Exponential average with alpha 2 / (k + 1); a series must fit one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        pdf[f"ema_{k}"] = pdf[x].astype(float).ewm(span=k, adjust=False).mean()
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `ema_{k}` double"
    return df.groupBy(*keys).applyInPandas(run, schema)


def returns(df: DataFrame, time: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    prev = F.lag(x).over(_w(time, keys))
    return df.withColumn("ret", F.when(prev != 0, (F.col(x) - prev) / F.nullif(prev, F.lit(0.0))))


def drawdown(df: DataFrame, time: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    peak = F.max(x).over(_w(time, keys).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("drawdown", (peak - F.col(x)) / F.nullif(peak, F.lit(0.0)))


def risk(df: DataFrame, time: str, x: str, keys: Sequence[str] = (), year: int = 252) -> DataFrame:
    """Total return, volatility, Sharpe, Sortino, Calmar, win rate, profit factor, VaR and CVaR at 95 %, drawdown."""
    d = drawdown(returns(df, time, x, keys), time, x, keys)
    r, root = F.col("ret"), math.sqrt(year)
    first = F.min_by(x, time)
    g = d.groupBy(*keys).agg(
        F.count("ret").alias("n"), ((F.max_by(x, time) - first) / F.nullif(first, F.lit(0.0))).alias("total_return"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"),
        F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))).alias("down"), F.max("drawdown").alias("max_drawdown"), (F.count_if(r > 0) / F.greatest(F.count(r), F.lit(1))).alias("win_rate"),
        (F.sum(F.greatest(r, F.lit(0.0))) / F.nullif(F.sum(F.greatest(-r, F.lit(0.0))), F.lit(0.0))).alias("profit_factor"),
    )
    g = matched(g, quantiles(d, "ret", {"q5": 0.05}, keys), keys, "left")
    tail = matched(d, g.select(*keys, "q5"), keys).where(r <= F.col("q5")).groupBy(*keys).agg(F.avg(r).alias("es"))
    g = matched(g, tail, keys, "left")
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return g.select(
        *keys, "n", "total_return", (F.col("sd") * root).alias("volatility"), safe(F.col("mean") * root, F.col("sd")).alias("sharpe"), safe(F.col("mean") * root, F.col("down")).alias("sortino"),
        safe(F.col("mean") * year, F.col("max_drawdown")).alias("calmar"), "win_rate", F.coalesce("profit_factor", F.lit(0.0)).alias("profit_factor"), (-F.col("q5")).alias("var95"), (-F.col("es")).alias("cvar95"), "max_drawdown",
    )


def regimes(df: DataFrame, time: str, x: str, bars: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """One of nine regimes from the trend and volatility of the last bars."""
    w = _w(time, keys)
    d = returns(df, time, x, keys)
    trend = F.col(x) / F.nullif(F.lag(x, bars).over(w), F.lit(0.0)) - 1
    vol = F.stddev_samp("ret").over(w.rowsBetween(-(bars - 1), 0))
    return d.select("*", trend.alias("trend"), vol.alias("vol")).withColumn("regime", regime(F.col("trend"), F.col("vol"))).drop("ret")


def regime(trend: Column, vol: Column) -> Column:
    return (
        F.when(trend.isNull() | vol.isNull(), None)
        .when(trend > 0.10, REGIMES[0]).when(trend > 0.05, REGIMES[1]).when(trend > 0.02, REGIMES[2])
        .when(trend < -0.10, REGIMES[8]).when(trend < -0.05, REGIMES[7]).when(trend < -0.02, REGIMES[6])
        .when(vol > 0.03, REGIMES[3]).when(vol < 0.005, REGIMES[5]).otherwise(REGIMES[4])
    )


def trend_lines(df: DataFrame, time: str, x: str, half: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """keys, level, slope (a bar) and value at the last bar of the line through the two latest supports, and resistances."""
    bars = df.select(*keys, time, x, F.row_number().over(_w(time, keys)).alias("__i"))
    ends = bars.groupBy(*keys).agg(F.max("__i").alias("__last"))
    latest = F.row_number().over(Window.partitionBy(*keys, "level").orderBy(F.desc("__i")))
    two = levels(bars, time, x, half, keys).withColumn("__n", latest).where("__n <= 2")
    at = lambda c, k: F.max(F.when(F.col("__n") == k, F.col(c)))
    line = two.groupBy(*keys, "level").agg(F.count("*").alias("__k"), at("__i", 1).alias("i1"), at("__i", 2).alias("i2"), at(x, 1).alias("x1"), at(x, 2).alias("x2")).where("__k = 2")
    slope = (F.col("x1") - F.col("x2")) / (F.col("i1") - F.col("i2"))
    return matched(line, ends, keys).select(*keys, "level", slope.alias("slope"), (F.col("x1") + slope * (F.col("__last") - F.col("i1"))).alias("value"))


def levels(df: DataFrame, time: str, x: str, half: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Support and resistance: rows that are the lowest or highest of their surroundings."""
    around = _w(time, keys).rowsBetween(-half, half)
    full = F.count("*").over(around) == 2 * half + 1
    kind = F.when(full & (F.col(x) == F.min(x).over(around)), "support").when(full & (F.col(x) == F.max(x).over(around)), "resistance")
    return df.withColumn("level", kind).where("level IS NOT NULL")
