"""Monte Carlo market paths: one task group per path, each with its own seeded generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.market import REGIMES
from sparkloom.operators.tsprep import interval_seconds
from sparkloom.plans.ordering import matched, quantiles

# --- fixed values: variance recursion, drift and volatility factor of each scenario ---
OMEGA, ALPHA, BETA = 1e-6, 0.1, 0.85
SCENARIOS = {"BASE": (0.0, 1.0), "BULL": (0.0005, 0.9), "BEAR": (-0.0005, 1.2), "CRASH": (-0.004, 3.0), "RALLY": (0.003, 1.5), "VOLATILE": (0.0, 2.0), "SIDEWAYS": (0.0, 0.6)}
SCHEMA = "simulation_id string, step int, path int, timestamp timestamp, price double, return double, volatility double, volume double, regime string, sma_20 double, rsi double, bid double, ask double, confidence double"


def calibrate(df: DataFrame, time: str, price: str) -> dict[str, float]:
    """Last price and time, and the mean and deviation of log returns."""
    from pyspark.sql import Window

    w = Window.partitionBy().orderBy("t")  # one row per instant is left
    d = df.where(F.col(price) > 0).select(F.col(time).alias("t"), F.col(price).cast("double").alias("p"))
    d = d.groupBy("t").agg(F.avg("p").alias("p"))
    r = d.select("t", "p", F.log(F.col("p") / F.lag("p").over(w)).alias("r"))
    m = r.agg(F.max_by("p", "t").alias("last"), F.max("t").alias("at"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.avg("p").alias("mean")).first()
    return {"last": m.last, "at": m.at, "mu": m.mu or 0.0, "sd": m.sd or 0.01, "mean": m.mean}


def one_path(path: int, steps: int, start: dict, seconds: int, noise: float, scenario: str, reversion: float, seed: int, name: str) -> pd.DataFrame:
    """Price by drift, mean reversion and GARCH(1, 1) volatility, with bid, ask, volume and indicators."""
    rng = np.random.default_rng([seed, path])
    drift, stress = SCENARIOS[scenario]
    var, price = start["sd"] ** 2, start["last"]
    at = pd.Timestamp(start["at"])
    prices, rows, ret = [price], [], 0.0
    for k in range(1, steps + 1):
        var = OMEGA + ALPHA * ret * ret + BETA * var + (1 - ALPHA - BETA) * start["sd"] ** 2
        vol = np.sqrt(var) * stress
        pull = reversion * (np.log(start["mean"]) - np.log(price)) if reversion else 0.0
        ret = float(np.clip(start["mu"] + drift + pull + noise * vol * rng.standard_normal(), -0.5, 0.5))
        price = price * np.exp(ret)
        prices.append(price)
        last = np.array(prices[-21:])
        moves = np.diff(np.array(prices[-15:]))
        loss = -moves[moves < 0].sum()
        rsi = 100.0 if loss == 0 else 100 - 100 / (1 + moves[moves > 0].sum() / loss)
        trend = last[-1] / last[0] - 1
        regime = next((REGIMES[i] for i, ok in ((0, trend > 0.1), (1, trend > 0.05), (2, trend > 0.02), (8, trend < -0.1), (7, trend < -0.05), (6, trend < -0.02), (3, vol > 0.03), (5, vol < 0.005)) if ok), REGIMES[4])
        spread = price * (0.0005 + 0.1 * vol)
        volume = float(1e6 * np.exp(rng.standard_normal() * 0.2 + 5 * abs(ret)))
        rows.append((name, k, path, at + pd.Timedelta(seconds=seconds * k), price, ret, vol, volume, regime, float(last[-20:].mean()), float(rsi), price - spread / 2, price + spread / 2, float(np.exp(-0.01 * k))))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def simulate(spark: SparkSession, start: dict, steps: int, paths: int, interval: str = "1d", noise: float = 1.0, scenario: str = "BASE", reversion: float = 0.0, seed: int = 1, name: str = "simulation") -> DataFrame:
    """All paths; the same seed gives the same paths however they're spread."""
    if steps < 1 or paths < 1:
        raise ValueError("at least one step and one path")
    if scenario.upper() not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario}")
    seconds, start, kind = interval_seconds(interval), dict(start), scenario.upper()

    def run(batches):
        for b in batches:
            for p in b["id"]:
                yield one_path(int(p), steps, start, seconds, noise, kind, reversion, seed, name)

    return spark.range(paths).mapInPandas(run, SCHEMA)


def outcomes(sim: DataFrame) -> DataFrame:
    """Per step: mean price and the 5, 50 and 95 % quantiles over the paths."""
    return matched(sim.groupBy("step").agg(F.avg("price").alias("mean")), quantiles(sim, "price", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, ("step",)), ("step",), "left")
