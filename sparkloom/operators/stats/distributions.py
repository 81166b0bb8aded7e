"""Maximum-likelihood fits of six distributions from sufficient statistics of one aggregation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.stats import special as S

NAMES = ("normal", "lognormal", "exponential", "gamma", "beta", "weibull")


def estimate(df: DataFrame, x: str, name: str) -> dict[str, float] | None:
    """Parameters of one distribution; None where the data lie outside its support."""
    c = F.col(x).cast("double")
    pos = F.when(c > 0, F.log(F.when(c > 0, c)))
    unit = F.when((c > 0) & (c < 1), F.log(1 - F.when((c > 0) & (c < 1), c)))
    r = df.agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(pos).alias("ln"), F.var_pop(pos).alias("lv"), F.avg(unit).alias("l1")).first()
    if not r.n or not r.v:
        return None
    if name == "normal":
        return {"mu": r.m, "sigma": math.sqrt(r.v)}
    if r.lo <= 0 and name != "exponential" or r.lo < 0:
        return None
    if name == "lognormal":
        return {"mu": r.ln, "sigma": math.sqrt(r.lv)}
    if name == "exponential":
        return {"rate": 1 / r.m}
    if name == "gamma":
        s = math.log(r.m) - r.ln
        k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
        for _ in range(50):
            step = (math.log(k) - S.digamma(k) - s) / (1 / k - S.trigamma(k))
            k = k - step if k - step > 0 else k / 2
            if abs(step) < 1e-12 * k:
                break
        return {"shape": k, "scale": r.m / k}
    if name == "beta":
        if r.hi >= 1:
            return None
        t = r.m * (1 - r.m) / r.v - 1
        a, b = max(r.m * t, 1e-3), max((1 - r.m) * t, 1e-3)
        for _ in range(200):  # Newton on both equations
            g1, g2 = S.digamma(a) - S.digamma(a + b) - r.ln, S.digamma(b) - S.digamma(a + b) - r.l1
            c0 = S.trigamma(a + b)
            h11, h22 = S.trigamma(a) - c0, S.trigamma(b) - c0
            det = h11 * h22 - c0 * c0
            da, db = (h22 * g1 + c0 * g2) / det, (c0 * g1 + h11 * g2) / det
            a, b = (a - da if a - da > 0 else a / 2), (b - db if b - db > 0 else b / 2)
            if abs(da) < 1e-11 * a and abs(db) < 1e-11 * b:
                break
        return {"a": a, "b": b}
    if name == "weibull":
        k = 1.2 / math.sqrt(r.lv) if r.lv else 1.0
        for _ in range(40):  # the profile equation's sums, one pass a step
            p = F.pow(c / F.lit(r.hi), F.lit(k))
            l = F.log(c)
            q = df.agg(F.sum(p).alias("s0"), F.sum(p * l).alias("s1"), F.sum(p * l * l).alias("s2")).first()
            f = q.s1 / q.s0 - 1 / k - r.ln
            d = q.s2 / q.s0 - (q.s1 / q.s0) ** 2 + 1 / k**2
            k = k - f / d if k - f / d > 0 else k / 2
            if abs(f / d) < 1e-10 * k:
                break
        s0 = df.agg(F.avg(F.pow(c / F.lit(r.hi), F.lit(k)))).first()[0]
        return {"shape": k, "scale": r.hi * s0 ** (1 / k)}
    raise ValueError(f"unknown distribution {name}")


def _log_density(name: str, p: dict[str, float]):
    @F.pandas_udf("double")
    def f(v: pd.Series) -> pd.Series:
        return v.map(lambda z: math.log(max(S.pdf(name, z, **p), 1e-300)))

    return f


def fit(df: DataFrame, x: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """One row per distribution that fits the support: parameters, log-likelihood, AIC and BIC; best AIC first."""
    spark, rows = df.sparkSession, []
    for name in names:
        p = estimate(df, x, name)
        if p is None:
            continue
        density = _log_density(name, p)
        r = df.where(F.col(x).isNotNull()).agg(F.sum(F.lit(1)).alias("n")).first()
        ll = df.where(F.col(x).isNotNull()).select(density(F.col(x).cast("double")).alias("l")).agg(F.sum("l")).first()[0]
        rows.append((name, str({k: round(v, 8) for k, v in p.items()}), float(ll), 2 * len(p) - 2 * ll, len(p) * math.log(r.n) - 2 * ll))
    return spark.createDataFrame(sorted(rows, key=lambda r: r[3]), "distribution string, parameters string, log_likelihood double, aic double, bic double")


def density_column(name: str, x: str, **p: float):
    """The density of a column's values under given parameters."""

    @F.pandas_udf("double")
    def f(v: pd.Series) -> pd.Series:
        return v.map(lambda z: S.pdf(name, z, **p))

    return f(F.col(x).cast("double"))
