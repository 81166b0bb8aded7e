"""Measures of an ordered series. A series is one key's rows; keys spread over the cluster."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def acf(df: DataFrame, order: str, x: str, lags: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """key, lag, acf: autocovariance over population variance."""
    w = Window.partitionBy(*keys).orderBy(order)
    m = df.groupBy(*keys).agg(F.avg(x).alias("__m"))
    both = df.join(m, list(keys)) if keys else df.join(m)
    e = both.select(*keys, order, (F.col(x) - F.col("__m")).alias("e"))
    e = e.select(*keys, "e", *[(F.col("e") * F.lag("e", k).over(w)).alias(f"p{k}") for k in range(1, lags + 1)])
    var = F.nullif(F.sum(F.col("e") * F.col("e")), F.lit(0.0))
    one = e.groupBy(*keys).agg(*[F.coalesce(F.sum(f"p{k}") / var, F.lit(0.0)).alias(f"r{k}") for k in range(1, lags + 1)])
    return one.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("acf")) for k in range(1, lags + 1)])).alias("a")).select(*keys, "a.lag", "a.acf")


def durbin_levinson(r: list[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations at lags 1, 2, ..."""
    out, phi = [], []
    for k in range(1, len(r) + 1):
        if k == 1:
            p = r[0]
            phi = [p]
        else:
            den = 1 - sum(a * b for a, b in zip(phi, r))
            p = (r[k - 1] - sum(a * b for a, b in zip(phi, reversed(r[: k - 1])))) / den if den else 0.0
            phi = [a - p * b for a, b in zip(phi, reversed(phi))] + [p]
        out.append(p)
    return out


def pacf(df: DataFrame, order: str, x: str, lags: int) -> DataFrame:
    rows = sorted((r.lag, r.acf) for r in acf(df, order, x, lags).collect())
    return df.sparkSession.createDataFrame(list(zip([r[0] for r in rows], durbin_levinson([r[1] for r in rows]))), "lag int, pacf double")


def hurst_exponent(x: np.ndarray) -> float:
    """Slope of log rescaled range over log window, for doubling windows from 8."""
    n, points, w = len(x), [], 8
    while w <= n // 2:
        parts = x[: n // w * w].reshape(-1, w)
        d = np.cumsum(parts - parts.mean(1, keepdims=True), axis=1)
        s = parts.std(1)
        rs = ((d.max(1) - d.min(1))[s > 0] / s[s > 0]).mean() if (s > 0).any() else 0
        if rs > 0:
            points.append((math.log(w), math.log(rs)))
        w *= 2
    if len(points) < 2:
        return 0.5
    return float(np.polyfit(*zip(*points), 1)[0])


def lyapunov_exponent(x: np.ndarray, dim: int = 3) -> float:
    """Mean log divergence of nearest neighbours of the embedding one step on."""
    n = len(x) - dim
    if n < 10:
        return 0.0
    e = np.stack([x[i : i + n] for i in range(dim)], 1)
    total, used = 0.0, 0
    for i in range(n - 1):
        d = np.sqrt(((e[: n - 1] - e[i]) ** 2).sum(1))
        d[max(0, i - 1) : i + 2] = np.inf
        j = int(d.argmin())
        after = float(np.sqrt(((e[i + 1] - e[j + 1]) ** 2).sum()))
        if 0 < d[j] < np.inf and after > 0:
            total += math.log(after / d[j])
            used += 1
    return total / used if used else 0.0


def sample_entropy(x: np.ndarray, m: int = 2, tolerance: float = 0.2) -> float:
    r = tolerance * x.std()

    def matches(k: int) -> int:
        e = np.stack([x[i : len(x) - m + i] for i in range(k)], 1)
        return sum(int((np.abs(e[i + 1 :] - e[i]).max(1) <= r).sum()) for i in range(len(e) - 1))

    if len(x) <= m + 1:
        return 0.0
    a, b = matches(m + 1), matches(m)
    return -math.log(a / b) if a and b else 0.0


def approximate_entropy(x: np.ndarray, m: int = 2, tolerance: float = 0.2) -> float:
    """Log of how often stretches that agree on m values, each with itself too, agree on the next."""
    r = tolerance * x.std()

    def phi(k: int) -> float:
        e = np.stack([x[i : len(x) - k + 1 + i] for i in range(k)], 1)
        share = np.array([(np.abs(e - row).max(1) <= r).mean() for row in e])
        return float(np.log(share).mean())

    return phi(m) - phi(m + 1) if len(x) > m + 1 else 0.0


def ewma_variance(x: np.ndarray, decay: float = 0.94) -> np.ndarray:
    out, v = np.zeros(len(x)), 0.0
    for i, r in enumerate(x):
        v = decay * v + (1 - decay) * r * r if i else r * r
        out[i] = v
    return out


def per_series(df: DataFrame, order: str, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Hurst, Lyapunov, sample and approximate entropy of each key's series; a series must fit one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order, kind="stable")[x].dropna().to_numpy(float)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), len(v), hurst_exponent(v), lyapunov_exponent(v), sample_entropy(v), approximate_entropy(v)]], columns=[*keys, "n", "hurst", "lyapunov", "sample_entropy", "approximate_entropy"])

    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.groupBy(*keys).applyInPandas(run, fields + "n long, hurst double, lyapunov double, sample_entropy double, approximate_entropy double")


def spectrum(df: DataFrame, order: str, x: str, keys: tuple[str, ...] = (), top: int = 5) -> DataFrame:
    """The strongest periods of each key's series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order, kind="stable")[x].dropna().to_numpy(float)
        p = np.abs(np.fft.rfft(v - v.mean())) ** 2 if len(v) else np.zeros(1)
        at = np.argsort(-p[1:], kind="stable")[:top] + 1 if len(p) > 1 else []
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), len(v) / i, float(p[i])] for i in at], columns=[*keys, "period", "power"])

    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.groupBy(*keys).applyInPandas(run, fields + "period double, power double")
