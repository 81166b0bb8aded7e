"""Forecasts per series: ridge autoregression on lags, driven recursively, directly, at once, or as an ensemble.

A series is one key's rows and must fit one task; series spread over the cluster. Intervals are conformal on the
one-step errors of persistence, widened by 10 % a step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("recursive", "direct", "mimo", "dirrec", "ensemble", "persistence", "seasonal")


def _design(x: np.ndarray, p: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(x) - p - h + 1
    a = np.stack([x[i : i + n] for i in range(p)], 1)
    y = np.stack([x[p + k : p + k + n] for k in range(h)], 1)
    return np.c_[a, np.ones(n)], y


def _solve(a: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    g = a.T @ a + ridge * np.eye(a.shape[1]) * max(1.0, np.trace(a.T @ a) / a.shape[1])
    return np.linalg.solve(g, a.T @ y)


def decompose(x: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend (centred mean, ends filled), additive seasonal pattern of mean zero, residual."""
    k = period if period % 2 else period + 1
    t = pd.Series(x).rolling(k, center=True).mean().bfill().ffill().fillna(float(np.mean(x)) if len(x) else 0.0).to_numpy()
    d = x - t
    s = np.array([d[i::period].mean() if len(d[i::period]) else 0.0 for i in range(period)])
    s -= s.mean()
    season = s[np.arange(len(x)) % period]
    return t, season, x - t - season


def find_period(x: np.ndarray, most: int = 365, least: float = 0.3) -> int:
    """The lag of the strongest peak of the autocorrelation above `least`, 0 without one."""
    x = np.asarray(x, float)
    most = min(most, len(x) // 2)
    if most < 2 or np.var(x) < 1e-12:
        return 0
    e = x - x.mean()
    r = np.array([1.0] + [(e[:-k] * e[k:]).mean() / e.var() for k in range(1, most + 1)])
    peaks = [k for k in range(2, most) if r[k] > r[k - 1] and r[k] > r[k + 1] and r[k] > least]
    return max(peaks, key=lambda k: r[k], default=0)


def forecast_values(x: np.ndarray, horizon: int, strategy: str = "ensemble", lags: int = 7, period: int = 0) -> np.ndarray:
    """horizon values after x."""
    x = np.asarray(x, float)
    n = len(x)
    if n == 0:
        return np.full(horizon, np.nan)
    flat = np.full(horizon, x[-1])
    p = max(1, min(lags, (n - horizon) // 2))
    if strategy == "persistence" or n < 8 or n - p - horizon < 3:
        return flat
    if strategy == "seasonal":
        if period < 2 or n < 2 * period:
            return flat
        t, s, _ = decompose(x, period)
        return t[-1] + s[(n + np.arange(horizon)) % period]
    if strategy == "recursive":
        w = _solve(*_design(x, p, 1))[:, 0]
        past, out = x.tolist(), []
        lo, hi = x.min() - 3 * np.ptp(x), x.max() + 3 * np.ptp(x)
        for _ in range(horizon):
            v = float(np.clip(np.r_[past[-p:], 1.0] @ w, lo, hi))
            out.append(v)
            past.append(v)
        return np.array(out)
    if strategy == "mimo":
        return np.r_[x[-p:], 1.0] @ _solve(*_design(x, p, horizon))
    if strategy == "direct":
        a, y = _design(x, p, horizon)
        return np.array([np.r_[x[-p:], 1.0] @ _solve(a, y[:, k]) for k in range(horizon)])
    if strategy == "dirrec":
        return (forecast_values(x, horizon, "direct", lags) + forecast_values(x, horizon, "recursive", lags)) / 2
    if strategy == "ensemble":
        names = ["recursive", "direct", "mimo", "persistence"] + (["seasonal"] if period > 1 else [])
        cut = max(8, n - max(horizon, 3))
        weights, parts = [], []
        for name in names:
            held = forecast_values(x[:cut], n - cut, name, lags, period)
            mape = np.abs((x[cut:] - held) / np.where(np.abs(x[cut:]) > 1e-10, x[cut:], 1.0)).mean() if n > cut else 1.0
            weights.append(1 / (mape + 1e-6))
            parts.append(forecast_values(x, horizon, name, lags, period))
        w = np.array(weights) / sum(weights)
        return w @ np.array(parts)
    raise ValueError(f"unknown strategy {strategy}")


def _bands(x: np.ndarray, horizon: int, levels: Sequence[float]) -> list[np.ndarray]:
    err = np.abs(np.diff(x)) if len(x) > 1 else np.zeros(1)
    return [np.quantile(err, level) * (1 + 0.1 * np.arange(horizon)) for level in levels]


def forecast(df: DataFrame, time: str, y: str, horizon: int, keys: Sequence[str] = (), strategy: str = "ensemble", lags: int = 7, period: int | None = None) -> DataFrame:
    """keys, step, value and the 80 % and 95 % bands after each series' last row; without a period each series' own is found."""
    if horizon < 1:
        raise ValueError("the horizon is at least 1")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time, kind="stable")[y].dropna().to_numpy(float)
        own = find_period(x) if period is None and strategy in ("seasonal", "ensemble") else period or 0
        v = forecast_values(x, horizon, strategy, lags, own)
        b80, b95 = _bands(x, horizon, (0.8, 0.95))
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * horizon for k in keys})
        for name, col in (("step", np.arange(1, horizon + 1)), ("value", v), ("low80", v - b80), ("high80", v + b80), ("low95", v - b95), ("high95", v + b95)):
            out[name] = col
        return out

    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.select(*keys, time, y).groupBy(*keys).applyInPandas(run, fields + "step long, value double, low80 double, high80 double, low95 double, high95 double")


def periods(df: DataFrame, time: str, y: str, keys: Sequence[str] = (), most: int = 365) -> DataFrame:
    """keys, period: what a forecast takes for each series' season, 0 for none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time, kind="stable")[y].dropna().to_numpy(float)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), find_period(x, most)]], columns=[*keys, "period"])

    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.select(*keys, time, y).groupBy(*keys).applyInPandas(run, fields + "period int")


def backtest(df: DataFrame, time: str, y: str, horizon: int, folds: int = 3, keys: Sequence[str] = (), strategies: Sequence[str] = STRATEGIES, lags: int = 7, period: int = 7) -> DataFrame:
    """keys, strategy, mape and rmse over expanding splits: the auto-tuner takes the smallest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time, kind="stable")[y].dropna().to_numpy(float)
        rows = []
        for s in strategies:
            errs, rel = [], []
            for f in range(folds, 0, -1):
                cut = len(x) - f * horizon
                if cut < 8:
                    continue
                e = x[cut : cut + horizon] - forecast_values(x[:cut], horizon, s, lags, period)
                errs += (e * e).tolist()
                rel += np.abs(e / np.where(np.abs(x[cut : cut + horizon]) > 1e-10, x[cut : cut + horizon], 1.0)).tolist()
            if errs:
                rows.append([*(pdf[k].iloc[0] for k in keys), s, float(np.mean(rel)), float(np.sqrt(np.mean(errs)))])
        return pd.DataFrame(rows, columns=[*keys, "strategy", "mape", "rmse"])

    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.select(*keys, time, y).groupBy(*keys).applyInPandas(run, fields + "strategy string, mape double, rmse double")


def bootstrap_intervals(df: DataFrame, time: str, y: str, horizon: int, keys: Sequence[str] = (), level: float = 0.95, paths: int = 200, seed: int = 1) -> DataFrame:
    """Recursive forecasts with resampled one-step errors: keys, step, low, high."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time, kind="stable")[y].dropna().to_numpy(float)
        v = forecast_values(x, horizon, "recursive")
        rng = np.random.default_rng(seed)
        e = np.diff(x) if len(x) > 1 else np.zeros(1)
        sims = v + np.cumsum(rng.choice(e - e.mean(), (paths, horizon)), axis=1)
        lo, hi = np.quantile(sims, [(1 - level) / 2, (1 + level) / 2], axis=0)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * horizon for k in keys})
        out["step"], out["low"], out["high"] = np.arange(1, horizon + 1), lo, hi
        return out

    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.select(*keys, time, y).groupBy(*keys).applyInPandas(run, fields + "step long, low double, high double")


def decomposition(df: DataFrame, time: str, y: str, period: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, time, trend, seasonal, residual of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        pdf["trend"], pdf["seasonal"], pdf["residual"] = decompose(pdf[y].to_numpy(float), period)
        return pdf[[*keys, time, "trend", "seasonal", "residual"]]

    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in (*keys, time))
    return df.select(*keys, time, F.col(y).cast("double").alias(y)).groupBy(*keys).applyInPandas(run, fields + "trend double, seasonal double, residual double")
