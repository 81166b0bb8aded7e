"""Candles, indicators, risk and simulation; a price per event type from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import market as M
from sparkloom.operators import simulate as S
from sparkloom.queries import query
from sparkloom.queries.statistics import rounded

c = F.col
_C = "WITH c AS (SELECT event_type AS s, date_trunc('hour', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS volume, count(*) AS n FROM events GROUP BY 1, 2)"
_W = "(PARTITION BY s ORDER BY start)"


def _rows(k, table="c"):
    return f"(PARTITION BY s ORDER BY start ROWS {k} PRECEDING)"


def hourly(t):
    return M.candles(t.events.withColumnRenamed("event_type", "s"), "ts", "value", "value", "1 hour", ("s",), "event_id")


@query("market_candles", f"{_C} SELECT s, start, open, high, low, close, round(volume, 6) AS volume, n FROM c")
def _(t):
    return hourly(t).select("s", c("start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", F.round("volume", 6).alias("volume"), "n")


@query("market_sma", f"{_C} SELECT s, start, CASE WHEN row_number() OVER {_W} >= 20 THEN round(avg(close) OVER {_rows(19)}, 6) END AS sma_20, CASE WHEN row_number() OVER {_W} >= 5 THEN round(avg(close) OVER {_rows(4)}, 6) END AS sma_5 FROM c")
def _(t):
    return rounded(M.sma(M.sma(hourly(t), "start", "close", 20, ("s",)), "start", "close", 5, ("s",)).select("s", c("start").cast("timestamp_ntz").alias("start"), "sma_20", "sma_5"))


@query(
    "market_rsi",
    f"{_C}, d AS (SELECT s, start, close - lag(close) OVER {_W} AS d, row_number() OVER {_W} AS i FROM c), g AS (SELECT s, start, i, avg(CASE WHEN d IS NULL OR d < 0 THEN 0 ELSE d END) OVER {_rows(13)} AS g, avg(CASE WHEN d IS NULL OR d > 0 THEN 0 ELSE -d END) OVER {_rows(13)} AS l FROM d) SELECT s, start, CASE WHEN i > 14 THEN CASE WHEN l = 0 THEN 100.0 ELSE round(100 - 100 / (1 + g / l), 6) END END AS rsi_14 FROM g",
)
def _(t):
    return rounded(M.rsi(hourly(t), "start", "close", 14, ("s",)).select("s", c("start").cast("timestamp_ntz").alias("start"), "rsi_14"))


@query("market_bollinger", f"{_C} SELECT s, start, CASE WHEN row_number() OVER {_W} >= 20 THEN round(avg(close) OVER {_rows(19)} + 2 * stddev_pop(close) OVER {_rows(19)}, 6) END AS bb_upper FROM c")
def _(t):
    return rounded(M.bollinger(hourly(t), "start", "close", 20, 2.0, ("s",)).select("s", c("start").cast("timestamp_ntz").alias("start"), "bb_upper"))


@query(
    "market_ema",
    f"{_C.replace('WITH', 'WITH RECURSIVE', 1)}, i AS (SELECT s, start, close, row_number() OVER {_W} AS i FROM c), e AS (SELECT s, start, close, i, close AS ema FROM i WHERE i = 1 UNION ALL SELECT i.s, i.start, i.close, i.i, i.close * 2 / 13 + e.ema * 11 / 13 FROM e JOIN i ON i.s = e.s AND i.i = e.i + 1) SELECT s, start, close, round(ema, 6) AS ema_12 FROM e",
)
def _(t):
    return rounded(M.ema(hourly(t).select("s", "start", "close"), "start", "close", 12, ("s",)).select("s", c("start").cast("timestamp_ntz").alias("start"), "close", "ema_12"))


@query(
    "market_risk",
    f"{_C}, r AS (SELECT s, start, close, (close - lag(close) OVER {_W}) / nullif(lag(close) OVER {_W}, 0) AS r, 1 - close / max(close) OVER (PARTITION BY s ORDER BY start ROWS UNBOUNDED PRECEDING) AS dd FROM c) SELECT s, count(r) AS n, round(stddev_samp(r) * sqrt(252), 6) AS volatility, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(count(*) FILTER (r > 0) / count(r), 6) AS win_rate, round(-quantile_cont(r, 0.05), 6) AS var95, round(max(dd), 6) AS max_drawdown FROM r GROUP BY 1",
)
def _(t):
    return rounded(M.risk(hourly(t), "start", "close", ("s",)).select("s", "n", "volatility", "sharpe", "win_rate", "var95", "max_drawdown"))


@query("market_drawdown", f"{_C} SELECT s, start, round((max(close) OVER (PARTITION BY s ORDER BY start ROWS UNBOUNDED PRECEDING) - close) / max(close) OVER (PARTITION BY s ORDER BY start ROWS UNBOUNDED PRECEDING), 8) AS drawdown FROM c")
def _(t):
    return rounded(M.drawdown(hourly(t), "start", "close", ("s",)).select("s", c("start").cast("timestamp_ntz").alias("start"), "drawdown"), 8)


_REGIME = "CASE WHEN trend IS NULL OR vol IS NULL THEN NULL " + " ".join(f"WHEN {x} THEN '{M.REGIMES[k]}'" for x, k in (("trend > 0.10", 0), ("trend > 0.05", 1), ("trend > 0.02", 2), ("trend < -0.10", 8), ("trend < -0.05", 7), ("trend < -0.02", 6), ("vol > 0.03", 3), ("vol < 0.005", 5))) + f" ELSE '{M.REGIMES[4]}' END"


@query(
    "market_regimes",
    f"{_C}, r AS (SELECT s, start, close, close / nullif(lag(close, 20) OVER {_W}, 0) - 1 AS trend, (close - lag(close) OVER {_W}) / nullif(lag(close) OVER {_W}, 0) AS r FROM c), v AS (SELECT s, start, trend, stddev_samp(r) OVER {_rows(19)} AS vol FROM r) SELECT s, start, {_REGIME} AS regime FROM v",
)
def _(t):
    return M.regimes(hourly(t), "start", "close", 20, ("s",)).select("s", c("start").cast("timestamp_ntz").alias("start"), "regime")


@query("market_levels", f"{_C}, a AS (SELECT s, start, close, min(close) OVER w AS lo, max(close) OVER w AS hi, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY s ORDER BY start ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT s, start, CASE WHEN close = lo THEN 'support' ELSE 'resistance' END AS level FROM a WHERE n = 11 AND (close = lo OR close = hi)")
def _(t):
    return M.levels(hourly(t), "start", "close", 5, ("s",)).select("s", c("start").cast("timestamp_ntz").alias("start"), "level")


@query(
    "market_trend_lines",
    f"{_C}, b AS (SELECT s, start, close, row_number() OVER {_W} AS i, count(*) OVER (PARTITION BY s) AS last FROM c), a AS (SELECT *, min(close) OVER w AS lo, max(close) OVER w AS hi, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY s ORDER BY start ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), l AS (SELECT s, i, close, last, CASE WHEN close = lo THEN 'support' ELSE 'resistance' END AS level FROM a WHERE n = 11 AND (close = lo OR close = hi)), r AS (SELECT *, row_number() OVER (PARTITION BY s, level ORDER BY i DESC) AS r FROM l), p AS (SELECT a.s, a.level, (a.close - b.close) / (a.i - b.i) AS slope, a.close, a.i, a.last FROM r a JOIN r b ON a.s = b.s AND a.level = b.level AND a.r = 1 AND b.r = 2) SELECT s, level, round(slope, 6) AS slope, round(close + slope * (last - i), 6) AS value FROM p",
)
def _(t):
    return rounded(M.trend_lines(hourly(t), "start", "close", 5, ("s",)))


def simulated(t, **k):
    start = S.calibrate(t.orders, "o_orderdate", "o_totalprice")
    return S.simulate(t.spark, start, 30, 50, "1d", seed=7, **k)


@query("simulate_market")
def _(t):
    return simulated(t)


@query("simulate_scenario")
def _(t):
    return S.outcomes(simulated(t, scenario="CRASH", reversion=0.05))


@query("simulate_shape", "SELECT s.step::INT AS step, 50::BIGINT AS paths, TRUE AS ok FROM (SELECT unnest(range(1, 31)) AS step) s")
def _(t):
    ok = F.every((c("price") > 0) & (c("bid") < c("price")) & (c("ask") > c("price")) & c("rsi").between(0, 100))
    return simulated(t).groupBy("step").agg(F.count("*").alias("paths"), ok.alias("ok"))
