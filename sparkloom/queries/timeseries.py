"""Time-series preparation and forecasting, on daily order totals and on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import forecast as Y
from sparkloom.operators import tsprep as P
from sparkloom.queries import query
from sparkloom.queries.statistics import rounded

c = F.col


def daily(t):
    return t.orders.groupBy("o_orderstatus", F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))


_D = "WITH t AS (SELECT o_orderstatus, o_orderdate::DATE AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)"
_W = "(PARTITION BY o_orderstatus ORDER BY d)"


@query("ts_lags", f"{_D} SELECT o_orderstatus, d, round(lag(v, 1) OVER {_W}, 2) AS v_lag_1, round(lag(v, 7) OVER {_W}, 2) AS v_lag_7 FROM t")
def _(t):
    return rounded(P.lag_features(daily(t), "d", "v", (1, 7), ("o_orderstatus",)).drop("v"), 2)


@query("ts_rolling", f"{_D} SELECT o_orderstatus, d, round(avg(v) OVER (PARTITION BY o_orderstatus ORDER BY d ROWS 6 PRECEDING), 2) AS v_mean_7, round(coalesce(stddev_samp(v) OVER (PARTITION BY o_orderstatus ORDER BY d ROWS 6 PRECEDING), 0), 2) AS v_std_7 FROM t")
def _(t):
    return rounded(P.rolling_features(daily(t), "d", "v", (7,), ("o_orderstatus",)).drop("v"), 2)


@query("ts_difference", f"{_D} SELECT o_orderstatus, d, round(v - lag(v) OVER {_W}, 2) AS v_diff_1, round(v - lag(v, 7) OVER {_W}, 2) AS v_diff_7 FROM t")
def _(t):
    return rounded(P.difference(P.difference(daily(t), "d", "v", 1, ("o_orderstatus",)), "d", "v", 7, ("o_orderstatus",)).drop("v"), 2)


@query("ts_percent_change", f"{_D} SELECT o_orderstatus, d, round((v - lag(v) OVER {_W}) / abs(lag(v) OVER {_W}), 6) AS v_pct_1 FROM t")
def _(t):
    return rounded(P.percent_change(daily(t), "d", "v", 1, ("o_orderstatus",)).drop("v"))


@query("ts_ewma", f"WITH RECURSIVE u AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::DATE AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM u), e AS (SELECT k, i, d, v::DOUBLE AS s FROM t WHERE i = 1 UNION ALL SELECT t.k, t.i, t.d, 0.3 * t.v + 0.7 * e.s FROM e JOIN t ON t.k = e.k AND t.i = e.i + 1) SELECT k, d, round(s, 2) AS v_ewma FROM e")
def _(t):
    m = t.orders.groupBy(c("o_orderpriority").alias("k"), F.trunc("o_orderdate", "month").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(P.ewma(m, "d", "v", 0.3, ("k",)).drop("v"), 2)


@query("ts_datetime_features", "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, dayofweek(ts)::INT AS day_of_week, dayofweek(ts) IN (0, 6) AS weekend, round(sin(hour(ts) * 2 * pi() / 24), 8) AS hour_sin FROM events")
def _(t):
    d = P.datetime_features(t.events.select("event_id", "ts"), "ts")
    return d.select("event_id", "year", "month", "day", "hour", "day_of_week", "weekend", F.round("hour_sin", 8).alias("hour_sin"))


@query("ts_split", f"{_D}, s AS (SELECT *, (row_number() OVER {_W} - 1) / count(*) OVER (PARTITION BY o_orderstatus) AS x FROM t) SELECT o_orderstatus, d, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS part FROM s")
def _(t):
    return P.split(daily(t), "d", keys=("o_orderstatus",)).drop("v")


@query(
    "ts_walk_forward",
    "WITH t AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS v, row_number() OVER (ORDER BY o_orderdate::DATE) AS i, count(*) OVER () AS n FROM orders GROUP BY 1), f AS (SELECT unnest([1, 2, 3]) AS fold) SELECT fold, (count(*) FILTER (i > n - (4 - fold) * 30 AND i <= n - (3 - fold) * 30))::INT AS n, min(d) FILTER (i > n - (4 - fold) * 30) AS first, round(sum(v) FILTER (i > n - (4 - fold) * 30 AND i <= n - (3 - fold) * 30), 2) AS total, (count(*) FILTER (i <= n - (4 - fold) * 30 - 2))::INT AS trained, max(d) FILTER (i <= n - (4 - fold) * 30 - 2) AS last FROM t, f GROUP BY fold",
)
def _(t):
    m = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    out = None
    for i, (train, test) in enumerate(P.walk_forward(m, "d", 3, 30, gap=2), 1):
        of_train = train.agg(F.count("*").cast("int").alias("trained"), F.max("d").alias("last"))
        one = test.agg(F.lit(i).alias("fold"), F.count("*").cast("int").alias("n"), F.min("d").alias("first"), F.round(F.sum("v"), 2).alias("total")).join(of_train)
        out = one if out is None else out.union(one)
    return out


@query(
    "ts_stationarity",
    f"{_D}, h AS (SELECT *, ntile(2) OVER {_W} AS h FROM t), m AS (SELECT o_orderstatus, count(*) AS n, avg(v) FILTER (h = 1) AS m1, avg(v) FILTER (h = 2) AS m2, var_samp(v) FILTER (h = 1) AS v1, var_samp(v) FILTER (h = 2) AS v2 FROM h GROUP BY 1) SELECT o_orderstatus, n, round(abs(m1 - m2) / abs(m1), 6) AS mean_shift, round(least(v1, v2) / greatest(v1, v2), 6) AS variance_ratio, n >= 30 AND abs(m1 - m2) / abs(m1) < 0.1 AND least(v1, v2) / greatest(v1, v2) > 0.9 AS stationary FROM m",
)
def _(t):
    return rounded(P.stationarity(daily(t), "d", "v", keys=("o_orderstatus",)))


#: A weekly wave on the events' values, in the order of their keys.
_WAVE = "SELECT event_id, 10 * sin(2 * pi() * event_id / 7) + value / 50 AS v FROM events"


@query(
    "ts_detect_seasonality",
    f"WITH w AS ({_WAVE}), e AS (SELECT v - avg(v) OVER () AS e, row_number() OVER (ORDER BY event_id) AS i FROM w), a AS (SELECT k AS lag, sum(a.e * b.e) / (SELECT sum(e * e) FROM e) AS acf FROM e a, (SELECT unnest(range(1, 31)) AS k), e b WHERE a.i = b.i + k GROUP BY 1), n AS (SELECT *, lag(acf) OVER (ORDER BY lag) AS l, lead(acf) OVER (ORDER BY lag) AS r FROM a) SELECT lag::INT AS period, round(acf, 6) AS strength FROM n WHERE lag >= 2 AND acf > 0.3 AND acf > l AND acf >= coalesce(r, -1)",
)
def _(t):
    wave = t.events.select("event_id", (10 * F.sin(2 * F.pi() * c("event_id") / 7) + c("value") / 50).alias("v"))
    return rounded(P.detect_seasonality(wave, "event_id", "v", 30))


@query(
    "ts_seasonal_strengths",
    f"{_D}, e AS (SELECT o_orderstatus, v - avg(v) OVER (PARTITION BY o_orderstatus) AS e, row_number() OVER {_W} AS i FROM t), a AS (SELECT a.o_orderstatus, k AS period, sum(a.e * b.e) AS p FROM e a, (SELECT unnest([7, 30]) AS k), e b WHERE a.o_orderstatus = b.o_orderstatus AND a.i = b.i + k GROUP BY 1, 2), v AS (SELECT o_orderstatus, sum(e * e) AS v FROM e GROUP BY 1) SELECT o_orderstatus, period::INT AS period, round(p / v, 6) AS acf, p / v > 0.3 AS seasonal FROM a JOIN v USING (o_orderstatus)",
)
def _(t):
    return rounded(P.seasonal_strengths(daily(t), "d", "v", (7, 30), ("o_orderstatus",)))


@query("ts_prepare", f"{_D} SELECT o_orderstatus, d, round(v, 2) AS v, round(lag(v, 1) OVER {_W}, 2) AS v_lag_1, round(avg(v) OVER (PARTITION BY o_orderstatus ORDER BY d ROWS 2 PRECEDING), 2) AS v_mean_3, round(coalesce(stddev_samp(v) OVER (PARTITION BY o_orderstatus ORDER BY d ROWS 2 PRECEDING), 0), 2) AS v_std_3, round(v - lag(v) OVER {_W}, 2) AS v_diff_1 FROM t")
def _(t):
    return rounded(P.prepare(daily(t), "d", "v", ("o_orderstatus",), lags=(1,), windows=(3,), make_stationary=True), 2)


@query("forecast_ensemble")
def _(t):
    return Y.forecast(daily(t), "d", "v", 14, ("o_orderstatus",), "ensemble", period=7)


@query("forecast_recursive")
def _(t):
    return Y.forecast(daily(t), "d", "v", 7, ("o_orderstatus",), "recursive")


@query("forecast_direct")
def _(t):
    return Y.forecast(daily(t), "d", "v", 7, ("o_orderstatus",), "direct")


@query("forecast_mimo")
def _(t):
    return Y.forecast(daily(t), "d", "v", 7, ("o_orderstatus",), "mimo")


@query("forecast_dirrec")
def _(t):
    return Y.forecast(daily(t), "d", "v", 7, ("o_orderstatus",), "dirrec")


@query("forecast_persistence", f"{_D}, l AS (SELECT o_orderstatus, max_by(v, d) AS v FROM t GROUP BY 1) SELECT o_orderstatus, s AS step, round(v, 2) AS value FROM l, (SELECT unnest(range(1, 6)) AS s)")
def _(t):
    return rounded(Y.forecast(daily(t), "d", "v", 5, ("o_orderstatus",), "persistence").select("o_orderstatus", "step", "value"), 2)


@query("forecast_bootstrap")
def _(t):
    return Y.bootstrap_intervals(daily(t), "d", "v", 7, ("o_orderstatus",))


@query("forecast_backtest")
def _(t):
    return Y.backtest(daily(t), "d", "v", 7, 3, ("o_orderstatus",))


@query("forecast_period", "SELECT event_type, 7::INT AS period FROM events GROUP BY 1")
def _(t):
    """A weekly wave on each type's events, in their order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    wave = t.events.select("event_type", "event_id", (10 * F.sin(2 * F.pi() * place / 7) + c("value") / 100).alias("v"))
    return Y.periods(wave, "event_id", "v", ("event_type",), 10)


@query(
    "forecast_decomposition",
    f"""{_D}, i AS (SELECT *, row_number() OVER {_W} - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n, avg(v) OVER (PARTITION BY o_orderstatus ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM t),
    f AS (SELECT o_orderstatus, max(m) FILTER (i = 3) AS a, max(m) FILTER (i = n - 4) AS z FROM i GROUP BY 1), r AS (SELECT o_orderstatus, d, v, i, CASE WHEN i < 3 THEN a WHEN i > n - 4 THEN z ELSE m END AS trend FROM i JOIN f USING (o_orderstatus)),
    s AS (SELECT o_orderstatus, i % 7 AS p, avg(v - trend) AS s FROM r GROUP BY 1, 2), c AS (SELECT o_orderstatus, p, s - avg(s) OVER (PARTITION BY o_orderstatus) AS s FROM s)
    SELECT o_orderstatus, d, round(trend, 2) AS trend, round(s, 2) AS seasonal, round(v - trend - s, 2) AS residual FROM r JOIN c USING (o_orderstatus) WHERE i % 7 = p""",
)
def _(t):
    return rounded(Y.decomposition(daily(t), "d", "v", 7, ("o_orderstatus",)), 2)


@query("interval_parsing", "SELECT * FROM (VALUES ('30s', 30), ('5m', 300), ('4h', 14400), ('1d', 86400)) v(text, seconds)")
def _(t):
    return t.nation.sparkSession.createDataFrame([(x, P.interval_seconds(x)) for x in ("30s", "5m", "4h", "1d")], "text string, seconds int")
