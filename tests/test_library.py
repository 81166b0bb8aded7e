"""Hand-derived cases and invariants of the library's own operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import aggregates as A
from sparkloom.functions import scalar as S
from sparkloom.operators import anomaly, forecast, market, plotdata, profile, simulate, tsprep
from sparkloom.operators.stats import correlation, descriptive, distributions, special
from sparkloom.operators.stats import tests as hypothesis_tests
from sparkloom.operators.stats import timeseries as series
from sparkloom.plans.dialect import Engine
from sparkloom.plans.dialect.lexer import DialectError
from sparkloom.plans.dialect.parser import Parser
from sparkloom.plans.ordering import average_ranks, running


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 7.0), (4.0, 8.0), (10.0, 9.0)], "x double, y double")


def test_micro_fixtures(five):
    c = F.col
    r = five.agg(A.percentile_cont(c("x"), 0.3).alias("p"), A.stddev(c("x")).alias("sd"), descriptive.skewness(c("x")).alias("sk"), descriptive.kurtosis(c("x")).alias("ku"), A.regr_slope(c("x"), c("y")).alias("b"), A.regr_slope(c("y"), c("x")).alias("r")).first()
    assert r.p == pytest.approx(2.2) and r.sd == pytest.approx(math.sqrt(10))
    assert r.sk == pytest.approx(1.21431462) and r.ku == pytest.approx(-1.21568, abs=1e-5)
    assert r.b == pytest.approx(0.7) and r.r == pytest.approx(0.90206186)


def test_scalar_fixtures(spark):
    d = spark.createDataFrame([("hello",)], "s string")
    s = F.col("s")
    r = d.select(S.substr(s, 0, 2), S.substr(s, 6, 1), S.substr(s, 2, -1), S.substr(s, 2, 3), S.julianday(F.lit("2024-01-01 00:00:00")), S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), S.like(s, "[a-h]ell%"), S.like(F.lit("a"), "a%")).first()
    assert tuple(r[:4]) == ("", "", "", "ell") and r[4] == 2460310.5 and r[5] == pytest.approx(math.pi * 6371) and r[6] and r[7]


def test_special_functions():
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.student_cdf(2.228138851964939, 10) == pytest.approx(0.975)
    assert special.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert special.digamma(1) == pytest.approx(-0.5772156649015329)
    assert special.trigamma(1) == pytest.approx(math.pi**2 / 6)


def test_order_without_one_task(spark):
    d = spark.range(1000).withColumn("v", F.pmod(F.col("id") * 7919, F.lit(1000)))
    got = sorted((r.v, r.before, r.total) for r in running(d, ["v"]).collect())
    assert got == [(i, i, 1000) for i in range(1000)]
    t = average_ranks(spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,)], "v double"), "v", "r")
    assert sorted((r.v or 0, r.r or 0) for r in t.collect()) == [(0, 0), (1.0, 1.5), (1.0, 1.5), (2.0, 3.0)]


def test_rank_measures_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, 300).astype(float)
    y = x + rng.integers(0, 15, 300)
    d = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    s = np.sign(np.subtract.outer(x, x)) * np.sign(np.subtract.outer(y, y))
    k = correlation.kendall(d, "x", "y").first()
    assert k.kendall == pytest.approx(((s > 0).sum() - (s < 0).sum()) / (s != 0).sum())
    rx, ry = (pd.Series(v).rank().to_numpy() for v in (x, y))
    assert correlation.spearman(d, "x", "y").first().value == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    up = spark.createDataFrame([(float(i), float(i)) for i in range(30)], "x double, y double")
    assert correlation.hoeffding_d(up, "x", "y").first()[0] == pytest.approx(1.0)
    assert correlation.distance_correlation(up, "x", "y").first()[0] == pytest.approx(1.0)
    assert correlation.maximal_information(spark.range(500).selectExpr("double(id) x", "double(id) y"), "x", "y").first()[0] == pytest.approx(1.0, abs=0.02)


def test_edf_statistics_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.sort(np.round(rng.standard_normal(400), 2))
    d = spark.createDataFrame(pd.DataFrame({"x": x}))
    n = len(x)
    f = np.array([special.normal_cdf((v - x.mean()) / x.std(ddof=1)) for v in x])
    i = np.arange(1, n + 1)
    assert hypothesis_tests.anderson_darling(d, "x").first()[0] == pytest.approx(-n - ((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1]))).sum() / n)
    assert hypothesis_tests.cramer_von_mises(d, "x").first()[0] == pytest.approx(1 / (12 * n) + (((2 * i - 1) / (2 * n) - f) ** 2).sum())
    assert hypothesis_tests.kolmogorov_smirnov(d, "x").first().p_value > 0.05
    w = hypothesis_tests.shapiro_wilk(d, "x").first()
    assert w.statistic > 0.99 and w.p_value > 0.01


def test_fits_recover_parameters(spark):
    rng = np.random.default_rng(3)
    for name, data, want in (
        ("gamma", rng.gamma(3.0, 2.0, 20000), {"shape": 3, "scale": 2}),
        ("weibull", 4 * rng.weibull(1.7, 20000), {"shape": 1.7, "scale": 4}),
        ("beta", rng.beta(2.0, 5.0, 20000), {"a": 2, "b": 5}),
        ("lognormal", rng.lognormal(1.0, 0.5, 20000), {"mu": 1, "sigma": 0.5}),
    ):
        got = distributions.estimate(spark.createDataFrame(pd.DataFrame({"x": data})), "x", name)
        assert got == {k: pytest.approx(v, rel=0.06) for k, v in want.items()}, name


def test_series_measures():
    assert series.durbin_levinson([0.5, 0.25]) == pytest.approx([0.5, 0.0])
    rng = np.random.default_rng(4)
    assert 0.35 < series.hurst_exponent(rng.standard_normal(4096)) < 0.7
    assert series.sample_entropy(np.sin(np.arange(300) / 5)) < series.sample_entropy(rng.standard_normal(300))


def test_seasonality_and_forecast(spark):
    x = 100 + 10 * np.sin(2 * np.pi * np.arange(140) / 7)
    d = spark.createDataFrame(pd.DataFrame({"t": np.arange(140), "v": x}))
    assert tsprep.detect_seasonality(d, "t", "v", 20).first().period in (7, 14)
    want = 100 + 10 * np.sin(2 * np.pi * np.arange(140, 147) / 7)
    for s in ("recursive", "direct", "mimo", "dirrec", "seasonal"):
        got = forecast.forecast_values(x, 7, s, lags=7, period=7)
        assert np.abs(got - want).max() < 2.5, s
    f = forecast.forecast(d, "t", "v", 3).toPandas()
    assert (f.low95 <= f.low80).all() and (f.low80 <= f.value).all() and (f.value <= f.high80).all()
    flat = pd.DataFrame({"t": np.arange(100), "v": np.r_[np.zeros(50), np.ones(50) * 9]})
    assert not tsprep.stationarity(spark.createDataFrame(flat), "t", "v").first().stationary


def test_market_and_simulation(spark):
    d = spark.createDataFrame(list(enumerate([100.0, 120.0, 90.0, 130.0])), "t int, p double")
    assert max(r.drawdown for r in market.drawdown(d, "t", "p").collect()) == pytest.approx(0.25)
    start = {"last": 100.0, "at": "2024-01-01", "mu": 0.0, "sd": 0.01, "mean": 100.0}
    a, b = (simulate.simulate(spark, start, 5, 8, seed=3).orderBy("path", "step").toPandas() for _ in range(2))
    assert a.equals(b) and len(a) == 40
    with pytest.raises(ValueError):
        tsprep.interval_seconds("5x")


def test_anomalies_find_the_planted_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 2))
    x[:5] = 9
    d = spark.createDataFrame(pd.DataFrame({"k": np.arange(400), "a": x[:, 0], "b": x[:, 1]}))
    for how in ("isolation_forest", "lof", "zscore"):
        found = {r.k for r in anomaly.detect(d, ["a", "b"], how, 0.05, key="k").where("anomaly").collect()}
        assert {0, 1, 2, 3, 4} <= found, how
    found = {r.k for r in profile.outliers(d, "k", ["a", "b"]).where("outlier").collect()}
    assert {0, 1, 2, 3, 4} <= found


def test_kde_integrates_to_one(spark):
    d = spark.createDataFrame(pd.DataFrame({"v": np.random.default_rng(6).standard_normal(500) * 10}))
    k = plotdata.kde(d, "v", 100).toPandas()
    assert np.trapezoid(k.density, k.x) == pytest.approx(1, abs=0.1)


def test_quality_of_bad_rows(spark):
    d = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (2, None), (3, "bad")], "id int, email string")
    r = profile.quality(d).first()
    assert r.duplicates == 1 and r.completeness == pytest.approx(7 / 8) and r.validity == pytest.approx(2 / 3) and r.candidate_keys == []


def test_dialect_errors(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    for bad in ("SELEC 1", "SELECT a FROM t HAVING a > 1", "SELECT RANK() OVER (PARTITION BY a) FROM t", "SELECT LAG(a) FROM t", "CREATE TABLE x", "SELECT 'open FROM t"):
        with pytest.raises(DialectError):
            e.run(bad)
    assert Parser("SELECT a - 1 FROM t").select() == "SELECT (`a` - 1) FROM `t`"
    assert Parser("(1 + 2) * 3").expr() == "(((1 + 2)) * 3)"


def test_isolation_forest_samples_rows_of_few_values(spark):
    """Equal rows are drawn one by one: the trees see all of 50 values, and the rare far one scores highest."""
    df = spark.range(300_000).selectExpr("CASE WHEN id < 30 THEN 500D ELSE double(id % 50) END AS q")
    rows = anomaly.detect(df, ["q"]).groupBy("q").agg({"score": "max"}).collect()
    score = {r[0]: r[1] for r in rows}
    assert len(score) == 51 and len({round(v, 6) for v in score.values()}) > 10
    assert max(score, key=score.get) == 500.0
