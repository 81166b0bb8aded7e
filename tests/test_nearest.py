"""Nearest neighbours and LOF of a table of several blocks, held against all pairs."""

import numpy as np
import pytest

from sparkloom.operators import anomaly as A
from sparkloom.operators import profile as P


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)).round(2)
    x[250:] = x[:50]  # copies
    return x


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d, at, 1), at


@pytest.mark.parametrize("columns", [["a"], ["a", "b"]])
def test_neighbours_across_blocks(spark, points, columns):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "k long, a double, b double")
    d, at = brute(points[:, : len(columns)], 3)
    rows = {r.k: r.neighbours for r in P.nearest(df, "k", columns, 3, size=32).collect()}
    assert sorted(rows) == list(range(300))
    for k, found in rows.items():
        assert [n.d for n in found] == pytest.approx(d[k], abs=1e-12)
        if len(columns) == 2:
            assert [n.id for n in found] == at[k].tolist()


def test_lof_of_more_than_one_block(spark):
    x = np.random.default_rng(4).normal(size=(2500, 1))
    df = spark.createDataFrame([(i, float(a)) for i, (a,) in enumerate(x)], "k long, a double")
    d, at = brute(x, 10)
    density = 10 / np.maximum(d, d[:, -1][at]).sum(1)
    rows = {r.k: r.lof for r in P.local_outlier_factor(df, "k", ["a"], 10).collect()}
    assert len(rows) == 2500
    assert [rows[i] for i in range(2500)] == pytest.approx(density[at].mean(1) / density, rel=1e-9)


def lof(x, k):
    d, at = brute(x, k)
    density = k / np.maximum(d, d[:, -1][at]).sum(1)
    return d[:, 0], density[at].mean(1) / density


def test_outliers_of_more_than_one_block(spark):
    x = np.random.default_rng(5).normal(size=(2500, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    z = (x - x.mean(0)) / x.std(0)
    near, factor = lof(z, 10)
    unit = lambda v: (v - v.min()) / (v.max() - v.min())
    score = 0.4 * unit(np.sqrt((z * z).sum(1))) + 0.3 * unit(near) + 0.3 * unit(factor)
    rows = {r.k: r for r in P.outliers(df, "k", ["a", "b"]).collect()}
    assert [rows[i].score for i in range(2500)] == pytest.approx(score, abs=1e-9)
    assert [rows[i].outlier for i in range(2500)] == (score > np.quantile(score, 0.95)).tolist()


def test_lof_detector_of_more_than_one_block(spark):
    x = np.random.default_rng(6).normal(size=(2500, 1))
    df = spark.createDataFrame([(i, float(a)) for i, (a,) in enumerate(x)], "k long, a double")
    score = 1 - 1 / np.maximum(lof(x, 19)[1], 1)
    rows = {r.k: r for r in A.detect(df, ["a"], "lof", key="k").collect()}
    assert [rows[i].score for i in range(2500)] == pytest.approx(score, abs=1e-9)
    assert [rows[i].anomaly for i in range(2500)] == (score > np.quantile(score, 0.95)).tolist()
