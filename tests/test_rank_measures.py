"""Rank measures without pairs, against their definitions over all pairs."""

import math

import numpy as np
import pytest

from sparkloom.operators.stats import correlation as C
from sparkloom.plans import dominance


def sets():
    rng = np.random.default_rng(8)
    n = 160
    x = rng.standard_normal(n)
    return {
        "smooth": (x, x + rng.standard_normal(n)),
        "ties": (rng.integers(0, 6, n).astype(float), rng.integers(0, 5, n).astype(float)),
        "hot": (np.where(rng.random(n) < 0.5, 3.0, rng.integers(0, 40, n)), np.where(rng.random(n) < 0.4, 7.0, rng.standard_normal(n))),
        "same": (np.ones(n), x),
        "line": (np.arange(n) * 1.0, -np.arange(n) * 2.0),
        "one": (np.array([1.0]), np.array([2.0])),
    }


def frame(spark, x, y):
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None)]
    return spark.createDataFrame(rows, "x double, y double")


def test_below_left_equals_pairs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 129):
        x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 9, n).astype(float)
        f = rng.standard_normal((n, 2))
        want = ((x[:, None] > x[None]) & (y[:, None] > y[None])) @ f if n else f
        assert np.allclose(dominance.below_left(x, y, f), want)


@pytest.mark.parametrize("size", [4, 1000])
def test_sums_equal_pairs_whatever_the_blocks(spark, size):
    for x, y in sets().values():
        pts = {(float(a), float(b)) for a, b in zip(x, y)}
        df = spark.createDataFrame([(a, b, a + 2 * b) for a, b in pts], "x double, y double, f double")
        got = {(r.x, r.y): (r.one, r.f) for r in dominance.lower_left_sums(df, {"one": "1", "f": "f"}, size=size).collect()}
        for a, b in pts:
            below = [c + 2 * d for c, d in pts if c < a and d < b]
            assert got[a, b][0] == len(below) and got[a, b][1] == pytest.approx(sum(below), abs=1e-9)
    assert dominance.lower_left_sums(df.limit(0), {"one": "1"}).count() == 0


@pytest.mark.parametrize("name", sorted(sets()))
def test_measures_equal_definitions(spark, monkeypatch, name):
    monkeypatch.setattr(dominance, "LEAST", 16)
    x, y = sets()[name]
    n, df = len(x), frame(spark, x, y)
    sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    c, d = ((sx * sy) > 0).sum() / 2, ((sx * sy) < 0).sum() / 2
    r = C.kendall(df, "x", "y").first()
    assert (r.concordant, r.discordant) == (c, d) and r.kendall == pytest.approx((c - d) / (c + d) if c + d else 0.0)

    centre = lambda v: (m := np.abs(np.subtract.outer(v, v))) - m.mean(0) - m.mean(1)[:, None] + m.mean()
    a, b = centre(x), centre(y)
    both = math.sqrt((a * a).mean() * (b * b).mean())
    want = math.sqrt(max(0.0, (a * b).mean()) / both) if both > 1e-20 else 0.0
    assert C.distance_correlation(df, "x", "y").first()[0] == pytest.approx(want, abs=1e-6)

    if n > 4:
        half = lambda s: (s < 0) * 0.0 + (s > 0) * 1.0 + (s == 0) * 0.5
        hx, hy = half(sx), half(sy)
        np.fill_diagonal(hx, 0), np.fill_diagonal(hy, 0)
        rr, ss, q = hx.sum(1) + 1, hy.sum(1) + 1, (hx * hy).sum(1) + 1
        d1, d2, d3 = ((q - 1) * (q - 2)).sum(), ((rr - 1) * (rr - 2) * (ss - 1) * (ss - 2)).sum(), ((rr - 2) * (ss - 2) * (q - 1)).sum()
        want = 30 * ((n - 2) * (n - 3) * d1 + d2 - 2 * (n - 2) * d3) / (n * (n - 1) * (n - 2) * (n - 3) * (n - 4))
        assert C.hoeffding_d(df, "x", "y").first()[0] == pytest.approx(want, abs=1e-9)


def mic(x, y):
    """Every grid of at most n^0.6 cells, from its definition."""
    n = len(x)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    rx, ry, cells, best = rank(x), rank(y), max(4, int(n**0.6)), 0.0
    for a in range(2, cells // 2 + 1):
        for b in range(2, cells // a + 1):
            i, j = (np.minimum(((r - 0.5) * k / n).astype(int), k - 1) for r, k in ((rx, a), (ry, b)))
            p = np.zeros((a, b))
            np.add.at(p, (i, j), 1 / n)
            e = p.sum(1)[:, None] * p.sum(0)[None]
            best = max(best, (p[p > 0] * np.log(p[p > 0] / e[p > 0])).sum() / math.log(min(a, b)))
    return best


def test_maximal_information_tries_every_grid(spark):
    rng = np.random.default_rng(3)
    steps = np.repeat(np.arange(7.0), 20)  # seven levels: a grid of seven rows tells them apart
    for x, y in [(steps, (steps * 3) % 7 + rng.random(140) * 0.1), (rng.standard_normal(120), rng.standard_normal(120)), sets()["ties"]]:
        assert C.maximal_information(frame(spark, x, y), "x", "y").first()[0] == pytest.approx(mic(x, y), abs=1e-9)


def test_maximal_information_by_bins_is_near(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.random(600)
    y = np.sin(9 * x) + rng.standard_normal(600) * 0.1
    monkeypatch.setattr(C, "FINE", 256)
    assert C.maximal_information(frame(spark, x, y), "x", "y").first()[0] == pytest.approx(mic(x, y), abs=0.02)
