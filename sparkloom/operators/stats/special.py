"""Special functions and distributions on the driver, in plain Python (no SciPy)."""

from __future__ import annotations

import math

SQRT2 = math.sqrt(2.0)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / SQRT2)


def normal_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def erf_inv(y: float) -> float:
    """Newton steps on erf from a logarithmic start."""
    if not -1 < y < 1:
        return math.copysign(math.inf, y) if abs(y) == 1 else math.nan
    if y == 0:
        return 0.0
    a = 0.147
    ln = math.log(1 - y * y)
    t = 2 / (math.pi * a) + ln / 2
    x = math.copysign(math.sqrt(math.sqrt(t * t - ln / a) - t), y)
    for _ in range(4):
        err = math.erf(x) - y
        x -= err / (2 / math.sqrt(math.pi) * math.exp(-x * x) + x * err * 1e-300)
    return x


def normal_quantile(p: float) -> float:
    return SQRT2 * erf_inv(2 * p - 1)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def student_cdf(t: float, df: float) -> float:
    half = beta_i(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - half if t > 0 else half


def chi2_tail(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def f_tail(x: float, d1: float, d2: float) -> float:
    return 1 - beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 1.0


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def pdf(name: str, x: float, **p: float) -> float:
    """Density at x of normal, lognormal, exponential, gamma, beta and weibull."""
    if name == "normal":
        return normal_pdf((x - p["mu"]) / p["sigma"]) / p["sigma"]
    if name == "lognormal":
        return normal_pdf((math.log(x) - p["mu"]) / p["sigma"]) / (x * p["sigma"]) if x > 0 else 0.0
    if name == "exponential":
        return p["rate"] * math.exp(-p["rate"] * x) if x >= 0 else 0.0
    if name == "gamma":
        return math.exp((p["shape"] - 1) * math.log(x) - x / p["scale"] - math.lgamma(p["shape"]) - p["shape"] * math.log(p["scale"])) if x > 0 else 0.0
    if name == "beta":
        return math.exp(math.lgamma(p["a"] + p["b"]) - math.lgamma(p["a"]) - math.lgamma(p["b"]) + (p["a"] - 1) * math.log(x) + (p["b"] - 1) * math.log1p(-x)) if 0 < x < 1 else 0.0
    if name == "weibull":
        return p["shape"] / p["scale"] * (x / p["scale"]) ** (p["shape"] - 1) * math.exp(-((x / p["scale"]) ** p["shape"])) if x >= 0 else 0.0
    raise ValueError(f"unknown distribution {name}")


def cdf(name: str, x: float, **p: float) -> float:
    if name == "normal":
        return normal_cdf((x - p["mu"]) / p["sigma"])
    if name == "lognormal":
        return normal_cdf((math.log(x) - p["mu"]) / p["sigma"]) if x > 0 else 0.0
    if name == "exponential":
        return -math.expm1(-p["rate"] * x) if x > 0 else 0.0
    if name == "gamma":
        return gamma_p(p["shape"], x / p["scale"])
    if name == "beta":
        return beta_i(p["a"], p["b"], x)
    if name == "weibull":
        return -math.expm1(-((x / p["scale"]) ** p["shape"])) if x > 0 else 0.0
    if name == "uniform":
        return min(1.0, max(0.0, (x - p["low"]) / (p["high"] - p["low"])))
    raise ValueError(f"unknown distribution {name}")
