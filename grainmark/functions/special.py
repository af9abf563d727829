"""Tail probabilities for the handful of statistics Spark hands back.

Textbook series and continued fractions; everything here works on single
numbers on the driver.
"""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of an array: a series near zero, a continued fraction beyond."""
    x = np.asarray(x, float)
    z = np.abs(x)
    near = z < 2.0
    small, large = np.where(near, z, 0.0), np.where(near, 2.0, z)
    term = small.copy()
    total = small.copy()
    for k in range(1, 60):  # erf as sum of 2^k x^(2k+1) / (1·3·…·(2k+1)), all terms positive
        term = term * 2 * small * small / (2 * k + 1)
        total += term
    series = 1 - 2 / math.sqrt(math.pi) * np.exp(-small * small) * total
    tail = np.zeros_like(large)
    for k in range(90, 0, -1):
        tail = k / 2 / (large + tail)
    fraction = np.exp(-large * large) / math.sqrt(math.pi) / (large + tail)
    out = np.where(near, series, fraction)
    return np.where(x < 0, 2 - out, out)


def _bisect(f, target: float, lo: float, hi: float) -> float:
    """Solve f(x) = target for increasing f."""
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if f(mid) < target:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def norm_ppf(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    return _bisect(norm_cdf, p, -40.0, 40.0)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * scale
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1.0 - scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 + step * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + step / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h / a


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 else 1.0 - gamma_p(df / 2.0, x / 2.0)


def chi2_ppf(p: float, df: float) -> float:
    return _bisect(lambda v: gamma_p(df / 2.0, v / 2.0), p, 0.0, 10.0 * df + 200.0)


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    if math.isinf(t):
        return 0.0
    return beta_i(df / 2.0, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    return _bisect(lambda v: 1.0 - 0.5 * t_sf2(v, df), p, 0.0, 1e6)


def t_isf(q: float, df: float) -> float:
    """Upper-tail quantile; keeps its precision for very small ``q``."""
    return _bisect(lambda v: -0.5 * t_sf2(v, df), -q, 0.0, 1e8)


def f_sf(x: float, d1: float, d2: float) -> float:
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    return beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * x))


def kolmogorov_sf(d: float, n: float) -> float:
    """Asymptotic tail of the one-sample Kolmogorov–Smirnov distance."""
    z = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if z < 0.2:
        return 1.0
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))
    return min(1.0, max(0.0, total))
