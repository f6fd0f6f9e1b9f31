"""Distributions, percentiles and paired tests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_place(n: Column, q: float) -> Column:
    """The 0-based place of the index percentile: floor(n * q), the last at most. It never interpolates."""
    return F.least(n - 1, F.floor(n * F.lit(q)))


def sign_test(less: int, more: int) -> float:
    """Exact two-sided binomial p of ties-free signs."""
    n, k = less + more, min(less, more)
    if n == 0:
        return 1.0
    if n <= 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    # the same sum by the incomplete beta function: large integers cost their square
    return min(1.0, 2 * _beta(0.5, n - k, k + 1))


def student_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its distribution function."""

    def below(t: float) -> float:
        x = df / (df + t * t)
        half = 0.5 * _beta(x, df / 2, 0.5)
        return 1 - half if t >= 0 else half

    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(20_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)
