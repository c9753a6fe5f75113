"""Distribution functions applied to short columns of already aggregated numbers.

Inputs here are one row per series (or at most 5,000 values per tested group), so these are small
vectorised helpers; all the data volume is reduced by Spark before they run.
"""

from __future__ import annotations

import math
from itertools import count
from statistics import NormalDist

import numpy as np
import pandas as pd

_NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz iteration)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in count(1):
        if m > 10 * (1_000 + math.sqrt(max(a, b))):  # far beyond where the fraction settles
            raise ArithmeticError(f"the p-value for a={a}, b={b}, x={x} does not converge")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coefficient in (even, odd):
            d = 1.0 + coefficient * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + coefficient / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def regularized_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p_value(r: float, n: float) -> float:
    """Two-sided p-value of a correlation r over n points (Student t with n - 2 degrees)."""
    if n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    freedom = n - 2.0
    return regularized_beta(1.0 - r * r, freedom / 2.0, 0.5)


def correlation_p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p_value(float(a), float(b)) for a, b in zip(r, n)], dtype="float64")


def _polynomial(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


# The published approximation constants of the Shapiro-Wilk test (Royston 1995),
# lowest power first.
_WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_WEIGHT_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
_SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_SPREAD = (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W statistic and p-value for 4 <= n <= 5000 values; a constant sample gives (1, 1)."""
    x = np.sort(np.asarray(values, dtype="float64"))
    n = len(x)
    if x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total = float(m @ m)
    root = 1.0 / math.sqrt(n)
    weights = m / math.sqrt(total)
    last = weights[-1] + _polynomial(_WEIGHT_LAST, root)
    if n > 5:
        second = weights[-2] + _polynomial(_WEIGHT_SECOND, root)
        scale = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        weights = m / math.sqrt(scale)
        weights[[-2, 1]] = second, -second
    else:
        scale = (total - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        weights = m / math.sqrt(scale)
    weights[[-1, 0]] = last, -last
    centred = x - x.mean()
    w = min(float(weights @ centred) ** 2 / float(centred @ centred), 1.0)
    if w == 1.0:
        return 1.0, 1.0
    log_n = math.log(n)
    if n <= 11:
        limit = 0.459 * n - 2.273
        if math.log1p(-w) >= limit:
            return w, 0.0
        score = -math.log(limit - math.log1p(-w))
        mean, spread = _polynomial(_SMALL_MEAN, n), math.exp(_polynomial(_SMALL_SPREAD, n))
    else:
        score = math.log1p(-w)
        mean, spread = _polynomial(_LARGE_MEAN, log_n), math.exp(_polynomial(_LARGE_SPREAD, log_n))
    return w, 0.5 * math.erfc((score - mean) / spread / math.sqrt(2.0))
