"""Tail probabilities of test statistics, the normal distribution of many values at once, and the Shapiro-Wilk test of a sample."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + t * d) or tiny)
            c = (1 + t / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series for small x, continued fraction for large."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    f = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_tail(d: float, n: float) -> float:
    """The chance of a distance of d or more between n values and their distribution, with Stephens' correction for few values."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0  # beyond the last digit
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """The normal distribution function of an array: a series of positive terms near 0, a continued fraction beyond. NaN stays NaN."""
    z = np.asarray(z, np.float64)
    x = np.abs(z)
    near = np.where(x < 4, x, 0.0)
    term = total = near
    for k in range(1, 90):
        term = term * near * near / (2 * k + 1)
        total = total + term
    inner = 0.5 - total * np.exp(-near * near / 2) / math.sqrt(2 * math.pi)  # upper tail
    far = np.where(x < 4, 4.0, np.minimum(x, 40.0))
    fraction = far
    for k in range(60, 0, -1):
        fraction = far + k / fraction
    upper = np.where(x < 4, inner, np.exp(-far * far / 2) / math.sqrt(2 * math.pi) / fraction)
    return np.where(np.isnan(z), np.nan, np.where(z > 0, 1 - upper, upper))


# The polynomials of Royston's approximation of the Shapiro-Wilk test (Applied Statistics 44, algorithm R94), lowest power first.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_GAMMA = [-2.273, 0.459]
SMALL_MEAN, SMALL_LOG_SD = [0.544, -0.39978, 0.025054, -6.714e-4], [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN, LARGE_LOG_SD = [-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302]


def shapiro_weights(n: int) -> np.ndarray:
    """The weights of the ordered sample: expected normal order statistics, scaled, with fitted outermost ones."""
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    size, u = math.sqrt(m @ m), 1 / math.sqrt(n)
    fitted = [np.polynomial.polynomial.polyval(u, LAST_WEIGHT) + m[-1] / size]
    if n > 5:
        fitted.append(np.polynomial.polynomial.polyval(u, NEXT_WEIGHT) + m[-2] / size)
    k = len(fitted)
    inner = m[k : n - k]
    out = m * math.sqrt((1 - 2 * sum(a * a for a in fitted)) / (inner @ inner))
    for i, a in enumerate(fitted):
        out[i], out[n - 1 - i] = -a, a
    return out


def shapiro_wilk(values: np.ndarray) -> tuple[float, float] | None:
    """(W, p) of 3 to 5000 values; none for fewer, for values without spread, or with one that is no number."""
    x = np.sort(np.asarray(values, np.float64))
    n = len(x)
    if not 3 <= n <= 5000 or not np.isfinite(x).all() or x[0] == x[-1]:
        return None
    x = (x - x.mean()) / (x[-1] - x[0])
    w = min(1.0, float((shapiro_weights(n) @ x) ** 2 / (x @ x)))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1:
        return w, 1.0
    poly, y = np.polynomial.polynomial.polyval, math.log(1 - w)
    if n <= 11:
        gamma = poly(n, SMALL_GAMMA)
        if y >= gamma:
            return w, 0.0
        y, mean, sd = -math.log(gamma - y), poly(n, SMALL_MEAN), math.exp(poly(n, SMALL_LOG_SD))
    else:
        mean, sd = poly(math.log(n), LARGE_MEAN), math.exp(poly(math.log(n), LARGE_LOG_SD))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))
