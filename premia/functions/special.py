"""Distribution functions on NumPy arrays, for use inside Arrow-batched UDFs.

They run over aggregated rows (levels, bins, coefficients), never over raw records.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

# UDFs defined here carry their helpers with them, so workers need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
#: From this shape on the density is integrated in standard units, at one cost for every shape.
LARGE_SHAPE = 1000.0
_REACH = 12.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def _lgamma(x):
    """ln Gamma for positive arguments: Stirling's series, after shifting small ones up by 8."""
    x = np.asarray(x, float)
    small = x < 8
    shift = np.zeros_like(x)
    if small.any():
        low = x[small]
        product = np.ones_like(low)
        for k in range(8):
            product = product * (low + k)
        shift[small] = np.log(product)
    z = np.where(small, x + 8, x)
    inverse = 1 / (z * z)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def _standard_density(a, s):
    """Density at `s` of (Gamma(a) - a) / sqrt(a), for large `a`.

    The exponent is a * (m - log(1 + m)) with m = s / sqrt(a); near zero its power series avoids the cancellation.
    """
    m = s / np.sqrt(a)
    series = np.zeros_like(m)
    for k in range(12, 1, -1):
        series = 1 / k - m * series
    exponent = np.where(np.abs(m) < 0.02, m * m * series, m - np.log1p(m))
    return np.exp(-a * exponent - 1 / (12 * a) + 1 / (360 * a**3)) / ((1 + m) * math.sqrt(2 * math.pi))


def _large_cdf(a, x):
    """P(a, x) for large `a`: Gauss-Legendre over the nearer tail in standard units."""
    s = np.clip((x - a) / np.sqrt(a), -_REACH, _REACH)
    lower = s <= 0
    start, stop = np.where(lower, -_REACH, s), np.where(lower, s, _REACH)
    half = (stop - start) / 2
    points = start[:, None] + half[:, None] * (1 + _NODES)
    area = half * (_standard_density(a[:, None], points) @ _WEIGHTS)
    return np.where(lower, area, 1 - area)


def gamma_cdf(shape, x):
    """Regularised lower incomplete gamma P(shape, x): by series or continued fraction, for large shapes by quadrature."""
    a, x = np.broadcast_arrays(np.asarray(shape, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    large = (x > 0) & (a >= LARGE_SHAPE)
    if large.any():
        out[large] = _large_cdf(a[large], x[large])
    live = (x > 0) & (a > 0) & ~large
    if not live.any():
        return out
    av, xv = a[live], x[live]
    log_head = av * np.log(xv) - xv - _lgamma(av)
    low = xv < av + 1
    value = np.empty_like(av)
    if low.any():
        an, term, total = av[low].copy(), 1 / av[low], 1 / av[low]
        for _ in range(5000):
            an = an + 1
            term = term * xv[low] / an
            total = total + term
            if np.all(np.abs(term) <= np.abs(total) * 1e-16):
                break
        value[low] = total * np.exp(log_head[low])
    high = ~low
    if high.any():
        ah, xh = av[high], xv[high]
        b = xh + 1 - ah
        c = np.full_like(b, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, 5000):
            an = -i * (i - ah)
            b = b + 2
            d = an * d + b
            d = np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            d = 1 / d
            delta = d * c
            h = h * delta
            if np.all(np.abs(delta - 1) < 1e-15):
                break
        value[high] = 1 - np.exp(log_head[high]) * h
    out[live] = np.clip(value, 0.0, 1.0)
    return out


def normal_ppf(p: float) -> float:
    """Standard normal quantile by bisection on the error function."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _large_ppf(p: float, a):
    """Newton steps in standard units from the cube-root normal approximation."""
    root = np.sqrt(a)
    s = (a * (1 - 1 / (9 * a) + normal_ppf(p) / (3 * root)) ** 3 - a) / root
    for _ in range(8):
        s = s - (_large_cdf(a, a + s * root) - p) / np.maximum(_standard_density(a, s), _TINY)
    return a + s * root


def gamma_ppf(p: float, shape):
    """Quantile of a unit-scale Gamma, by bracketing and bisection (vectorised); by Newton for large shapes."""
    shape = np.asarray(shape, float)
    large = shape >= LARGE_SHAPE
    if large.any():
        out = np.empty_like(shape)
        out[large] = _large_ppf(p, shape[large])
        if not large.all():
            out[~large] = gamma_ppf(p, shape[~large])
        return out
    a = shape
    low = np.zeros_like(a)
    high = a + 10 * np.sqrt(a) + 20
    for _ in range(60):
        short = gamma_cdf(a, high) < p
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    for _ in range(100):
        mid = (low + high) / 2
        below = gamma_cdf(a, mid) < p
        low = np.where(below, mid, low)
        high = np.where(below, high, mid)
    return (low + high) / 2


def chi2_tail(statistic: float, df: int) -> float:
    """P(chi-squared with `df` degrees of freedom > statistic)."""
    return float(1.0 - gamma_cdf(np.array([df / 2.0]), np.array([statistic / 2.0]))[0])


def poisson_interval(confidence: float = 0.95):
    """UDF (claims, exposure) -> struct(low, high): the exact Garwood interval of a frequency."""

    @F.pandas_udf("low double, high double")
    def interval(claims: pd.Series, exposure: pd.Series) -> pd.DataFrame:
        n = claims.fillna(0).to_numpy(float)
        e = exposure.fillna(0).to_numpy(float)
        tail = (1 - confidence) / 2
        low = np.where(n > 0, gamma_ppf(tail, np.maximum(n, 1e-9)), 0.0)
        high = gamma_ppf(1 - tail, n + 1)
        positive = e > 0
        basis = np.where(positive, e, 1.0)
        return pd.DataFrame({"low": np.where(positive, low / basis, 0.0), "high": np.where(positive, high / basis, 0.0)})

    return interval


def gamma_mean_interval(confidence: float = 0.95):
    """UDF (amount, claims) -> struct(low, high) for a mean severity; null below two claims."""

    @F.pandas_udf("low double, high double")
    def interval(amount: pd.Series, claims: pd.Series) -> pd.DataFrame:
        n = claims.fillna(0).to_numpy(float)
        total = amount.fillna(0).to_numpy(float)
        usable = (n >= 2) & (total > 0)
        shape = np.where(usable, n, 2.0)
        scale = np.where(usable, total / np.where(usable, n * n, 1.0), 1.0)
        tail = (1 - confidence) / 2
        low = np.where(usable, gamma_ppf(tail, shape) * scale, np.nan)
        high = np.where(usable, gamma_ppf(1 - tail, shape) * scale, np.nan)
        return pd.DataFrame({"low": low, "high": high})

    return interval
