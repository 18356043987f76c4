"""Negative binomial with mean/dispersion parameters, as Spark columns.

With dispersion ``r`` and mean ``mu`` the success probability is ``r / (r + mu)``.  Invalid parameters
(``mu <= 0`` or ``r <= 0``) give NULL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ebbtide.session import ship_package

_SHIFT = 8
# Stirling series coefficients B(2k) / (2k (2k-1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def ln_gamma(x: Column) -> Column:
    """log Gamma for positive arguments: shift the argument up, then use the Stirling series."""
    y = x + _SHIFT
    rising = x
    for k in range(1, _SHIFT):
        rising = rising * (x + k)
    series = F.lit(0.0)
    for k, coefficient in enumerate(_STIRLING):
        series = series + F.lit(coefficient) / F.pow(y, F.lit(2 * k + 1))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * float(np.log(2 * np.pi))) + series - F.log(rising)


def nbinom_params(mu: Column, theta: Column) -> tuple[Column, Column]:
    """Dispersion and success probability; NULL where the distribution is not defined."""
    valid = (mu > 0) & (theta > 0)
    return F.when(valid, theta), F.when(valid, theta / (theta + mu))


def nbinom_pmf(k: Column, mu: Column, theta: Column) -> Column:
    r, p = nbinom_params(mu.cast("double"), theta.cast("double"))
    k = k.cast("double")
    log_pmf = ln_gamma(k + r) - ln_gamma(r) - ln_gamma(k + 1) + r * F.log(p) + k * F.log(1 - p)
    return F.exp(log_pmf)


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    y = x + _SHIFT
    rising = np.prod([x + k for k in range(_SHIFT)], axis=0)
    series = sum(c / y ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(rising)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (cost grows as sqrt(a + b)).

    Very large arguments, where the logarithms of gamma cancel, go through the normal approximation of the
    cube roots; NaN where the fraction does not converge.
    """
    large = (a + b > LARGE) & (np.minimum(a, b) > LARGE / 1000)
    if large.any():
        value = np.empty(x.shape)
        value[large] = _large_beta(a[large], b[large], x[large])
        value[~large] = incomplete_beta(a[~large], b[~large], x[~large])
        return value
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / _away_from_zero(1 - (a + b) * x / (a + 1), tiny)
    value = d.copy()
    step = 0
    active = np.ones(x.shape, dtype=bool)
    while active.any() and step < 100_000:
        step += 1
        even = step * (b - step) * x / ((a + 2 * step - 1) * (a + 2 * step))
        odd = -(a + step) * (a + b + step) * x / ((a + 2 * step) * (a + 2 * step + 1))
        change = np.ones_like(x)
        for term in (even, odd):
            d = 1 / _away_from_zero(1 + term * d, tiny)
            c = _away_from_zero(1 + term / c, tiny)
            change = change * c * d
        value = np.where(active, value * change, value)
        active = active & (np.abs(change - 1) > 1e-15)
    front = np.exp(a * np.log(x) + b * np.log1p(-x) + _ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b)) / a
    part = np.where(active, np.nan, front * value)
    return np.where(flip, 1 - part, part)


LARGE = 1e9


def _large_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    left, right = np.cbrt(b * x), np.cbrt(a * (1 - x))
    score = 3 * (left * (1 - 1 / (9 * b)) - right * (1 - 1 / (9 * a))) / np.sqrt(left**2 / b + right**2 / a)
    return np.array([0.5 * math.erfc(-s / math.sqrt(2)) for s in score])


def _away_from_zero(x: np.ndarray, tiny: float) -> np.ndarray:
    return np.where(np.abs(x) < tiny, tiny, x)


def _cdf_batches(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for k, r, p in batches:
        out = np.full(len(k), np.nan)
        ok = (k.notna() & r.notna() & p.notna()).to_numpy()
        if ok.any():
            counts, size, chance = (s.to_numpy(dtype=float)[ok] for s in (k, r, p))
            found = np.zeros(len(counts))
            reached = counts >= 0
            found[reached] = incomplete_beta(size[reached], np.floor(counts[reached]) + 1, chance[reached])
            out[ok] = found
        yield pd.Series(out).where(ok, None)


def nbinom_cdf(k: Column, mu: Column, theta: Column) -> Column:
    """P(X <= k), through the incomplete beta function so large counts cost no more than small ones."""
    r, p = nbinom_params(mu.cast("double"), theta.cast("double"))
    ship_package(SparkSession.active())
    return F.pandas_udf(_cdf_batches, "double")(k.cast("double"), r, p)
