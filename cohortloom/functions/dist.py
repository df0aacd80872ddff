"""Tail probabilities of the normal, chi-square, t and F distributions, and digamma, for small result tables.

Vectorized numpy inside pandas UDFs; inputs are one row per test, never the measurements themselves.
Formulas: continued fraction for the incomplete beta function, series and continued fraction for the
incomplete gamma function, and the asymptotic series for digamma.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-300


def log_gamma(x) -> np.ndarray:
    """Stirling series after shifting the argument past 10; absolute error below 1e-12 for positive x."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(10):
        low = z < 10
        shift = np.where(low, shift - np.log(np.where(low, np.maximum(z, TINY), 1.0)), shift)
        z = np.where(low, z + 1, z)
    inverse = 1 / z
    square = inverse * inverse
    tail = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    return shift + (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + tail


def digamma(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    total = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        low = z < 8
        total = np.where(low, total - 1 / np.where(low, z, 1.0), total)
        z = np.where(low, z + 1, z)
    s = 1 / (z * z)
    return total + np.log(z) - 0.5 / z - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))


def trigamma(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    total, z = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = z < 8
        total = np.where(low, total + 1 / np.where(low, z, 1.0) ** 2, total)
        z = np.where(low, z + 1, z)
    s = 1 / (z * z)
    return total + 1 / z + s / 2 + (s / z) * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s / 30)))


def normal_sf2(z) -> np.ndarray:
    """Two-sided normal tail: a chi-square tail of the square."""
    return chi2_sf(np.square(np.asarray(z, dtype=float)), 1.0)


def beta_inc(a, b, x) -> np.ndarray:
    """Regularized incomplete beta function."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, b, x)])
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    y = np.clip(y, 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    result = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - result, result)


def gamma_q(a, x) -> np.ndarray:
    """Regularized upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(np.maximum(x, TINY)) - x - log_gamma(a))
    term = 1 / a
    total = term.copy()
    for n in range(1, 2000):
        term = term * x / (a + n)
        total = total + term
        if np.all((term < total * 1e-16) | (x >= a + 1)):
            break
    low = 1 - front * total
    b = x + 1 - a
    c = np.full_like(b, 1 / TINY)
    d = 1 / np.where(np.abs(b) < TINY, TINY, b)
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < TINY, TINY, c)
        h = h * d * c
        if np.all((np.abs(d * c - 1) < 1e-15) | (x < a + 1)):
            break
    return np.where(x <= 0, 1.0, np.where(x < a + 1, low, front * h))


def chi2_sf(x, df) -> np.ndarray:
    return gamma_q(np.asarray(df, dtype=float) / 2, np.asarray(x, dtype=float) / 2)


def t_sf2(t, df) -> np.ndarray:
    """Two-sided t tail."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2) -> np.ndarray:
    f, d1, d2 = [np.asarray(v, dtype=float) for v in (f, d1, d2)]
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _over_known(function, *columns: pd.Series) -> pd.Series:
    """Apply to rows without a null; null elsewhere."""
    frame = pd.concat([c.astype(float) for c in columns], axis=1)
    known = frame.notna().all(axis=1).to_numpy()
    out = np.full(len(frame), np.nan)
    if known.any():
        out[known] = function(*[frame.iloc[:, i].to_numpy()[known] for i in range(frame.shape[1])])
    return pd.Series(out).where(pd.Series(known), None).astype("Float64")


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _over_known(chi2_sf, x, df)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _over_known(t_sf2, t, df)


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _over_known(f_sf, f, d1, d2)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _over_known(normal_sf2, z)


@F.pandas_udf(DoubleType())
def digamma_of(x: pd.Series) -> pd.Series:
    return _over_known(digamma, x)
