"""Distribution functions for p-values, used on small result tables (one row per test)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _each(fn, x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([fn(v) for v in x.ravel()]).reshape(x.shape)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def normal_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2.0))


def _beta_fraction(a, b, x, steps: int = 500):
    """Modified Lentz evaluation of the continued fraction of the incomplete beta."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + num / np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.nanmax(np.abs(d * c - 1.0), initial=0.0) < 1e-15:
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        aa, bb, xx = a[mid], b[mid], x[mid]
        swap = xx > (aa + 1.0) / (aa + bb + 2.0)
        p, q, z = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1.0 - xx, xx)
        front = np.exp(p * np.log(z) + q * np.log1p(-z)
                       - (_lgamma(p) + _lgamma(q) - _lgamma(p + q))) / p
        val = front * _beta_fraction(p, q, z)
        out[mid] = np.where(swap, 1.0 - val, val)
    return out


def gammainc_upper(s, x):
    """Regularised upper incomplete gamma function."""
    s, x = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (s, x)))
    out = np.full(x.shape, np.nan)
    for i in np.ndindex(x.shape):
        a, z = s[i], x[i]
        if not (np.isfinite(a) and np.isfinite(z)) or a <= 0:
            continue
        if z <= 0:
            out[i] = 1.0
            continue
        scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
        if z < a + 1.0:
            term = total = 1.0 / a
            n = a
            while abs(term) > abs(total) * 1e-16:
                n += 1.0
                term *= z / n
                total += term
            out[i] = 1.0 - total * scale
        else:
            b = z + 1.0 - a
            c, d = 1.0 / _TINY, 1.0 / b
            h = d
            for k in range(1, 10000):
                an = -k * (k - a)
                b += 2.0
                d = an * d + b
                d = 1.0 / (d if abs(d) > _TINY else _TINY)
                c = b + an / c
                c = c if abs(c) > _TINY else _TINY
                step = d * c
                h *= step
                if abs(step - 1.0) < 1e-16:
                    break
            out[i] = scale * h
    return out


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper(x, df):
    return gammainc_upper(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


def studentized_range_upper(q, k, df):
    """Upper tail of the studentised range, by two nested quadratures."""
    zs, zw = np.polynomial.legendre.leggauss(96)
    ss, sw = np.polynomial.legendre.leggauss(64)
    zs, zw = 8.0 * zs, 8.0 * zw
    phi = np.exp(-0.5 * zs * zs) / math.sqrt(2.0 * math.pi)
    out = []
    for qi, ki, di in np.broadcast(q, k, df):
        if not all(map(np.isfinite, (qi, ki, di))):
            out.append(np.nan)
            continue
        width = 8.0 / math.sqrt(2.0 * di)
        lo, hi = max(1e-8, 1.0 - width), 1.0 + width
        s = 0.5 * (hi - lo) * ss + 0.5 * (hi + lo)
        logf = (math.log(2.0) + 0.5 * di * math.log(0.5 * di) - math.lgamma(0.5 * di)
                + (di - 1.0) * np.log(s) - 0.5 * di * s * s)
        w = np.exp(logf) * sw * 0.5 * (hi - lo)
        spread = normal_cdf(zs[None, :] + qi * s[:, None]) - normal_cdf(zs)[None, :]
        inner = (ki * phi[None, :] * spread ** (ki - 1.0) * zw[None, :]).sum(axis=1)
        out.append(float(min(1.0, max(0.0, 1.0 - (w * inner).sum()))))
    return np.array(out)


@F.pandas_udf(DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df))


@F.pandas_udf(DoubleType())
def f_upper_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f, d1, d2))


@F.pandas_udf(DoubleType())
def chi2_upper_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x, df))


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return pd.Series(_erfc(np.abs(z.to_numpy(float)) / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def studentized_range_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(studentized_range_upper(q.to_numpy(float), k.to_numpy(float), df.to_numpy(float)))
