"""Tail probabilities of the usual distributions, on numpy arrays and as columns of small tables of results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function at positive arguments."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(8):
        low = x < 8
        out -= np.where(low, 1 / x, 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if not (a > 0 and b > 0) or x != x:
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """Regularised, the upper tail."""
    if not a > 0 or x != x:
        return math.nan
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for n in range(1, 10_000):
        b += 2
        d = 1 / (-n * (n - a) * d + b)
        c = b - n * (n - a) / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return math.nan if f != f else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(f, 0.0)))


def chi2_upper(x: float, df: float) -> float:
    return upper_gamma(df / 2, x / 2)


def z_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


_OF = {"t": t_two_sided, "f": f_upper, "chi2": chi2_upper, "z": z_two_sided}


def p_value(kind: str, *args: Column) -> Column:
    """The tail probability of a statistic (t and z two-sided, f and chi2 upper) with its degrees of freedom; null where any of them is. For tables of results, one row a test."""
    of = _OF[kind]

    def tail(*xs: pd.Series) -> pd.Series:
        rows = np.column_stack([x.to_numpy(float, na_value=np.nan) for x in xs])
        return pd.Series([math.nan if np.isnan(r).any() else of(*r) for r in rows], dtype="float64")

    return F.nanvl(F.pandas_udf(tail, "double")(*[a.cast("double") for a in args]), F.lit(None).cast("double"))
