"""Distribution functions that Spark lacks, as plain Python and as Arrow UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()


def regularised_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - regularised_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + num * d, 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * out


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * regularised_beta(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    """By bisection on the distribution function, to the last bits of a double."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    low, high = 0.0, 1.0
    while t_cdf(high, df) < p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if mid in (low, high):
            break
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2.0


def chi2_sf(x: float, df: float) -> float:
    """Upper tail: a series below df + 1, a continued fraction above."""
    if x <= 0.0:
        return 1.0
    a, x = df / 2.0, x / 2.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    b, c = x + 1.0 - a, 1e300
    d = out = 1.0 / b
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        out *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * out


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided tail at one half: the smaller tail doubled, one at most."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    log_half, total = n * math.log(0.5), 0.0
    for i in range(k, -1, -1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + log_half)
    return min(1.0, 2.0 * total)


@F.pandas_udf(T.DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    return x.map(_NORMAL.cdf, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return p.map(_NORMAL.inv_cdf, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) if pd.notna(a) else None for a, b in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sign_test_p(a: pd.Series, b: pd.Series) -> pd.Series:
    """From the wins of both sides; ties are in neither.  Without wins there is no answer."""
    return pd.Series([binomial_two_sided(int(x), int(x + y)) if x + y else np.nan for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    memo: dict[tuple[float, float], float] = {}
    return pd.Series([memo.setdefault((x, d), t_ppf(x, d)) if pd.notna(d) and d >= 1 else None for x, d in zip(p, df, strict=True)], dtype="float64")


@F.pandas_udf(T.LongType())
def ulp_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many float32 values lie between two: order-preserving integers of their bits."""

    def key(x: pd.Series) -> np.ndarray:
        i = x.to_numpy(np.float32).view(np.int32).astype(np.int64)
        return np.where(i < 0, -(1 << 31) - i, i)

    return pd.Series(np.abs(key(a) - key(b)))
