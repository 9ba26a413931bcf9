"""Tail probabilities for test statistics, applied to small aggregated results.

The regularised incomplete beta and gamma functions follow their textbook
continued fractions and series.  The ``*_col`` forms are Arrow UDFs: they only
ever see one row per test, never input rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(log_front) if log_front > -745 else 0.0
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t)) if math.isfinite(t) else 0.0


def f_upper(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_upper(x: float, k: float) -> float:
    """Upper tail of chi-square: regularised Q(k/2, x/2)."""
    a, y = k / 2.0, x / 2.0
    if y <= 0:
        return 1.0
    log_front = a * math.log(y) - y - math.lgamma(a)
    if y < a + 1.0:
        term = s = 1.0 / a
        for n in range(1, 2000):
            term *= y / (a + n)
            s += term
            if term < s * 1e-16:
                break
        return 1.0 - s * math.exp(log_front)
    b, c = y + 1.0 - a, 1.0 / _TINY
    d = 1.0 / b
    h = d
    for n in range(1, 2000):
        an = -n * (n - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h * math.exp(log_front)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def _pairwise(fn, *series: pd.Series) -> pd.Series:
    return pd.Series([fn(*(float(v) for v in row)) for row in zip(*series)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_two_sided_col(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _pairwise(t_two_sided, t, dof)


@F.pandas_udf(DoubleType())
def f_upper_col(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _pairwise(f_upper, f, d1, d2)


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation coefficient by its t statistic."""
    dof = n.cast("double") - 2.0
    return t_two_sided_col(pearson_t(r, n), dof)


def pearson_t(r: Column, n: Column) -> Column:
    dof = n.cast("double") - 2.0
    return r * F.sqrt(dof / F.greatest(1.0 - r * r, F.lit(1e-300)))


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 60) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value (limiting series)."""
    lam = F.sqrt(F.try_divide(n1.cast("double") * n2, n1 + n2)) * d
    ks = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(
        ks, F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    # below 0.2 the series converges slowly and the probability is one to 12 digits
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))
