"""Distribution functions for one-row-per-test results: incomplete beta, t and normal tails, Beta quantiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _fraction(a, b, x, terms: int = 300):
    """Continued fraction of the incomplete beta function, evaluated from the last term backwards."""
    value = np.zeros_like(x)
    for m in range(terms, 0, -1):
        k = m // 2
        if m % 2 == 0:
            d = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            d = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        value = d / (1 + value)
    return 1 / (1 + value)


def betainc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.clip(np.where(flip, 1 - x, x), 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    value = np.where(z <= 1e-300, 0.0, front * _fraction(p, q, z))
    return np.where(flip, 1 - value, value)


def beta_quantile(p, a, b):
    """Beta quantile by bisection; 60 halvings give full double precision on [0, 1]."""
    p, a, b = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float), np.asarray(b, float))
    lo, hi = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = betainc(a, b, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(betainc(df.to_numpy() / 2, 0.5, df.to_numpy() / (df.to_numpy() + t.to_numpy() ** 2)))


@F.pandas_udf(DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(_erfc(np.abs(z.to_numpy()) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def _beta_q(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(p.to_numpy(), a.to_numpy(), b.to_numpy()))


def t_p_value(t: Column, df: Column) -> Column:
    return _t_two_sided(t.cast("double"), df.cast("double"))


def normal_p_value(z: Column) -> Column:
    return _normal_two_sided(z.cast("double"))


def beta_ppf(p: float, a: Column, b: Column) -> Column:
    return _beta_q(F.lit(float(p)), a.cast("double"), b.cast("double"))
