"""Tail probabilities that Spark lacks, vectorised over Arrow batches of per-marker rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def t_two_tailed(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|), exact: the regularised incomplete beta I_x(df/2, 1/2) at x = df / (df + t^2).

    Lentz's continued fraction on whichever side converges.  NaN in, or df <= 0, gives NaN.
    """
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    if not ok.any():
        return out
    square, nu = t[ok] ** 2, df[ok]
    x = nu / (nu + square)
    a, b = nu / 2, np.full_like(nu, 0.5)
    log_beta = np.array([math.lgamma(p) + math.lgamma(0.5) - math.lgamma(p + 0.5) for p in a])
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + 0.5 * np.log(square / (nu + square)) - log_beta)
    swap = x >= (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, square / (nu + square), x)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for k in range(1, 400):
        even = k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k))
        odd = -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * (step := c * d)
        if np.all(np.abs(step - 1) < 1e-15):
            break
    tail = front * h / p
    out[ok] = np.clip(np.where(square == 0, 1.0, np.where(swap, 1 - tail, tail)), 0.0, 1.0)
    return out


def t_pvalue(t: Column, df: Column) -> Column:
    """The two-tailed p-value of ``t`` at ``df``; null stays null."""

    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        p = t_two_tailed(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan))
        return pd.Series(p).astype("Float64").mask(pd.isna(p))

    return F.pandas_udf(tail, "double")(t, df)


def chi_square_sf_1df(x: Column) -> Column:
    """erfc(sqrt(x / 2)); null stays null."""

    def tail(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else math.erfc(math.sqrt(max(v, 0.0) / 2)) for v in x], dtype="Float64")

    return F.pandas_udf(tail, "double")(x)
