"""Exact binomial bounds. Closed forms stay in Catalyst; the inversion runs on distinct counts only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_binom_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p); for scalar parameters of a plan only."""
    if p <= 0.0 or k >= n:
        return 0.0
    if p >= 1.0:
        return -math.inf
    i = np.arange(k + 1, dtype=float)
    steps = np.log((n - i[:-1]) / (i[1:])) if k else np.zeros(0)
    coeff = np.concatenate([[0.0], np.cumsum(steps)])
    terms = coeff + i * math.log(p) + (n - i) * math.log1p(-p)
    top = float(terms.max())
    return top + math.log(float(np.exp(terms - top).sum()))


def passing_failures(n: int, target: float, delta: float) -> int:
    """Largest k whose upper bound stays at or below ``target``; -1 if even k = 0 does not.

    ``upper(k) <= p`` holds exactly when ``P(X <= k; n, p) <= delta``, so no inversion is needed.
    """
    lo, hi = -1, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if log_binom_cdf(mid, n, target) <= math.log(delta):
            lo = mid
        else:
            hi = mid
    return lo


def zero_failure_budget(p: Column, delta: Column) -> Column:
    """Clean trials needed before zero failures prove a rate below p."""
    return F.ceil(F.ln(delta) / F.log1p(-p)).cast("bigint")


def _beta_cf(a, b, x):
    """Continued fraction of the regularised incomplete beta function (vectorised Lentz steps)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for coef in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + coef / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            return h
    if np.any(np.abs(d * c - 1.0) > 1e-9):
        raise ArithmeticError("the continued fraction of the beta function has not converged")
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(a, b, x):
    """Regularised incomplete beta I_x(a, b) on arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner)
    )
    low = inner < (a + 1.0) / (a + b + 2.0)
    out = np.where(
        low,
        front * _beta_cf(a, b, np.where(low, inner, 0.5 * (a + 1.0) / (a + b + 2.0))) / a,
        1.0 - front * _beta_cf(b, a, np.where(low, 0.5 * (b + 1.0) / (a + b + 2.0), 1.0 - inner)) / b,
    )
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, out))


def beta_quantile(q, a, b):
    """Inverse of ``beta_cdf`` in x by halving."""
    lo, hi = np.zeros_like(a, dtype=float), np.ones_like(a, dtype=float)
    for _ in range(80):
        mid = 0.5 * (lo + hi)
        below = beta_cdf(a, b, mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return hi


@F.pandas_udf(T.DoubleType())
def _upper_udf(k: pd.Series, n: pd.Series, delta: pd.Series) -> pd.Series:
    kk, nn = k.to_numpy(dtype=float), n.to_numpy(dtype=float)
    inside = kk < nn
    return pd.Series(
        np.where(
            inside,
            beta_quantile(1.0 - delta.to_numpy(dtype=float), kk + 1.0, np.where(inside, nn - kk, 1.0)),
            1.0,
        )
    )


def closed_upper(k: Column, n: Column, delta: Column) -> Column:
    """The cases that need no inversion; NULL otherwise."""
    return F.when((n == 0) | (k >= n), F.lit(1.0)).when(k == 0, -F.expm1(F.ln(delta) / n))


def with_cp_upper(df: DataFrame, k: str, n: str, delta: Column, out: str) -> DataFrame:
    """Add the one-sided exact upper bound.

    The inversion runs once per distinct (k, n, delta); the result is joined back on those counts,
    so its cost follows the number of different outcomes and not the number of rows.
    """
    base = df.withColumn("_d", delta.cast("double"))
    need = base.where((F.col(n) > 0) & (F.col(k) > 0) & (F.col(k) < F.col(n)))
    solved = (
        need.select(F.col(k).alias("_k"), F.col(n).alias("_n"), F.col("_d").alias("_dd"))
        .distinct()
        .withColumn("_u", _upper_udf("_k", "_n", "_dd"))
    )
    return (
        base.join(
            solved,
            (base[k] == solved["_k"]) & (base[n] == solved["_n"]) & (base["_d"] == solved["_dd"]),
            "left",
        )
        .withColumn(out, F.coalesce(closed_upper(F.col(k), F.col(n), F.col("_d")), F.col("_u")))
        .drop("_k", "_n", "_dd", "_u", "_d")
    )


def with_cp_lower(df: DataFrame, k: str, n: str, delta: Column, out: str) -> DataFrame:
    """One-sided exact lower bound: 1 - upper(n - k)."""
    mirrored = df.withColumn("_miss", F.col(n) - F.col(k))
    return (
        with_cp_upper(mirrored, "_miss", n, delta, "_up")
        .withColumn(out, F.when(F.col(k) == 0, F.lit(0.0)).otherwise(1.0 - F.col("_up")))
        .drop("_miss", "_up")
    )
