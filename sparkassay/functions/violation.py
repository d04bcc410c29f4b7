"""P(margin < 0) under a predicted Gaussian or Student-t margin."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binomial import beta_cdf

EPS = 1e-12
_erfc = np.vectorize(math.erfc, otypes=[float])


@F.pandas_udf(T.DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(0.5 * _erfc(-z.to_numpy(dtype=float) / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def _t_cdf(x: pd.Series, df: pd.Series) -> pd.Series:
    v, d = x.to_numpy(dtype=float), df.to_numpy(dtype=float)
    tail = 0.5 * beta_cdf(d / 2.0, np.full_like(d, 0.5), d / (d + v * v))
    return pd.Series(np.where(v > 0, 1.0 - tail, tail))


def gaussian_violation(mu: Column, var: Column, bias: float = 0.0, scale: float = 1.0) -> Column:
    return _normal_cdf(-(mu + bias) / F.sqrt(var * scale + EPS))


def student_t_violation(mu: Column, var: Column, df: float = 5.0, bias: float = 0.0, scale: float = 1.0) -> Column:
    """``var`` is the wanted variance; the t scale parameter is derived from it (df > 2)."""
    if df <= 2.0:
        raise ValueError("a finite variance needs df > 2")
    width = F.sqrt(F.greatest(F.lit(0.0), var * scale) * ((df - 2.0) / df) + EPS)
    return _t_cdf(-(mu + bias) / width, F.lit(float(df)))
