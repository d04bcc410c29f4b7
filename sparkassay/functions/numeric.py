"""Finite-number guards, safe exponentials and exact rounding helpers as Catalyst expressions."""

from __future__ import annotations

import sys
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_MAX = log(sys.float_info.max)
LOG_MIN = log(sys.float_info.min)
INF = float("inf")


def lit_inf(sign: int = 1) -> Column:
    return F.lit(INF if sign > 0 else -INF)


def is_finite(x: Column) -> Column:
    """False for NULL, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < lit_inf()), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x)


def safe_exp(x: Column) -> Column:
    """exp with 0 for -inf and subnormal results, NULL for overflow, NaN and +inf."""
    return F.when(x == lit_inf(-1), F.lit(0.0)).when(
        is_finite(x) & (x <= LOG_MAX), F.when(x < LOG_MIN, F.lit(0.0)).otherwise(F.exp(x))
    )


def ratio(num: Column, den: Column) -> Column:
    """NULL where the denominator is zero or missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def number_key(x: Column) -> Column:
    """Canonical text of a number, so that 0.20 and 0.2 (and -0.0 and 0) meet in an equi-join."""
    return F.when(x == 0, F.lit("0")).otherwise(x.cast("double").cast("string"))
