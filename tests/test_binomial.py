import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkassay.functions import binomial as B
from sparkassay.operators import auditing as A


def cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("k,n,delta", [(1, 20, 0.05), (3, 50, 0.005), (10, 200, 0.025), (199, 200, 0.05), (40, 80, 0.1)])
def test_upper_bound_solves_its_equation(k, n, delta):
    u = float(B.beta_quantile(np.array([1 - delta]), np.array([k + 1.0]), np.array([n - k + 0.0]))[0])
    assert cdf(k, n, u) == pytest.approx(delta, rel=1e-9)


def test_published_audit_bound(spark):
    """n = 2117 clean trials are the fewest that pass the published audit."""
    df = spark.createDataFrame([("a", 2117, 0), ("b", 2116, 0), ("c", 10, 10), ("d", 0, 0)], "stage_id string, n long, k long")
    rows = {r["stage_id"]: r for r in A.audit_decision(df, F.lit(0.005), 0.05, 0.05).collect()}
    assert rows["a"]["cp_upper"] == pytest.approx(0.0024996186669342, abs=1e-12)
    assert rows["a"]["unsafe_bound"] == pytest.approx(0.04999237, abs=1e-7) and rows["a"]["passed"]
    assert rows["b"]["unsafe_bound"] == pytest.approx(0.0500160, abs=1e-6) and not rows["b"]["passed"]
    assert rows["c"]["cp_upper"] == 1.0 and rows["d"]["cp_upper"] == 1.0


def test_largest_passing_count_is_tight():
    for n, p, d in ((2117, 0.0025, 0.005), (500, 0.05, 0.05), (30, 0.5, 0.01)):
        k = B.passing_failures(n, p, d)
        assert k < 0 or cdf(k, n, p) <= d
        assert cdf(k + 1, n, p) > d


def test_bounds_grow_with_failures(spark):
    df = spark.range(0, 41).select(F.col("id").alias("k"), F.lit(40).cast("long").alias("n"))
    out = B.with_cp_lower(B.with_cp_upper(df, "k", "n", F.lit(0.05), "u"), "k", "n", F.lit(0.05), "l").orderBy("k").toPandas()
    assert out["u"].is_monotonic_increasing and out["l"].is_monotonic_increasing
    assert (out["l"] <= out["k"] / 40 + 1e-12).all() and (out["u"] >= out["k"] / 40 - 1e-12).all()


def test_clean_budget(spark):
    row = spark.range(1).select(B.zero_failure_budget(F.lit(0.05), F.lit(0.05)).alias("b")).first()
    assert row["b"] == 59
