import math

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import draws as DR
from sparkassay.functions import gates as G
from sparkassay.operators import estimators as E
from sparkassay.operators import families as FM
from sparkassay.operators import reconcile as R

SCHEMA = "job string, log_weight double, failure boolean, sampling_component string"


def is_row(spark, rows, **k):
    return E.is_estimate(spark.createDataFrame(rows, SCHEMA), ["job"], "failure", **k).first()


def test_small_sample_by_hand(spark):
    w = [0.5, 2.0, 1.0, 0.0]
    rows = [("a", math.log(x) if x else -math.inf, h, "s") for x, h in zip(w, (True, False, True, True))]
    r = is_row(spark, rows)
    y = [0.5, 0.0, 1.0, 0.0]
    m = sum(y) / 4
    se = math.sqrt(sum((v - m) ** 2 for v in y) / 3 / 4)
    assert (r["n"], r["hits"]) == (4, 3)
    assert r["estimate"] == pytest.approx(m) and r["se"] == pytest.approx(se)
    assert r["hit_ess"] == pytest.approx(1.5**2 / 1.25) and r["snis"] == pytest.approx(1.5 / 3.5)
    assert r["ci_lo"] == pytest.approx(m * math.exp(-1.959963984540054 * se / m))
    assert r["ci_hi"] == pytest.approx(min(1.0, m * math.exp(1.959963984540054 * se / m)))


def test_extreme_weights_do_not_overflow(spark):
    rows = [("a", lw, True, "s") for lw in (-2000.0, -2001.0, -1990.0)] + [("b", 5000.0, True, "s"), ("b", -math.inf, True, "s")]
    out = {r["job"]: r for r in E.is_estimate(spark.createDataFrame(rows, SCHEMA), ["job"], "failure").collect()}
    log_est = -1990.0 + math.log((1 + math.exp(-10) + math.exp(-11)) / 3)
    assert out["a"]["log_estimate"] == pytest.approx(log_est) and out["a"]["estimate"] == 0.0
    assert out["b"]["estimate"] is None and out["b"]["log_estimate"] == pytest.approx(5000.0 + math.log(0.5))
    assert out["b"]["ess"] == pytest.approx(1.0)


def test_no_hits_and_no_weight(spark):
    r = is_row(spark, [("a", 0.0, False, "s"), ("a", 0.3, False, "s")])
    assert (r["estimate"], r["ci_lo"], r["ci_hi"], r["rse"]) == (0.0, 0.0, None, None)
    r = is_row(spark, [("a", -math.inf, True, "s"), ("a", -math.inf, True, "s")])
    assert (r["estimate"], r["hits"], r["ess"], r["snis"], r["max_norm_w"]) == (0.0, 2, 0.0, None, None)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_a_bad_weight_leaves_no_estimate(spark, bad):
    rows = [("a", True, 0.0, "x"), ("a", False, bad, "x"), ("a", True, 0.0, "y"), ("a", True, 0.0, "y")]
    rows += [("b", True, 0.0, "x"), ("b", False, float("-inf"), "x"), ("b", True, 0.0, "y"), ("b", True, 0.0, "y")]
    df = spark.createDataFrame(rows, "job string, failure boolean, log_weight double, sampling_component string")
    one = {r["job"]: r for r in E.is_estimate(df, ["job"], "failure").collect()}
    assert one["a"]["estimate"] is None and one["a"]["ess"] is None and abs(one["b"]["estimate"] - 0.75) < 1e-12
    two = {r["job"]: r for r in E.stratified_estimate(df, ["job"], "sampling_component", "failure", "failure").collect()}
    assert two["a"]["estimate"] is None and two["b"]["estimate"] is not None
    three = {r["job"]: r for r in E.weight_diagnostics(df, ["job"]).collect()}
    assert three["a"]["ess"] is None and three["b"]["n"] == 4


def test_invalid_weights_are_reported(spark):
    rows = [("a", x, True, "s") for x in (0.0, math.nan, math.inf, -math.inf)] + [("a", None, True, "s")]
    assert E.invalid_weights(spark.createDataFrame(rows, SCHEMA)).count() == 3


def test_strata(spark):
    rows = [("a", 0.0, h, s) for s, hs in (("x", (True, False, True)), ("y", (False, True))) for h in hs]
    r = E.stratified_estimate(spark.createDataFrame(rows, SCHEMA), ["job"], "sampling_component", "failure", "failure").first()
    var = (3 * (1 / 3) + 2 * 0.5) / 25
    assert r["estimate"] == pytest.approx(0.6) and r["se"] == pytest.approx(math.sqrt(var))
    assert r["strata"] == {"x": 3, "y": 2}
    lone = E.stratified_estimate(spark.createDataFrame(rows[:4], SCHEMA), ["job"], "sampling_component", "failure", "failure").first()
    assert lone["bad_strata"] == 1 and lone["estimate"] is None


def test_severity_equals_single_estimates(spark):
    rows = [("a", 0.1 * i - 0.4, float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "job string, log_weight double, d double")
    curve = {r["threshold"]: r for r in E.severity_curve(df, ["job"], F.col("d"), [-1.0, 0.0, 2.0, 9.0]).collect()}
    for t in (-1.0, 0.0, 2.0, 9.0):
        one = E.is_estimate(df, ["job"], F.col("d") <= t).first()
        for c in ("hits", "estimate", "se", "hit_ess", "ci_lo", "ci_hi"):
            assert curve[t][c] == (pytest.approx(one[c], abs=1e-12) if one[c] is not None else None), (t, c)


def test_family_cuts(spark):
    rows = [(True, 3000.0, 10.0), (True, 2990.0, 201.0), (True, 2990.0, 200.0), (True, None, 1.0), (True, 5.0, None), (False, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "failure boolean, first_detection_ms double, first_external_message_age_ms double")
    late, stale, fresh = FM.FAMILIES
    assert [r[0] for r in df.select(FM.failure_family()).collect()] == [late, stale, fresh, late, stale, None]


def test_gates_read_zero_as_missing(spark):
    """A relative error of exactly zero fails the weighted gate, as a missing one does."""
    row = spark.createDataFrame([("iid_is", 30, 25.0, 0.1, 0.0)], "s string, n int, e double, c double, r double")
    status, names = G.precision_status(*[F.col(c) for c in "snecr".replace("n", "n")])
    got = row.select(status.alias("st"), names.alias("g")).first()
    assert got["st"] == "imprecise_exploratory" and got["g"] == ["maximum_relative_standard_error"]
    nominal = spark.createDataFrame([("nominal_mc", 30, None, None, None)], "s string, n int, e double, c double, r double")
    assert nominal.select(status.alias("st")).first()["st"] == "mc_exact_but_imprecise"
    none = spark.createDataFrame([("iid_is", 0, 0.0, None, None)], "s string, n int, e double, c double, r double")
    got = none.select(status.alias("st"), names.alias("g")).first()
    assert got["st"] == "not_observed" and got["g"] is None


@pytest.mark.parametrize("lr,alpha", [(0.0, 0.1), (3.0, 0.2), (-50.0, 0.5), (900.0, 0.1)])
def test_defensive_weight_is_bounded(spark, lr, alpha):
    w = spark.range(1).select(DR.defensive_mixture_weight(F.lit(lr), alpha).alias("w")).first()["w"]
    assert w <= -math.log(alpha) + 1e-12
    if abs(lr) < 100:
        assert w == pytest.approx(-math.log(alpha + (1 - alpha) * math.exp(-lr)))


def test_mixture_edges(spark):
    get = lambda a, b: spark.range(1).select(
        DR.finite_mixture_weight(F.create_map(F.lit("a"), F.lit(a), F.lit("b"), F.lit(b)), {"a": 0.5, "b": 0.5}).alias("w")
    ).first()["w"]
    inf = math.inf
    assert get(0.0, 0.0) == pytest.approx(0.0) and get(-inf, 1.0) == -inf and get(inf, inf) == inf
    assert get(math.nan, 1.0) is None and get(inf, 0.0) == pytest.approx(math.log(2))
    with pytest.raises(ValueError):
        DR.finite_mixture_weight(F.lit(None), {"a": 0.5})


def test_comparison_of_numbers(spark):
    rows = [(1.0, 1.0 + 1e-13, True), (1.0, 1.0 + 1e-9, False), (None, None, True), (None, 1.0, False), (math.nan, math.nan, False), (0.0, 1e-26, True)]
    df = spark.createDataFrame(rows, "a double, b double, ok boolean")
    assert df.where(R.same_number(F.col("a"), F.col("b")) != F.col("ok")).isEmpty()


def test_a_figure_at_its_limit_passes_in_any_order(spark):
    schema = "e double, m double, l double, n long, k long, r double"
    up, down = 1 + 1e-13, 1 - 1e-13  # what the order of a sum may leave
    rows = [(0.8 * down, 0.006 * up, 0.12 * up, 1000, 10, 0.2 * up), (0.79, 0.0061, -0.13, 1000, 9, 0.21)]
    df = spark.createDataFrame(rows, schema).orderBy(F.desc("e"))
    quality = G.weight_quality(F.col("e"), F.col("m"), F.col("l"), min_ess_ratio=0.8, max_weight=0.006, max_log_mean=0.12)
    args = [F.col("n"), F.col("k"), F.col("r")]
    _, proposal = G.proposal_validation(quality, *args, final_n=1000, min_failures=10, max_projected=0.2)
    final = G.final_estimate(
        quality, F.col("k"), F.col("e") * 10, F.col("r"), F.lit(0.1), F.lit(0.2), min_failures=10, min_ess=8.0, max_rse=0.2
    )
    got = df.select(F.size(quality), F.size(proposal), F.size(final)).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (3, 5, 6)]
