import inspect

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkassay.models import margins as MM
from sparkassay.models import safety as SM
from sparkassay.operators import metrics as M
from sparkassay.operators import selection as SEL
from sparkassay.operators import splits as SP
from sparkassay.plans import loops as L


@pytest.fixture(scope="module")
def designs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.random((120, 2)))]
    return spark.createDataFrame(rows, "gidx long, vec array<double>").withColumn("features", array_to_vector("vec")).cache()


@pytest.fixture(scope="module")
def labelled(designs):
    return designs.withColumn("label", (F.col("vec")[0] > 0.4).cast("int"))


def probabilities(df):
    p = np.array([r["p_unsafe"] for r in df.collect()])
    assert ((p >= 0) & (p <= 1)).all()
    return p


def test_forest_beats_the_prior(designs, labelled):
    train, calib = labelled.where("gidx % 3 <> 0"), labelled.where("gidx % 3 = 0")
    model, losses = SM.rf_safety(train, calib, [dict(trees=5, depth=1), dict(trees=15, depth=4)])
    probabilities(model.transform(designs))
    share = calib.agg(F.avg(1 - F.col("label")).alias("p")).first()["p"]
    prior = -(share * np.log(share) + (1 - share) * np.log(1 - share))
    assert min(v for _, v in losses) < prior


def test_single_class_gives_its_share(designs, labelled):
    model = SM.forest(labelled.where("label = 0"))
    assert model.name == "prior" and set(probabilities(model.transform(designs))) == {1.0}


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_is_monotone(designs, labelled, method):
    base = SM.forest(labelled, trees=10, depth=3)
    raw = {r["gidx"]: r["p_unsafe"] for r in base.transform(designs).collect()}
    cal = {r["gidx"]: r["p_unsafe"] for r in SM.calibrate(base, labelled, method).transform(designs).collect()}
    order = sorted(raw, key=raw.get)
    seq = [cal[g] for g in order]
    assert all(b >= a - 1e-9 for a, b in zip(seq, seq[1:]))


def test_ensemble_members(designs, labelled):
    model, members = SM.mlp_ensemble(labelled, 2, members=2, hidden=(4,), max_iter=30)
    probabilities(model.transform(designs))
    row = members(designs).first()
    assert row["p_unsafe"] == pytest.approx((row["member_0"] + row["member_1"]) / 2)


def test_one_leaf_is_the_weighted_sample(spark, designs):
    rows = spark.createDataFrame([(float(v), 1.0) for v in range(1, 11)], "margin double, weight double")
    train = rows.withColumn("features", array_to_vector(F.array(F.lit(0.0), F.lit(0.0))))
    qf = MM.quantile_forest(train, trees=1, min_leaf=10, depth=2)
    q = qf.quantiles(designs.limit(3), [0.0, 0.5, 0.95]).orderBy("gidx", "tau").collect()
    drawn = [r["y"] for r in qf.distribution(designs.limit(1)).orderBy("y").collect()]
    assert all(a["q"] <= b["q"] for a, b in zip(q[:3], q[1:3])) and q[0]["q"] == drawn[0]
    total = qf.distribution(designs).groupBy("gidx").agg(F.sum("w").alias("s"))
    assert total.where(F.abs(F.col("s") - 1) > 1e-9).isEmpty()


def test_leaf_share_equals_the_distribution(spark, designs):
    train = designs.withColumn("margin", F.col("vec")[0] * 4 - 1.5).withColumn("weight", F.lit(1.0))
    qf = MM.quantile_forest(train, trees=5, min_leaf=4, depth=4)
    a = qf.p_below(designs, 0.0)
    b = qf.distribution(designs).groupBy("gidx").agg(F.sum(F.when(F.col("y") < 0, F.col("w")).otherwise(0.0)).alias("p"))
    assert a.join(b, "gidx").where(F.abs(F.col("p_unsafe") - F.col("p")) > 1e-9).isEmpty()


def test_coverage_hits_the_target(spark):
    rng = np.random.default_rng(3)
    m = spark.createDataFrame([(int(i % 50), float(v)) for i, v in enumerate(rng.normal(1.0, 2.0, 4000))], "gidx long, margin double")
    pred = spark.range(50).select(F.col("id").alias("gidx"), F.lit(0.7).alias("mu"), F.lit(1.0).alias("var"))
    for family in ("gaussian", "student_t"):
        row = M.margin_coverage_calibration(pred, m, 0.9, family).first()
        assert row["coverage"] == pytest.approx(0.9, abs=1e-3) and row["bias"] == pytest.approx(0.3, abs=0.15)
    low = M.margin_coverage_calibration(pred.withColumn("var", F.lit(1e9)), m, 0.9).first()
    assert low["scale"] == 1e-3


def test_farthest_first_against_brute_force(spark, designs):
    picks = [r["gidx"] for r in SEL.farthest_first(designs, 25, seed=3, every=6).orderBy("rank").collect()]
    vec = {r["gidx"]: np.array(r["vec"]) for r in designs.collect()}
    assert len(set(picks)) == 25
    for i in range(1, 25):
        gap = lambda g: min(((vec[g] - vec[p]) ** 2).sum() for p in picks[:i])
        assert gap(picks[i]) == pytest.approx(max(gap(g) for g in vec))


def test_split_counts(spark):
    for n in (1, 2, 7, 10, 33):
        labels = spark.range(n).select(F.col("id").alias("gidx"), F.lit(1).alias("label"))
        out = {r["split"]: r["count"] for r in SP.stratified_split(labels, 0.25, 0.15, 1).groupBy("split").count().collect()}
        want = np.array([0.25 * n, 0.15 * n, 0.6 * n])
        counts = np.floor(want).astype(int)
        for i in np.argsort(-(want - counts), kind="stable")[: n - counts.sum()]:
            counts[i] += 1
        assert [out.get(s, 0) for s in SP.SPLITS] == list(counts)


def test_active_learning_grows_by_the_batch(spark, designs, labelled):
    trials = designs.select("gidx", F.explode(F.sequence(F.lit(0), F.lit(79))).alias("ord")).join(designs.select("gidx", "vec"), "gidx")
    start = labelled.where("gidx % 6 = 0").select("gidx", "label")
    new, tracker = L.active_learning_round(
        designs, start, trials, order=["ord"], unsafe=F.col("vec")[0] <= 0.4, cycles=2, batch=5, trees=5, depth=3
    )
    got = new.collect()
    assert len(got) == 10 == len({r["gidx"] for r in got}) and all(r["gidx"] % 6 for r in got)
    assert [r["cycle"] for r in tracker.orderBy("cycle").collect()] == [0, 1]


def test_proposals_are_unobserved(spark, designs):
    hist = designs.where("gidx < 8").select("gidx", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))
    assert L.parego_propose(designs, hist, objectives=["a", "b"], seed=1).first()["gidx"] >= 8
    more = designs.where("gidx < 30").select("gidx", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))
    row = L.parego_propose(designs, more, objectives=["a", "b"], seed=1, trees=5).first()
    assert row["gidx"] >= 30 and row["acq"] is not None


def test_t_distribution_is_symmetric(spark):
    from sparkassay.functions import violation as V

    row = spark.range(1).select(
        V.student_t_violation(F.lit(0.0), F.lit(2.0)).alias("t"), V.gaussian_violation(F.lit(0.0), F.lit(2.0)).alias("g"),
        (V.student_t_violation(F.lit(1.0), F.lit(2.0)) + V.student_t_violation(F.lit(-1.0), F.lit(2.0))).alias("s"),
    ).first()
    assert row["t"] == pytest.approx(0.5) and row["g"] == pytest.approx(0.5) and row["s"] == pytest.approx(1.0)


def test_tables_of_designs_are_not_broadcast(spark):
    from workloads import models as W

    for df in (W.training(spark, "/root/testdata/sf0.001"), W.margins_of(spark, "/root/testdata/sf0.001")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_designs_in_the_same_leaves_share_one_distribution(spark):
    from sparkassay.models import margins as MM

    rows = [(i, float(i % 4), float(j), 1.0) for i in range(400) for j in range(3)]
    train = SM.feature_vector(spark.createDataFrame(rows, "gidx long, x double, margin double, weight double"), ["x"])
    qf = MM.quantile_forest(train, trees=3, min_leaf=5, depth=3)
    designs = train.select("gidx", "features").distinct()
    routed = MM._routed(qf.model, designs, ["gidx"])
    assert qf._classes(routed).select("leaves").distinct().count() <= 4
    assert designs.count() == 400 == qf.p_below(designs, 0.5).count() == qf.quantiles(designs, [0.5]).count()
    shares = {r["gidx"]: r["s"] for r in qf.distribution(designs).groupBy("gidx").agg(F.sum("w").alias("s")).collect()}
    assert len(shares) == 400 and all(abs(s - 1) < 1e-9 for s in shares.values())


def test_poisson_draws_are_a_fold(spark):
    from math import exp

    from sparkassay.functions.seeds import hash_uniform

    count = SM._poisson_count(F.col("w"), F.lit("s"), F.col("id"))
    rows = spark.range(40).withColumn("w", (F.col("id") % 10) / 11.0)
    # written out, the sums of 24 terms took thousands of nodes for every row
    assert len(rows.select(count)._jdf.queryExecution().analyzed().toString()) < 5000
    for r in rows.select("w", count.alias("k"), hash_uniform(F.lit("s"), F.col("id"), F.lit(1)).alias("u")).collect():
        want, term = 0, exp(-r["w"])
        cum = term
        for k in range(1, 25):
            want, term = want + (r["u"] > cum), term * r["w"] / k
            cum += term
        assert r["k"] == want


def test_the_ensemble_query_fits_whole_networks(spark, monkeypatch):
    """Five networks of 128 and 64 units in 300 iterations, the reference's sizes."""
    from workloads import models as W

    seen, shape = [], inspect.signature(SM.mlp_ensemble)

    def record(*args, **named):
        call = shape.bind(*args, **named)
        call.apply_defaults()
        seen.append(call.arguments)
        return SM.prior_model({0: 1, 1: 1}), None

    monkeypatch.setattr(W.SM, "mlp_ensemble", record)
    W.mlp_ensemble(spark, "/root/testdata/sf0.001")
    assert [(x["members"], x["hidden"], x["max_iter"]) for x in seen] == [(5, (128, 64), 300)]
