"""Model queries: parts are designs, their stored lineitem rows the trials."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkassay.models import margins as MM
from sparkassay.models import safety as SM
from sparkassay.operators import aggregates as A
from sparkassay.operators import auditing as AU
from sparkassay.operators import splits as SP
from sparkassay.plans import jobs as J
from sparkassay.plans import loops as L
from sparkassay.session import durable, keyed

from .adapters import EP_ORDER, EP_ORDER_SQL, EP_SQL, by_part, episodes, table
from .audit import RES_SQL, results
from .rare import CUTS, MODE_OUT, MODE_ROUND, MODE_SQL, job_rows, jobs, rounded
from .registry import query

COLS = ["p_size", "p_retailprice", "brand"]


def designs(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("gidx"),
        F.col("p_size").cast("double").alias("p_size"),
        "p_retailprice",
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("double").alias("brand"),
    )
    return SM.feature_vector(p, COLS)


def margins_of(spark, sf):
    """Margins with a signal: large parts are less safe."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gidx"), "l_quantity")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("gidx"), "p_size")
    return li.join(keyed(p), "gidx").select("gidx", ((F.col("l_quantity") - F.col("p_size")) / 10 + 1).alias("margin"))


def labels(spark, sf):
    return margins_of(spark, sf).groupBy("gidx").agg((F.avg("margin") >= 0.8).cast("int").alias("label"))


def parts(spark, sf):
    """(train, calib) with features and labels."""
    sp = SP.stratified_split(labels(spark, sf), 0.3, 0.0, 13)
    d = durable(designs(spark, sf).join(keyed(sp), "gidx"))  # every fit and score reads it
    return d.where("split = 'train'"), d.where("split = 'calib'")


@query(
    "feature_vector",
    """SELECT p_partkey AS gidx, p_size::DOUBLE AS f0, p_retailprice AS f1, regexp_extract(p_brand, '(\\d+)', 1)::DOUBLE AS f2 FROM part""",
)
def feature_vector(spark, sf):
    v = vector_to_array("features")
    return designs(spark, sf).select("gidx", *[v[i].alias(f"f{i}") for i in range(len(COLS))])


@query("rf_safety")
def rf_safety(spark, sf):
    train, calib = parts(spark, sf)
    model, _ = SM.rf_safety(train, calib, [dict(trees=20, depth=4), dict(trees=20, depth=6, min_leaf=3)])
    return model.transform(designs(spark, sf))


@query("prob_calibration")
def prob_calibration(spark, sf):
    train, calib = parts(spark, sf)
    base = SM.forest(train, trees=20, depth=5)
    iso = SM.calibrate(base, calib, "isotonic").transform(designs(spark, sf)).withColumnRenamed("p_unsafe", "p_isotonic")
    sig = SM.calibrate(base, calib, "sigmoid").transform(designs(spark, sf)).withColumnRenamed("p_unsafe", "p_sigmoid")
    return iso.join(keyed(sig), "gidx")


@query("mlp_ensemble")
def mlp_ensemble(spark, sf):
    train, _ = parts(spark, sf)
    model, _ = SM.mlp_ensemble(train, len(COLS))
    return model.transform(designs(spark, sf))


def training(spark, sf):
    m = margins_of(spark, sf)
    rows = m.join(keyed(m.groupBy("gidx").agg((1.0 / F.count(F.lit(1))).alias("weight"))), "gidx")
    return rows.join(keyed(designs(spark, sf).select("gidx", "features")), "gidx")


def margin_forest(spark, sf):
    return MM.quantile_forest(training(spark, sf), trees=10, min_leaf=20, depth=6)


TAUS = [0.05, 0.25, 0.5, 0.75]


@query("quantile_forest")
def quantile_forest(spark, sf):
    return margin_forest(spark, sf).quantiles(designs(spark, sf), TAUS)


@query("quantile_calibrated_predict")
def quantile_calibrated_predict(spark, sf):
    from sparkassay.operators.metrics import quantile_deltas

    qf = margin_forest(spark, sf)
    q = durable(qf.quantiles(designs(spark, sf), TAUS))  # read by every pass of the deltas
    pairs = margins_of(spark, sf).join(keyed(q), "gidx").select(F.col("tau").alias("q"), F.col("q").alias("pred"), F.col("margin").alias("y"))
    deltas = {r["q"]: r["delta"] for r in quantile_deltas(pairs).collect()}
    return MM.quantile_calibrated_predict(q, deltas, TAUS)


@query("risk_isotonic")
def risk_isotonic(spark, sf):
    raw = margin_forest(spark, sf).p_below(designs(spark, sf))
    cal = MM.risk_isotonic(raw, margins_of(spark, sf))
    return raw.withColumn("p_calibrated", cal(F.col("p_unsafe")))


@query("hetero_margin_model")
def hetero_margin_model(spark, sf):
    d = designs(spark, sf).select("gidx", "features")
    stats = A.margin_stats(margins_of(spark, sf)).join(keyed(d), "gidx")
    sp = durable(SP.stratified_split(labels(spark, sf), 0.3, 0.0, 13))
    train, calib = (keyed(sp.where(F.col("split") == s).select("gidx")) for s in ("train", "calib"))
    model = MM.hetero_margin_model(
        durable(stats.join(train, "gidx")), d.join(calib, "gidx"), margins_of(spark, sf).join(calib, "gidx"), trees=15, depth=5
    )
    return model.predict(d)


@query("score_grid")
def score_grid(spark, sf):
    li = table(spark, sf, "lineitem")
    d = designs(spark, sf)
    models = {}
    for s in ("F", "O"):
        lab = li.where(F.col("l_linestatus") == s).groupBy(F.col("l_partkey").alias("gidx")).agg(
            (F.avg("l_quantity") <= 26).cast("int").alias("label")
        )
        train = durable(d.join(keyed(lab), "gidx"))
        models[(s, "rf")] = SM.forest(train, trees=10, depth=4)
        models[(s, "mlp")] = SM.mlp_ensemble(train, len(COLS), members=2, hidden=(6,), max_iter=20)[0]
    return SM.score_grid(models, d)


@query("active_learning_round")
def active_learning_round(spark, sf):
    d = designs(spark, sf).withColumn("vec", F.array(F.col("p_size") / 50, F.col("brand") / 25))
    start = SP.stratified_split(labels(spark, sf), 0.25, 0.0, 5).where("split = 'calib'").select("gidx", "label")
    trials = episodes(spark, sf).withColumn("slot", F.col("gidx"))
    trials = by_part(trials)
    # several parts share a supplier's distance rule, so short sequences of one part decide early or stay open
    unsafe = F.col("qty") > 50 - F.col("slot") % 25
    new, _ = L.active_learning_round(
        d, start, trials, order=EP_ORDER, unsafe=unsafe, cycles=2, batch=8, trees=10, depth=4
    )
    return new.select("cycle", "gidx", "label", "mode", "n", "k")


@query("parego_propose")
def parego_propose(spark, sf):
    p = table(spark, sf, "part")
    cand = p.select(F.col("p_partkey").alias("gidx"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000).alias("vec"))
    tried = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    hist = p.join(keyed(tried), "p_partkey", "left_semi").select(
        F.col("p_partkey").alias("gidx"), F.col("p_size").cast("double").alias("c"), (2000 - F.col("p_retailprice")).alias("f")
    )
    return L.parego_propose(cand, hist, objectives=["c", "f"], seed=11, trees=10)


@query(
    "offline_labels_split",
    """WITH lq AS (SELECT l_suppkey AS gidx, count(*) AS c FROM lineitem GROUP BY 1) SELECT count(*) AS designs FROM lq""",
)
def offline_labels_split(spark, sf):
    out = J.offline_labels(
        episodes(spark, sf), [*EP_ORDER, "scenario"], F.col("min_d") < 0.5, calib=0.2, test=0.2, seed=13
    )
    return out.agg(F.count(F.lit(1)).alias("designs"))


@query(
    "replay_campaign",
    f"""WITH RECURSIVE {MODE_SQL.replace("failure AND right(route_signature, 1) = '1' AS hit", "failure AS hit")} SELECT {MODE_OUT},
  CASE WHEN scheme = 'nominal_mc' THEN 'mc_exact' WHEN events >= 20 AND event_ess >= 20 AND max_contrib <= 0.2 AND rse <= 0.25 THEN 'precise'
    ELSE 'imprecise_exploratory' END AS status FROM mode""",
)
def replay_campaign(spark, sf):
    sig = F.substring("route_signature", 1, 1)
    rows = job_rows(spark, sf).withColumn("route_signature", F.when(sig == F.col("job"), "principal").otherwise("other"))
    out = J.replay_campaign(rows, jobs(spark, sf), "principal")
    return rounded(out.drop("failed_gates"), MODE_ROUND)


@query("replay_families")
def replay_families(spark, sf):
    rows = job_rows(spark, sf)
    unit = F.when(F.col("job") == "R", F.lit(0.0)).otherwise(F.col("log_weight"))
    out = J.replay_families(rows.withColumn("log_weight", unit), jobs(spark, sf), **CUTS)
    return out.withColumn("failed_gates", F.array_join("failed_gates", ","))


@query(
    "audit_verdict",
    f"""WITH {RES_SQL}, tr AS (SELECT stage_id, trial_index, bool_or(violation) AS v FROM res GROUP BY ALL)
SELECT stage_id, count(*) AS n, count(*) FILTER (WHERE v) AS k, FALSE AS passed FROM tr GROUP BY stage_id""",
)
def audit_verdict(spark, sf):
    _, rows = results(spark, sf)
    stages = [AU.Stage("s1", 0.9, 0.005, 1, 1), AU.Stage("other", 0.9, 0.005, 1, 2)]
    return J.audit_verdict(rows, stages, 0.05, 0.05).select("stage_id", "n", "k", "passed")


@query(
    "history_replay_check",
    f"""WITH {EP_SQL}, r AS (SELECT part AS gidx, scenario, metric, row_number() OVER (PARTITION BY part, scenario ORDER BY {EP_ORDER_SQL.replace('part', 'gidx')}) AS n FROM ep),
s AS (SELECT gidx, scenario, avg(metric) AS m FROM r WHERE n <= 5 GROUP BY ALL), o AS (SELECT gidx, avg(m) AS metric FROM s GROUP BY gidx)
SELECT p_partkey AS iter, 'metric_agg' AS field, round(metric, 6) AS got, round(metric + 1, 6) AS want FROM part JOIN o ON gidx = p_partkey WHERE p_partkey % 6 = 1
UNION ALL SELECT p_partkey, 'obj_cost', p_size, p_size + 2.0 FROM part JOIN o ON gidx = p_partkey WHERE p_partkey % 9 = 2""",
)
def history_replay_check(spark, sf):
    trials = by_part(episodes(spark, sf)).withColumn("value", F.col("metric"))
    costs = table(spark, sf, "part").select(F.col("p_partkey").alias("gidx"), F.col("p_size").cast("double").alias("cost"))
    first = A.fixed_replication(trials, 5, EP_ORDER)
    obj = A.portfolio_objective(A.metric_agg_noise(first, ["gidx", "scenario"], "mean"), 2, "mean", True)
    hist = obj.join(costs, "gidx").select(
        F.col("gidx").alias("iter"),
        "gidx",
        F.when(F.col("gidx") % 9 == 2, F.col("cost") + 2).otherwise(F.col("cost")).alias("obj_cost"),
        F.when(F.col("gidx") % 6 == 1, F.col("metric") + 1).otherwise(F.col("metric")).alias("metric_agg"),
        "obj_perf",
        "obs_var",
    )
    out = J.history_replay_check(hist, costs, trials, EP_ORDER, scenarios=2, repetitions=5, maximize=True)
    return rounded(out, {"got": 6, "want": 6})


