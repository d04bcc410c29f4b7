"""Audit plans and outcomes: parts are designs, orders are trials, line status is the scenario."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import seeds as SD
from sparkassay.operators import auditing as A
from sparkassay.operators import designs as D
from sparkassay.operators.ordering import slice_bounds
from sparkassay.session import default_slices

from .adapters import table
from .designs import P_SAFE_SQL, p_safe_rows
from .rare import bound_sql, rounded
from .registry import query

STAGES = (A.Stage("s1", 0.9, 0.005, 0, 2026082701), A.Stage("s2", 0.97, 0.005, 0, 2026082702, ("s1", False)))
SCEN = ["F", "O"]


def scores(spark, sf):
    return D.portfolio_score(p_safe_rows(spark, sf))


def trials(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_index"))


def plans(spark, sf):
    """Every order is a trial of both stages."""
    out = [A.trial_plan(scores(spark, sf), s, SCEN, trials(spark, sf)) for s in STAGES]
    return out[0].unionByName(out[1])


HASH = "('0x' || substr(sha1({}), 1, 8))::BIGINT"


def plan_sql(i: int) -> str:
    s = STAGES[i]
    draw = HASH.format(f"'draw:{s.rng_seed}:' || o_orderkey")
    seed = HASH.format(f"'{s.rng_seed}:' || gidx || ':' || scenario || ':' || (trial_index * 2 + place + 1)")
    return f"""a{i} AS (SELECT gidx, row_number() OVER (ORDER BY gidx) AS pos FROM f WHERE f_min >= {s.tau!r}),
d{i} AS (SELECT o_orderkey AS trial_index, {draw} % (SELECT count(*) FROM a{i}) + 1 AS pos FROM orders),
p{i} AS (SELECT '{s.id}' AS stage_id, trial_index, gidx, scenario, {seed} AS seed
  FROM d{i} JOIN a{i} USING (pos) CROSS JOIN (VALUES (0, 'F'), (1, 'O')) sc(place, scenario))"""


PLAN_SQL = f"""{P_SAFE_SQL}, f AS (SELECT gidx, min(p_safe) AS f_min FROM p GROUP BY gidx), {plan_sql(0)}, {plan_sql(1)},
plans AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1)"""


@query("trial_plan", f"WITH {PLAN_SQL} SELECT stage_id, trial_index, gidx, scenario, seed FROM plans")
def trial_plan(spark, sf):
    return plans(spark, sf)


@query(
    "seed_collisions",
    f"""WITH {PLAN_SQL}, q AS (SELECT stage_id, seed % 1000003 AS seed FROM plans)
SELECT seed, count(DISTINCT stage_id) AS stages FROM q GROUP BY seed HAVING count(DISTINCT stage_id) > 1""",
)
def seed_collisions(spark, sf):
    return A.seed_collisions(plans(spark, sf).withColumn("seed", F.col("seed") % 1000003))


@query(
    "stage_plan_check",
    f"""WITH {PLAN_SQL}, q AS (SELECT * REPLACE (seed % 1000003 AS seed) FROM plans)
SELECT 'seed_shared_between_stages' AS rule, stage_id FROM q GROUP BY stage_id
UNION ALL SELECT 'seed_repeated_in_stage', stage_id FROM q GROUP BY stage_id HAVING count(DISTINCT seed) < count(*)
UNION ALL SELECT 'delta_exceeds_global', NULL UNION ALL SELECT 'trials_differ_from_n', 's2'""",
)
def stage_plan_check(spark, sf):
    p = plans(spark, sf).withColumn("seed", F.col("seed") % 1000003)
    n = trials(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    stages = n.select(F.explode(F.array(*[
        F.struct(F.lit(s.id).alias("stage_id"), F.lit(s.delta).alias("delta"), (F.col("n") + i).alias("n"))
        for i, s in enumerate(STAGES)
    ])).alias("s")).select("s.*")
    return A.stage_plan_check(stages, p, global_delta=0.009)


@query(
    "plan_load",
    f"WITH {PLAN_SQL} SELECT stage_id, count(DISTINCT gidx) AS designs, count(*) AS jobs FROM plans GROUP BY stage_id",
)
def plan_load(spark, sf):
    return A.plan_load(plans(spark, sf))


# cached episodes: one per lineitem row, the uid repeats
PRIOR_SQL = """prior AS (SELECT l_orderkey || '-' || l_linenumber AS ep_uid, l_partkey AS gidx, l_linestatus AS scenario,
  l_orderkey AS ord, l_linenumber AS line, l_returnflag AS stage_id, l_extendedprice AS price, l_suppkey AS supp FROM lineitem)"""
PRIOR_ORDER = ["ord", "line", "stage_id", "price", "supp", "gidx", "scenario"]


def prior(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ep_uid"),
        F.col("l_partkey").alias("gidx"),
        F.col("l_linestatus").alias("scenario"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("stage_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_suppkey").alias("supp"),
    )


REUSE_SQL = f"""{PLAN_SQL}, {PRIOR_SQL}, once AS (SELECT * FROM prior QUALIFY
  row_number() OVER (PARTITION BY ep_uid ORDER BY {', '.join(PRIOR_ORDER)}) = 1),
c AS (SELECT ep_uid, gidx, scenario, stage_id AS reused_from_stage, row_number() OVER (PARTITION BY gidx, scenario
  ORDER BY {', '.join(PRIOR_ORDER)}) AS rn FROM once),
j AS (SELECT trial_index, gidx, scenario, row_number() OVER (PARTITION BY gidx, scenario ORDER BY trial_index) AS rn FROM p0),
reuse AS (SELECT trial_index, gidx, scenario, ep_uid, reused_from_stage FROM j JOIN c USING (gidx, scenario, rn))"""


def reuse(spark, sf):
    plan = A.trial_plan(scores(spark, sf), STAGES[0], SCEN, trials(spark, sf))
    limits = slice_bounds(trials(spark, sf), "trial_index", default_slices(spark))
    return plan, A.reuse_assign(plan, prior(spark, sf), PRIOR_ORDER, limits)


@query("reuse_assign", f"WITH {REUSE_SQL} SELECT * FROM reuse")
def reuse_assign(spark, sf):
    return reuse(spark, sf)[1].select("trial_index", "gidx", "scenario", "ep_uid", "reused_from_stage")


@query(
    "pending_jobs",
    f"""WITH {REUSE_SQL} SELECT trial_index, gidx, scenario, seed FROM p0
WHERE (trial_index, scenario) NOT IN (SELECT (trial_index, scenario) FROM reuse)""",
)
def pending_jobs(spark, sf):
    plan, used = reuse(spark, sf)
    return A.pending_jobs(plan, used).select("trial_index", "gidx", "scenario", "seed")


# one result per (order, status); every seventh order has a fault planted
RES_SQL = """base AS (SELECT l_orderkey AS trial_index, l_linestatus AS scenario, min(l_partkey) AS gidx,
  max(l_quantity) AS q, count(*) AS c FROM lineitem GROUP BY ALL),
plan AS (SELECT trial_index, scenario, gidx, trial_index * 2 + (scenario = 'O')::INT AS seed FROM base WHERE trial_index % 11 <> 3),
r0 AS (SELECT trial_index, scenario, CASE WHEN trial_index % 7 = 1 THEN gidx + 1 ELSE gidx END AS gidx,
  CASE WHEN trial_index % 13 = 2 THEN 'other' ELSE 's1' END AS stage_id, 0.9 AS threshold,
  CASE WHEN trial_index % 17 = 5 THEN 'shared' ELSE trial_index || scenario END AS ep_uid,
  trial_index * 2 + (scenario = 'O')::INT AS requested_seed,
  trial_index * 2 + (scenario = 'O')::INT + (trial_index % 19 = 4)::INT AS seed,
  c > 4 AS reused, CASE WHEN trial_index % 23 = 6 THEN c > 4 ELSE c <= 4 END AS planned_seed_executed,
  q >= 50 AS malformed, CASE WHEN q < 50 OR trial_index % 29 = 7 THEN (45 - q) / 10 + 0.5 END AS min_d,
  CASE WHEN q >= 50 THEN trial_index % 31 <> 8 ELSE q > 45 END AS violation FROM base),
res AS (SELECT *, CASE WHEN trial_index % 37 = 9 THEN NOT bool_or(violation) OVER (PARTITION BY trial_index)
  ELSE bool_or(violation) OVER (PARTITION BY trial_index) END AS trial_violation FROM r0 WHERE trial_index % 5 <> 0),
acc AS (SELECT p_partkey AS gidx FROM part WHERE p_size <= 45)"""


def results(spark, sf):
    base = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("trial_index"), F.col("l_linestatus").alias("scenario"))
        .agg(F.min("l_partkey").alias("gidx"), F.max("l_quantity").alias("q"), F.count(F.lit(1)).alias("c"))
    )
    t = F.col("trial_index")
    seed = t * 2 + (F.col("scenario") == "O").cast("int")
    plan = base.where(t % 11 != 3).select("trial_index", "scenario", "gidx", seed.alias("seed"))
    bad = F.col("q") >= 50
    rows = base.where(t % 5 != 0).select(
        "trial_index",
        "scenario",
        F.when(t % 7 == 1, F.col("gidx") + 1).otherwise(F.col("gidx")).alias("gidx"),
        F.when(t % 13 == 2, "other").otherwise("s1").alias("stage_id"),
        F.lit(0.9).alias("threshold"),
        F.when(t % 17 == 5, "shared").otherwise(F.concat(t.cast("string"), "scenario")).alias("ep_uid"),
        seed.alias("requested_seed"),
        (seed + (t % 19 == 4).cast("int")).alias("seed"),
        seed.alias("planned_seed"),
        (F.col("c") > 4).alias("reused"),
        F.when(t % 23 == 6, F.col("c") > 4).otherwise(F.col("c") <= 4).alias("planned_seed_executed"),
        bad.alias("malformed"),
        F.when(~bad | (t % 29 == 7), (45 - F.col("q")) / 10 + 0.5).alias("min_d"),
        F.when(bad, t % 31 != 8).otherwise(F.col("q") > 45).alias("violation"),
    )
    any_v = rows.groupBy("trial_index").agg(F.max("violation").alias("_any"))
    rows = rows.join(any_v, "trial_index").withColumn(
        "trial_violation", F.when(t % 37 == 9, ~F.col("_any")).otherwise(F.col("_any"))
    )
    return plan, rows.drop("_any")


RULES = [
    ("wrong_design", "r.gidx IS DISTINCT FROM p.gidx"),
    ("outside_accepted", "r.gidx NOT IN (SELECT gidx FROM acc)"),
    ("wrong_stage", "r.stage_id <> 's1'"),
    ("bad_uid", "r.ep_uid IN (SELECT ep_uid FROM res GROUP BY ep_uid HAVING count(*) > 1)"),
    ("seed_not_preserved", "r.requested_seed <> r.seed"),
    ("reuse_flags", "r.planned_seed_executed = r.reused"),
    ("malformed_with_distance", "r.malformed AND r.min_d IS NOT NULL"),
    ("malformed_not_unsafe", "r.malformed AND NOT r.violation"),
    ("invalid_distance", "NOT r.malformed AND r.min_d IS NULL"),
    ("label_differs", "NOT r.malformed AND r.min_d IS NOT NULL AND r.violation <> (r.min_d < 0.5)"),
    ("portfolio_label", "r.trial_violation <> v.any_v"),
]


@query(
    "plan_result_reconcile",
    f"""WITH {RES_SQL}, v AS (SELECT trial_index, bool_or(violation) AS any_v FROM res GROUP BY 1)
SELECT trial_index, scenario, 'missing_result' AS rule FROM plan WHERE (trial_index, scenario) NOT IN (SELECT (trial_index, scenario) FROM res)
UNION ALL SELECT trial_index, scenario, 'unplanned_result' FROM res WHERE (trial_index, scenario) NOT IN (SELECT (trial_index, scenario) FROM plan)
"""
    + "\n".join(
        f"UNION ALL SELECT r.trial_index, r.scenario, '{name}' FROM res r JOIN plan p USING (trial_index, scenario) "
        f"JOIN v USING (trial_index) WHERE {cond}"
        for name, cond in RULES
    ),
)
def plan_result_reconcile(spark, sf):
    plan, rows = results(spark, sf)
    accepted = table(spark, sf, "part").where("p_size <= 45").select(F.col("p_partkey").alias("gidx"))
    return A.plan_result_reconcile(plan, rows, accepted, stage_id="s1", tau=0.9, d_safe=0.5)


@query(
    "raw_vs_trial_uids",
    f"""WITH {RES_SQL}, raw AS (SELECT trial_index || scenario AS ep_uid, scenario, gidx FROM base WHERE trial_index % 3 <> 0)
SELECT ep_uid, 'store_only' AS side FROM raw WHERE ep_uid NOT IN (SELECT ep_uid FROM res)
UNION ALL SELECT DISTINCT ep_uid, 'result_only' FROM res WHERE ep_uid NOT IN (SELECT ep_uid FROM raw)
UNION ALL SELECT DISTINCT raw.ep_uid, 'mismatch' FROM raw JOIN res USING (ep_uid) WHERE raw.gidx <> res.gidx OR raw.scenario <> res.scenario""",
)
def raw_vs_trial_uids(spark, sf):
    _, rows = results(spark, sf)
    raw = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("t"), F.col("l_linestatus").alias("scenario"))
        .agg(F.min("l_partkey").alias("gidx"))
        .where(F.col("t") % 3 != 0)
        .select(F.concat(F.col("t").cast("string"), "scenario").alias("ep_uid"), "scenario", "gidx")
    )
    return A.raw_vs_trial_uids(raw, rows)


STAGE_SQL = f"""{RES_SQL}, st AS (SELECT 's' || trial_index % 40 AS stage_id, * EXCLUDE (stage_id) FROM res),
tr AS (SELECT stage_id, trial_index, bool_or(violation) AS v, count(*) FILTER (WHERE malformed) AS m,
  count(*) FILTER (WHERE reused) AS r, count(*) AS e FROM st GROUP BY ALL),
stg AS (SELECT stage_id, count(*) AS n, count(*) FILTER (WHERE v) AS k, sum(m)::BIGINT AS malformed, sum(r)::BIGINT AS reused,
  sum(e - r)::BIGINT AS fresh FROM tr GROUP BY stage_id)"""


def staged(spark, sf):
    _, rows = results(spark, sf)
    stage = F.concat(F.lit("s"), (F.col("trial_index") % 40).cast("string"))
    return A.audit_stage(rows.withColumn("stage_id", stage))


@query("audit_stage", f"WITH {STAGE_SQL} SELECT * FROM stg")
def audit_stage(spark, sf):
    return staged(spark, sf)


@query(
    "audit_decision",
    f"""WITH RECURSIVE {STAGE_SQL}, {bound_sql('u', 'stg', 'k', '0.005')}
SELECT stage_id, stg.n, stg.k, round(bound, 7) AS cp_upper, round(least(1, bound / 0.9), 6) AS unsafe_bound,
  least(1, bound / 0.9) <= 0.8 AS passed FROM stg JOIN u ON u.k = stg.k AND u.n = stg.n""",
)
def audit_decision(spark, sf):
    out = A.audit_decision(staged(spark, sf).select("stage_id", "n", "k"), F.lit(0.005), 0.9, 0.8)
    return rounded(out, {"cp_upper": 7, "unsafe_bound": 6})


@query(
    "max_passing_failures",
    """WITH st AS (SELECT l_partkey AS stage_id, count(*) AS n FROM lineitem GROUP BY 1),
d AS (SELECT DISTINCT n FROM st), kk AS (SELECT n, unnest(range(0, n + 1)) AS k FROM d),
pm AS (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.25) + (n - k) * ln(0.75)) AS p FROM kk),
c AS (SELECT n, k, sum(p) OVER (PARTITION BY n ORDER BY k) AS cdf FROM pm),
m AS (SELECT n, coalesce(max(k) FILTER (WHERE cdf <= 0.05), -1) AS k_max FROM c GROUP BY n)
SELECT stage_id, n, k_max FROM st JOIN m USING (n)""",
)
def max_passing_failures(spark, sf):
    stages = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("stage_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("delta", F.lit(0.05))
    )
    return A.max_passing_failures(stages, 0.5, 0.5).select("stage_id", "n", "k_max")


@query(
    "fresh_seed",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {HASH.format("'7:' || l_partkey || ':' || l_linestatus || ':' || l_orderkey")} AS seed
FROM lineitem""",
)
def fresh_seed(spark, sf):
    seed = SD.fresh_seed(F.lit(7), F.col("l_partkey"), F.col("l_linestatus"), F.col("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", seed.alias("seed"))


@query(
    "partitioned_seed",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <= 5 AND
  1000 + (l_partkey * 2 + (l_linestatus = 'O')::INT) * 5 + l_linenumber - 1 <= 4294967295
  THEN 1000 + (l_partkey * 2 + (l_linestatus = 'O')::INT) * 5 + l_linenumber - 1 END AS seed FROM lineitem""",
)
def partitioned_seed(spark, sf):
    seed = SD.partitioned_seed(
        1000, F.col("l_partkey"), (F.col("l_linestatus") == "O").cast("int"), F.col("l_linenumber") - 1,
        scenarios=2, repetitions=5,
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", seed.alias("seed"))


@query(
    "sampler_seed",
    """SELECT o_orderkey, hex(encode('simreq-sampler-v1:' || CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_custkey::VARCHAR END
  || ':' || o_orderkey)) AS seed FROM orders""",
)
def sampler_seed(spark, sf):
    conf = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", SD.sampler_seed(F.col("o_orderkey"), conf).alias("seed"))


@query(
    "identity_digest",
    """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"'
  || o_orderpriority || '"}') AS digest FROM orders""",
)
def identity_digest(spark, sf):
    d = SD.identity_digest("o_orderkey", "o_custkey", "o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", d.alias("digest"))
