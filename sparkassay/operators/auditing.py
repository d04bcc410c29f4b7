"""Frozen trial plans, reuse of cached episodes, audit outcomes and their cross-checks."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binomial import passing_failures, with_cp_upper
from ..functions.numeric import is_finite
from ..functions.seeds import fresh_seed, hash_int, plan_counter
from ..session import default_slices
from .designs import accept_threshold
from .episodes import keep_first
from .ordering import row_numbers, slice_bounds
from .reconcile import set_difference


@dataclass(frozen=True)
class Stage:
    """One predeclared audit stage; ``run_if`` names (stage, passed) of an earlier one."""

    id: str
    tau: float
    delta: float
    n: int
    rng_seed: int
    run_if: tuple[str, bool] | None = None


# The shipped two-stage declaration.
GLOBAL_DELTA = 0.01
STAGES = (
    Stage("primary", 0.9523809523809523, 0.005, 2117, 2026082701),
    Stage("fallback", 1.0, 0.005, 2969, 2026082702, ("primary", False)),
)


def stage_trials(spark, stage: Stage) -> DataFrame:
    return spark.range(stage.n).withColumnRenamed("id", "trial_index")


def trial_plan(scores: DataFrame, stage: Stage, scenarios: list[str], trials: DataFrame | None = None) -> DataFrame:
    """Draw designs with replacement from the accepted set, one seed per (trial, scenario).

    The accepted set gets dense positions, each trial hashes to a position, and the two meet in an
    equi-join; no accepted set passes through the driver.
    """
    accepted = row_numbers(accept_threshold(scores, stage.tau).select("gidx"), [], ["gidx"], "_pos")
    size = accepted.agg(F.count(F.lit(1)).alias("m")).scalar()
    base = trials if trials is not None else stage_trials(scores.sparkSession, stage)
    draw = hash_int(F.lit("draw"), F.lit(stage.rng_seed), F.col("trial_index"))
    drawn = base.withColumn("_pos", F.when(size > 0, draw % F.greatest(size, F.lit(1)) + 1))
    rows = drawn.join(accepted, "_pos").select(
        F.lit(stage.id).alias("stage_id"),
        "trial_index",
        "gidx",
        F.posexplode(F.array(*[F.lit(s) for s in scenarios])).alias("_at", "scenario"),
    )
    counter = plan_counter(F.col("trial_index"), F.col("_at"), len(scenarios))
    return rows.withColumn("seed", fresh_seed(F.lit(stage.rng_seed), F.col("gidx"), F.col("scenario"), counter)).drop("_at")


def seed_collisions(plans: DataFrame) -> DataFrame:
    """Seeds planned by more than one stage."""
    pairs = plans.select("seed", "stage_id").distinct()
    return pairs.groupBy("seed").agg(F.count(F.lit(1)).alias("stages")).where("stages > 1")


def repeated_seeds(plans: DataFrame) -> DataFrame:
    """Seeds planned more than once within a stage."""
    return plans.groupBy("stage_id", "seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stage_plan_check(stages: DataFrame, plans: DataFrame, global_delta: float = GLOBAL_DELTA) -> DataFrame:
    """Broken rules of a declaration and its plans: (rule, stage_id)."""
    none = F.lit(None).cast("string")
    over = (
        stages.agg(F.sum("delta").alias("d"))
        .where(F.col("d") > global_delta + 1e-15)
        .select(F.lit("delta_exceeds_global").alias("rule"), none.alias("stage_id"))
    )
    twice = stages.groupBy("stage_id").count().where("count > 1").select(F.lit("repeated_stage").alias("rule"), "stage_id")
    shared = (
        plans.join(seed_collisions(plans).select("seed"), "seed", "left_semi")
        .select(F.lit("seed_shared_between_stages").alias("rule"), "stage_id")
        .distinct()
    )
    inner = repeated_seeds(plans).select(F.lit("seed_repeated_in_stage").alias("rule"), "stage_id").distinct()
    short = (
        plans.groupBy("stage_id")
        .agg(F.count_distinct("trial_index").alias("have"))
        .join(stages.select("stage_id", "n"), "stage_id", "full")
        .where(~F.col("have").eqNullSafe(F.col("n")))
        .select(F.lit("trials_differ_from_n").alias("rule"), "stage_id")
    )
    return over.union(twice).union(shared).union(inner).union(short)


def plan_load(plans: DataFrame) -> DataFrame:
    """Distinct designs and jobs a plan asks for."""
    return plans.groupBy("stage_id").agg(
        F.count_distinct("gidx").alias("designs"), F.count(F.lit(1)).alias("jobs")
    )


def reuse_assign(
    plan: DataFrame, prior: DataFrame, prior_order: list[str], trial_bounds: list | None = None
) -> DataFrame:
    """k-th planned job of a (design, scenario) takes its k-th cached episode, first in first out.

    ``plan``: trial_index, gidx, scenario, seed. ``prior``: ep_uid, gidx, scenario, stage_id and the
    order columns. A uid mentioned by several earlier stages is one cached episode. Positions come from
    sliced windows, so a design that dominates the plan is numbered by many tasks.
    """
    keys = ["gidx", "scenario"]
    once = keep_first(prior, ["ep_uid"], prior_order)
    limits = slice_bounds(prior, prior_order[0], default_slices(prior.sparkSession))
    cached = row_numbers(once, keys, prior_order, "_rn", bounds=limits).select(
        *keys, "_rn", "ep_uid", F.col("stage_id").alias("reused_from_stage")
    )
    jobs = row_numbers(plan, keys, ["trial_index"], "_rn", bounds=trial_bounds)
    return jobs.join(cached, [*keys, "_rn"]).drop("_rn")


def pending_jobs(plan: DataFrame, done: DataFrame, keys: list[str] = ("trial_index", "scenario")) -> DataFrame:
    return plan.join(done.select(*keys), list(keys), "left_anti")


def plan_result_reconcile(
    plan: DataFrame, results: DataFrame, accepted: DataFrame, *, stage_id: str, tau: float, d_safe: float
) -> DataFrame:
    """Every rule a result row breaks against its frozen plan: (trial_index, scenario, rule).

    ``results``: trial_index, scenario, gidx, stage_id, threshold, ep_uid, requested_seed, seed,
    planned_seed, planned_seed_executed, reused, min_d, violation, malformed, trial_violation.
    """
    keys = ["trial_index", "scenario"]
    uids = results.groupBy("ep_uid").agg(F.count(F.lit(1)).alias("_uses"))
    portfolio = results.groupBy("trial_index").agg(F.max("violation").alias("_any"))
    inside = accepted.select(F.col("gidx").alias("_acc")).distinct()
    res = (
        results.join(uids, "ep_uid", "left")
        .join(portfolio, "trial_index", "left")
        .join(inside, results["gidx"] == F.col("_acc"), "left")
        .withColumn("_r", F.lit(True))
    )
    want = plan.select(*keys, F.col("gidx").alias("_pg"), F.col("seed").alias("_ps")).withColumn("_p", F.lit(True))
    both = want.join(res, keys, "full")
    ok_d = is_finite(F.col("min_d"))
    seeds_kept = (F.col("requested_seed") >= 0) & F.col("requested_seed").eqNullSafe(F.col("seed"))
    fresh_ok = F.col("requested_seed").eqNullSafe(F.col("_ps")) & F.col("planned_seed").eqNullSafe(F.col("_ps"))
    rules = {
        "missing_result": F.col("_r").isNull(),
        "unplanned_result": F.col("_p").isNull(),
        "wrong_design": ~F.col("gidx").eqNullSafe(F.col("_pg")),
        "outside_accepted": F.col("_acc").isNull(),
        "wrong_stage": ~(F.col("stage_id").eqNullSafe(F.lit(stage_id)) & F.col("threshold").eqNullSafe(F.lit(tau))),
        "bad_uid": F.col("ep_uid").isNull() | (F.col("ep_uid") == "") | (F.col("_uses") > 1),
        "seed_not_preserved": ~F.coalesce(seeds_kept, F.lit(False)),
        "reuse_flags": F.col("planned_seed_executed").eqNullSafe(F.col("reused")),
        "fresh_seed_differs": ~F.coalesce(F.col("reused"), F.lit(False)) & ~fresh_ok,
        "malformed_with_distance": F.col("malformed") & ok_d,
        "malformed_not_unsafe": F.col("malformed") & ~F.col("violation"),
        "invalid_distance": ~F.col("malformed") & ~ok_d,
        "label_differs": ~F.col("malformed") & ok_d & (F.col("violation") != (F.col("min_d") < d_safe)),
        "portfolio_label": ~F.col("trial_violation").eqNullSafe(F.col("_any")),
    }
    first_two = ("missing_result", "unplanned_result")
    present = F.col("_r") & F.col("_p")
    tests = [
        F.when(cond if name in first_two else (present & cond), F.lit(name)) for name, cond in rules.items()
    ]
    broken = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return both.select(*keys, F.explode(broken).alias("rule"))


def raw_vs_trial_uids(raw: DataFrame, results: DataFrame) -> DataFrame:
    """Uids stored but not reported, reported but not stored, or reported for another (scenario, design)."""
    sides = set_difference(raw, results, ["ep_uid"], "store_only", "result_only")
    r = results.select("ep_uid", F.col("scenario").alias("_s"), F.col("gidx").alias("_g"))
    moved = (
        raw.join(r, "ep_uid")
        .where((F.col("scenario") != F.col("_s")) | (F.col("gidx") != F.col("_g")))
        .select("ep_uid", F.lit("mismatch").alias("side"))
        .distinct()
    )
    return sides.select("ep_uid", "side").union(moved)


def audit_stage(results: DataFrame) -> DataFrame:
    """A trial is violated when any scenario is; n, k and the episode counts per stage."""
    trials = results.groupBy("stage_id", "trial_index").agg(
        F.max("violation").alias("_v"),
        F.count_if("malformed").alias("_m"),
        F.count_if("reused").alias("_r"),
        F.count(F.lit(1)).alias("_e"),
    )
    return trials.groupBy("stage_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("_v").alias("k"),
        F.sum("_m").alias("malformed"),
        F.sum("_r").alias("reused"),
        (F.sum("_e") - F.sum("_r")).alias("fresh"),
    )


def audit_decision(outcomes: DataFrame, delta: Column, p: float, alpha_frac: float) -> DataFrame:
    """Bound on the unsafe share of the accepted set and its verdict."""
    out = with_cp_upper(outcomes, "k", "n", delta, "cp_upper")
    out = out.withColumn("unsafe_bound", F.least(F.lit(1.0), F.col("cp_upper") / p))
    return out.withColumn("passed", F.col("unsafe_bound") <= alpha_frac)


@F.pandas_udf(T.LongType())
def _passing_udf(n: pd.Series, target: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series([passing_failures(int(a), float(b), float(c)) for a, b, c in zip(n, target, delta)])


def max_passing_failures(stages: DataFrame, p: float, alpha_frac: float) -> DataFrame:
    """Largest number of violated trials that still passes, solved once per distinct (n, delta)."""
    solved = stages.select("n", "delta").distinct().withColumn("k_max", _passing_udf("n", F.lit(p * alpha_frac), "delta"))
    return stages.join(solved, ["n", "delta"])


def should_run(stage: Stage, outcomes: dict[str, bool]) -> bool:
    """Gate of a stage on the verdict of an earlier one (a plain condition on one row)."""
    return stage.run_if is None or outcomes.get(stage.run_if[0]) == stage.run_if[1]
