"""Offline jobs over stored tables: replay of a campaign, offline labelling, audit verdicts and checks of a search history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gates as G
from ..session import durable, small_side
from ..operators import aggregates, auditing, families, reconcile, replay, sequential, splits
from ..schemas import CAMPAIGN_ROW
from ..sources import campaign_shards


def replay_campaign(rows: DataFrame, jobs: DataFrame, signature: str = families.PRINCIPAL_MODE) -> DataFrame:
    """Mode estimate of every job with its reporting status: all jobs in one pass per scheme."""
    modes = families.mode_estimate(rows, jobs, families.principal_mode_hit(signature))
    args = [F.col(c) for c in ("scheme", "events", "event_ess", "max_contrib", "rse")]
    status, failed = G.mode_status(*args)
    return modes.withColumns({"status": status, "failed_gates": failed})


def replay_families(rows: DataFrame, jobs: DataFrame, **cuts) -> DataFrame:
    """Family estimates of every job under its own scheme, with their precision status."""
    tagged = rows.join(small_side(jobs.select("job", "scheme")), "job")
    out = None
    for scheme, estimator in families.FAMILY_SCHEME.items():
        mine = tagged.where(F.col("scheme") == scheme)
        sums = families.family_sums(mine, ["job"], estimator, families.failure_family(**cuts))
        vec = families.family_vector(sums, ["job"], estimator).withColumn("estimator", F.lit(estimator))
        status, failed = G.precision_status(
            F.col("estimator"), F.col("events"), F.col("ess"), F.col("max_contrib"), F.col("rse")
        )
        vec = vec.withColumns({"status": status, "failed_gates": failed})
        out = vec if out is None else out.unionByName(vec)
    return out


def replay_shards(spark: SparkSession, root: str, plan: DataFrame, hit: Column, family: Column) -> DataFrame:
    """``replay.replay_sums`` of a campaign in storage; ``plan``: key, scheme, episodes.

    A job whose shards fail their digests, or whose rows do not match the plan, keeps its counts and gets these problems
    as further reasons against an estimate.
    """
    scanned = campaign_shards.scan(spark, root)
    sums = replay.replay_sums(campaign_shards.parsed(scanned, CAMPAIGN_ROW), plan.select(F.col("key").alias("job"), "scheme"), hit, family)
    wrong = campaign_shards.problems(scanned, plan).groupBy("job").agg(F.array_sort(F.collect_set("problem")).alias("_problems"))  # a few names
    none = F.array().cast("array<string>")
    both = {c: F.concat(F.coalesce("_problems", none), c) for c in ("reasons", "family_reasons")}
    return sums.join(wrong, "job", "left").withColumns(both).drop("_problems")


def verify_campaign(recomputed: DataFrame, published: DataFrame, numbers: list[str], texts: list[str] = ()) -> DataFrame:
    """Fields of a published analysis that the replay does not reproduce."""
    got = reconcile.melt(recomputed, ["job"], numbers, list(texts))
    want = reconcile.melt(published, ["job"], numbers, list(texts))
    return reconcile.published_compare(got, want, ["job"])


def offline_labels(
    trials: DataFrame, order: list[str], unsafe: Column, *, calib: float, test: float, seed: int,
    rule: sequential.SequentialRule = sequential.SequentialRule(),
) -> DataFrame:
    """Label every design from stored trials and split the decided ones: (gidx, label, mode, n, k, llr, split)."""
    labels = durable(sequential.sprt_label(trials, ["gidx"], order, unsafe, rule))  # a row per design, read by each pass of the split
    parts = splits.stratified_split(labels.where("label IS NOT NULL").select("gidx", "label"), calib, test, seed)
    return labels.join(parts.select("gidx", "split"), "gidx", "left")


def audit_verdict(results: DataFrame, stages: list[auditing.Stage], p: float, alpha_frac: float) -> DataFrame:
    """Counts, exact bound and verdict per stage, each with its own share of the error budget."""
    delta = F.lit(None).cast("double")
    for s in stages:
        delta = F.when(F.col("stage_id") == s.id, F.lit(s.delta)).otherwise(delta)
    return auditing.audit_decision(auditing.audit_stage(results), delta, p, alpha_frac)


def history_replay_check(
    history: DataFrame, costs: DataFrame, trials: DataFrame, order: list[str], *, scenarios: int, repetitions: int, maximize: bool,
    rel: float = 1e-10, abs_tol: float = 1e-12,
) -> DataFrame:
    """Stored objectives against recomputed ones: (iter, field, got, want) where they differ.

    ``history``: iter, gidx, obj_cost, metric_agg, obj_perf, obs_var. ``costs``: gidx, cost.
    ``trials``: gidx, scenario, value and the order columns.
    """
    first = aggregates.fixed_replication(trials, repetitions, order)
    per = aggregates.metric_agg_noise(first, ["gidx", "scenario"], "mean")
    obj = aggregates.portfolio_objective(per, scenarios, "mean", maximize)
    fields = ["obj_cost", "metric_agg", "obj_perf", "obs_var"]
    again = (
        history.select("iter", "gidx")
        .join(costs.select("gidx", F.col("cost").alias("obj_cost")), "gidx", "left")
        .join(obj.withColumnRenamed("metric", "metric_agg"), "gidx", "left")
    )
    got = reconcile.melt(again, ["iter"], fields)
    want = reconcile.melt(history, ["iter"], fields)
    return reconcile.published_compare(got, want, ["iter"], rel, abs_tol).select("iter", "field", "got", "want")
