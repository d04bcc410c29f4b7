"""Choosing designs: thresholds, shortlists, diversity, near-ties and stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, is_finite
from ..functions.seeds import hash_int
from ..session import durable, keyed
from .ordering import running
from .quantiles import exact_quantiles

# Clamp of the adaptive quantile, default band and relative/absolute tie width.
Q_CLAMP, DEFAULT_BAND, TIE = (0.01, 0.99), 0.05, 1e-12


def provisional_threshold(scores: DataFrame, q: float, score: str = "score") -> DataFrame:
    """Quantile of the clipped scores: one row (t)."""
    return exact_quantiles(scores, [], clip(F.col(score), 0.0, 1.0), {"t": min(max(q, 0.0), 1.0)})


def adaptive_level(scores: DataFrame, t_last: float, score: str = "score") -> DataFrame:
    """Next quantile level from the share of scores at or above the last threshold: one row (q)."""
    return scores.agg(clip(1.0 - F.avg((F.col(score) >= t_last).cast("double")), *Q_CLAMP).alias("q"))


def boundary_shortlist(
    scores: DataFrame, labels: DataFrame, t: Column | float, batch: int, factor: int = 20, band: float | None = None,
    score: str = "score",
) -> DataFrame:
    """Unlabelled designs closest to the threshold: from the band if it holds a batch, else from all.

    ``limit`` after a sort keeps only the best rows of each task, never the whole table.
    """
    at = t if isinstance(t, Column) else F.lit(t)
    pool = scores.join(keyed(labels.select("gidx")), "gidx", "left_anti").withColumn("margin", F.abs(F.col(score) - at))
    if band is not None and band > 0:
        near = F.col("margin") <= band
        enough = pool.agg((F.count_if(near) >= batch).alias("e")).scalar()
        pool = pool.where(near | ~enough)
    return pool.orderBy("margin", "gidx").limit(max(batch * factor, batch)).select("gidx", score, "margin")


def farthest_first(points: DataFrame, k: int, seed: int, vector: str = "vec", every: int = 16) -> DataFrame:
    """Greedy k-centre: a seeded start, then always the point farthest from all picks: (gidx, rank).

    Each round is one distributed top-1; only the picked row reaches the driver. Distances to older
    picks are folded into a column and stored every few rounds, so the plan stays short.
    """
    spark = points.sparkSession
    base = points.select("gidx", F.col(vector).cast("array<double>").alias("_v")).withColumn("_d", F.lit(float("inf")))
    start = base.orderBy(hash_int(F.lit(seed), F.col("gidx")), "gidx").first()
    picks = [] if start is None else [start]
    recent = list(picks)

    def gap(v: list[float]) -> Column:
        diffs = F.zip_with("_v", F.array(*[F.lit(float(x)) for x in v]), lambda a, b: (a - b) * (a - b))
        return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)

    while picks and len(picks) < k:
        reach = F.least(F.col("_d"), *[gap(p["_v"]) for p in recent])
        taken = F.col("gidx").isin([p["gidx"] for p in picks])
        best = base.where(~taken).withColumn("_r", reach).orderBy(F.col("_r").desc(), "gidx").first()
        if best is None:
            break
        picks.append(best)
        recent.append(best)
        if len(recent) >= every:
            base = durable(base.withColumn("_d", F.least(F.col("_d"), *[gap(p["_v"]) for p in recent])))
            recent = [best]
    rows = [(int(p["gidx"]), i) for i, p in enumerate(picks)]
    return spark.createDataFrame(rows, "gidx BIGINT, rank INT")


def argmin_ties(points: DataFrame, value: str, seed: int, tol: float = TIE) -> DataFrame:
    """One design with the smallest finite value; near-ties are broken by a seeded hash.

    ``ties`` counts them, ``degenerate`` tells that every finite value ties.
    """
    ok = points.where(is_finite(F.col(value)))
    low = ok.agg(F.min(value).alias("m")).scalar()
    near = F.abs(F.col(value) - low) <= tol + tol * F.abs(low)
    stats = ok.agg(
        F.struct(F.count_if(near).alias("ties"), (F.count_if(near) == F.count(F.lit(1))).alias("deg")).alias("s")
    ).scalar()
    pick = ok.where(near).orderBy(hash_int(F.lit(seed), F.col("gidx")), "gidx").limit(1)
    return pick.select("gidx", value, stats["ties"].alias("ties"), stats["deg"].alias("degenerate"))


def best_config(results: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest loss per key, the first candidate on ties: (keys, cfg, loss)."""
    pick = F.min(F.when(is_finite(F.col("loss")), F.struct("loss", "ord", "cfg"))).alias("b")
    return results.groupBy(*keys).agg(pick).select(*keys, "b.cfg", "b.loss")


def unobserved(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    return candidates.join(keyed(seen.select("gidx")), "gidx", "left_anti")


def mask_jaccard(previous: DataFrame | None, current: DataFrame) -> DataFrame:
    """1 - |intersection| / |union| of two accepted sets: no previous gives 1, two empty sets give 0."""
    if previous is None:
        return current.agg(F.lit(1.0).alias("distance"))
    a = previous.select("gidx").distinct().withColumn("_a", F.lit(1))
    b = current.select("gidx").distinct().withColumn("_b", F.lit(1))
    both = a.join(keyed(b), "gidx", "full").agg(
        F.count(F.lit(1)).alias("u"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("i")
    )
    return both.select(F.when(F.col("u") == 0, F.lit(0.0)).otherwise(1.0 - F.try_divide("i", "u")).alias("distance"))


def al_boundary_stats(scores: DataFrame, keys: list[str], t: Column | float, band: float, score: str = "score") -> DataFrame:
    """Predicted accepted share and the mass near the threshold."""
    at = t if isinstance(t, Column) else F.lit(t)
    width = band if band > 0 else DEFAULT_BAND
    return scores.groupBy(*keys).agg(
        F.avg((F.col(score) >= at).cast("double")).alias("v_pred"),
        F.avg((F.abs(F.col(score) - at) <= width).cast("double")).alias("boundary_mass"),
    )


def label_effort(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions per mode and trials spent per decision of a cycle."""
    return labels.groupBy(*keys).agg(
        F.count_if(F.col("label").isNotNull()).alias("decided"),
        F.sum("n").alias("sims"),
        F.try_divide(F.sum("n"), F.count_if(F.col("label").isNotNull())).alias("sims_per_decision"),
    )


def early_stop_streak(cycles: DataFrame, keys: list[str], eps: float, patience: int) -> DataFrame:
    """Length of the run of stable cycles ending at each cycle, and whether it reaches the patience."""
    broke = F.coalesce(~(F.col("distance") <= eps) | F.isnan("distance"), F.lit(True))
    # both running columns read their input for limits, slices and totals, so it is stored
    cycles = durable(cycles.select(*keys, "cycle", "distance").withColumn("_broke", broke))
    run = durable(running(cycles, keys, ["cycle"], {"_n": ("count", F.lit(1))}))
    last_break = running(
        run, keys, ["cycle"], {"_at": ("max", F.when(F.col("_broke"), F.col("_n")))}
    )
    streak = F.col("_n") - F.coalesce("_at", F.lit(0))
    return last_break.select(*keys, "cycle", "distance", streak.alias("streak"), (streak >= patience).alias("stop"))
