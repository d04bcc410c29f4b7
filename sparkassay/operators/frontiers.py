"""Two-objective frontiers, hypervolume, scalarisation and the rolling operational gate."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import last_rows, row_numbers, running, with_neighbours
from ..functions.seeds import hash_uniform


def _staircase(points: DataFrame, keys: list[str], cost: str, perf: str, *extra: Column) -> DataFrame:
    """Best perf per distinct cost next to the best perf of all cheaper points (``_prev``)."""
    best = points.groupBy(*keys, cost).agg(F.min(perf).alias("_best"), *extra)
    return running(best, keys, [cost], {"_prev": ("min", F.col("_best"))}, include_current=False)


def non_dominated(points: DataFrame, keys: list[str], cost: str, perf: str) -> DataFrame:
    """Rows with no other row at most as large in both objectives and smaller in one; ties all stay.

    Instead of comparing pairs: the minimum per cost must beat the running minimum over cheaper costs.
    """
    steps = _staircase(points, keys, cost, perf)
    edge = steps.where(F.col("_prev").isNull() | (F.col("_best") < F.col("_prev"))).select(
        *keys, cost, F.col("_best").alias(perf)
    )
    return points.join(edge, [*keys, cost, perf], "left_semi")


def hypervolume_2d(points: DataFrame, keys: list[str], cost: str, perf: str, ref: tuple[float, float]) -> DataFrame:
    """Dominated area per key. ``outside`` counts points the reference does not cover; hv is NULL then."""
    beyond = F.count_if((F.col(cost) > ref[0]) | (F.col(perf) > ref[1])).alias("_out")
    steps = _staircase(points, keys, cost, perf, beyond)
    prev = F.least(F.lit(ref[1]), F.coalesce("_prev", F.lit(ref[1])))
    gain = (F.lit(ref[0]) - F.col(cost)) * F.greatest(F.lit(0.0), prev - F.col("_best"))
    area = steps.groupBy(*keys).agg(F.sum(gain).alias("_hv"), F.sum("_out").alias("outside"))
    return area.withColumn("hv", F.when(F.col("outside") == 0, F.col("_hv"))).drop("_hv")


def hypervolume_history(
    history: DataFrame, keys: list[str], ref: tuple[float, float], block: int = 2048
) -> DataFrame:
    """Gain and total area after every iteration of each run: (keys, iter, hv, delta).

    A run is cut into blocks of iterations. The frontier left by all earlier blocks enters a block as
    its starting point, so blocks run side by side; totals are running sums of the gains.
    """
    if not keys:
        raise ValueError("name the column that identifies a run")
    pts = row_numbers(history.select(*keys, "iter", "cost", "perf"), keys, ["iter"], "_pos")
    pts = pts.withColumn("_block", F.floor((F.col("_pos") - 1) / block).cast("bigint"))
    local = non_dominated(pts, [*keys, "_block"], "cost", "perf").select(*keys, "_block", "cost", "perf").distinct()
    last = pts.groupBy(*keys).agg(F.max("_block").alias("_end"))
    later = (
        local.join(last, keys)
        .where(F.col("_block") < F.col("_end"))
        .select(*keys, "cost", "perf", F.explode(F.sequence(F.col("_block") + 1, F.col("_end"))).alias("_block"))
    )
    entering = non_dominated(later, [*keys, "_block"], "cost", "perf").distinct()
    rows = pts.select(*keys, "_block", F.col("iter").cast("bigint").alias("iter"), "cost", "perf").unionByName(
        entering.withColumn("iter", F.lit(None).cast("bigint"))
    )
    types = dict(history.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", iter bigint, delta double"

    def gains(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf[pdf["iter"].isna()].sort_values("cost")
        xs, ys = start["cost"].to_numpy(float), start["perf"].to_numpy(float)
        mine = pdf[pdf["iter"].notna()].sort_values("iter")
        out = np.zeros(len(mine))
        for i, (c, p) in enumerate(zip(mine["cost"].to_numpy(float), mine["perf"].to_numpy(float))):
            at = int(np.searchsorted(xs, c, side="right"))
            ceiling = min(ref[1], ys[at - 1]) if at else ref[1]
            if p >= ceiling or c >= ref[0]:
                continue
            # area gained runs to the right until a point at least as good takes over
            stop = at + int(np.searchsorted(-ys[at:], -p, side="left"))
            edges = np.concatenate([[c], xs[at:stop], [xs[stop] if stop < len(xs) else ref[0]]])
            edges = np.minimum(edges, ref[0])
            tops = np.minimum(np.concatenate([[ceiling], ys[at:stop]]), ref[1])
            out[i] = float(np.sum(np.diff(edges) * np.maximum(0.0, tops - p)))
            cut = at if not at or xs[at - 1] < c else at - 1
            xs = np.concatenate([xs[:cut], [c], xs[stop:]])
            ys = np.concatenate([ys[:cut], [p], ys[stop:]])
        res = mine[keys].copy()
        res["iter"] = mine["iter"].astype("int64")
        res["delta"] = out
        return res

    delta = rows.groupBy(*keys, "_block").applyInPandas(gains, schema)
    return running(delta, keys, ["iter"], {"hv": ("sum", F.col("delta"))})


def rolling_gate(
    history: DataFrame,
    keys: list[str],
    *,
    window: int,
    trials: int,
    scenarios: int,
    max_seconds: float,
    max_retries: float,
    prefix: int = 0,
) -> DataFrame:
    """Throughput and retry rate over the last ``window`` designs after an excluded prefix."""
    numbered = row_numbers(history, keys, ["iter"], "_n").where(F.col("_n") > prefix)
    rolled = last_rows(numbered, keys, ["iter"], window, {"_sec": F.col("seconds"), "_ret": F.col("retries")})
    paired = window * trials
    per_trial = F.col("_sec") / paired
    per_100 = 100.0 * F.col("_ret") / (paired * scenarios)
    warm = F.col("position") >= window
    slow, flaky = warm & (per_trial > max_seconds), warm & (per_100 > max_retries)
    breaches = F.filter(
        F.array(F.when(slow, F.lit("throughput")), F.when(flaky, F.lit("retry_rate"))), lambda x: x.isNotNull()
    )
    return rolled.select(
        *keys,
        "iter",
        F.when(~warm, "warming").when(F.size(breaches) > 0, "stopped").otherwise("passed").alias("status"),
        F.when(warm, per_trial).alias("seconds_per_trial"),
        F.when(warm, per_100).alias("retries_per_100"),
        F.array_join(breaches, ",").alias("breaches"),
    )


def frontier_steps(points: DataFrame, keys: list[str]) -> DataFrame:
    """Frontier in (metric, cost) order with the end of each step segment."""
    near = with_neighbours(points, keys, ["metric", "cost", "design_id"], ["metric", "cost"])
    return near.select(
        *keys, "design_id", "metric", "cost", F.col("next.metric").alias("metric_to"), F.col("next.cost").alias("cost_to")
    )


def frontier_delta(before: DataFrame, after: DataFrame, key: str = "gidx") -> DataFrame:
    """new, displaced or retained, per id."""
    a = before.select(key).distinct().withColumn("_a", F.lit(True))
    b = after.select(key).distinct().withColumn("_b", F.lit(True))
    status = (
        F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "displaced").otherwise(F.lit("retained"))
    )
    return a.join(b, key, "full").select(key, status.alias("status"))


def augmented_chebyshev(points: DataFrame, objectives: list[str], weights: list[Column | float], rho: float = 0.05) -> DataFrame:
    """Weighted max plus rho times the weighted sum of the min-max scaled objectives."""
    if rho < 0:
        raise ValueError("rho must not be negative")
    s = points.agg(
        F.struct(*[F.min(o).alias(f"lo{i}") for i, o in enumerate(objectives)],
                 *[F.max(o).alias(f"hi{i}") for i, o in enumerate(objectives)]).alias("s")
    ).scalar()
    terms = []
    for i, (o, w) in enumerate(zip(objectives, weights)):
        span = s[f"hi{i}"] - s[f"lo{i}"]
        scaled = F.when(span > 0, (F.col(o) - s[f"lo{i}"]) / span).otherwise(F.lit(0.0))
        terms.append((w if isinstance(w, Column) else F.lit(w)) * scaled)
    return points.withColumn("scalar", F.greatest(*terms) + rho * sum(terms[1:], terms[0]))


def dirichlet_weights(seed: Column, m: int) -> list[Column]:
    """Uniform point of the (m-1)-simplex from exponential spacings of hashed uniforms."""
    e = [-F.ln(hash_uniform(F.lit("simplex"), seed, F.lit(i))) for i in range(m)]
    tot = sum(e[1:], e[0])
    return [x / tot for x in e]


def heldout_means(trials: DataFrame, start: int, end: int) -> DataFrame:
    """Mean metric per design over ordinals start..end and whether the block is complete."""
    block = trials.where(F.col("ordinal").between(start, end))
    return block.groupBy("design_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("metric").alias("mean"),
        ((F.count_distinct("ordinal") == end - start + 1) & (F.count(F.lit(1)) == end - start + 1)).alias("complete"),
    )


