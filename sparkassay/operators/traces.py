"""Features of logged episodes: closest approach, message age, delivery, channel state and outcomes.

A trace is long form, one row per record. Ordered operators use sliced windows, so that one very long
episode is spread over many tasks; folded arrays come in time chunks for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_finite
from .ordering import running, with_neighbours
from .quantiles import exact_quantiles

# Shares of the reported age percentiles and the IMU overflow limit.
AGE_LEVELS = {"p90": 0.90, "p95": 0.95, "p99": 0.99, "p100": 1.0}
IMU_LIMIT = 1000.0
COLLISION_CAUSE = "col_shapes"


def valid_distance(d: Column) -> Column:
    return is_finite(d) & (d > -1.0)


def closest_approach(trace: DataFrame, keys: list[str], t: str, dist: str, order: str | None = None) -> DataFrame:
    """Smallest valid distance per episode and its time; the first of equal minima wins."""
    pos = F.col(order or t)
    best = F.when(valid_distance(F.col(dist)), F.struct(F.col(dist).alias("d"), pos.alias("o"), F.col(t).alias("t")))
    out = trace.groupBy(*keys).agg(F.min(best).alias("b"))
    return out.select(*keys, F.col("b.d").alias("min_d"), F.col("b.t").alias("t_min"))


def trace_tick_lookup(values: Column, t: Column, step: Column) -> Column:
    """Value of a per-tick array at time t: element int(t / step) - 1, NULL outside the array."""
    pos = F.floor(t / step).cast("int") - 1
    return F.when(pos >= 0, F.get(values, pos))


def speeds_at(closest: DataFrame, ticks: DataFrame, keys: list[str], step: int, cols: list[str]) -> DataFrame:
    """The same lookup against long-form ticks: (keys, tick, cols), with ticks counted from 0."""
    want = closest.withColumn("tick", F.floor(F.col("t_min") / step).cast("bigint") - 1)
    return want.join(ticks.select(*keys, "tick", *cols), [*keys, "tick"], "left")


def age_windows(messages: DataFrame, closest: DataFrame, keys: list[str]) -> DataFrame:
    """Messages with the windows they belong to: all of them, and those up to the closest approach.

    The second window exists only where a message carries exactly that time.
    """
    timed = messages.join(closest.select(*keys, "t_min"), keys, "left")
    exact = timed.where(F.col("t") == F.col("t_min")).select(*keys).distinct().withColumn("_x", F.lit(True))
    both = timed.join(exact, keys, "left")
    names = F.filter(
        F.array(F.lit("first_last"), F.when(F.col("_x") & (F.col("t") <= F.col("t_min")), F.lit("first_min_dist"))),
        lambda w: w.isNotNull(),
    )
    return both.withColumn("window", F.explode(names)).drop("_x", "t_min")


def aoi_stats(windowed: DataFrame, keys: list[str], age: str = "aoi") -> DataFrame:
    """Mean and percentiles of the finite ages per episode and window."""
    by = [*keys, "window"]
    clean = windowed.where(is_finite(F.col(age)))
    mean = clean.groupBy(*by).agg(F.avg(age).alias("mean"), F.count(F.lit(1)).alias("n"))
    return mean.join(exact_quantiles(clean, by, F.col(age), AGE_LEVELS), by)


def aoi_peaks(messages: DataFrame, keys: list[str], order: list[str], age: str = "aoi") -> DataFrame:
    """Number and mean of the values strictly above both neighbours; no peak gives NULL."""
    near = with_neighbours(messages.select(*keys, *order, age), keys, order, [age])
    top = (F.col(age) > F.col(f"prev.{age}")) & (F.col(age) > F.col(f"next.{age}"))
    peak = F.when(F.coalesce(top, F.lit(False)), F.col(age))
    return near.groupBy(*keys).agg(F.count(peak).alias("n_peaks"), F.avg(peak).alias("mean_peak"))


def trace_fold(
    events: DataFrame, keys: list[str], order: list[str], cols: dict[str, Column], chunk: Column
) -> DataFrame:
    """Ordered arrays per (keys, chunk). A chunk spans a fixed stretch of time, so its length is bounded
    by the tick rate; the arrays of an episode are the chunks in order."""
    item = F.struct(*order, *[c.alias(f"_v{i}") for i, c in enumerate(cols.values())])
    folded = events.withColumn("chunk", chunk).groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(item)).alias("_items")
    )
    return folded.select(
        *keys, "chunk", F.size("_items").alias("len"), *[F.col(f"_items._v{i}").alias(n) for i, n in enumerate(cols)]
    )


def imu_clean(a: Column) -> Column:
    return F.when(a < IMU_LIMIT, a).otherwise(F.lit(0.0))


def comm_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Online share and dropped packets per episode: ``records`` has ``online`` and ``dropped``."""
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("online").cast("double")).alias("online_share"),
        F.count_if("dropped").alias("dropped"),
    )


def drops_by_sender(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.where("dropped").groupBy(*keys, "sender").agg(F.count(F.lit(1)).alias("dropped"))


def sensor_outcome_counts(records: DataFrame, keys: list[str] = ("sender", "region", "outcome")) -> DataFrame:
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def episode_outcome(endings: DataFrame) -> DataFrame:
    """Collision flag from the termination cause, and the duration."""
    return endings.select(
        "episode",
        F.coalesce(F.col("cause") == COLLISION_CAUSE, F.lit(False)).alias("collided"),
        (F.col("t_end") - F.col("t_start")).alias("duration"),
    )


def latest_message_asof(
    decisions: DataFrame, messages: DataFrame, keys: list[str], decision_id: str = "decision"
) -> DataFrame:
    """Freshest message received at or before each decision, and its age.

    ``decisions``: keys, t, decision id. ``messages``: keys, t (received), time_stamp, msg_id. One
    union and a running maximum instead of a range join.
    """
    d = decisions.select(
        *keys, "t", F.lit(1).alias("_kind"), F.col(decision_id).alias("_id"), F.lit(None).cast("bigint").alias("_ts"),
        F.lit(None).cast("bigint").alias("_msg"),
    )
    m = messages.select(
        *keys, "t", F.lit(0).alias("_kind"), F.col("msg_id").cast("bigint").alias("_id"),
        F.col("time_stamp").cast("bigint").alias("_ts"), F.col("msg_id").cast("bigint").alias("_msg"),
    )
    seen = F.when(F.col("_msg").isNotNull(), F.struct("_ts", "_msg"))
    run = running(d.unionByName(m), keys, ["t", "_kind", "_id"], {"_best": ("max", seen)})
    return run.where("_kind = 1").select(
        *keys,
        F.col("_id").alias(decision_id),
        "t",
        F.col("_best._msg").alias("msg_id"),
        (F.col("t") - F.col("_best._ts")).alias("age"),
    )


def message_delivery(
    ingress: DataFrame, polls: DataFrame, keys: list[str], outages: DataFrame | None = None
) -> DataFrame:
    """When each offered message is handed over: (keys, msg_id, status, delivered_t).

    ``ingress``: keys, msg_id, t, delay, dropped. ``polls``: keys, t. ``outages``: keys, t_from, t_to,
    offline in t_from < t <= t_to (one per key). A message waits for the first online poll at or after
    t + delay: a running minimum over falling time.
    """
    offer, poll = ingress, polls
    if outages is not None:
        offer, poll = (
            x.join(outages, keys, "left").withColumn(
                "_off", F.coalesce((F.col("t") > F.col("t_from")) & (F.col("t") <= F.col("t_to")), F.lit(False))
            )
            for x in (ingress, polls)
        )
    else:
        offer, poll = (x.withColumn("_off", F.lit(False)) for x in (ingress, polls))
    waiting = offer.where(~F.col("_off") & ~F.col("dropped"))
    marks = waiting.select(
        *keys, (-(F.col("t") + F.col("delay"))).alias("_back"), F.lit(1).alias("_kind"), F.col("msg_id")
    ).unionByName(
        poll.where(~F.col("_off")).select(
            *keys, (-F.col("t")).alias("_back"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("msg_id")
        )
    )
    next_poll = F.when(F.col("_kind") == 0, -F.col("_back"))
    run = running(marks, keys, ["_back", "_kind", "msg_id"], {"delivered_t": ("min", next_poll)})
    got = run.where("_kind = 1").select(
        *keys,
        "msg_id",
        F.when(F.col("delivered_t").isNull(), "in_flight").otherwise("delivered").alias("status"),
        "delivered_t",
    )
    lost = offer.where(F.col("_off") | F.col("dropped")).select(
        *keys,
        "msg_id",
        F.when(F.col("_off"), "refused").otherwise("dropped").alias("status"),
        F.lit(None).cast("bigint").alias("delivered_t"),
    )
    return got.unionByName(lost)


def fault_onset(ticks: DataFrame, triggers: DataFrame, keys: list[str], duration: Column) -> DataFrame:
    """The one outage per episode: it starts with the first tick at or after the trigger."""
    hit = ticks.join(triggers, keys).where(F.col("t") >= F.col("trigger"))
    first = hit.groupBy(*keys).agg(F.min("t").alias("t_from"))
    return first.withColumn("t_to", F.col("t_from") + duration)


def fault_state(ticks: DataFrame, triggers: DataFrame, keys: list[str], duration: Column) -> DataFrame:
    """Online flag per tick. The triggering tick still reports online; the outage lasts while
    elapsed <= duration and does not come back."""
    onset = fault_onset(ticks, triggers, keys, duration)
    off = (F.col("t") > F.col("t_from")) & (F.col("t") <= F.col("t_to"))
    return ticks.join(onset, keys, "left").withColumn("online", ~F.coalesce(off, F.lit(False))).drop("t_from", "t_to")


def bias_window_active(
    draws: DataFrame, keys: list[str], order: list[str], *, t: str, success: str, start: int, end: int, until: int | None
) -> DataFrame:
    """Whether a conditional proposal applies to each draw: inside the inclusive window and, when
    ``until`` is set, fewer than that many earlier successes."""
    inside = F.col(t).between(start, end)
    if until is None:
        return draws.withColumn("active", inside)
    counted = running(
        draws, keys, order, {"_before": ("sum", F.col(success).cast("bigint"))}, include_current=False
    )
    return counted.withColumn("active", inside & (F.coalesce("_before", F.lit(0)) < until)).drop("_before")


def data_association(messages: DataFrame, keys: list[str], target: str, chunk: Column) -> DataFrame:
    """Messages per observed target in arrival order, in bounded chunks."""
    return trace_fold(messages, [*keys, target], ["t", "msg_id"], {"messages": F.col("msg_id")}, chunk)


def draw_sums(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Log ratio and number of draws per episode (component NULL) and per component, in one rollup.

    ``invalid`` counts NaN or missing ratios; a sum with any is NULL.
    """
    bad = F.col("log_ratio").isNull() | F.isnan("log_ratio")
    return (
        draws.rollup(*keys, "component")
        .agg(
            F.when(F.count_if(bad) == 0, F.sum("log_ratio")).alias("log_ratio"),
            F.count(F.lit(1)).alias("draws"),
            F.count_if(bad).alias("invalid"),
        )
        .where(F.col(keys[0]).isNotNull())
    )


def proposal_sums(draws: DataFrame, keys: list[str]) -> DataFrame:
    """The same per audit proposal; ``proposal_log_ratios`` maps proposal to log ratio."""
    flat = draws.select(*keys, F.explode("proposal_log_ratios").alias("proposal", "log_ratio"))
    return flat.groupBy(*keys, "proposal").agg(F.sum("log_ratio").alias("log_ratio"), F.count(F.lit(1)).alias("draws"))


def proposal_params(designs: DataFrame, plan: dict[str, float], scales: list[float]) -> DataFrame:
    """Proposal laws per design and scale, with the rule they break (NULL when usable).

    ``plan`` keys: miss_scale, jitter_scale, trigger_var_scale (multiplicative) and delay_min_add,
    delay_avg_add, drop_add, trigger_mean_add, unc_pos_add, unc_vel_add (additive). Scale 0 is the
    nominal law.
    """
    multiplicative = ("miss_scale", "jitter_scale", "trigger_var_scale")
    additive = ("delay_min_add", "delay_avg_add", "drop_add", "trigger_mean_add", "unc_pos_add", "unc_vel_add")
    rows = designs.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    scaled = {k: 1.0 + (F.lit(plan.get(k, 1.0)) - 1.0) * F.col("scale") for k in multiplicative}
    scaled |= {k: F.lit(plan.get(k, 0.0)) * F.col("scale") for k in additive}
    rows = rows.withColumns({f"_{k}": v for k, v in scaled.items()})
    base = F.col("packet_drop_rate")
    cols = {
        "delay_min": F.col("network_delay_min") + F.col("_delay_min_add"),
        "delay_avg": F.col("network_delay_avg") + F.col("_delay_avg_add"),
        "jitter": F.col("network_jit") * F.col("_jitter_scale"),
        "drop": base + F.col("_drop_add"),
    }
    rows = rows.withColumns(cols)
    lost = ((base > 0) & (F.col("drop") <= 0)) | ((base < 1) & (F.col("drop") >= 1))
    rule = (
        F.when(lost, "drop_support")
        .when(F.col("delay_avg") <= F.col("delay_min"), "delay_order")
        .when(F.col("jitter") <= 0, "jitter_positive")
    )
    identity = F.lit(True)
    for k in multiplicative:
        identity = identity & (F.col(f"_{k}") == 1.0)
    for k in additive:
        identity = identity & (F.col(f"_{k}") == 0.0)
    return rows.select(
        "gidx",
        "scale",
        *cols,
        F.col("_miss_scale").alias("miss_scale"),
        F.col("_trigger_mean_add").alias("trigger_mean_add"),
        F.col("_trigger_var_scale").alias("trigger_var_scale"),
        identity.alias("is_identity"),
        rule.alias("rule"),
    )
