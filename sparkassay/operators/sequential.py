"""Sequential labelling of designs from their ordered trials.

A test needs at most ``cap`` trials of a design. ``row_number() <= cap`` is planned by Spark as a group
limit before the shuffle, so a design that holds a third of all rows still sends at most ``cap`` rows
per map task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import passing_failures
from .ordering import row_numbers


@dataclass(frozen=True)
class SequentialRule:
    """Parameters of the Wald test with exact-binomial shortcuts."""

    p: float = 0.05
    confidence: float = 0.95
    p1_factor: float = 0.5
    beta_err: float = 0.2
    cap: int = 80

    @property
    def alpha(self) -> float:
        return 1.0 - self.confidence

    @property
    def clean_needed(self) -> int:
        return ceil(log(self.alpha) / log(1.0 - self.p))

    @property
    def log_a(self) -> float:
        return log((1.0 - self.beta_err) / self.alpha)

    @property
    def log_b(self) -> float:
        return log(self.beta_err / (1.0 - self.alpha))

    @property
    def fail_step(self) -> float:
        return log(self.p1_factor)

    @property
    def clean_step(self) -> float:
        return log((1.0 - self.p1_factor * self.p) / (1.0 - self.p))

    @property
    def cap_k(self) -> int:
        return passing_failures(self.cap, self.p, self.alpha)


def log_likelihood(n: Column, k: Column, rule: SequentialRule) -> Column:
    return k * F.lit(rule.fail_step) + (n - k) * F.lit(rule.clean_step)


def stop_mode(n: Column, k: Column, rule: SequentialRule) -> Column:
    """The stopping rule that fires at counts (n, k), in priority order; NULL while undecided."""
    llr = log_likelihood(n, k, rule)
    return (
        F.when((k == 0) & (n >= rule.clean_needed), "CP_K0")
        .when(llr >= rule.log_a, "WALD_SAFE")
        .when(llr <= rule.log_b, "WALD_UNSAFE")
        .when((n >= rule.cap) & (k <= rule.cap_k), "CP_CAP")
        .when(n >= rule.cap, "CAP_UNSAFE")
    )


def stop_at(n: int, k: int, rule: SequentialRule) -> str | None:
    """``stop_mode`` at one pair of counts."""
    llr = k * rule.fail_step + (n - k) * rule.clean_step
    fired = (
        ("CP_K0", k == 0 and n >= rule.clean_needed),
        ("WALD_SAFE", llr >= rule.log_a),
        ("WALD_UNSAFE", llr <= rule.log_b),
        ("CP_CAP", n >= rule.cap and k <= rule.cap_k),
        ("CAP_UNSAFE", n >= rule.cap),
    )
    return next((mode for mode, yes in fired if yes), None)


def clean_only_mode(n: Column, k: Column, rule: SequentialRule) -> Column:
    """Stop at the first failure, after enough clean trials, or at the cap."""
    return (
        F.when(k > 0, "OBS_FAIL")
        .when(n >= rule.clean_needed, "CP_K0")
        .when((n >= rule.cap) & (k <= rule.cap_k), "CP_CAP")
        .when(n >= rule.cap, "CAP_UNSAFE")
    )


def mode_label(mode: Column) -> Column:
    """1 safe, 0 unsafe, NULL undecided."""
    return F.when(mode.isin("CP_K0", "WALD_SAFE", "CP_CAP"), F.lit(1)).when(mode.isNotNull(), F.lit(0)).cast("int")


def first_trials(trials: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows per key with their position ``n``.

    Spark cuts a key before the shuffle only up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows; beyond it the
    positions come from sliced windows, so a hot key is not sorted in one task either way.
    """
    if limit > int(trials.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return row_numbers(trials, keys, order, "n").where(F.col("n") <= limit)
    w = Window.partitionBy(*keys).orderBy(*order)
    return trials.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def sprt_path(trials: DataFrame, keys: list[str], order: list[str], unsafe: Column, rule: SequentialRule) -> DataFrame:
    """Counts and log likelihood after every trial, up to the cap."""
    slim = trials.select(*keys, *[c for c in order if c not in keys], unsafe.cast("int").alias("_u"))
    so_far = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    path = first_trials(slim, keys, order, rule.cap).withColumn("k", F.sum("_u").over(so_far))
    return path.select(
        *keys,
        F.col("n").cast("bigint").alias("n"),
        F.col("k").cast("bigint").alias("k"),
        log_likelihood(F.col("n"), F.col("k"), rule).alias("llr"),
    )


def _first_stop(path: DataFrame, keys: list[str], mode: Column) -> DataFrame:
    """Earliest row at which ``mode`` is set, or the last row where it never is."""
    rows = path.withColumn("mode", mode)
    pick = F.struct(F.col("mode").isNull().cast("int").alias("open"), F.when(F.col("mode").isNull(), -F.col("n")).otherwise(F.col("n")).alias("at"))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("mode", "n", "k", "llr"), pick).alias("s"))
    return best.select(
        *keys,
        mode_label(F.col("s.mode")).alias("label"),
        F.coalesce("s.mode", F.lit("INSUFFICIENT_EPISODES")).alias("mode"),
        F.col("s.n").alias("n"),
        F.col("s.k").alias("k"),
        F.col("s.llr").alias("llr"),
    )


def sprt_label(
    trials: DataFrame, keys: list[str], order: list[str], unsafe: Column, rule: SequentialRule = SequentialRule()
) -> DataFrame:
    path = sprt_path(trials, keys, order, unsafe, rule)
    return _first_stop(path, keys, stop_mode(F.col("n"), F.col("k"), rule))


def cp_only_label(
    trials: DataFrame, keys: list[str], order: list[str], unsafe: Column, rule: SequentialRule = SequentialRule()
) -> DataFrame:
    path = sprt_path(trials, keys, order, unsafe, rule)
    return _first_stop(path, keys, clean_only_mode(F.col("n"), F.col("k"), rule))


def remaining(n: Column, k: Column, rule: SequentialRule) -> Column:
    """Fewest further trials that could decide, assuming all clean or all failing."""
    llr = log_likelihood(n, k, rule)
    options = [
        F.when((k == 0) & (n < rule.clean_needed), rule.clean_needed - n),
        F.when(llr < rule.log_a, F.ceil((rule.log_a - llr) / rule.clean_step)),
        F.when(llr > rule.log_b, F.ceil((llr - rule.log_b) / -rule.fail_step)),
        F.when(n < rule.cap, rule.cap - n),
    ]
    need = F.greatest(F.lit(0), F.least(*[o.cast("bigint") for o in options]))
    return F.when(stop_mode(n, k, rule).isNotNull(), F.lit(0)).otherwise(F.coalesce(need, F.lit(0))).cast("bigint")


def sprt_remaining(labels: DataFrame, rule: SequentialRule = SequentialRule()) -> DataFrame:
    return labels.withColumn("need", remaining(F.col("n"), F.col("k"), rule))


def label_summary(
    labels: DataFrame, trials: DataFrame, designs: DataFrame, scenarios: DataFrame, rule: SequentialRule = SequentialRule()
) -> DataFrame:
    """Per scenario: how much of the grid is decided, what is missing and the distances of unsafe designs.

    ``labels``: scenario, gidx, label, n, k. ``trials``: scenario, gidx, min_d. ``designs``: gidx.
    ``scenarios``: the distinct scenarios. The grid is never multiplied by the scenarios: undecided
    designs come from the labels, and absent ones are the grid total minus the labelled designs in it.
    """
    grid = designs.select("gidx").distinct().withColumn("_g", F.lit(True))
    need = remaining(F.col("n"), F.col("k"), rule)
    decided, inside = F.col("label").isNotNull(), F.coalesce("_g", F.lit(False))
    everywhere = labels.join(grid, "gidx", "left").groupBy("scenario").agg(
        F.count(F.lit(1)).alias("designs"),
        F.count_if(decided).alias("labelled"),
        F.count_if(~decided).alias("insufficient"),
        F.count_if(inside).alias("_in"),
        F.count_if(inside & decided).alias("grid_labelled"),
        F.sum(F.when(inside & ~decided, need).otherwise(0)).alias("_open_need"),
    )
    unsafe = labels.where("label = 0").select("scenario", "gidx")
    span = (
        trials.join(unsafe, ["scenario", "gidx"], "left_semi")
        .groupBy("scenario")
        .agg(F.min("min_d").alias("min_d_lo"), F.max("min_d").alias("min_d_hi"))
    )
    total = designs.agg(F.count_distinct("gidx").alias("n")).scalar()
    out = scenarios.join(everywhere, "scenario", "left").join(span, "scenario", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select(
        "scenario",
        zero("designs").alias("designs"),
        zero("labelled").alias("labelled"),
        zero("insufficient").alias("insufficient"),
        total.alias("grid_total"),
        zero("grid_labelled").alias("grid_labelled"),
        (total - zero("grid_labelled")).alias("grid_missing"),
        (zero("_open_need") + (total - zero("_in")) * rule.cap).alias("eps_needed"),
        "min_d_lo",
        "min_d_hi",
    )
