"""Per-design statistics of margins and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.numeric import finite_or_null, is_finite
from .episodes import keep_first
from .quantiles import exact_quantiles
from .sequential import first_trials

# Floors of the margin statistics and the spread used when no design has two trials.
VAR_FLOOR, NOISE_FLOOR, LONE_VAR = 1e-6, 1e-5, 1e-4
MODES = ("min", "max", "mean", "median")


def margin_stats(
    margins: DataFrame, min_n: int = 1, var_floor: float = VAR_FLOOR, noise_floor: float = NOISE_FLOOR
) -> DataFrame:
    """Mean, spread and noise of the margins per design.

    A design with one trial takes the median spread of the others.
    """
    per = (
        margins.where(F.col("margin").isNotNull())
        .groupBy("gidx")
        .agg(F.avg("margin").alias("y"), F.var_samp("margin").alias("_v"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_n)
    )
    middle = exact_quantiles(per, [], F.col("_v"), {"m": 0.5}).scalar()
    var = F.greatest(F.coalesce("_v", middle, F.lit(LONE_VAR)), F.lit(var_floor))
    return per.withColumn("var", var).select(
        "gidx",
        "y",
        "n",
        "var",
        F.greatest(F.col("var") / F.col("n"), F.lit(noise_floor)).alias("alpha"),
        F.ln(F.col("var") + var_floor).alias("log_var"),
        F.col("_v").isNull().alias("fallback"),
    )


def training_rows(
    trials: DataFrame, order: list[str], margin: Column, min_eps: int = 30, max_eps: int = 60
) -> DataFrame:
    """One row per usable trial with a weight that gives every design the same total, mean weight 1."""
    first = first_trials(trials, ["gidx"], order, max_eps).withColumn("margin", margin)
    kept = first.where(is_finite(F.col("margin"))).select("gidx", "margin", "n")
    counts = kept.groupBy("gidx").agg(F.count(F.lit(1)).alias("n_d")).where(F.col("n_d") >= min_eps)
    totals = counts.agg((F.sum("n_d") / F.count(F.lit(1))).alias("r")).scalar()
    sized = kept.withColumn("n_d", F.count(F.lit(1)).over(Window.partitionBy("gidx")))
    return sized.where(F.col("n_d") >= min_eps).select(
        "gidx", "margin", F.col("n").alias("ord"), (totals / F.col("n_d")).alias("weight")
    )


def training_summary(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("gidx").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.count(F.lit(1)).alias("designs"),
        F.sum("c").alias("rows"),
        F.min("c").alias("min_eps"),
        F.max("c").alias("max_eps"),
        F.avg("c").alias("mean_eps"),
    )


def metric_agg(rows: DataFrame, keys: list[str], mode: str, value: str = "value") -> DataFrame:
    """Aggregate the finite values per key; a key without any gives NaN."""
    if mode not in MODES:
        raise ValueError(f"unknown aggregation {mode!r}")
    nan = F.lit(float("nan"))
    clean = rows.select(*keys, finite_or_null(F.col(value)).alias("_x"))
    if mode == "median":
        mid = exact_quantiles(clean, keys, F.col("_x"), {"value": 0.5})
        every = clean.select(*keys).distinct()
        return every.join(mid, keys, "left").withColumn("value", F.coalesce("value", nan))
    agg = {"min": F.min, "max": F.max, "mean": F.avg}[mode]
    return clean.groupBy(*keys).agg(F.coalesce(agg("_x"), nan).alias("value"))


def metric_agg_noise(rows: DataFrame, keys: list[str], mode: str, value: str = "value") -> DataFrame:
    """As ``metric_agg`` with the variance of the mean; other modes have no variance.

    Sums of decimal values are exact and each result is one division of them, so it is the same to the bit in any order of
    rows; those of doubles follow that order in their last digits. n * sum(x * x), counted in units of the last digit, has 38 digits.
    """
    kind = rows.schema[value].dataType
    if mode != "mean":
        rows = rows.withColumn(value, F.col(value).cast("double")) if isinstance(kind, DecimalType) else rows
        return metric_agg(rows, keys, mode, value).withColumn("var", F.lit(None).cast("double"))
    nan = F.lit(float("nan"))
    if isinstance(kind, DecimalType):
        unit, whole = 10.0**kind.scale, "decimal(38,0)"
        x = (F.col(value).cast(f"decimal(38,{kind.scale})") * 10**kind.scale).cast(whole)
        sums = rows.groupBy(*keys).agg(F.count(x).alias("_n"), F.sum(x).cast(whole).alias("_s"), F.sum((x * x).cast(whole)).cast(whole).alias("_q"))
        n = F.col("_n")
        spread = ((n.cast(whole) * F.col("_q")).cast(whole) - (F.col("_s") * F.col("_s")).cast(whole)).cast("double")
        pairs = n.cast("double") * n.cast("double") * (n - 1).cast("double") * (unit * unit)
        return sums.select(
            *keys,
            F.coalesce(F.try_divide(F.col("_s").cast("double"), n.cast("double") * unit), nan).alias("value"),
            F.when(n == 1, F.lit(0.0)).when(n > 1, F.try_divide(spread, pairs)).alias("var"),
        )
    x = finite_or_null(F.col(value))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.avg(x), nan).alias("value"),
        F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.try_divide(F.var_samp(x), F.count(x))).alias("var"),
    )


def fixed_replication(rows: DataFrame, repetitions: int, order: list[str], seed: str | None = None) -> DataFrame:
    """Exactly the first R finite values per (gidx, scenario); ``short`` marks incomplete groups."""
    keys = ["gidx", "scenario"]
    if seed is not None:
        rows = keep_first(rows, [*keys, seed], order)
    first = first_trials(rows.where(is_finite(F.col("value"))), keys, order, repetitions)
    have = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return first.select(*keys, F.col("n").alias("ord"), "value", (have < repetitions).alias("short"))


def portfolio_objective(per_scenario: DataFrame, scenarios: int, mode: str, maximize: bool) -> DataFrame:
    """Combine per-scenario (value, var) into one objective to minimise.

    The noise of an equally weighted mean exists only if every scenario has one.
    """
    combine = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median}[mode]
    noise = F.when(
        (F.count(finite_or_null(F.col("var"))) == scenarios) & F.lit(mode == "mean"),
        F.sum("var") / (scenarios * scenarios),
    )
    out = per_scenario.groupBy("gidx").agg(combine("value").alias("metric"), noise.alias("obs_var"))
    return out.select("gidx", "metric", (-F.col("metric") if maximize else F.col("metric")).alias("obj_perf"), "obs_var")
