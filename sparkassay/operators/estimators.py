"""Rare-event estimates from importance-weighted rows, many jobs in one pass.

Weights span hundreds of orders of magnitude, so sums are taken per band of 64 log units with the
band's own shift: one map-side combined aggregation whose output has a few rows per job. The bands of
a job are then rescaled to its largest weight, which needs no second pass over the rows.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import with_cp_lower, with_cp_upper
from ..functions.numeric import is_finite, lit_inf, ratio, safe_exp

BAND = 64.0
METHOD_IS = "asymptotic-log-scale-normal-delta-two-sided"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def z_two_sided(delta: float) -> float:
    return NormalDist().inv_cdf(1.0 - delta / 2.0)


def bad_weight() -> Column:
    lw = F.col("log_weight")
    return lw.isNull() | F.isnan(lw) | (lw == lit_inf())


def invalid_weights(rows: DataFrame) -> DataFrame:
    """Rows whose log weight is missing, NaN or +inf; the estimate of a key with any of them is NULL."""
    return rows.where(bad_weight())


def _told(df: DataFrame) -> DataFrame:
    """NaN, which a bad weight leaves in every sum of its key, shown as NULL."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def _banded(rows: DataFrame, keys: list[str], hit: Column | str) -> DataFrame:
    """Per (keys, band): counts, sums and centred second moment of w * hit, on the scale of the key's top band."""
    lw = F.col("log_weight")
    band = F.when(is_finite(lw), F.floor(lw / BAND)).cast("double")
    base = rows.select(
        *keys, lw.alias("_lw"), band.alias("_b"), _col(hit).cast("boolean").alias("_hit"), bad_weight().alias("_bad")
    )
    w = F.when(F.col("_bad"), F.lit(float("nan"))).when(F.col("_b").isNotNull(), F.exp(F.col("_lw") - F.col("_b") * BAND))
    w = w.otherwise(F.lit(0.0))
    y = F.when(F.col("_hit") | F.col("_bad"), F.col("_w")).otherwise(F.lit(0.0))
    part = (
        base.withColumn("_w", w)
        .withColumn("_y", y)
        .groupBy(*keys, "_b")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("_hit").alias("hits"),
            F.sum("_w").alias("sw"),
            F.sum(F.col("_w") * F.col("_w")).alias("sw2"),
            F.max("_w").alias("mw"),
            F.sum("_y").alias("sy"),
            F.sum(F.col("_y") * F.col("_y")).alias("sy2"),
            F.max("_y").alias("my"),
            (F.var_pop("_y") * F.count(F.lit(1))).alias("m2"),
        )
    )
    top = F.max("_b").over(Window.partitionBy(*keys))
    scale = F.coalesce(F.exp((F.col("_b") - F.col("_top")) * BAND), F.lit(0.0))
    return (
        part.withColumn("_top", top)
        .withColumn("_s", scale)
        .select(
            *keys,
            (F.col("_top") * BAND).alias("shift"),
            "n",
            "hits",
            *[(F.col(c) * F.col("_s")).alias(c) for c in ("sw", "sy", "mw", "my")],
            *[(F.col(c) * F.col("_s") * F.col("_s")).alias(c) for c in ("sw2", "sy2", "m2")],
        )
    )


def _joined(banded: DataFrame, keys: list[str]) -> DataFrame:
    """Combine the bands of a key (count-weighted combination of means and second moments)."""
    out = banded.groupBy(*keys).agg(
        F.max("shift").alias("shift"),
        F.sum("n").alias("n"),
        F.sum("hits").alias("hits"),
        F.sum("sw").alias("sw"),
        F.sum("sw2").alias("sw2"),
        F.max("mw").alias("mw"),
        F.sum("sy").alias("sy"),
        F.sum("sy2").alias("sy2"),
        F.max("my").alias("my"),
        F.sum("m2").alias("m2"),
        F.sum(F.col("sy") * F.col("sy") / F.col("n")).alias("_b2"),
    )
    between = F.greatest(F.lit(0.0), F.col("_b2") - F.col("sy") * F.col("sy") / F.col("n"))
    return out.withColumn("m2", F.col("m2") + between).drop("_b2")


def _diagnostics() -> dict[str, Column]:
    n, sw, sw2 = F.col("n"), F.col("sw"), F.col("sw2")
    ess = F.coalesce(ratio(sw * sw, sw2), F.lit(0.0))
    log_mean = F.when(sw > 0, F.col("shift") + F.ln(sw / n)).otherwise(lit_inf(-1))
    return {
        "ess": ess,
        "ess_ratio": ess / n,
        "max_norm_w": ratio(F.col("mw"), sw),
        "log_mean_w": log_mean,
        "mean_w": safe_exp(log_mean),
    }


def weight_diagnostics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap of proposal and nominal law per key; -inf is weight zero."""
    sums = _joined(_banded(rows, keys, F.lit(False)), keys)
    return _told(sums.select(*keys, "n", *[c.alias(n) for n, c in _diagnostics().items()]))


def _log_ci(log_est: Column, rse: Column, delta: float) -> tuple[Column, Column]:
    half = z_two_sided(delta) * F.greatest(F.lit(0.0), rse)
    return safe_exp(log_est - half), F.least(F.lit(1.0), safe_exp(log_est + half))


def is_estimate(rows: DataFrame, keys: list[str], hit: Column | str, delta: float = 0.05) -> DataFrame:
    """Weighted mean of hits with error, hit ESS, log-scale interval and self-normalised estimate."""
    return _told(_finish_is(_joined(_banded(rows, keys, hit), keys), keys, delta))


def _finish_is(sums: DataFrame, keys: list[str], delta: float) -> DataFrame:
    n, sy, sw = F.col("n"), F.col("sy"), F.col("sw")
    log_est = F.when(sy > 0, F.col("shift") + F.ln(sy / n)).otherwise(lit_inf(-1))
    se_scaled = F.when(n > 1, F.sqrt(F.try_divide(F.greatest(F.lit(0.0), F.col("m2")), n - 1) / n)).otherwise(
        F.lit(0.0)
    )
    rse = ratio(se_scaled, sy / n)
    out = sums.withColumns({"_log_est": log_est, "_se": se_scaled, "rse": rse})
    se = F.when(F.col("_se") > 0, safe_exp(F.col("shift") + F.ln("_se"))).otherwise(F.lit(0.0))
    lo, hi = _log_ci(F.col("_log_est"), F.col("rse"), delta)
    zero = sy == 0
    shown = safe_exp(F.col("_log_est"))
    usable = shown.isNotNull() & se.isNotNull()
    return out.select(
        *keys,
        "n",
        "hits",
        shown.alias("estimate"),
        F.col("_log_est").alias("log_estimate"),
        se.alias("se"),
        "rse",
        F.coalesce(ratio(sy * sy, F.col("sy2")), F.lit(0.0)).alias("hit_ess"),
        F.when(zero, F.lit(0.0)).when(usable, lo).alias("ci_lo"),
        F.when(~zero & usable, hi).alias("ci_hi"),
        ratio(sy, sw).alias("snis"),
        ratio(F.col("my"), sy).alias("max_contrib"),
        *[c.alias(k) for k, c in _diagnostics().items()],
    )


def stratified_estimate(
    rows: DataFrame, keys: list[str], stratum: str, hit: Column | str, failure: Column | str, delta: float = 0.05
) -> DataFrame:
    """The same event under a fixed allocation: variance sum_h n_h s_h^2 / n^2.

    ``bad_strata`` counts strata that are unnamed or hold fewer than two rows; the estimate is NULL
    where there are any. ``strata`` lists the rows per stratum.
    """
    both = _joined_strata(rows, keys, stratum, hit)
    fails = _joined(_banded(rows, keys, failure), keys).select(
        *keys,
        F.col("hits").alias("failures"),
        F.coalesce(ratio(F.col("sy") * F.col("sy"), F.col("sy2")), F.lit(0.0)).alias("failure_ess"),
    )
    n, sy = F.col("n"), F.col("sy")
    log_est = F.when(sy > 0, F.col("shift") + F.ln(sy / n)).otherwise(lit_inf(-1))
    good = F.col("bad_strata") == 0
    se_scaled = F.sqrt(F.greatest(F.lit(0.0), F.col("var_sum"))) / n
    out = both.withColumns({"_log_est": log_est, "_se": se_scaled, "rse": ratio(se_scaled, sy / n)})
    lo, hi = _log_ci(F.col("_log_est"), F.col("rse"), delta)
    out = out.select(
        *keys,
        "n",
        F.col("hits").alias("events"),
        F.when(good, safe_exp(F.col("_log_est"))).alias("estimate"),
        F.when(good, F.when(F.col("_se") > 0, safe_exp(F.col("shift") + F.ln("_se"))).otherwise(F.lit(0.0))).alias("se"),
        F.when(good, F.col("rse")).alias("rse"),
        F.when(good & (sy > 0), lo).alias("ci_lo"),
        F.when(good & (sy > 0), hi).alias("ci_hi"),
        F.coalesce(ratio(sy * sy, F.col("sy2")), F.lit(0.0)).alias("event_ess"),
        ratio(F.col("my"), sy).alias("max_contrib"),
        "strata",
        "bad_strata",
        *[c.alias(k) for k, c in _diagnostics().items()],
    )
    return _told(out.join(fails, keys))


def _joined_strata(rows: DataFrame, keys: list[str], stratum: str, hit: Column | str) -> DataFrame:
    """Banded sums per stratum on the shift of the whole key, then the combination over strata."""
    named = rows.withColumn("_h", F.col(stratum))
    banded = _banded(named, [*keys, "_h"], hit)
    top = F.max("shift").over(Window.partitionBy(*keys))
    s = F.coalesce(F.exp(F.col("shift") - F.col("_top")), F.lit(0.0))
    level = banded.withColumn("_top", top).withColumn("_s", s)
    level = level.select(
        *keys,
        "_h",
        F.col("_top").alias("shift"),
        "n",
        "hits",
        *[(F.col(c) * F.col("_s")).alias(c) for c in ("sw", "sy", "mw", "my")],
        *[(F.col(c) * F.col("_s") * F.col("_s")).alias(c) for c in ("sw2", "sy2", "m2")],
    )
    per = _joined(level, [*keys, "_h"])
    size = F.col("n")
    return per.groupBy(*keys).agg(
        F.max("shift").alias("shift"),
        F.sum("n").alias("n"),
        F.sum("hits").alias("hits"),
        F.sum("sw").alias("sw"),
        F.sum("sw2").alias("sw2"),
        F.max("mw").alias("mw"),
        F.sum("sy").alias("sy"),
        F.sum("sy2").alias("sy2"),
        F.max("my").alias("my"),
        F.sum(size * F.try_divide(F.col("m2"), size - 1)).alias("var_sum"),
        F.count_if((size < 2) | F.col("_h").isNull()).alias("bad_strata"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("_h", F.lit("")), size)))).alias("strata"),
    )


def nominal_summary(rows: DataFrame, keys: list[str], hit: Column | str, delta: float = 0.05) -> DataFrame:
    """k of n with exact two-sided and one-sided bounds."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(_col(hit)).alias("k"))
    counts = counts.withColumn("p", F.col("k") / F.col("n"))
    counts = with_cp_lower(counts, "k", "n", F.lit(delta / 2), "lo")
    counts = with_cp_upper(counts, "k", "n", F.lit(delta / 2), "hi")
    return with_cp_upper(counts, "k", "n", F.lit(delta), "upper")


def severity_curve(
    rows: DataFrame, keys: list[str], distance: Column, thresholds: list[float], delta: float = 0.05
) -> DataFrame:
    """``is_estimate`` of "distance <= t" for every t, in one pass.

    Each row is added once, in the first threshold that contains it; the sums of a threshold are the
    running sums over its predecessors, so the rows are never multiplied by the thresholds.
    """
    ts = sorted(set(float(t) for t in thresholds))
    slot = F.lit(len(ts))
    for i in reversed(range(len(ts))):
        slot = F.when((distance <= ts[i]) & ~F.isnan(distance), F.lit(i)).otherwise(slot)
    banded = _banded(rows.withColumn("_slot", slot), [*keys, "_slot"], F.lit(True))
    kw = Window.partitionBy(*keys)
    level = banded.withColumn("_top", F.max("shift").over(kw))
    s = F.coalesce(F.exp(F.col("shift") - F.col("_top")), F.lit(0.0))
    level = level.withColumn("_s", s).select(
        *keys,
        "_slot",
        F.col("_top").alias("shift"),
        "n",
        *[(F.col(c) * F.col("_s")).alias(c) for c in ("sw", "mw")],
        *[(F.col(c) * F.col("_s") * F.col("_s")).alias(c) for c in ("sw2",)],
    )
    per = level.groupBy(*keys, "_slot").agg(
        F.max("shift").alias("shift"), F.sum("n").alias("n"), F.sum("sw").alias("sw"),
        F.sum("sw2").alias("sw2"), F.max("mw").alias("mw"),
    )
    # a threshold without rows of its own still has a row in the result
    frame = rows.select(*keys).distinct().withColumn(
        "_slot", F.explode(F.array(*[F.lit(i) for i in range(len(ts) + 1)]))
    )
    full = frame.join(per, [*keys, "_slot"], "left")
    upto = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0.0)
    sums = full.select(
        *keys,
        "_slot",
        F.max("shift").over(kw).alias("shift"),
        F.sum("n").over(kw).alias("n"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("hits"),
        F.sum("sw").over(kw).alias("sw"),
        F.sum("sw2").over(kw).alias("sw2"),
        F.max("mw").over(kw).alias("mw"),
        F.coalesce(F.sum("sw").over(upto), zero).alias("sy"),
        F.coalesce(F.sum("sw2").over(upto), zero).alias("sy2"),
        F.coalesce(F.max("mw").over(upto), zero).alias("my"),
    ).where(F.col("_slot") < len(ts))
    values = F.array(*[F.lit(t) for t in ts])
    sums = sums.withColumn("threshold", F.get(values, F.col("_slot"))).withColumn(
        "m2", F.greatest(zero, F.col("sy2") - F.col("sy") * F.col("sy") / F.col("n"))
    )
    sums = sums.withColumn("sy", F.when(F.isnan("sw"), F.col("sw")).otherwise(F.col("sy")))  # a bad weight spoils all thresholds
    return _told(_finish_is(sums, [*keys, "threshold"], delta))
