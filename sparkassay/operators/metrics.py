"""Quality of predictions and their calibration, in aggregations without a global sort."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import beta_quantile
from ..functions.numeric import clip, is_finite
from ..session import keyed, small_side
from .ordering import running, slice_number
from .quantiles import exact_quantiles

# Fixed value: clipping of probabilities in the log-loss.
CLIP = 1e-6
# Levels of the quantile calibration.
CALIB_QUANTILES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.25, 0.5, 0.75)


def log_loss(p: Column, y: Column) -> Column:
    c = clip(p, CLIP, 1.0 - CLIP)
    return F.avg(-(y * F.ln(c) + (1 - y) * F.ln(1 - c)))


def classification_metrics(scored: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Log-loss, accuracy at 0.5, AUC and class rate per key; NULL log-loss and AUC for one class.

    The AUC counts, per distinct score, the negatives below it; rows are first reduced to distinct
    scores and the running count is sliced.
    """
    rows = scored.where(is_finite(F.col(p))).select(*keys, F.col(p).alias("_p"), F.col(y).cast("int").alias("_y"))
    basic = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_y").alias("_pos"),
        log_loss(F.col("_p"), F.col("_y")).alias("_ll"),
        F.avg(((F.col("_p") >= 0.5).cast("int") == F.col("_y")).cast("double")).alias("accuracy"),
        F.avg("_y").alias("rate"),
    )
    per_score = rows.groupBy(*keys, "_p").agg(
        F.sum("_y").alias("_sp"), F.sum(1 - F.col("_y")).alias("_sn")
    )
    below = running(per_score, keys, ["_p"], {"_nb": ("sum", F.col("_sn"))}, include_current=False)
    won = F.col("_sp") * (F.coalesce("_nb", F.lit(0)) + F.col("_sn") / 2)
    wins = below.groupBy(*keys).agg(F.sum(won).alias("_wins"))
    both = basic.join(wins, keys) if keys else basic.withColumn("_wins", wins.scalar())
    mixed = (F.col("_pos") > 0) & (F.col("_pos") < F.col("n"))
    return both.select(
        *keys,
        "n",
        F.when(mixed, F.col("_ll")).alias("logloss"),
        "accuracy",
        F.when(mixed, F.try_divide(F.col("_wins"), F.col("_pos") * (F.col("n") - F.col("_pos")))).alias("auc"),
        "rate",
    )


def regression_metrics(scored: DataFrame, keys: list[str], pred: str = "pred", y: str = "y") -> DataFrame:
    e = F.col(pred) - F.col(y)
    return scored.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def quantile_deltas(predictions: DataFrame) -> DataFrame:
    """Residual quantile per level and the coverage before and after adding it: input (q, pred, y)."""
    res = predictions.withColumn("_r", F.col("y") - F.col("pred"))
    delta = exact_quantiles(res, ["q"], F.col("_r"), {"delta": F.col("q")}, few=True)
    # one row per level; a shuffle on so few keys would pile all rows up in a few tasks
    cover = res.join(small_side(delta), "q")
    return cover.groupBy("q").agg(
        F.first("delta").alias("delta"),
        F.avg((F.col("y") <= F.col("pred")).cast("double")).alias("cov_pre"),
        F.avg((F.col("y") <= F.col("pred") + F.col("delta")).cast("double")).alias("cov_post"),
    )


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through (xs, ys), clamped at both ends; the bracket is found by halving."""
    if len(xs) == 1:
        return F.lit(float(ys[0]))
    ax, ay = F.array(*[F.lit(float(v)) for v in xs]), F.array(*[F.lit(float(v)) for v in ys])
    hi = F.greatest(F.lit(1), F.least(F.lit(len(xs) - 1), slice_number(x, [float(v) for v in xs])))
    x0, x1, y0, y1 = F.get(ax, hi - 1), F.get(ax, hi), F.get(ay, hi - 1), F.get(ay, hi)
    line = y0 + F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0)) * (y1 - y0)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).when(x >= xs[-1], F.lit(float(ys[-1]))).otherwise(line)


def p_calibrate(
    p: Column, xs: list[float], ys: list[float], *, tail_alpha: float = 1.0, tail_power: float = 1.0, upper: bool = True
) -> Column:
    """Calibrated probability: knots, optional inflation below 0.1, never below the raw value."""
    q = interpolate(p, xs, ys)
    if tail_alpha > 1.0 or tail_power > 1.0:
        q = F.when(q < 0.1, F.least(F.lit(1.0), tail_alpha * F.pow(q, 1.0 / tail_power))).otherwise(q)
    if upper:
        q = F.greatest(q, p)
    return clip(q, 0.0, 1.0)


def quantile_shift(q: float, deltas: dict[float, float]) -> float:
    """Correction of a quantile level, linear between the calibrated levels."""
    qs = sorted(deltas)
    return float(np.interp(q, qs, [deltas[x] for x in qs]))


def temperature_scale(p: Column, t: float) -> Column:
    c = clip(p, CLIP, 1.0 - CLIP)
    return 1.0 / (1.0 + F.exp(-F.ln(c / (1 - c)) / t))


# Candidate temperatures.
TEMPERATURES = tuple(float(t) for t in np.linspace(0.5, 5.0, 30))


def temperature_fit(scored: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Best of the candidate temperatures by log-loss: all candidates are averaged in one aggregation."""
    losses = [log_loss(temperature_scale(F.col(p), t), F.col(y)).alias(f"_t{i}") for i, t in enumerate(TEMPERATURES)]
    agg = scored.groupBy(*keys).agg(*losses)
    cells = F.array(
        *[
            F.struct(F.col(f"_t{i}").alias("logloss"), F.lit(i).alias("i"), F.lit(t).alias("temperature"))
            for i, t in enumerate(TEMPERATURES)
        ]
    )
    return agg.select(*keys, F.array_min(cells).alias("b")).select(*keys, "b.temperature", "b.logloss")


def two_sided_quantile(gamma: float, family: str = "gaussian", df: float = 5.0) -> float:
    """Half width in standard units that covers gamma of the family."""
    if family == "gaussian":
        return NormalDist().inv_cdf(0.5 * (1.0 + gamma))
    b = float(beta_quantile(np.array([gamma]), np.array([0.5]), np.array([df / 2.0]))[0])
    return float(np.sqrt(df * b / (1.0 - b)))


def margin_coverage_calibration(
    predictions: DataFrame,
    margins: DataFrame,
    gamma: float = 0.9,
    family: str = "gaussian",
    df: float = 5.0,
    bounds: tuple[float, float] = (1e-3, 1e3),
) -> DataFrame:
    """Bias and variance scale that make two-sided intervals cover gamma: one row.

    Coverage at scale s is the share of rows with (residual / (z sigma))^2 <= s, so the wanted scale is
    an exact quantile of that ratio, clamped to the bounds; no repeated passes. For the t family sigma
    is converted to the scale parameter that has this variance.
    """
    per = margins.groupBy("gidx").agg(F.avg("margin").alias("_m"))
    diff = per.join(keyed(predictions), "gidx").select((F.col("_m") - F.col("mu")).alias("_d"))
    bias = exact_quantiles(diff, [], F.col("_d"), {"b": 0.5}).scalar()
    z = two_sided_quantile(gamma, family, df)
    var = F.col("var") if family == "gaussian" else F.col("var") * ((df - 2.0) / df)
    used = margins.join(keyed(predictions.where(is_finite(F.col("var")) & (F.col("var") > 0))), "gidx")
    resid = F.col("margin") - (F.col("mu") + F.coalesce(bias, F.lit(0.0)))
    ratios = used.select("gidx", (resid * resid / (z * z * var)).alias("_r"))
    # the smallest scale that covers gamma is the order statistic at rank ceil(gamma n)
    need = exact_quantiles(ratios, [], F.col("_r"), {"s": lambda n: F.ceil(F.lit(gamma) * n) - 1}).scalar()
    scale = F.coalesce(clip(need, *bounds), F.lit(1.0))
    # the comparison is projected before the aggregate, as predictions of a model may not be repeatable
    flagged = ratios.select((F.col("_r") <= scale).cast("double").alias("_in"))
    out = flagged.agg(F.avg("_in").alias("coverage"), F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce(bias, F.lit(0.0)).alias("bias"), scale.alias("scale"), "coverage", "n")


def quantile_crossing(quantiles: DataFrame) -> DataFrame:
    """P(margin < 0) per design from predicted quantiles (gidx, tau, q).

    The envelope is the running maximum over tau; the first level at or above zero is interpolated with
    its predecessor. None gives 1, the first gives the smallest level. Levels per design are a fixed list.
    """
    w = Window.partitionBy("gidx").orderBy("tau")
    env = quantiles.withColumn("_q", F.max("q").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    env = env.withColumn("_q0", F.lag("_q").over(w)).withColumn("_t0", F.lag("tau").over(w))
    first = env.groupBy("gidx").agg(
        F.min(F.when(F.col("_q") >= 0, F.struct("tau", "_q", "_t0", "_q0"))).alias("s")
    )
    gap = F.col("s._q") - F.col("s._q0")
    frac = F.when(gap > 1e-12, clip(-F.col("s._q0") / gap, 0.0, 1.0)).otherwise(F.lit(1.0))
    p = (
        F.when(F.col("s").isNull(), F.lit(1.0))
        .when(F.col("s._t0").isNull(), F.col("s.tau"))
        .otherwise(F.col("s._t0") + frac * (F.col("s.tau") - F.col("s._t0")))
    )
    return first.select("gidx", clip(p, 0.0, 1.0).alias("p_unsafe"))
