"""Log likelihood ratios of recorded random draws and the mixture weights built from them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import lit_inf

LOG_SQRT_2PI = 0.5 * math.log(2.0 * math.pi)


def log_or_ninf(p: Column) -> Column:
    return F.when(p > 0, F.ln(p)).otherwise(lit_inf(-1))


def log_normal_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / sigma
    return -(F.ln(sigma) + LOG_SQRT_2PI) - 0.5 * z * z


def log_lognormal_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    """-inf outside the positive half line."""
    safe = F.when(x > 0, x)
    return F.coalesce(log_normal_pdf(F.ln(safe), mu, sigma) - F.ln(safe), lit_inf(-1))


def _minus(p: Column, q: Column) -> Column:
    """log p - log q where both may be -inf: a base zero wins only when q is positive."""
    return p - q


def draw_log_ratio(kind: Column, value: Column, p: Column, q: Column) -> Column:
    """log p(value) - log q(value) per draw; ``p`` and ``q`` are arrays of law parameters.

    bernoulli [prob], categorical [weights...], normal [mu, sigma], lognormal [mu, sigma],
    shifted_lognormal [shift, mu, sigma], uniform [a, b].
    """

    def total(w: Column) -> Column:
        return F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)

    def bern(w: Column) -> Column:
        return log_or_ninf(F.when(value != 0, w[0]).otherwise(1.0 - w[0]))

    def cat(w: Column) -> Column:
        return log_or_ninf(F.try_divide(F.get(w, value.cast("int")), total(w)))

    def unif(w: Column) -> Column:
        return F.when(value.between(w[0], w[1]), -F.ln(w[1] - w[0])).otherwise(lit_inf(-1))

    laws = {
        "bernoulli": bern,
        "categorical": cat,
        "normal": lambda w: log_normal_pdf(value, w[0], w[1]),
        "lognormal": lambda w: log_lognormal_pdf(value, w[0], w[1]),
        "shifted_lognormal": lambda w: log_lognormal_pdf(value - w[0], F.get(w, F.lit(1)), F.get(w, F.lit(2))),
    }
    expr = F.when(kind == "uniform", F.when(value.between(p[0], p[1]), unif(p) - unif(q)).otherwise(lit_inf(-1)))
    for name, law in laws.items():
        expr = expr.when(kind == name, _minus(law(p), law(q)))
    return expr


def log_add(a: Column, b: Column) -> Column:
    """log(exp a + exp b) without overflow; both finite."""
    top = F.greatest(a, b)
    return top + F.log1p(F.exp(F.least(a, b) - top))


def defensive_mixture_weight(log_ratio: Column, alpha: float) -> Column:
    """log p/q  ->  log p/(alpha p + (1-alpha) q); bounded above by -log alpha."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must lie in [0, 1]")
    if alpha == 0.0:
        return log_ratio
    if alpha == 1.0:
        return F.when(log_ratio.isNotNull(), F.lit(0.0))
    mixed = log_ratio - log_add(F.lit(math.log(alpha)) + log_ratio, F.lit(math.log1p(-alpha)))
    return (
        F.when(log_ratio == lit_inf(-1), lit_inf(-1))
        .when(log_ratio == lit_inf(), F.lit(-math.log(alpha)))
        .otherwise(mixed)
    )


def finite_mixture_weight(log_ratios: Column, alphas: dict[str, float]) -> Column:
    """-log sum_j exp(log alpha_j - r_j) over a map of log ratios r_j = log p/q_j.

    Components of probability zero are ignored; a missing component or NaN gives NULL.
    """
    if abs(sum(alphas.values()) - 1.0) > 1e-12 or any(a < 0 for a in alphas.values()):
        raise ValueError("mixture probabilities must be non-negative and sum to one")
    live = {k: a for k, a in alphas.items() if a > 0}
    terms = F.array(*[F.lit(math.log(a)) - log_ratios[F.lit(k)] for k, a in live.items()])
    top = F.array_max(terms)
    summed = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.exp(t - top))
    bad = F.exists(terms, lambda t: t.isNull() | F.isnan(t))
    return (
        F.when(bad, F.lit(None).cast("double"))
        .when(top == lit_inf(), lit_inf(-1))
        .when(top == lit_inf(-1), lit_inf())
        .otherwise(-(top + F.ln(summed)))
    )


def lognormal_mu(mean: Column, sd: Column) -> Column:
    return F.ln(mean * mean / F.sqrt(mean * mean + sd * sd))


def lognormal_sigma(mean: Column, sd: Column) -> Column:
    return F.sqrt(F.log1p((sd * sd) / (mean * mean)))


def outcome_weights(weights: list[Column], miss: int, miss_scale: float) -> list[Column]:
    """Scale the miss weight, clip negatives, renormalise; all zero becomes uniform."""
    vals = [F.greatest(F.lit(0.0), w * miss_scale if i == miss else w) for i, w in enumerate(weights)]
    tot = sum(vals[1:], vals[0])
    return [F.when(tot <= 0, F.lit(1.0 / len(vals))).otherwise(F.try_divide(v, tot)) for v in vals]
