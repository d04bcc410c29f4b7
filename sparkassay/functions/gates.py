"""Reporting gates: thresholds in, verdict and names of the failed gates out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import is_finite


# Fixed value: a figure within this relative distance of its limit counts as equal to it. Weights come from logarithms and
# sums in any order, so their last bits are chance; 1.5 in 250 must pass a limit of 0.006 on every run.
TIE = 1e-9


def at_least(x: Column, limit: float) -> Column:
    return x >= limit - TIE * abs(limit)


def at_most(x: Column, limit: float) -> Column:
    return x <= limit + TIE * abs(limit)


@dataclass(frozen=True)
class PrecisionGates:
    # Gates below which a weighted estimate is only exploratory.
    events: int = 20
    ess: float = 20.0
    contribution: float = 0.20
    rse: float = 0.25


def failed(checks: dict[str, Column]) -> Column:
    """Sorted names of the checks that do not hold (NULL counts as not holding)."""
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(checks.items())]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def zero_as(x: Column, default: float) -> Column:
    """A missing or zero number becomes the default, as the published gates treat it."""
    return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(x)


def weighted_checks(
    events: Column, ess: Column, contribution: Column, rse: Column, rse_default: float, g: PrecisionGates
) -> dict[str, Column]:
    return {
        "minimum_event_paths": events >= g.events,
        "minimum_event_ess": zero_as(ess, 0.0) >= g.ess,
        "maximum_event_contribution": zero_as(contribution, 1.0) <= g.contribution,
        "maximum_relative_standard_error": zero_as(rse, rse_default) <= g.rse,
    }


def precision_status(
    scheme: Column, events: Column, ess: Column, contribution: Column, rse: Column, g: PrecisionGates = PrecisionGates()
) -> tuple[Column, Column]:
    """(status, failed gates) of a family or mode estimate; no gates apply when nothing was observed."""
    weighted = failed(weighted_checks(events, ess, contribution, rse, float("inf"), g))
    nominal = failed(
        {"minimum_event_paths": events >= g.events, "maximum_relative_standard_error": rse <= g.rse}
    )
    exact_wide = (events < g.events) | (zero_as(rse, float("inf")) > g.rse)
    mc = scheme == "nominal_mc"
    status = (
        F.when(events == 0, "not_observed")
        .when(mc, F.when(exact_wide, "mc_exact_but_imprecise").otherwise("mc_exact_precise"))
        .when(F.size(weighted) == 0, "precise")
        .otherwise("imprecise_exploratory")
    )
    return status, F.when(events > 0, F.when(mc, nominal).otherwise(weighted))


def mode_status(
    scheme: Column, events: Column, ess: Column, contribution: Column, rse: Column, g: PrecisionGates = PrecisionGates()
) -> tuple[Column, Column]:
    """As above for the principal mode: an exact nominal sample passes without gates."""
    weighted = failed(weighted_checks(events, ess, contribution, rse, 1.0, g))
    mc = scheme == "nominal_mc"
    status = (
        F.when(events == 0, "not_observed")
        .when(mc, "mc_exact")
        .when(F.size(weighted) == 0, "precise")
        .otherwise("imprecise_exploratory")
    )
    return status, F.when((events > 0) & ~mc, weighted)


def weight_quality(
    ess_ratio: Column, max_norm_w: Column, log_mean_w: Column, *, min_ess_ratio: float, max_weight: float, max_log_mean: float
) -> Column:
    return failed(
        {
            "ess_ratio_below_minimum": at_least(ess_ratio, min_ess_ratio),
            "max_normalized_weight_above_maximum": at_most(max_norm_w, max_weight),
            "mean_weight_inconsistent_with_one": is_finite(log_mean_w) & at_most(F.abs(log_mean_w), max_log_mean),
        }
    )


def proposal_validation(
    quality: Column, n: Column, failures: Column, rse: Column, *, final_n: int, min_failures: int, max_projected: float
) -> tuple[Column, Column]:
    """(projected relative error at the final size, reasons against the proposal)."""
    projected = F.when(is_finite(rse), rse * F.sqrt(n / F.lit(float(final_n))))
    more = failed(
        {
            "proposal_validation_failures_below_minimum": failures >= min_failures,
            "projected_final_relative_standard_error_above_maximum": at_most(projected, max_projected),
        }
    )
    return projected, F.concat(quality, more)


def final_estimate(
    quality: Column,
    failures: Column,
    failure_ess: Column,
    rse: Column,
    ci_lo: Column,
    ci_hi: Column,
    *,
    min_failures: int,
    min_ess: float,
    max_rse: float,
) -> Column:
    small = is_finite(rse) & at_most(rse, max_rse)
    more = failed(
        {
            "proposal_failures_below_minimum": failures >= min_failures,
            "failure_ess_below_minimum": at_least(failure_ess, min_ess),
            "relative_standard_error_above_maximum": small,
            "positive_relative_standard_error_unavailable": ~small | (rse > 0),
            "positive_confidence_interval_lower_bound_unavailable": is_finite(ci_lo) & (ci_lo > 0),
            "finite_confidence_interval_unavailable": is_finite(ci_hi),
        }
    )
    return F.concat(quality, more)
