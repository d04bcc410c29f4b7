"""Exact linear-interpolated quantiles of groups of any size.

The built-in ``percentile`` holds every distinct value of a group in one task. Here values are first
counted per distinct value, the counts are cut into slices, the slices that hold a wanted rank are
found from the per-slice totals, and only those slices are ordered.

Few groups (the whole table, or a row per level) are narrowed down before: a mergeable sketch of each group gives limits
whose rank is known to within one part in ``8 * GRID``; a second pass counts what lies below the limits around a wanted rank, and
only the values between them, some five parts in ``GRID``, are shuffled, cut and ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_slices, durable
from .ordering import SLICE, null_safe_alias, slice_bounds, with_slices


GRID = 512  # limits of a sketch


def exact_quantiles(
    df: DataFrame, keys: list[str], value: Column, qs: dict, slices: int | None = None, few: bool = False
) -> DataFrame:
    """One row per key with one column per entry of ``qs`` (name -> level); NULL values are ignored.

    A level may be a column of the keys, or a function from the row count to a 0-based position. ``few`` says that there
    are no more than some hundred keys, each with a great many rows; the result is the same.
    """
    values = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if few or not keys:
        return _narrowed(values, keys, qs, slices)
    bounds = slice_bounds(values, "_v", slices or default_slices(values.sparkSession))
    return _sliced(values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), keys, qs, bounds)


def _position(level, total: Column) -> Column:
    if callable(level) and not isinstance(level, Column):
        return level(total).cast("double")
    return (level if isinstance(level, Column) else F.lit(float(level))) * (total - 1)


def rank_limits(values: DataFrame, keys: list[str], qs: dict) -> DataFrame:
    """(keys, wanted): for every entry of ``qs`` its place, position and the limits that enclose both ranks beside it.

    A sketch whose limits are off by at most an eighth of a grid step encloses a rank between the limits two steps away.
    NaN is above all limits.
    """
    real = F.when(~F.isnan("_v"), F.col("_v"))
    grid = F.percentile_approx(real, [i / GRID for i in range(GRID + 1)], 8 * GRID)
    held = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count(real).alias("_m"), grid.alias("_g"))
    wanted = []
    for i, level in enumerate(qs.values()):
        at = _position(level, F.col("_n"))
        low = F.floor(at)
        step = GRID / F.greatest(F.col("_m"), F.lit(1))
        below, above = F.floor(low * step) - 2, F.ceil((low + 2) * step) + 2
        wanted.append(
            F.struct(
                F.lit(i).alias("i"),
                at.alias("at"),
                F.when((below < 0) | F.col("_g").isNull(), F.lit(float("-inf"))).otherwise(F.get("_g", F.least(below, F.lit(GRID)).cast("int"))).alias("lo"),
                F.when((above > GRID) | F.col("_g").isNull(), F.lit(float("nan"))).otherwise(F.get("_g", F.greatest(above, F.lit(0)).cast("int"))).alias("hi"),
            )
        )
    return held.where("_n > 0").select(*keys, F.array(*wanted).alias("_wanted"))


def _narrowed(values: DataFrame, keys: list[str], qs: dict, slices: int | None) -> DataFrame:
    wanted = F.col("_wanted")
    flat = [wanted[i][c].alias(f"_{c}{i}") for i in range(len(qs)) for c in ("at", "lo", "hi")]
    limits = rank_limits(values, keys, qs).select(*keys, *flat)
    limits = durable(limits) if keys else limits  # without keys it is used once
    met = values.alias("a").join(F.broadcast(limits.alias("b")), null_safe_alias("a", "b", keys))  # a row per key, few by contract
    met = met.select(*[F.col(f"a.{k}") for k in keys], "a._v", *[F.col(f"b.{c}") for c in limits.columns[len(keys) :]])
    v = F.col("_v")
    # a value below the limits of a rank is only counted, as null; one above them is left out
    use = lambda i: F.col(f"_at{i}").isNotNull() & ~(v > F.col(f"_hi{i}"))
    part = lambda i: (F.lit(i).alias("_i"), F.col(f"_at{i}").alias("_p"), F.when(~(v < F.col(f"_lo{i}")), v).alias("_v"))
    if len(qs) == 1:
        counted = met.where(use(0)).select(*keys, *part(0))
    else:
        each = met.select(*keys, F.explode(F.array(*[F.when(use(i), F.struct(*part(i))) for i in range(len(qs))])).alias("_w"))
        counted = each.where("_w IS NOT NULL").select(*keys, "_w.*")
    by = [*keys, "_i", "_p"]
    counted = durable(counted.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))
    base = counted.where("_v IS NULL").select(*by, F.col("_n").alias("_below"))
    near = counted.where("_v IS NOT NULL").alias("a").join(F.broadcast(base.alias("b")), null_safe_alias("a", "b", by), "left")
    inner = F.col("a._p") - F.coalesce("b._below", F.lit(0))
    placed = near.select(*[F.col(f"a.{k}") for k in by], inner.alias("_at"), "a._v", "a._n")
    at = F.col("_at")
    enclosed = lambda n: F.when((at >= 0) & (F.floor(at) < n), at).otherwise(
        F.raise_error(F.lit("a sketch of values does not enclose a rank")).cast("double")
    )
    bounds = slice_bounds(placed, "_v", slices or default_slices(values.sparkSession))
    found = _sliced(placed, [*by, "_at"], {"_x": enclosed}, bounds)
    cols = [F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(name) for i, name in enumerate(qs)]
    out = found.groupBy(*keys).agg(*cols)
    if not keys:
        return out
    every = limits.select(*keys).alias("a").join(out.alias("b"), null_safe_alias("a", "b", keys), "left")  # a key without a position has no quantile
    return every.select(*[F.col(f"a.{k}") for k in keys], *[F.col(f"b.{name}") for name in qs])


def _sliced(counted: DataFrame, keys: list[str], qs: dict, bounds: list) -> DataFrame:
    """``exact_quantiles`` of (keys, _v, _n): distinct values with their counts."""
    cut = with_slices(counted, "_v", bounds=bounds)
    per_slice = cut.groupBy(*keys, SLICE).agg(F.sum("_n").alias("_sn"))
    kw = Window.partitionBy(*keys)
    before = kw.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    placed = per_slice.withColumn("_base", F.coalesce(F.sum("_sn").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_sn").over(kw)
    )

    names = list(qs)
    spots = []
    for i, name in enumerate(names):
        at = _position(qs[name], F.col("_total"))
        low = F.floor(at)
        for side, rank in (("lo", low), ("hi", F.least(low + 1, F.col("_total") - 1))):
            spots.append(
                F.struct(
                    F.lit(f"{i}{side}").alias("slot"), rank.cast("bigint").alias("rank"), (at - low).alias("frac")
                )
            )
    wanted = F.filter(
        F.array(*spots),
        lambda s: (s["rank"] >= F.col("_base")) & (s["rank"] < F.col("_base") + F.col("_sn")),
    )
    hit = placed.withColumn("_spots", wanted).where(F.size("_spots") > 0).select(*keys, SLICE, "_base", "_spots")
    near = (
        cut.alias("a")
        .join(hit.alias("b"), null_safe_alias("a", "b", [*keys, SLICE]))
        .select(*[F.col(f"a.{c}") for c in cut.columns], "b._base", "b._spots")
    )
    in_slice = Window.partitionBy(*keys, SLICE).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    found = near.withColumn("_from", F.col("_base") + F.coalesce(F.sum("_n").over(in_slice), F.lit(0)))
    found = found.select(
        *keys,
        "_v",
        F.explode(
            F.filter(
                "_spots",
                lambda s: (s["rank"] >= F.col("_from")) & (s["rank"] < F.col("_from") + F.col("_n")),
            )
        ).alias("_s"),
    )

    def pick(slot: str) -> Column:
        return F.max(F.when(F.col("_s.slot") == slot, F.col("_v")))

    cols = []
    for i, name in enumerate(names):
        frac = F.max(F.when(F.col("_s.slot") == f"{i}lo", F.col("_s.frac")))
        lo, hi = pick(f"{i}lo"), pick(f"{i}hi")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return found.groupBy(*keys).agg(*cols)
