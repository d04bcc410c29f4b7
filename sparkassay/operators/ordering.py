"""Ordered analytics over keys of any size.

A plain window sends a whole key to one task. Here each key is cut into slices of its order column,
every slice is windowed on its own, and what earlier slices contribute (a count, a sum, a running
extreme, the last row) is carried over from a table with one row per (key, slice). The result equals
the unsliced window. Slice limits are equal-depth quantiles of the order column, a row of bounded
size that is fixed in the plan as literals, so every branch of the plan cuts at the same points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_slices

SLICE = "_slice"


def _as_number(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name)


def slice_bounds(df: DataFrame, order: str, slices: int) -> list:
    """Equal-depth limits of the order column (at most ``slices - 1`` numbers)."""
    shares = [i / slices for i in range(1, slices)]
    row = df.agg(F.percentile_approx(_as_number(df, order), shares, 10 * slices).alias("b")).first()
    return sorted(set(row["b"] or []))


def slice_number(x: Column, bounds: list) -> Column:
    """Number of limits below x, by halving (a handful of steps even for thousands of limits)."""
    if not bounds:
        return F.lit(0)
    size, steps = len(bounds), []
    step = 1
    while step * 2 <= size:
        step *= 2
    while step:
        steps.append(step)
        step //= 2
    limits = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda acc, s: F.when((acc + s <= size) & (F.get(limits, acc + s - 1) < x), acc + s).otherwise(acc),
    )


def with_slices(df: DataFrame, order: str, slices: int | None = None, bounds: list | None = None) -> DataFrame:
    if bounds is None:
        bounds = slice_bounds(df, order, slices or default_slices(df.sparkSession))
    return df.withColumn(SLICE, slice_number(_as_number(df, order), bounds))


_TOTALS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "min":
        return F.least(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    zero = F.lit(0)
    if kind == "count":
        return F.coalesce(local, zero) + F.coalesce(carry, zero)
    return F.when(local.isNull(), carry).when(carry.isNull(), local).otherwise(local + carry)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, tuple[str, Column]],
    *,
    slices: int | None = None,
    include_current: bool = True,
    bounds: list | None = None,
) -> DataFrame:
    """Add running count / sum / min / max columns per key in the given total order.

    ``measures`` maps an output name to (kind, expression). With ``include_current=False`` the frame
    ends one row before the current one. ``bounds`` are slice limits from a cheaper table with a similar
    spread; they affect the balance of the slices, never the result.
    """
    cut = with_slices(df, order[0], slices, bounds)
    end = 0 if include_current else -1
    local_w = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before_w = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    local = cut
    for name, (kind, expr) in measures.items():
        local = local.withColumn(f"_l_{name}", _TOTALS[kind](expr).over(local_w))
    totals = cut.groupBy(*keys, SLICE).agg(*[_TOTALS[k](e).alias(f"_t_{n}") for n, (k, e) in measures.items()])
    roll = {"count": F.sum}
    carry = totals.select(
        *keys,
        SLICE,
        *[roll.get(k, _TOTALS[k])(f"_t_{n}").over(before_w).alias(f"_c_{n}") for n, (k, _) in measures.items()],
    )
    a, b = local.alias("a"), carry.alias("b")
    joined = a.join(b, null_safe_alias("a", "b", [*keys, SLICE]), "left")
    return joined.select(
        *[F.col(f"a.{c}") for c in df.columns],
        *[
            _combine(k, F.col(f"a._l_{n}"), F.col(f"b._c_{n}")).alias(n)
            for n, (k, _) in measures.items()
        ],
    )


def null_safe_alias(left: str, right: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def row_numbers(
    df: DataFrame, keys: list[str], order: list[str], out: str, slices: int | None = None, bounds: list | None = None
) -> DataFrame:
    """1-based position of each row within its key."""
    return running(df, keys, order, {out: ("count", F.lit(1))}, slices=slices, bounds=bounds)


def with_neighbours(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], slices: int | None = None
) -> DataFrame:
    """Add structs ``prev`` and ``next`` holding ``cols`` of the adjacent rows of the key."""
    cut = with_slices(df, order[0], slices)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    body = F.struct(*cols)
    local = cut.withColumn("_lp", F.lag(body).over(w)).withColumn("_ln", F.lead(body).over(w))
    by_order = F.struct(*order)
    edges = cut.groupBy(*keys, SLICE).agg(
        F.min_by(body, by_order).alias("_first"), F.max_by(body, by_order).alias("_last")
    )
    kw = Window.partitionBy(*keys).orderBy(SLICE)
    edges = edges.select(
        *keys, SLICE, F.lag("_last").over(kw).alias("_ep"), F.lead("_first").over(kw).alias("_en")
    )
    joined = local.alias("a").join(edges.alias("b"), null_safe_alias("a", "b", [*keys, SLICE]), "left")
    return joined.select(
        *[F.col(f"a.{c}") for c in df.columns],
        F.coalesce("a._lp", "b._ep").alias("prev"),
        F.coalesce("a._ln", "b._en").alias("next"),
    )


def last_rows(
    df: DataFrame, keys: list[str], order: list[str], n: int, sums: dict[str, Column], block: int = 4096
) -> DataFrame:
    """Sums over the last ``n`` rows up to each row, as blocks with an overlap of n - 1 rows.

    Adds ``position`` (1-based) and one column per entry of ``sums``.
    """
    if n > block:
        block = n
    ranked = row_numbers(df, keys, order, "position")
    home = F.floor((F.col("position") - 1) / block).cast("bigint")
    spills = (F.col("position") - 1) % block >= block - (n - 1)
    spread = ranked.withColumn(
        "_block", F.explode(F.when(spills, F.array(home, home + 1)).otherwise(F.array(home)))
    ).withColumn("_home", home)
    w = Window.partitionBy(*keys, "_block").orderBy("position").rowsBetween(-(n - 1), 0)
    out = spread
    for name, expr in sums.items():
        out = out.withColumn(name, F.sum(expr).over(w))
    return out.where(F.col("_block") == F.col("_home")).drop("_block", "_home")
