"""Comparing tables: recomputed against published, plan against result, stored against derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerances of a published number.
REL_TOL, ABS_TOL = 1e-12, 1e-25


def same_number(got: Column, want: Column, rel: float = REL_TOL, abs_tol: float = ABS_TOL) -> Column:
    """NULL matches NULL only, NaN matches nothing."""
    near = F.abs(got - want) <= F.greatest(rel * F.greatest(F.abs(got), F.abs(want)), F.lit(abs_tol))
    both = got.isNotNull() & want.isNotNull() & ~F.isnan(got) & ~F.isnan(want)
    return F.when(got.isNull() & want.isNull(), F.lit(True)).when(both, (got == want) | near).otherwise(F.lit(False))


def melt(df: DataFrame, keys: list[str], numbers: list[str], texts: list[str] = ()) -> DataFrame:
    """Wide results as (keys, field, number, text)."""
    cells = [
        F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("number"), F.lit(None).cast("string").alias("text"))
        for c in numbers
    ] + [
        F.struct(F.lit(c).alias("field"), F.lit(None).cast("double").alias("number"), F.col(c).cast("string").alias("text"))
        for c in texts
    ]
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def published_compare(
    got: DataFrame, want: DataFrame, keys: list[str], rel: float = REL_TOL, abs_tol: float = ABS_TOL
) -> DataFrame:
    """Fields of ``want`` that ``got`` does not reproduce; both are (keys, field, number, text)."""
    by = [*keys, "field"]
    g = got.select(*by, F.col("number").alias("got"), F.col("text").alias("got_text"), F.lit(True).alias("_g"))
    w = want.select(*by, F.col("number").alias("want"), F.col("text").alias("want_text"))
    both = w.join(g, by, "left")
    ok = (
        F.col("_g").isNotNull()
        & same_number(F.col("got"), F.col("want"), rel, abs_tol)
        & F.col("got_text").eqNullSafe(F.col("want_text"))
    )
    return both.where(~ok).select(*by, "got", "want", "got_text", "want_text", F.col("_g").isNull().alias("absent"))


def set_difference(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Keys on one side only, with the side's name; one full join of the distinct keys."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = x.join(y, keys, "full").where(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(*keys, F.when(F.col("_b").isNull(), F.lit(left)).otherwise(F.lit(right)).alias("side"))
