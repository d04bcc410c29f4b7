"""Label splits: stratified assignment, membership and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seeds import hash_int
from ..session import durable, small_side
from .ordering import row_numbers

SPLITS = ("calib", "test", "train")


def largest_remainder(n: Column, calib: float, test: float) -> tuple[Column, Column]:
    """(calib, test) counts out of n; leftovers go to the largest fractions, ties in the order calib, test, train."""
    if calib < 0 or test < 0 or calib + test > 1.0:
        raise ValueError("split shares must be non-negative and sum to at most one")
    want = [n * calib, n * test, n * max(0.0, 1.0 - calib - test)]
    floors = [F.floor(w) for w in want]
    frac = [w - f for w, f in zip(want, floors)]
    left = n - (floors[0] + floors[1] + floors[2])

    def rank(i: int) -> Column:
        ahead = F.lit(0)
        for j in range(3):
            if j != i:
                wins = (frac[j] > frac[i]) | ((frac[j] == frac[i]) & F.lit(j < i))
                ahead = ahead + wins.cast("int")
        return ahead

    return tuple((floors[i] + (rank(i) < left).cast("int")).cast("bigint") for i in range(2))


def stratified_split(labels: DataFrame, calib: float, test: float, seed: int) -> DataFrame:
    """Shuffle each class by a seeded hash and cut it at the largest-remainder counts: (gidx, label, split)."""
    labels = durable(labels)  # a row per design; the limits, counts and sizes of the cut each read it
    mixed = labels.withColumn("_h", hash_int(F.lit(seed), F.col("gidx")))
    ranked = row_numbers(mixed, ["label"], ["_h", "gidx"], "_rn")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    n_calib, n_test = largest_remainder(F.col("_n"), calib, test)
    where = (
        F.when(F.col("_rn") <= n_calib, "calib").when(F.col("_rn") <= n_calib + n_test, "test").otherwise("train")
    )
    return ranked.join(small_side(sizes), "label").select("gidx", "label", where.alias("split"))


def split_labels_filter(labels: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    return labels.join(splits.where(F.col("split") == split).select("gidx"), "gidx").select("gidx", "label")


def split_membership(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of designs that belong to a split, with its name."""
    return rows.join(splits.select("gidx", "split"), "gidx")


def split_check(splits: DataFrame, labels: DataFrame, grid_size: int) -> DataFrame:
    """(rule, gidx) for every broken rule; an empty training split is one row without a design."""
    s = splits.groupBy("gidx").agg(F.count(F.lit(1)).alias("_k"))
    lab = labels.groupBy("gidx").agg(F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("_bad"))
    both = s.withColumn("_s", F.lit(True)).join(lab.withColumn("_l", F.lit(True)), "gidx", "full")
    rules = F.filter(
        F.array(
            F.when(F.col("_k") > 1, F.lit("in_two_splits")),
            F.when(F.col("_s").isNull(), F.lit("label_without_split")),
            F.when(F.col("_l").isNull(), F.lit("split_without_label")),
            F.when(~F.col("gidx").between(0, grid_size - 1), F.lit("outside_grid")),
            F.when(F.col("_bad") > 0, F.lit("label_not_binary")),
        ),
        lambda r: r.isNotNull(),
    )
    broken = both.select(F.explode(rules).alias("rule"), "gidx")
    train = splits.agg(F.count_if(F.col("split") == "train").alias("n")).where("n = 0")
    return broken.unionByName(
        train.select(F.lit("no_training_rows").alias("rule"), F.lit(None).cast("bigint").alias("gidx"))
    )
