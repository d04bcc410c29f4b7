"""Bounded samples of distinct texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_sample(df: DataFrame, value: Column, n: int) -> list[str]:
    """The distinct values with the ``n`` smallest hashes, in the order of these; fewer if there are fewer.

    Tasks send hashes first and then only the chosen values, so what reaches the driver does not grow with the tasks.
    """
    hashed = df.select(value.alias("v")).select("v", F.xxhash64("v").alias("h")).filter("v is not null")
    low = [r[0] for r in hashed.groupBy("h").agg(F.lit(1).alias("one")).select("h").orderBy("h").limit(n).collect()]
    if not low:
        return []
    chosen = hashed.filter(F.col("h") <= max(low)).groupBy("h", "v").agg(F.lit(1).alias("one")).collect()
    return [r["v"] for r in sorted(chosen, key=lambda r: (r["h"], r["v"]))]
