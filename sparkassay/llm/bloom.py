"""A filter of fixed size for sets of any size: it may let others through, never hold a member back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def build(values: DataFrame) -> np.ndarray:
    """One bit per value of the long column v, merged by aggregation: at most BITS / 64 words reach the driver."""
    bit = F.pmod(F.col("v"), F.lit(BITS)).alias("bit")
    word = values.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")
    )
    table = word.toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def maybe(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be a member."""
    bit = np.mod(values, BITS)
    return (bits[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
