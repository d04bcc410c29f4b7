"""Nearest neighbours by inner product with a hash-prefix forest.

Every tree gives each vector a long string of sign bits and keeps the strings sorted, so the vectors that share a prefix
with a query are one range of the sorted array. A query descends in every tree to its longest match and then ascends in
all trees at once, one bit at a time, until the ranges hold enough candidates. How many vectors share each prefix is
counted over the whole table beforehand (at most TREES * 2^BITS numbers), so the level at which a query stops is the
same in every block of the table.

Inner products of vectors of different lengths are searched as angles: each row of the table gets one more component that
fills its length up to the greatest one, and a query gets 0 there, so its angle to a row falls as their inner product
grows. A vector that is both has a string for each part. Scores are taken from the original vectors in double precision, component by
component in order, so equal vectors have equal scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.session import durable

TREES = 64
BITS = 14
SHARE = 0.9  # candidates wanted, over all trees, as a share of the rows
SEED = 20
INDEX_ROWS = 8192  # rows of the table, and queries, that meet in one task
QUERY_ROWS = 4096
STEP = 256


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v, largest): vectors that are not null, not zero and finite in every component; ``largest`` is that of them."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    largest = F.array_max(F.transform("v", F.abs))
    found = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    found = found.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(~bad)
    return found.withColumn("largest", largest).filter("largest > 0")


def _lengths(largest: float):
    """The greatest length among the vectors of a task, in units of the largest component, so no square overflows."""

    def run(batches):
        longest = 0.0
        for batch in batches:
            if len(batch):
                v = batch.column(0).flatten().to_numpy().reshape(len(batch), -1) / largest
                longest = max(longest, float((v * v).sum(1).max()) ** 0.5)
        yield pa.RecordBatch.from_arrays([pa.array([longest])], ["longest"])

    return run


def _strings(planes: np.ndarray, largest: float, longest: float, every: int):
    def codes(filled: np.ndarray) -> list[bytes]:
        signs = (filled @ planes > 0).reshape(-1, TREES, BITS)
        return [x.tobytes() for x in (signs << np.arange(BITS)[::-1]).sum(2).astype(np.uint16)]

    def run(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(n, -1)
            scaled = v / largest
            fill = np.sqrt(np.maximum(0, longest**2 - (scaled * scaled).sum(1)))
            asks = np.flatnonzero(batch.column(0).to_numpy() % every == 0)
            own = np.full(n, None, object)
            own[asks] = codes(np.column_stack([scaled[asks], np.zeros(len(asks))]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x.tobytes() for x in v]),
                    pa.array(codes(np.column_stack([scaled, fill]))),
                    pa.array(own, pa.binary()),
                ],
                ["id", "v", "codes", "asked"],
            )

    return run


def _count(batches):
    total = np.zeros((TREES, 1 << BITS), np.int64)
    for batch in batches:
        codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(-1, TREES)
        for t in range(TREES):
            total[t] += np.bincount(codes[:, t], minlength=1 << BITS)
    tree, code = np.nonzero(total)
    for i in range(0, len(tree), 10_000):
        t, c = tree[i : i + 10_000], code[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c), pa.array(total[t, c])], ["tree", "code", "times"])


def stop_level(codes: np.ndarray, below: np.ndarray, wanted: float, least: int) -> np.ndarray:
    """The longest prefix at which a query's ranges hold ``wanted`` rows over all trees, and one of them ``least`` rows;
    ``below`` counts smaller codes."""
    level = np.zeros(len(codes), np.int64)
    tree = np.arange(TREES)[None]
    for x in range(1, BITS + 1):
        shift = BITS - x
        low = (codes >> shift).astype(np.int64) << shift
        held = below[tree, low + (1 << shift)] - below[tree, low]
        level[(held.sum(1) >= wanted) & (held.max(1) >= least)] = x
    return level


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors))
    for d in range(len(query)):
        out += vectors[:, d] * query[d]
    return out


def _search(k: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(index) or not len(queries):
            return none
        v, q = (np.frombuffer(b"".join(f["v"])).reshape(len(f), -1) for f in (index, queries))
        code, asked = (np.frombuffer(b"".join(f["codes"]), np.uint16).reshape(-1, TREES) for f in (index, queries))
        ids, own, level = index["id"].to_numpy(), queries["id"].to_numpy(), queries["level"].to_numpy()
        order = np.argsort(code, axis=0, kind="stable")
        ranked = np.take_along_axis(code, order, 0).astype(np.int64)
        low = (asked.astype(np.int64) >> (BITS - level)[:, None]) << (BITS - level)[:, None]
        high = low + (1 << (BITS - level))[:, None]
        first = np.stack([np.searchsorted(ranked[:, t], low[:, t]) for t in range(TREES)], 1)
        last = np.stack([np.searchsorted(ranked[:, t], high[:, t]) for t in range(TREES)], 1)
        out = []
        for i in range(0, len(q), STEP):
            near = q[i : i + STEP] @ v.T
            for j in range(len(near)):
                hit = np.zeros(len(v), bool)
                for t in range(TREES):
                    hit[order[first[i + j, t] : last[i + j, t], t]] = True
                hit &= ids != own[i + j]
                some = np.flatnonzero(hit)
                rough = near[j, some]
                if len(some) > k:
                    least = np.partition(rough, len(some) - k)[len(some) - k]
                    some = some[rough >= (least - 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else least)]
                exact = scores(v[some], q[i + j])
                best = np.lexsort((ids[some], -exact))[:k]
                out.append((own[i + j], ids[some][best], exact[best]))
        if not out:
            return none
        n = [len(x[1]) for x in out]
        return pd.DataFrame(
            {"query_id": np.repeat([x[0] for x in out], n), "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])}
        )

    return run


def nearest(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates found for every row whose key is divisible by ``every``.

    Candidates are all other rows; ties go to the smaller key. Rows with a null key take no part, nor do vectors that
    are null, zero, or hold null or non-finite components, or differ in size from most. A repeated query key is asked
    once, for each of its vectors; a repeated candidate is a candidate each time. The queries meet the rows in blocks.
    """
    spark = vectors.sparkSession
    found = usable(vectors, key, column)
    sizes = found.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("rows"), F.max("largest").alias("largest"))
    common = sizes.orderBy(F.desc("rows"), "size").first()
    size, rows, largest = common or (1, 0, 1.0)
    planes = np.random.default_rng(SEED).normal(size=(size + 1, TREES * BITS))
    found = found.filter(F.size("v") == size).select("id", "v")
    longest = found.select("v").mapInArrow(_lengths(largest), "longest double").agg(F.max("longest")).first()[0] or 1.0
    strings = _strings(planes, largest, longest, every)
    coded = durable(found.mapInArrow(strings, "id long, v binary, codes binary, asked binary"))
    counted = coded.select("codes").mapInArrow(_count, "tree long, code long, times long")
    table = counted.groupBy("tree", "code").agg(F.sum("times").alias("times")).toArrow()  # at most TREES * 2^BITS rows
    below = np.zeros((TREES, (1 << BITS) + 1), np.int64)
    below[table.column("tree").to_numpy(), table.column("code").to_numpy() + 1] = table.column("times").to_numpy()
    shared = spark.sparkContext.broadcast(below.cumsum(1))

    def descend(batches):
        for batch in batches:
            if len(batch):
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, TREES)
                level = stop_level(codes, shared.value, SHARE * rows, min(k + 1, rows))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(level)], ["id", "v", "codes", "level"])

    asked = coded.filter("asked is not null").select("id", "v", F.col("asked").alias("codes")).dropDuplicates(["id", "v"])
    asked = asked.mapInArrow(descend, "id long, v binary, codes binary, level long")
    blocks = max(1, -(-rows // INDEX_ROWS))
    groups = max(1, -(-(rows // every + 1) // QUERY_ROWS))
    salt = F.xxhash64("id", "v")
    index = coded.drop("asked").withColumn("block", F.pmod(salt, F.lit(blocks))).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    asked = asked.withColumn("group", F.pmod(salt, F.lit(groups)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    met = index.groupBy("block", "group").cogroup(asked.groupBy("block", "group"))
    best = met.applyInPandas(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
