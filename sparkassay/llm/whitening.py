"""Whitening of vectors by the leading principal components of the distinct ones.

Every entry becomes the integer floor(64 * entry) + 1000000. Each distinct integer vector counts once for the fit. Counts
and sums are whole numbers; the covariance is taken of vectors centred at the mean, a matrix per task that lanes of tasks
add up. Only one matrix of dimension x dimension reaches the driver, where its leading eigenvectors are found (``eigen``);
the projection goes back as a broadcast of dimension x components numbers.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.session import scratch_path

from . import eigen

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
FARTHEST = 1 << 52  # whole numbers stop here, where doubles cease to hold all of them
LANES = 32  # tasks that add up the matrices of all tasks
HALF = 26  # bits of the lower half of a number in sums
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _packed(whole: np.ndarray) -> list[bytes]:
    """One string per row of integers: a byte for the width, then the numbers; equal rows have equal strings."""
    far = np.maximum(whole.max(1), -1 - whole.min(1)) if whole.shape[1] else np.zeros(len(whole), np.int64)
    out = np.empty(len(whole), object)
    left = np.ones(len(whole), bool)
    for width, kind in enumerate(WIDTHS):
        now = left & (far <= np.iinfo(kind).max)
        out[now] = [bytes([width]) + row.tobytes() for row in whole[now].astype(kind)]
        left &= ~now
    return out.tolist()


def unpacked(strings: pa.Array, size: int) -> np.ndarray:
    """The integers, less SHIFT, of ``_packed`` strings of ``size`` numbers each."""
    out = np.zeros((len(strings), size), np.int64)
    rows = strings.to_pylist()
    width = np.fromiter((row[0] for row in rows), np.int64, len(rows))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        body = np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), -1)[:, 1:]
        out[at] = np.ascontiguousarray(body).view(WIDTHS[w])
    return out


def _scaled(batches):
    for batch in batches:
        lists = batch.column(1)
        limits = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        size = np.diff(limits)
        x = np.empty(len(batch), object)
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            v = flat[limits[at][:, None] + np.arange(s)]
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(SCALE * v), -FARTHEST, FARTHEST).astype(np.int64)
            x[at] = _packed(whole)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(x.tolist(), pa.binary())], ["id", "size", "x"])


def scaled(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, size, x): the whole numbers of every vector that is not null and has only finite entries."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    kept = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    return kept.filter(F.col("v").isNotNull()).filter(~bad).mapInArrow(_scaled, "id long, size int, x binary")


def _totals(size: int):
    """Per dimension the sum of the upper and of the lower half of all numbers; place -1 counts the rows."""

    def run(batches):
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = unpacked(batch.column(0), size)
            n += len(x)
            high += (x >> HALF).sum(0)
            low += (x & ((1 << HALF) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, size), pa.int32()), pa.array(np.append(n, high)), pa.array(np.append(0, low))], ["place", "high", "low"]
            )

    return run


def _added(batches):
    """Adds up matrices of equal size, one string each."""
    total = None
    for batch in batches:
        for row in batch.column(0).to_pylist():
            part = np.frombuffer(row)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])


def _sum_of_tasks(rows: DataFrame, make) -> np.ndarray:
    """The sum of the matrices that ``make`` gives for the batches of each task: lanes first, then their sums."""

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                part = make(batch.column(0))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    each = rows.mapInArrow(run, "m binary").withColumn("lane", F.spark_partition_id() % LANES)
    lanes = each.repartition(LANES, "lane").select("m").mapInArrow(_added, "m binary")
    return np.frombuffer(lanes.repartition(1).mapInArrow(_added, "m binary").first()[0])


class Fit:
    """Count, sums, mean and components of the distinct vectors of one size."""

    def __init__(self, rows: DataFrame, size: int, components: int):
        self.size = size
        totals = {r["place"]: r for r in rows.mapInArrow(_totals(size), "place int, high long, low long").groupBy("place").agg(
            F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")
        ).collect()}  # one row per dimension
        self.n = n = int(totals[-1]["high"])
        sums = [(int(totals[i]["high"]) << HALF) + int(totals[i]["low"]) for i in range(size)]
        self.middle = [(2 * s + n) // (2 * n) for s in sums]  # the whole number next to the mean
        self.rest = [s - n * m for s, m in zip(sums, self.middle)]
        self.offset = np.asarray([r / n for r in self.rest])
        centred = self.centred
        covariance = _sum_of_tasks(rows, lambda x: (lambda y: y.T @ y)(centred(x))).reshape(size, size) / n
        covariance = (covariance + covariance.T) / 2
        trace = math.fsum(np.diag(covariance))
        values, vectors = eigen.principal(covariance, components)
        full = values > size * eigen.EPS * max(trace, 0.0)  # beyond the rank there is nothing to scale
        self.values = values[full]
        self.explained = self.values / trace if trace > 0 else self.values
        self.turn = turn = vectors[:, full] / np.sqrt(self.values)
        self.error = 0.0
        if len(self.values):

            def moments(x):
                z = np.column_stack([centred(x) @ turn, np.ones(len(x))])
                return z.T @ z

            k = len(self.values)
            second = _sum_of_tasks(rows, moments).reshape(k + 1, k + 1) / n
            mean = second[k, :k]
            self.error = float(np.abs(second[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())

    def whole(self, strings: pa.Array) -> np.ndarray:
        """Numbers less the whole mean, exact."""
        return unpacked(strings, self.size) - np.asarray(self.middle, np.int64)

    def centred(self, strings: pa.Array) -> np.ndarray:
        return self.whole(strings).astype(float) - self.offset

    def deviations(self, whole: np.ndarray) -> list[Decimal | None]:
        """Sum of (n * x - S)^2 over the dimensions of every row, exact; None beyond 38 digits."""
        most = self.n * (int(np.abs(whole).max(initial=0)) + 1)
        if most * most * self.size < 1 << 63:
            d = self.n * whole - np.asarray(self.rest, np.int64)
            return [Decimal(x) for x in (d * d).sum(1).tolist()]
        exact = (sum((self.n * x - r) ** 2 for x, r in zip(row, self.rest)) for row in whole.tolist())
        return [Decimal(x) if x < 10**38 else None for x in exact]

    def projected(self, batches):
        k = len(self.values)
        for batch in batches:
            whole = self.whole(batch.column(1))
            z = (whole.astype(float) - self.offset) @ self.turn
            rows = np.repeat(np.arange(len(batch)), k)
            times = len(batch)
            deviation = pa.array(self.deviations(whole), pa.decimal128(38, 0)).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1), times), pa.int32()),
                    pa.array(np.full(k * times, self.n)),
                    deviation,
                    pa.array(z.ravel()),
                    pa.array(np.tile(self.explained, times)),
                    pa.array(np.full(k * times, self.error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, one row per vector and component.

    Rows whose vector is null, or holds null or non-finite entries, are left out; a null key stays a null vec_id. Vectors
    of each size have a fit of their own. Repeated vectors, and different ones with the same whole numbers, count once
    for the fit and get equal rows; repeated keys get the rows of each of their vectors. A component whose eigenvalue is
    zero to rounding gives no rows, so a table of one distinct vector, of empty vectors, or without vectors gives none.
    Entries beyond 2^46 in size count as 2^46. ``deviation`` is null beyond 38 digits. Further columns are not read.
    """
    spark = vectors.sparkSession
    path, fitted = scratch_path(spark, "scaled"), scratch_path(spark, "distinct")
    scaled(vectors, key, column).write.parquet(path)
    rows = spark.read.parquet(path)
    rows.select("size", "x").dropDuplicates(["size", "x"]).write.parquet(fitted)
    distinct = spark.read.parquet(fitted)
    sizes = sorted(r["size"] for r in distinct.select("size").distinct().collect() if r["size"])
    out = None
    for size in sizes:
        fit = Fit(distinct.filter(F.col("size") == size).select("x"), size, components)
        part = rows.filter(F.col("size") == size).select("id", "x").mapInArrow(fit.projected, OUT)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], OUT) if out is None else out
