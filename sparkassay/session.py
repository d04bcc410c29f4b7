"""Session helpers: shared scratch space, durable lineage cuts and the number of ordered slices."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local-mode session without the setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """The shuffle files of a query that is built and run inside go when it ends, not when the driver collects garbage.

    For chains of jobs that each store their result. The session's own setting comes back afterwards.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a lookup table for broadcast after checking that it has at most ``max_rows`` rows.

    A larger one is returned as it is, and the join becomes a shuffle join with AQE's skew handling.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def keyed(df: DataFrame) -> DataFrame:
    """Mark a table that grows with the designs for a shuffle join.

    Spark's own choice goes by the size of files, and well compressed ones of a million designs pass as small: the whole
    table would be collected by the driver for a broadcast, once per job.
    """
    return df.hint("merge")


def default_slices(spark: SparkSession) -> int:
    """Slices of one ordered key: the next power of two above the shuffle width, 16 to 4096."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    slices = 16
    while slices < width and slices < 4096:
        slices *= 2
    return slices


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per Spark application, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_sparkassay_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-")
    path = os.path.join(folder, "sparkassay_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for top, dirs, files in os.walk(here):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(top, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    context._sparkassay_shipped = True
