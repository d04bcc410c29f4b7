"""Campaign shards as a data source: lines with their place, digests checked while they are read, a cursor per job.

Layout: ``<root>/<job>/sample-shards/<number>.jsonl`` with ``<number>.sha256.json`` beside it. An input partition is a run
of shards, packed by bytes with a fixed cost per file, so small shards share a task; a shard is read block by block, and
neither it nor its lines are ever held whole. ``scan`` lists the folders of the jobs in tasks, which leave a file per run: the
driver learns the names of these files and of the jobs, but no shard. ``format("campaign_shards")`` gives, in the order of
shard numbers,

    job, shard, ordinal, line, problem

one row per line that is not blank, and one more row, without ordinal and line, for every shard with a problem:
``digest mismatch``, ``missing digest``, ``unreadable digest``, or ``missing shard`` for a digest alone. A shard without lines
and without a problem gives such a row, too, so that every shard that was checked leaves one. Written rows go to drafts
that the driver renames when all tasks have ended, so a failed or repeated task leaves no shard behind.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from itertools import batched, chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import scratch_path

FORMAT = "campaign_shards"
SCHEMA = "job string, shard int, ordinal long, line string, problem string"
BLOCK = 1 << 20
BATCH = 10_000
INDEX = "index.json"
# Bytes of one input partition, what opening a shard counts as, renames under way at once and known at once.
PARTITION_BYTES, OPEN_BYTES, MOVES, NAMED = 64 << 20, 256 << 10, 16, 4096
NAME = re.compile(r"(?:^|/)([^/]+)/sample-shards/(\d+)\.(jsonl|sha256\.json)$")


@dataclass
class Shard:
    job: str
    shard: int
    path: str | None
    digest: str | None
    size: int = 0


@dataclass
class ShardRun(InputPartition):
    shards: list[Shard]


def packed(found: Iterable[Shard]) -> list[ShardRun]:
    """Runs of shards in their order, each of about ``PARTITION_BYTES``; a shard is never cut."""
    runs, room = [], 0
    for x in found:
        if room <= 0:
            runs.append(ShardRun([]))
            room = PARTITION_BYTES
        runs[-1].shards.append(x)
        room -= x.size + OPEN_BYTES
    return runs


def _at(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def _found(infos: Iterable[fs.FileInfo]) -> list[Shard]:
    found: dict[tuple[str, int, str], Shard] = {}  # by the whole name as well: 7 and 000007 are two shards of one number
    for info in infos:
        if hit := NAME.search(info.path):
            at = (hit[1], int(hit[2]))
            x = found.setdefault((*at, info.path[: hit.start(3)]), Shard(*at, None, None))
            if hit[3] == "jsonl":
                x.path, x.size = info.path, info.size or 0
            else:
                x.digest = info.path
    return [x for _, x in sorted(found.items())]


def shards(root: str) -> list[Shard]:
    """All shards and lone digests of all jobs, by job and number."""
    system, top = _at(root)
    return _found(system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)))


def listed(spark: SparkSession, root: str) -> str:
    """A folder with a file per run of shards below ``root``, written by the tasks that list the jobs' folders, and ``INDEX``.

    The index has the names of the files and what they weigh, in the order of jobs and numbers; files that a failed task has
    left are not in it.
    """
    system, top = _at(root)
    inside = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
    places = [(top, False), *sorted((x.path, True) for x in inside if x.type == fs.FileType.Directory)]
    out = scratch_path(spark, "shard-runs")
    notes, folder = _at(out)
    notes.create_dir(folder, recursive=True)

    def run(mine: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, int]]:
        (system, _), (notes, folder), token = _at(root), _at(out), uuid.uuid4().hex
        for path, deep in mine:
            infos = system.get_file_info(fs.FileSelector(path, recursive=deep, allow_not_found=True))
            for x in packed(_found(infos)):
                name = f"{token}-{x.shards[0].job}-{x.shards[0].shard}.json"
                with notes.open_output_stream(f"{folder}/{name}") as f:
                    f.write(json.dumps([asdict(y) for y in x.shards]).encode())
                yield name, sum(y.size + OPEN_BYTES for y in x.shards)

    tasks = min(len(places), 4 * spark.sparkContext.defaultParallelism)
    names = spark.sparkContext.parallelize(places, tasks).mapPartitions(run).collect()
    with notes.open_output_stream(f"{folder}/{INDEX}") as f:
        f.write(json.dumps(names).encode())
    return out


def _lines(stream, digest) -> Iterator[str]:
    """The lines of a file that are not blank; ``digest`` takes in every byte."""
    rest: list[bytes] = []
    while block := stream.read(BLOCK):
        digest.update(block)
        *whole, last = block.split(b"\n")
        for i, line in enumerate(whole):
            line = b"".join([*rest, line]) if i == 0 else line
            if i == 0:
                rest = []
            if line.strip():
                yield line.decode("utf-8", "replace")
        rest.append(last)
    if (line := b"".join(rest)).strip():
        yield line.decode("utf-8", "replace")


def _recorded(system: fs.FileSystem, path: str) -> str | None:
    try:
        with system.open_input_stream(path) as f:
            noted = json.loads(f.read())
        return noted["sha256"] if isinstance(noted["sha256"], str) else None
    except (ValueError, KeyError, TypeError):
        return None


def read_run(root: str, part: ShardRun) -> Iterator[pa.RecordBatch]:
    system, _ = _at(root)
    for x in part.shards:
        yield from read_shard(system, x)


def read_shard(system: fs.FileSystem, part: Shard) -> Iterator[pa.RecordBatch]:
    def batch(ordinals: list, lines: list, problem: str | None = None) -> pa.RecordBatch:
        n = len(lines)
        columns = [[part.job] * n, [part.shard] * n, ordinals, lines, [problem] * n]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["job", "shard", "ordinal", "line", "problem"])

    if part.path is None:
        yield batch([None], [None], "missing shard")
        return
    digest, held, n = hashlib.sha256(), [], 0
    with system.open_input_stream(part.path) as stream:
        for line in _lines(stream, digest):
            held.append(line)
            if len(held) == BATCH:
                yield batch(list(range(n, n + BATCH)), held)
                n, held = n + BATCH, []
    if held:
        yield batch(list(range(n, n + len(held))), held)
    if part.digest is None:
        yield batch([None], [None], "missing digest")
        return
    recorded = _recorded(system, part.digest)
    if recorded != digest.hexdigest():
        yield batch([None], [None], "unreadable digest" if recorded is None else "digest mismatch")
    elif not n and not held:
        yield batch([None], [None])


@dataclass
class ListedRuns(InputPartition):
    """Names of files of a folder made by ``listed``."""

    names: list[str]


class Reader(DataSourceReader):
    """Reads the runs of a folder made by ``listed``; without one the driver lists the shards itself."""

    def __init__(self, root: str, runs: str | None = None):
        self.root, self.runs = root, runs

    def partitions(self) -> list[InputPartition]:
        if self.runs is None:
            return packed(shards(self.root))
        system, folder = _at(self.runs)
        with system.open_input_stream(f"{folder}/{INDEX}") as f:
            names = json.loads(f.read())
        out, room = [], 0
        for name, weight in names:
            if room <= 0:
                out.append(ListedRuns([]))
                room = PARTITION_BYTES
            out[-1].names.append(name)
            room -= weight
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, ListedRuns):
            system, folder = _at(self.runs)
            for name in partition.names:
                with system.open_input_stream(f"{folder}/{name}") as f:
                    run = ShardRun([Shard(**x) for x in json.loads(f.read())])
                yield from read_run(self.root, run)
        elif isinstance(partition, ShardRun):
            yield from read_run(self.root, partition)


class StreamReader(DataSourceStreamReader):
    """The cursor of a job is the number of the next shard; a batch takes each job's new shards up to the first gap.

    A shard counts as arrived once its digest is there too, so one that is still being copied waits for the next batch.
    """

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        cursor: dict[str, int] = {}
        for x in shards(self.root):
            if x.path and x.digest and x.shard == cursor.get(x.job, 0):
                cursor[x.job] = x.shard + 1
        return cursor

    def partitions(self, start: dict, end: dict) -> list[ShardRun]:
        return packed(x for x in shards(self.root) if start.get(x.job, 0) <= x.shard < end.get(x.job, 0))

    def read(self, partition: ShardRun) -> Iterator[pa.RecordBatch]:
        return read_run(self.root, partition) if isinstance(partition, ShardRun) else iter(())

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Drafts(WriterCommitMessage):
    """What one task wrote, in few bytes per shard: its token and its numbers by job."""

    token: str
    numbers: dict[str, list[int]]

    def names(self, top: str) -> Iterator[tuple[str, str]]:
        """(draft, final) of every file."""
        for job, numbers in self.numbers.items():
            for n in numbers:
                draft, final = f"{top}/{job}/sample-shards/_draft-{self.token}-{n}", f"{top}/{job}/sample-shards/{n:06d}"
                yield draft, f"{final}.jsonl"
                yield f"{draft}.sha256", f"{final}.sha256.json"


class Writer(DataSourceWriter):
    """Writes rows (job, shard, line) that come sorted by job and shard in each task, a shard in one task only."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows) -> Drafts:
        system, top = _at(self.root)
        made, at, out, digest, draft = Drafts(uuid.uuid4().hex, {}), None, None, None, ""

        def close() -> None:
            out.close()
            with system.open_output_stream(f"{draft}.sha256") as note:
                note.write(json.dumps({"sha256": digest.hexdigest()}).encode())
            made.numbers.setdefault(at[0], []).append(at[1])

        for row in rows:
            if (row["job"], row["shard"]) != at:
                if out is not None:
                    close()
                at, digest = (row["job"], row["shard"]), hashlib.sha256()
                folder = f"{top}/{at[0]}/sample-shards"
                system.create_dir(folder, recursive=True)
                draft = f"{folder}/_draft-{made.token}-{at[1]}"
                out = system.open_output_stream(draft)
            line = row["line"].encode() + b"\n"
            digest.update(line)
            out.write(line)
        if out is not None:
            close()
        return made

    def commit(self, messages: list) -> None:
        system, top = _at(self.root)
        names = chain.from_iterable(m.names(top) for m in messages if m)
        with ThreadPoolExecutor(MOVES) as pool:
            for some in batched(names, NAMED):  # a pool holds all it is given
                for _done in pool.map(lambda pair: system.move(*pair), some):
                    pass

    def abort(self, messages: list) -> None:
        system, top = _at(self.root)
        for message in messages:
            for draft, _final in message.names(top) if message else []:
                system.delete_file(draft)


class CampaignShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("runs"))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All jobs under ``root``: job, shard, ordinal, line, problem; the shards that are there when it is called."""
    spark.dataSource.register(CampaignShards)
    return spark.read.format(FORMAT).option("runs", listed(spark, root)).load(root)


def stream(spark: SparkSession, root: str) -> DataFrame:
    """New shards of all jobs as they arrive, each job with a cursor of its own."""
    spark.dataSource.register(CampaignShards)
    return spark.readStream.format(FORMAT).load(root)


def write(rows: DataFrame, root: str) -> None:
    """Write (job, shard, ordinal, line) as shards with their digests, all jobs in one job of Spark."""
    rows.sparkSession.dataSource.register(CampaignShards)
    dealt = rows.repartition("job", "shard").sortWithinPartitions("job", "shard", "ordinal")
    slim = dealt.select("job", F.col("shard").cast("int"), F.col("ordinal").cast("long"), "line", F.lit(None).cast("string").alias("problem"))
    slim.write.format(FORMAT).mode("append").save(root)


def parsed(scanned: DataFrame, schema) -> DataFrame:
    """(job, shard, ordinal, the fields of ``schema``) of the lines; a line that is no record gives null fields."""
    lines = scanned.where("problem IS NULL AND ordinal IS NOT NULL").withColumn("r", F.from_json("line", schema))
    return lines.select("job", "shard", "ordinal", "r.*")


def problems(scanned: DataFrame, plan: DataFrame) -> DataFrame:
    """(job, shard, problem, found, expected): shards that fail their digest, and jobs whose rows do not match the plan.

    ``plan``: key, episodes. ``found`` and ``expected`` count rows; they are null for a shard. Problems of jobs have no shard:
    ``row count``, ``no shards`` for a planned job without any, ``not planned`` for a job that the plan does not name.
    """
    shard = scanned.where("problem IS NOT NULL").select(
        "job", "shard", "problem", F.lit(None).cast("long").alias("found"), F.lit(None).cast("long").alias("expected")
    )
    have = scanned.groupBy("job").agg(F.count("line").alias("found"))
    both = plan.select(F.col("key").alias("job"), F.col("episodes").alias("expected"), F.lit(True).alias("planned")).join(have, "job", "full")
    said = (
        F.when(F.col("planned").isNull(), "not planned")
        .when(F.col("found").isNull(), "no shards")
        .when(~F.col("found").eqNullSafe(F.col("expected")), "row count")
    )
    jobs = both.select("job", F.lit(None).cast("int").alias("shard"), said.alias("problem"), "found", "expected")
    return shard.unionByName(jobs.where("problem IS NOT NULL"))


def spoil(root: str, digests: dict[int, str | None], lone: tuple[str, int] | None = None) -> None:
    """For drills: put ``digests`` (None: an unnamed side-car, so none) beside the written shards of these numbers in every
    job, and a digest without a shard at ``lone`` (job, number)."""
    system, top = _at(root)
    for job in system.get_file_info(fs.FileSelector(top, allow_not_found=True)) if digests else []:
        for number, noted in digests.items():
            at = f"{job.path}/sample-shards/{number:06d}"
            digest = f"{at}.sha256.json"
            if system.get_file_info(f"{at}.jsonl").type != fs.FileType.File:
                continue
            if noted is None:
                system.move(digest, f"{digest}.aside")
            else:
                with system.open_output_stream(digest) as out:
                    out.write(json.dumps({"sha256": noted}).encode())
    if lone:
        folder = f"{top}/{lone[0]}/sample-shards"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{lone[1]:06d}.sha256.json") as out:
            out.write(json.dumps({"sha256": "0" * 64}).encode())
