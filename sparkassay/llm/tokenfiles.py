"""Token ids in compressed shard files with a shared zstandard dictionary.

A shard holds documents in ascending key order. Every document is one zstandard frame, compressed with a dictionary
trained on serialized id arrays, so one short document can be read alone. Layout, all little-endian:

    magic  8 bytes | sha256 of the dictionary  32 | bytes per id  4 | documents n  4
    keys  n x int64 | key is null  n x uint8 | ids per document  n x uint32 | frame limits  (n + 1) x uint64 | frames
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .files import make_folder, write_file
from .sampling import distinct_sample
from .tokens import END_ID, dropped_space, end_mark

MAGIC = b"IDSHARD1"
SAMPLE_DOCS = 512  # documents the dictionary is trained on
SAMPLE_BYTES = 1 << 15  # longest of them
DICTIONARY_BYTES = 1 << 16
SHARD_BYTES = 8 << 20
NO_DICTIONARY = b"none"  # an empty file would not be read
LEVEL = 3


def train_dictionary(docs: DataFrame, encode, text: str, width: int) -> bytes:
    """A dictionary from the ids of at most ``SAMPLE_DOCS`` documents, those with the smallest hash; empty if too few."""
    texts = distinct_sample(docs.filter(F.octet_length(text) <= SAMPLE_BYTES), F.col(text), SAMPLE_DOCS)
    coded = encode([t.encode() for t in texts])
    samples = [np.frombuffer(c, "<u4").astype(f"<u{width}").tobytes() for c in coded]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def shard_bytes(digest: bytes, width: int, keys: list, counts: list[int], frames: list[bytes]) -> list[bytes]:
    held = np.asarray([0 if k is None else k for k in keys], "<i8")
    none = np.asarray([k is None for k in keys], np.uint8)
    limits = np.cumsum([0, *map(len, frames)]).astype("<u8")
    head = MAGIC + digest + np.asarray([width, len(keys)], "<u4").tobytes()
    return [head, held.tobytes(), none.tobytes(), np.asarray(counts, "<u4").tobytes(), limits.tobytes(), *frames]


def read_shard(data: bytes, dictionary: bytes, wanted=None):
    """(place, key, ids) of each document of a shard; only those with a key in ``wanted``, if given, are unpacked."""
    view = memoryview(data)
    if bytes(view[:8]) != MAGIC or bytes(view[8:40]) != hashlib.sha256(dictionary).digest():
        raise ValueError("no id shard, or another dictionary")
    width, n = (int(x) for x in np.frombuffer(view, "<u4", 2, 40))
    at = 48
    keys = np.frombuffer(view, "<i8", n, at)
    none = np.frombuffer(view, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(view, "<u4", n, at + 9 * n)
    limits = np.frombuffer(view, "<u8", n + 1, at + 13 * n).astype(np.int64) + at + 13 * n + 8 * (n + 1)
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    for i in range(n):
        k = None if none[i] else int(keys[i])
        if wanted is None or k in wanted:
            body = unpack.decompress(view[limits[i] : limits[i + 1]], max_output_size=int(counts[i]) * width)
            yield i, k, np.frombuffer(body, f"<u{width}").astype("<u4")


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
) -> None:
    """Encode every text and write the shards below ``path`` in ascending (key, text) order, null keys first.

    Rows are dealt to tasks by ranges of (key, hash of the text), so a repeated key with different texts is split as
    well. A null or empty text is ``end_id`` alone; repeated rows are written as often as they occur; further columns
    are not read. ``path/parts`` lists the shards with their counts.
    """
    spark = docs.sparkSession
    width = 2
    data = train_dictionary(docs, dropped_space(tokenizer), text, width)
    make_folder(f"{path}/shards")
    write_file(f"{path}/dictionary.bin", data or NO_DICTIONARY)
    digest = hashlib.sha256(data).digest()
    shared = spark.sparkContext.broadcast(data)

    def run(batches):
        encoder, mark, part = dropped_space(tokenizer), end_mark(end_id), TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_content_size=True)
        keys, counts, frames, size, shard = [], [], [], 0, 0

        def close():
            write_file(f"{path}/shards/{part:06d}-{shard:04d}.ids", *shard_bytes(digest, width, keys, counts, frames))
            cols = [[part], [shard], [len(keys)], [sum(counts)]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["part", "shard", "docs", "ids"])

        for batch in batches:
            told, bodies = batch.column(0).to_pylist(), tx.plain(batch.column(1))
            for first, last in tx.pieces(bodies):
                for k, coded in zip(told[first:last], encoder(bodies[first:last].to_pylist())):
                    ids = np.frombuffer(coded + mark, "<u4")
                    if ids.max() >> 8 * width:
                        raise ValueError(f"an id needs more than {width} bytes")
                    frames.append(squeeze.compress(ids.astype(f"<u{width}").tobytes()))
                    keys.append(k)
                    counts.append(len(ids))
                    size += len(frames[-1])
                    if size >= SHARD_BYTES:
                        yield close()
                        keys, counts, frames, size, shard = [], [], [], 0, shard + 1
        if keys:
            yield close()

    order = [F.col("k").asc_nulls_first(), F.xxhash64("t"), F.col("t").asc_nulls_first()]
    dealt = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    dealt = dealt.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(run, "part long, shard long, docs long, ids long").write.mode("overwrite").parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id", keys=None, ids: bool = True) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32, and ids if wanted, of every document.

    With ``keys``, a small set, only those documents are unpacked, each by its place in the shard's index.
    """
    data = spark.read.format("binaryFile").load(f"{path}/dictionary.bin").select("content").first()[0]
    shared = spark.sparkContext.broadcast(b"" if bytes(data) == NO_DICTIONARY else bytes(data))
    wanted = None if keys is None else set(keys)
    more = ", ids array<int>" if ids else ""

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part, shard = (int(x) for x in where.rsplit("/", 1)[1].removesuffix(".ids").split("-"))
                body = content.as_buffer()
                n = int(np.frombuffer(body, "<u4", 1, 44)[0])
                before = np.cumsum(np.append(0, np.frombuffer(body, "<u4", n, 48 + 9 * n).astype(np.int64)))
                rows = []
                for i, k, x in read_shard(body, shared.value, wanted):
                    rows.append((part, shard, k, int(before[i]), len(x), zlib.crc32(x.tobytes()), x))
                    if len(rows) >= 2000 or i == n - 1:
                        yield _rows(rows, ids)
                        rows = []
                if rows:
                    yield _rows(rows, ids)

    found = spark.read.format("binaryFile").load(f"{path}/shards").select("path", "content")
    schema = "part long, shard long, k long, before long, n_tokens long, ids_crc32 long" + more
    each = found.mapInArrow(run, schema)
    # One row per shard of megabytes: a running sum over the list of files.
    parts = spark.read.parquet(f"{path}/parts")
    earlier = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", "shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    out = each.join(base, ["part", "shard"])
    cols = [F.col("k").alias(key), (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"]
    return out.select(*cols, *(["ids"] if ids else []))


def _rows(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in cols[:6]]
    names = ["part", "shard", "k", "before", "n_tokens", "ids_crc32"]
    if ids:
        limits = np.cumsum([0, *map(len, cols[6])]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(limits, pa.array(np.concatenate(cols[6]).astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)
