"""Web archives: writing with revisit records, and reading by verified record boundaries.

An archive can be read from any place, but the magic of a record may also stand inside a payload. Tasks therefore list,
block by block, every place that could start a record together with its successor, the place where the next record
would start. Inside a block the links are contracted by pointer jumping in numpy; between blocks Spark jumps from the
file's start with doubled links, so a file of 2^k blocks takes k rounds. Only records on that chain are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.session import durable

from . import bloom
from . import text as tx
from .files import read_range, write_file

# Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_BYTES = 100  # payloads below this are never revisits

ARCHIVE_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
HEADER_BYTES = 1 << 16  # read beyond a block at first; a longer header is read on


def _rows(pages: DataFrame, key: str, body: str) -> DataFrame:
    """k, url, body, digest, and v, a hash of key and digest."""
    digest = F.sha2(F.coalesce(F.col(body), F.lit("")).cast("binary"), 256).alias("digest")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).alias("k"), url.alias("url"), F.col(body).alias("body"), digest)
    return rows.withColumn("v", F.xxhash64("k", "digest"))


def revisits(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """(k, digest, first) of the rows that repeat the payload of a smaller key, ``first``; no payload is moved.

    A payload that a third of all rows share is combined before the shuffle, and split by the skew join after it, as
    both sides come straight from an exchange.
    """
    rows = _rows(pages, key, body).filter(F.octet_length("body") >= REVISIT_BYTES).select("k", "digest")
    firsts = rows.groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("times"))
    firsts = durable(firsts.filter("times > 1 and first is not null").select("digest", "first"))
    return rows.join(firsts, "digest").filter("k is null or k <> first").select("k", "digest", "first").distinct()


def record_bytes(key, url, body: bytes, digest: str, first) -> bytes:
    """One record; a revisit has no payload of its own but names its length and digest."""
    kind = b"response" if first is None else b"revisit"
    head = [b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:page:%d>" % key if key is not None else b"WARC-Record-ID: <urn:page:>"]
    if url is not None:
        safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(b"WARC-Target-URI: " + safe.encode())
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    head.append(b"X-Payload-Length: %d" % len(body))
    if first is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % first, b"WARC-Profile: " + PROFILE]
        body = b""
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
    return MAGIC + b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, key: str = "page_id", body: str = "html") -> None:
    """A record per row below ``path/archives``, and the list of files (path, length, records) in ``path/list``.

    Of the rows with equal payloads of at least ``REVISIT_BYTES`` bytes those with the smallest key are responses and
    the others revisits. A null payload is an empty one. Rows with equal keys are written as often as they occur; a
    null key is never the smallest unless all are null. Columns besides key, url and payload are not read.
    """

    other = durable(revisits(pages, key, body))
    shared = pages.sparkSession.sparkContext.broadcast(bloom.build(other.select(F.xxhash64("k", "digest").alias("v"))))

    def chosen(member: bool):
        def run(batches):
            for batch in batches:
                flags = bloom.maybe(shared.value, batch.column(4).to_numpy())
                yield batch.filter(pa.array(flags if member else ~flags))

        return run

    def run(batches):
        part, n, parts, size, records = TaskContext.get().partitionId(), 0, [], 0, 0

        def close():
            name = f"{path}/archives/{part:06d}-{n:04d}-{uuid.uuid4().hex[:8]}.warc"
            write_file(name, *parts)
            return pa.RecordBatch.from_pydict(
                {"path": [name], "length": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())}
            )

        for batch in batches:
            keys, urls, digests, firsts = (batch.column(i).to_pylist() for i in (0, 1, 3, 5))
            bodies = tx.plain(batch.column(2))
            for i, first in enumerate(firsts):
                one = record_bytes(keys[i], urls[i], bodies[i].as_py(), digests[i], first)
                parts.append(one)
                size, records = size + len(one), records + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    n, parts, size, records = n + 1, [], 0, 0
        if records:
            yield close()

    # Payloads stay where they are read, but for the rows that the filter takes for revisits: those are joined.
    rows = _rows(pages, key, body)
    schema = rows.schema
    plain = rows.mapInArrow(chosen(False), schema).withColumn("first", F.lit(None).cast(schema["k"].dataType))
    some = rows.mapInArrow(chosen(True), schema).alias("r").join(
        other.alias("o"), (F.col("r.digest") == F.col("o.digest")) & F.col("r.k").eqNullSafe(F.col("o.k")), "left"
    ).select("r.*", "o.first")
    listed = "path string, length long, records long"
    found = plain.mapInArrow(run, listed).unionByName(some.mapInArrow(run, listed))
    found.write.mode("overwrite").parquet(f"{path}/list")


def header(data: bytes, at: int) -> tuple[dict[bytes, bytes], int, int] | tuple[()] | None:
    """Fields, start of the payload and its length, if a record can start at ``at``; empty if ``data`` ends before that shows."""
    line = data.find(b"\r\n", at, at + 18)
    if data[at : at + 7] != MAGIC[:7] or line < 0:
        return None
    fields = {}
    while True:
        first = line + 2
        line = data.find(b"\r\n", first)
        if line < 0:
            return ()
        if line == first:
            break
        name, colon, value = data[first:line].partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        return None
    return fields, line + 2, int(length)


def whole_header(data: bytes, at: int, more) -> tuple[bytes, tuple[dict[bytes, bytes], int, int] | None]:
    """``data``, read on by ``more`` (place and number of bytes) as far as the header at ``at`` needs it, and that header."""
    while (found := header(data, at)) == () and (rest := more(len(data), max(HEADER_BYTES, len(data)))):
        data += rest
    return data, found or None


def candidates(data: bytes, start: int, size: int, more=lambda place, length: b"") -> tuple[np.ndarray, np.ndarray]:
    """Places in the first ``size`` bytes where a record can start, and where the chain from each leaves those bytes."""
    at, place, after = 0, [], []
    while 0 <= (at := data.find(MAGIC[:7], at)) < size:
        data, found = whole_header(data, at, more)
        if found:
            place.append(at)
            after.append(found[1] + found[2] + 4)
        at += 1
    own, leaves = np.asarray(place, np.int64), np.asarray(after, np.int64)
    # Pointer jumping: as long as a link ends at another candidate of the block, follow that one's link as well.
    while len(own):
        k = np.minimum(np.searchsorted(own, leaves), len(own) - 1)
        inside = own[k] == leaves
        if not inside.any():
            break
        leaves = np.where(inside, leaves[k], leaves)
    return own + start, leaves + start


def _reader(path: str, start: int):
    return lambda place, length: read_range(path, start + place, length)


def _links(frames):
    for frame in frames:
        for file, path, start, size in zip(frame["file"], frame["path"], frame["start"], frame["size"]):
            more = _reader(path, int(start))
            own, leaves = candidates(more(0, int(size) + HEADER_BYTES), int(start), int(size), more)
            yield pd.DataFrame({"file": file, "place": own, "leaves": leaves})


def entries(files: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(path, place): the first record on the chain from the file's start in every block that has one.

    A chain that ends at the file's length has met every record. Where ``files`` tell their number of ``records``, any
    other end is an error.
    """
    named = files.filter("length > 0").select(F.xxhash64("path").alias("file"), "path", "length")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("start")
    size = F.least(F.lit(block), F.col("length") - F.col("start")).alias("size")
    blocks = named.select("file", "path", "length", start).select("file", "path", "start", size)
    links = durable(blocks.repartition("file", "start").mapInPandas(_links, "file long, place long, leaves long"))
    # Between blocks only places that some chain leaves to can be entered.
    targets = links.select("file", F.col("leaves").alias("place")).distinct()
    jump = links.join(targets, ["file", "place"]).unionByName(links.filter("place = 0"))
    jump = durable(jump.select("file", "place", "leaves").distinct())
    reached = links.filter("place = 0").select("file", "place")
    longest = files.agg(F.max(F.ceil(F.col("length") / block))).first()[0] or 1
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        further = reached.join(jump, ["file", "place"]).select("file", F.col("leaves").alias("place"))
        reached = durable(reached.unionByName(further).distinct())
        far = jump.select("file", F.col("place").alias("leaves"), F.col("leaves").alias("beyond"))
        doubled = jump.join(far, ["file", "leaves"], "left")
        jump = durable(doubled.select("file", "place", F.coalesce("beyond", "leaves").alias("leaves")))
    if "records" in files.columns:
        whole = jump.filter("place = 0").select("file", F.col("leaves").alias("length"))
        cut = files.filter("records > 0").withColumn("file", F.xxhash64("path")).join(whole, ["file", "length"], "left_anti")
        if some := [r["path"] for r in cut.select("path").limit(10).collect()]:
            raise ValueError(f"records that cannot be reached from the start of {', '.join(some)}")
    found = reached.join(links.select("file", "place"), ["file", "place"], "left_semi")
    return found.join(named.select("file", "path"), "file").select("path", "place")


def read_archives(files: DataFrame, block: int = BLOCK_BYTES, payload: bool = True) -> DataFrame:
    """The records of ``files`` (path, length) that are reachable from each file's start.

    Columns path, place, record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest, and payload if
    wanted. Digest and length of a response are taken from its payload, those of a revisit from its header. A chain ends
    where no record can start: what follows is not read, and an error if ``files`` has a column ``records``, as the
    list of the writer does. Empty files give no rows.
    """

    def run(frames):
        for frame in frames:
            for path, place in zip(frame["path"], frame["place"]):
                start = int(place)
                end = (start // block + 1) * block
                more = _reader(path, start)
                data, at, rows = more(0, end - start + HEADER_BYTES), 0, []
                while start + at < end:
                    data, found = whole_header(data, at, more)
                    if not found:
                        break
                    fields, first, size = found
                    body = data[first : first + size]
                    if len(body) < size:
                        body += read_range(path, start + len(data), size - len(body))
                    if len(body) < size:
                        break
                    told = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
                    kind = told.get(b"warc-type")
                    digest, length = hashlib.sha256(body).hexdigest(), size
                    if kind == "revisit":
                        digest = told.get(b"warc-payload-digest", "").removeprefix("sha256:")
                        length = int(told.get(b"x-payload-length", "0"))
                    ids = [told.get(n) and told[n].strip("<>") for n in (b"warc-record-id", b"warc-refers-to")]
                    row = (path, start + at, kind, ids[0], told.get(b"warc-target-uri"), ids[1], length, digest)
                    rows.append(row + ((body,) if payload else ()))
                    at = first + size + 4
                    if sum(len(r[-1]) for r in rows) > block:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = ["path", "place", "record_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest"]
    schema = "path string, place long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string"
    if payload:
        names, schema = names + ["payload"], schema + ", payload binary"
    return entries(files, block).repartition("path", "place").mapInPandas(run, schema)
