"""Packing of whole documents into sequences of bounded length by order-preserving dynamic programming.

The ids of a partition's documents are one stream. Cuts may fall behind a document (no penalty), behind a sentence, or,
in a stretch without either that is longer than a sequence, every ``COARSE`` ids. With c the places of possible cuts,

    f(j) = min over i with c(j) - c(i) <= size of f(i) + (size - (c(j) - c(i))) + penalty(j)

is the least padding plus truncation penalty up to cut j. The padding is linear in c(i), so the best i is the front of
a monotone queue of f(i) + c(i), and every cut enters and leaves the queue once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as tx
from .tokens import END_ID, end_mark, leading_space

SIZE = 2048
SENTENCE_PENALTY = 8
TRUNCATION_PENALTY = 64
COARSE = 64
SEGMENT_IDS = 1 << 20  # ids planned together; the last sequence of a segment is planned anew with the next


def cuts(places: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The cheapest subset of ``places`` (ascending, from 0, gaps up to ``size``) that holds the first and the last."""
    c, pen = places.tolist(), penalty.tolist()
    back = [0] * len(c)
    queue, value, head = [0], [c[0]], 0
    for j in range(1, len(c)):
        least = c[j] - size
        while c[queue[head]] < least:
            head += 1
        back[j] = queue[head]
        g = value[head] + size + pen[j]
        while len(queue) > head and value[-1] > g:
            queue.pop()
            value.pop()
        queue.append(j)
        value.append(g)
    out, j = [c[-1]], len(c) - 1
    while j:
        j = back[j]
        out.append(c[j])
    return np.asarray(out[::-1], np.int64)


def possible_cuts(ids: np.ndarray, limits: np.ndarray, sentence_end: np.ndarray, size: int = SIZE):
    """Places and penalties for :func:`cuts`; ``limits`` are the ends of the documents in the stream."""
    kind = np.full(len(ids) + 1, 3, np.int8)
    kind[1:][sentence_end[ids]] = 1
    kind[limits] = 0
    kind[[0, -1]] = 0
    places = np.flatnonzero(kind < 3)
    wide = np.flatnonzero(np.diff(places) > size)
    if len(wide):
        more = [np.arange(places[i] + COARSE, places[i + 1], COARSE) for i in wide]
        kind[np.concatenate(more)] = 2
        places = np.flatnonzero(kind < 3)
    return places, np.asarray([0, SENTENCE_PENALTY, TRUNCATION_PENALTY])[kind[places]]


class Packer:
    """Collects documents and gives out the pieces of finished sequences."""

    def __init__(self, sentence_end: np.ndarray, size: int = SIZE):
        self.sentence_end, self.size = sentence_end, size
        self.docs: list[list] = []  # key, ids of the document not yet given out, start of those, ids in all
        self.held = self.sequence = 0

    def add(self, key, ids: bytes) -> None:
        part = np.frombuffer(ids, "<u4")
        self.docs.append([key, part, 0, len(part)])
        self.held += len(part)

    def take(self, last: bool) -> Iterator[tuple]:
        """(key, start, ids, ids of the document, sequence, offset) of each piece; the rest stays for later."""
        if not self.held:
            return
        ids = np.concatenate([d[1] for d in self.docs])
        limits = np.cumsum([len(d[1]) for d in self.docs])
        chosen = cuts(*possible_cuts(ids, limits, self.sentence_end, self.size), self.size)
        if not last:
            chosen = chosen[:-1]
        end = int(chosen[-1])
        bounds = np.union1d(chosen, limits[limits < end])
        doc = np.searchsorted(limits, bounds[:-1], "right")
        window = np.searchsorted(chosen, bounds[:-1], "right") - 1
        first = np.append(0, limits)
        for a, b, k, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc.tolist(), window.tolist()):
            key, _, before, total = self.docs[k]
            yield key, before + a - int(first[k]), ids[a:b], total, self.sequence + w, a - int(chosen[w])
        self.sequence += len(chosen) - 1
        k = int(np.searchsorted(limits, end, "right"))
        self.docs = self.docs[k:]
        if self.docs:
            gone = end - int(first[k])
            self.docs[0][1] = self.docs[0][1][gone:]
            self.docs[0][2] += gone
        self.held = int(limits[-1]) - end


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str,
    key: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    end_id: int = END_ID,
    ids: bool = True,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (array) if wanted.

    ``tokenizer`` is a byte-level tokenizer file and ``ranks`` the same vocabulary as ranks. Every document is followed
    by ``end_id``; a null or empty text is that id alone. Documents keep the order of their partition and no row moves,
    so the work needs no shuffle and a repeated task gives the same pieces; only the last sequence of a partition is
    short without need. ``sequence_id`` counts within the partition from partition * 2^32. Repeated rows and keys are
    packed as often as they occur, null keys stay null, and further input columns are not read.
    """
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind)] + [
        T.StructField(n, T.LongType())
        for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        encoder = leading_space(tokenizer, ranks)
        mark, base = end_mark(end_id), TaskContext.get().partitionId() << 32
        packer = Packer(encoder.sentence_end(), size)
        names = [f.name for f in fields]

        def out(last: bool):
            rows = [
                (k, s, len(x), zlib.crc32(np.ascontiguousarray(x)), n, base + q, o, x)
                for k, s, x, n, q, o in packer.take(last)
            ]
            for i in range(0, len(rows), 2000):
                cols = list(zip(*rows[i : i + 2000]))
                arrays = [pa.array(cols[0], key_type)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
                if ids:
                    limits = np.cumsum([0, *map(len, cols[7])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(limits, pa.array(np.concatenate(cols[7]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, bodies = batch.column(0).to_pylist(), tx.plain(batch.column(1))
            for first, last in tx.pieces(bodies):
                coded = encoder(bodies[first:last].to_pylist())
                for k, x in zip(keys[first:last], coded):
                    packer.add(k, x + mark)
                if packer.held >= SEGMENT_IDS:
                    yield from out(False)
        if key_type is not None:
            yield from out(True)

    return docs.select(key, text).mapInArrow(run, T.StructType(fields))
