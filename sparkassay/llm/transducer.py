"""Encoding and decoding with a subword model as a weighted finite-state transducer.

Three machines are compiled from the model's table and composed with each text:

* the normaliser writes one mark before the text and in place of every space;
* the lexicon reads characters and writes pieces; a character without a piece is written as its bytes;
* the merge filter lets a piece follow another only if merging the two, in the order of the scores, gives these two
  again. A text is in merge order exactly if all neighbours are.

An arc weighs the negative logarithm of nothing when the filter lets it pass and infinity otherwise, and the path of
least weight in the tropical semiring is the encoding. As every prefix of a word has one path of finite weight, the
search keeps one state per character. No piece spans from a letter to a mark, so a word's path does not depend on its
neighbours and is remembered.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .tokens import Words

MARK = "▁"
STATES = 800_000  # remembered beginnings of words
LONG = 64  # characters of a unit above which its states are kept by position, and for this unit only
WORDS = 1_000_000  # remembered words
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        table = sentencepiece.SentencePieceProcessor(model_file=path)
        size = table.get_piece_size()
        plain = [i for i in range(size) if not (table.is_byte(i) or table.is_control(i) or table.is_unknown(i))]
        self.ids = {table.id_to_piece(i): i for i in plain}
        self.score = {p: table.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.byte = np.zeros(256, np.int64)
        self.written: list[bytes] = [b""] * size
        for i in range(size):
            if table.is_byte(i):
                value = int(table.id_to_piece(i)[3:-1], 16)
                self.byte[value], self.written[i] = i, bytes([value])
        for p, i in self.ids.items():
            self.written[i] = p.replace(MARK, " ").encode()
        self.allowed: dict[tuple[str, str], bool] = {}
        self.state: dict[str, str] = {}  # beginning of a unit -> the piece that ends its path
        self.words = Words(WORDS)

    def merged(self, text: str) -> list[str]:
        """Merge characters by score, the leftmost of equal ones first, as long as a pair forms a piece."""
        parts, score = list(text), self.score
        if len(parts) > LONG:
            return self._merged_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merged_long(self, parts: list[str | None]) -> list[str]:
        """The same merges from a heap of pairs; a pair that is no more, or no more so, is passed over."""
        n, score, heap = len(parts), self.score, []
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] == left and j < n and parts[j] == right:
                parts[i], parts[j], after[i] = left + right, None, after[j]
                if after[j] < n:
                    before[after[j]] = i
                offer(before[i])
                offer(i)
        return [p for p in parts if p is not None]

    def _passes(self, before: str, piece: str) -> bool:
        if len(self.allowed) > 1_000_000:
            self.allowed.clear()
        found = self.merged(before + piece) == ([before, piece] if before else [piece])
        self.allowed[before, piece] = found
        return found

    def path(self, unit: str) -> list[str]:
        """Pieces, or single characters without a piece, along the path of least weight."""
        if unit.startswith(MARK + MARK) or len(unit) < 2:
            return self.merged(unit)  # runs of marks have equal scores, so neighbours alone do not tell their order
        if len(unit) > LONG:
            return self._long_path(unit)
        state, ids, allowed, longest = self.state, self.ids, self.allowed, self.longest
        if len(state) > STATES:
            state.clear()
        done = len(unit) - 1
        while done and unit[:done] not in state:
            done -= 1
        for end in range(done + 1, len(unit) + 1):
            for start in range(max(0, end - longest), end):
                piece = unit[start:end]
                if piece in ids or end - start == 1:
                    pair = (state[unit[:start]] if start else "", piece)
                    passes = allowed.get(pair)
                    if self._passes(*pair) if passes is None else passes:
                        state[unit[:end]] = piece
                        break
            else:
                return self.merged(unit)
        out, end = [], len(unit)
        while end:
            piece = state[unit[:end]]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def _long_path(self, unit: str) -> list[str]:
        """The path of a long unit, whose beginnings as strings would take the square of its length."""
        ids, allowed, longest = self.ids, self.allowed, self.longest
        last = [""]  # the piece that ends the path to each place
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - longest), end):
                piece = unit[start:end]
                if piece in ids or end - start == 1:
                    pair = (last[start], piece)
                    passes = allowed.get(pair)
                    if self._passes(*pair) if passes is None else passes:
                        last.append(piece)
                        break
            else:
                return self.merged(unit)
        out, end = [], len(unit)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def unit_ids(self, unit: str) -> bytes:
        out: list[int] = []
        for piece in self.path(unit):
            i = self.ids.get(piece)
            out += [i] if i is not None else self.byte[list(piece.encode())].tolist()
        return array("I", out).tobytes()

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        parts = [b.split(b" ") for b in bodies]
        odd = [b"" in p or MARK.encode() in b for b, p in zip(bodies, parts)]
        new = self.words.missing(p for p, o in zip(parts, odd) if not o)
        self.words.known.update((w, self.unit_ids(MARK + w.decode())) for w in new)
        known = self.words.known.__getitem__
        out = []
        for b, p, o in zip(bodies, parts, odd):
            if not o:
                out.append(b"".join(map(known, p)))
            elif b:
                text = MARK + b.decode().replace(" ", MARK)
                out.append(b"".join(map(self.unit_ids, UNITS.findall(text))))
            else:
                out.append(b"")
        self.words.forget(new)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text; bytes that form no character become the replacement character."""
        body = b"".join(map(self.written.__getitem__, ids.tolist()))
        return body.removeprefix(b" ").decode("utf-8", "replace").encode()


@functools.cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """key, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), text_sha256 (of the ids decoded again), round_trip, and
    ids (array) if wanted.

    A null or empty text has no pieces. Repeated rows are encoded each; null keys stay null; further columns are not
    read. ``round_trip`` is false only where the text itself holds the mark, which decodes to a space.
    """
    fields = [T.StructField("key", docs.schema[key].dataType), T.StructField("n_pieces", T.LongType())]
    fields += [T.StructField("ids_crc32", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches):
        machine = transducer(model)
        for batch in batches:
            bodies = tx.plain(batch.column(1))
            for first, last in tx.pieces(bodies):
                texts = bodies[first:last].to_pylist()
                coded = [np.frombuffer(c, "<u4") for c in machine.encode(texts)]
                again = [machine.decode(c) for c in coded]
                arrays = [
                    batch.column(0).slice(first, last - first),
                    pa.array([len(c) for c in coded], pa.int64()),
                    pa.array([zlib.crc32(c.tobytes()) for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(a).hexdigest() for a in again]),
                    pa.array([a == t for a, t in zip(again, texts)]),
                ]
                if ids:
                    arrays.append(pa.array([c.astype(np.int32) for c in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(coded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids", text: str = "text") -> DataFrame:
    """key and the decoded text; null ids give a null text."""

    def run(batches):
        machine = transducer(model)
        for batch in batches:
            texts = [None if x is None else machine.decode(np.asarray(x, np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    schema = T.StructType([T.StructField("key", coded.schema[key].dataType), T.StructField("text", T.StringType())])
    return coded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, schema).toDF(key, text)
