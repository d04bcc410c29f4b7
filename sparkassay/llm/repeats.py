"""Removal of every byte that lies in a string of 200 bytes which also starts elsewhere in the corpus.

1. *Anchors.* Every text picks the least hashes among its 32-byte strings (winnowing), so each string of 200 bytes holds
   an anchor, and equal strings hold the same anchor at the same place. An anchor's surroundings are all bytes that a
   200-byte string around it can cover. Equal surroundings are repeats as a whole, which settles most of a repetitive
   corpus; texts whose anchor stands nowhere else have no repeat there.
2. *Run-length index.* What is left, one occurrence for each different surroundings of a shared anchor, is dealt into
   blocks of bounded size, by the smallest text that shares the anchor. So the anchors that a group of near copies
   shares mostly meet in one block, where the surroundings of a text's anchors are one segment. A block gets the Burrows-Wheeler transform of its segments. Longest common
   prefixes are sampled at the ends of the transform's runs only; in between, a prefix is one shorter than that of the
   byte before, so the matching statistics of all segments are streamed from the samples. Matches of 200 bytes are
   marked.
3. The marks of each text are united and cut out.

A text that would draw more than ``HOT`` surroundings to it draws none, and its anchors are dealt one by one; an anchor
with more than ``HOT_ANCHOR`` different surroundings is not indexed in one block, but its strings are counted by hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.session import durable

from . import bloom
from . import text as tx

LENGTH = 200
GRAM = 32
REACH = LENGTH - GRAM  # bytes before an anchor that a string around it can cover
BLOCK_BYTES = 1 << 20
HOT = 20_000
HOT_ANCHOR = 20_000


def _slide(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every w consecutive values."""
    take = np.minimum if least else np.maximum
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, x[-1])
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = take.accumulate(blocks, axis=1).ravel()
    behind = take.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(gram: np.ndarray) -> np.ndarray:
    """Places of the 32-byte strings with the least hash among any REACH + 1 in a row; ties are all taken."""
    w = REACH + 1
    if len(gram) < w:
        return np.zeros(0, np.int64)
    low = _slide(gram, w, True)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(_slide(padded, w, False) == gram)


def _anchor_rows(batches):
    """(anchor, around, row, place, bytes of the text) of every anchor of every text."""
    for batch in batches:
        rows, bodies = batch.column(0).to_numpy(), tx.plain(batch.column(1))
        for first, last in tx.pieces(bodies):
            data, limits = tx.raw(bodies[first:last])
            hashes, out = tx.Hashes(data), []
            if len(data) < LENGTH:
                continue
            start = np.arange(len(data) - GRAM + 1)
            gram = hashes.spans(start, start + GRAM)
            for i in range(last - first):
                a, b = int(limits[i]), int(limits[i + 1])
                if b - a >= LENGTH:
                    at = anchors(gram[a : b - GRAM + 1]) + a
                    low, high = np.maximum(at - REACH, a), np.minimum(at + LENGTH, b)
                    around = tx.mix(hashes.spans(low, high) ^ (at - low).astype(np.uint64))
                    out.append((gram[at], around, np.full(len(at), rows[first + i]), at - a, np.full(len(at), b - a)))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "around", "row", "place", "size"])


ANCHOR_SCHEMA = "anchor long, around long, row long, place long, size long"


def _settle(batches):
    """From rows sorted by (anchor, around): ('m') rows whose surroundings are repeated, and ('p') one row for each
    different surroundings of an anchor that has several."""
    held = [np.zeros(0, np.int64)] * 5
    several = None  # an anchor already known to have several surroundings

    def give(cols, last):
        nonlocal held, several
        anchor, around = cols[0], cols[1]
        n = len(anchor)
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])[:n]
        new = new_anchor | np.append(True, around[1:] != around[:-1])[:n]
        if not last and n:
            # A run of equal surroundings that may go on is held back; the last anchor as a whole, unless it is large.
            keep = int(np.flatnonzero(new_anchor)[-1])
            if n - keep > 50_000:
                run = int(np.flatnonzero(new)[-1])
                known = anchor[-1] if run > keep or several == anchor[-1] else several
                tail = [np.concatenate([x[run : run + 1], x[-1:]]) if n - run > 1 else x[run:] for x in cols]
                keep = n if n - run > 1 else run
            else:
                known, tail = several, [x[keep:] for x in cols]
            held, cols = tail, [x[:keep] for x in cols]
            new_anchor, new, n = new_anchor[:keep], new[:keep], keep
        else:
            held, known = [np.zeros(0, np.int64)] * 5, several
        if n:
            follow = np.append(new[1:], True)
            repeated = ~(new & follow)
            group = np.cumsum(new_anchor) - 1
            kinds = np.bincount(group, new)
            if several is not None and cols[0][0] == several:
                kinds[0] = max(kinds[0], 2)
            if known is not None and cols[0][-1] == known:
                kinds[-1] = max(kinds[-1], 2)
            probe = new & (kinds[group] > 1)
            # The home of an anchor: its smallest text. A group that was cut into parts is its own home.
            home = np.minimum.reduceat(cols[2], np.flatnonzero(new_anchor))
            if several is not None and cols[0][0] == several:
                home[0] = several
            if known is not None and cols[0][-1] == known:
                home[-1] = known
            home = home[group]
            for what, which in (("m", repeated), ("p", probe)):
                at = np.flatnonzero(which)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([what] * len(at)), *[pa.array(c[at]) for c in (cols[0], home, cols[2], cols[3], cols[4])]],
                        ["what", "anchor", "home", "row", "place", "size"],
                    )
        several = known

    for batch in batches:
        yield from give([np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)], False)
    yield from give(held, True)


# ---- the run-length index of a block


def suffixes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of segments, by ranks of all places from their first 7, 14, 28 ... bytes.

    ``data`` holds the segments with one place behind each, at ``ends``; those places sort first and all differ. A rank
    is the place in the order at which the group of equal beginnings starts, so only groups of several are sorted again.
    """
    n = len(data)
    own = np.searchsorted(ends, np.arange(n)).astype(np.int32)
    left = ends[own] - np.arange(n)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(8)) | np.where(left > j, wide[j : j + n], np.uint8(0)).astype(np.uint64)
    key = (key << np.uint64(8)) | np.minimum(left, 7).astype(np.uint64)
    rank = np.zeros(n, np.int32)
    rank[ends] = np.arange(len(ends))
    some, base = np.flatnonzero(left > 0), len(ends)
    key, start = key[some], np.zeros(len(some), np.int64)
    depth = 7
    while True:
        order = np.argsort(key if depth == 7 else start * (n + 1) + key)
        some, key, start = some[order], key[order], start[order]
        new = np.append(True, (key[1:] != key[:-1]) | (start[1:] != start[:-1]))[: len(some)]
        group = np.append(True, start[1:] != start[:-1])[: len(some)]
        at = np.arange(len(some))
        first = np.flatnonzero(group)
        place = start + at - first[np.cumsum(group) - 1] + (base if depth == 7 else 0)
        fresh = place[np.flatnonzero(new)][np.cumsum(new) - 1] if len(some) else place
        rank[some] = fresh
        alone = new & np.append(new[1:], True)[: len(some)]
        some = some[~alone]
        if not len(some):
            break
        start = fresh[~alone].astype(np.int64)
        key = np.where(left[some] > depth, rank[np.minimum(some + depth, n - 1)], own[some]).astype(np.int64)
        depth *= 2
    order = np.zeros(n, np.int64)
    order[rank] = np.arange(n)
    return order


def common(data: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b, which never runs over a segment's end."""
    hashes = tx.Hashes(data)
    most = np.minimum(ends[np.searchsorted(ends, a)] - a, ends[np.searchsorted(ends, b)] - b)
    total = np.zeros(len(a), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step := step >> 1:
        fits = np.flatnonzero(total + step <= most)
        x, y = a[fits] + total[fits], b[fits] + total[fits]
        total[fits[hashes.spans(x, x + step) == hashes.spans(y, y + step)]] += step
    return total


def repeated_starts(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment the places at which a string of LENGTH bytes starts that also starts elsewhere in the block."""
    size = np.asarray([len(s) for s in segments], np.int64)
    ends = np.cumsum(size + 1) - 1
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    order = suffixes(data, ends)
    before = np.where(order > 0, data[order - 1].astype(np.int64), -1)
    border = np.zeros(len(data), bool)
    border[ends] = True
    opens = np.append(True, border[:-1])  # first place of a segment: no byte stands before it
    before[opens[order]] = -1
    head = np.append(True, (before[1:] != before[:-1]) | (before[1:] < 0))  # ends of the transform's runs
    head[0] = False
    at = np.flatnonzero(head)
    reach = np.zeros(len(data), np.int64)
    reach[order[at]] = order[at] + common(data, ends, order[at - 1], order[at])
    statistic = np.maximum.accumulate(reach) - np.arange(len(data))
    found = statistic >= LENGTH
    long = np.flatnonzero(found[order])
    found[order[long[long > 0] - 1]] = True
    starts = ends - size
    return [np.flatnonzero(found[a : a + n]) for a, n in zip(starts.tolist(), size.tolist())]


def _unite(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges."""
    if not len(low):
        return []
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    return list(zip(low[first].tolist(), high[np.append(first[1:], len(low)) - 1].tolist()))


def _index(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Marks of a block. Overlapping pieces of one text are one segment, so no place stands in a block twice."""
    frame = frame.sort_values(["row", "low"], kind="stable")
    rows, lows, segments = [], [], []
    for row, low, body in zip(frame["row"], frame["low"], frame["body"]):
        if rows and rows[-1] == row and low <= lows[-1] + len(segments[-1]):
            segments[-1] += body[max(0, lows[-1] + len(segments[-1]) - low) :]
        else:
            rows.append(row)
            lows.append(low)
            segments.append(bytearray(body))
    out = []
    for row, low, at in zip(rows, lows, repeated_starts([bytes(s) for s in segments])):
        out += [(row, low + a, low + b) for a, b in _unite(at, at + LENGTH)]
    return pd.DataFrame(out, columns=["row", "low", "high"])


def _cut_out(probes: list, text: bytes, merge: bool):
    """(home, anchor, low, place, body) of the probes (home, anchor, place) of a text. With ``merge``, overlapping
    surroundings of one home are one piece, which names the anchor and place of its first probe."""
    last = None
    for home, anchor, place in sorted(probes, key=lambda p: (p[0], p[2])):
        low, high = max(0, place - REACH), min(len(text), place + LENGTH)
        if merge and last and last[0] == home and low <= last[4]:
            last[4] = high
        else:
            if last:
                yield (*last[:4], text[last[2] : last[4]])
            last = [home, anchor, low, place, high]
    if last:
        yield (*last[:4], text[last[2] : last[4]])


def _pieces(merge: bool):
    def run(batches):
        for batch in batches:
            rows, probes, bodies = batch.column(0).to_pylist(), batch.column(1), tx.plain(batch.column(2))
            out, held = [], 0
            for row, probe, body in zip(rows, probes, bodies):
                told = [(p["home"], p["anchor"], p["place"]) for p in probe.as_py()]
                for home, anchor, low, place, piece in _cut_out(told, body.as_py(), merge):
                    out.append((home, anchor, row, low, place, piece))
                    held += len(piece)
                if held > 1 << 22:
                    yield _piece_batch(out)
                    out, held = [], 0
            if out:
                yield _piece_batch(out)

    return run


PIECE_SCHEMA = "home long, anchor long, row long, low long, place long, body binary"


def _piece_batch(out) -> pa.RecordBatch:
    cols = list(zip(*out))
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], ["home", "anchor", "row", "low", "place", "body"]
    )


def _strings(batches):
    """(anchor, shift, h, row, at): every 200-byte string of the pieces."""
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(4)]
        bodies = tx.plain(batch.column(4))
        data, limits = tx.raw(bodies)
        hashes = tx.Hashes(data)
        for i in range(0, len(bodies), 50):
            out = []
            for j in range(i, min(i + 50, len(bodies))):
                at = np.arange(max(0, int(limits[j + 1] - limits[j]) - LENGTH + 1))
                h = hashes.spans(at + limits[j], at + limits[j] + LENGTH).view(np.int64)
                whole = np.full(len(at), 1)
                out.append((cols[0][j] * whole, at + cols[2][j] - cols[3][j], h, cols[1][j] * whole, at + cols[2][j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor", "shift", "h", "row", "at"])


def _only(members: np.ndarray, column: int):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(bloom.maybe(members, batch.column(column).to_numpy())))

    return run


def marks(told: DataFrame) -> DataFrame:
    """(row, low, high) byte ranges covered by repeated strings; ``told`` has row (a hash of the whole row) and text."""
    found = told.mapInArrow(_anchor_rows, ANCHOR_SCHEMA)
    found = found.repartition("anchor").sortWithinPartitions("anchor", "around")
    settled = durable(found.mapInArrow(_settle, "what string, anchor long, home long, row long, place long, size long"))
    low, high = F.greatest(F.lit(0), F.col("place") - REACH), F.least("size", F.col("place") + LENGTH)
    whole = settled.filter("what = 'm'").select("row", low.alias("low"), high.alias("high"))
    probes = settled.filter("what = 'p'").select("home", "anchor", "row", "place")
    crowded = durable(probes.groupBy("home").count().filter(F.col("count") > HOT).select("home", F.lit(True).alias("crowded")))
    probes = probes.join(crowded, "home", "left")
    home = F.when(F.col("crowded"), F.col("anchor")).otherwise(F.col("home"))
    probes = durable(probes.select(home.alias("home"), "anchor", "row", "place"))
    alone = F.col("home") == F.col("anchor")
    hot = durable(probes.filter(alone).groupBy("home").count().filter(F.col("count") > HOT_ANCHOR).select("home"))
    members = bloom.build(probes.select(F.col("row").alias("v")))
    blocks = max(1, -(-probes.count() * (LENGTH + REACH) // (4 * BLOCK_BYTES)))
    some = told.mapInArrow(_only(members, 0), "row long, text string").dropDuplicates(["row"])

    def pieces(which: DataFrame, merge: bool) -> DataFrame:
        listed = which.groupBy("row").agg(F.collect_list(F.struct("home", "anchor", "place")).alias("probes"))
        return some.join(listed, "row").select("row", "probes", "text").mapInArrow(_pieces(merge), PIECE_SCHEMA)

    calm = probes.join(hot, "home", "left_anti")
    dealt = pieces(calm, True).withColumn("block", F.pmod(F.xxhash64("home"), F.lit(blocks)))
    out = whole.unionByName(dealt.groupBy("block").applyInPandas(_index, "row long, low long, high long"))
    if not hot.isEmpty():
        # Here every anchor is its own home. Strings are told apart by their place beside it.
        string = "anchor long, shift long, h long, row long, at long"
        strings = pieces(probes.join(hot, "home"), False).select("anchor", "row", "low", "place", "body").mapInArrow(_strings, string)
        key = ["anchor", "shift", "h"]
        again = durable(strings.groupBy(*key).count().filter("count > 1").select(*key))
        out = out.unionByName(strings.join(again, key).select("row", F.col("at").alias("low"), (F.col("at") + LENGTH).alias("high")))
    return out


def _cut(types, with_text: bool):
    def run(batches):
        for batch in batches:
            bodies, rows = tx.plain(batch.column(batch.num_columns - 2)), []
            for body, ranges in zip(bodies, batch.column(batch.num_columns - 1)):
                text = body.as_py()
                pairs = ranges.as_py() or []
                spans = _unite(np.asarray([p["low"] for p in pairs], np.int64), np.asarray([p["high"] for p in pairs], np.int64))
                rest, at = [], 0
                for a, b in spans:
                    rest.append(text[at:a])
                    at = b
                kept = b"".join([*rest, text[at:]])
                row = (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                rows.append(row + ((kept,) if with_text else ()))
            if rows:
                cols = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3])]
                arrays += [pa.array(cols[4], pa.binary())] if with_text else []
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *arrays], names=types.names)

    return run


def _clean(members: np.ndarray, types, with_text: bool):
    """The rows without marks, by the last column; filtered and cut in one worker."""
    cut = _cut(types, with_text)

    def run(batches):
        yield from cut(
            batch.filter(pa.array(~bloom.maybe(members, batch.column(3).to_numpy()))).select([0, 1, 2]) for batch in batches
        )

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (binary) of every row.

    A null or empty text has no bytes. Texts under LENGTH bytes lose nothing. Strings are judged on the input; a string
    may overlap its other start. Equal rows are copies of each other. Further columns are not read.
    """
    row = F.xxhash64(F.col(key), F.col(text)).alias("row")
    told = docs.select(row, F.col(text).alias("text"))
    found = durable(marks(told.filter(F.octet_length("text") >= LENGTH)))
    ranges = found.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    members = bloom.build(found.select(F.col("row").alias("v")))
    full = docs.select(F.col(key).alias("key"), row, F.col(text).alias("text"))
    kinds = full.schema
    marked = full.mapInArrow(_only(members, 1), kinds).join(ranges, "row", "left").select("key", "text", "ranges")
    clean = full.select("key", "text", F.lit(None).cast(marked.schema["ranges"].dataType).alias("ranges"), "row")
    fields = [T.StructField("key", docs.schema[key].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + ([T.StructField("kept", T.BinaryType())] if with_text else []))
    clean = clean.mapInArrow(_clean(members, schema, with_text), schema)
    return clean.unionByName(marked.mapInArrow(_cut(schema, with_text), schema)).withColumnRenamed("key", key)
