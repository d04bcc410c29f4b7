"""Exact similarity join on sets of word shingles as a T-occurrence search with long lists set aside.

Two sets of sizes n and m are linked when they share at least T = ceil(75 (n + m) / 175) shingles, so T >= 3/4 of the
larger one. Every shingle has an inverted list of the sets that hold it. As DivideSkip does, the L = ceil(3/4 n) - 1
longest lists of a set are set aside. Its short lists are merged and the occurrences of every partner counted; those
with at least T - L are probed by binary search in the whole sorted sets, which decides the overlap exactly.

* List lengths come from a count sketch of fixed size over all texts; the order only has to be the same everywhere, so
  its errors change the work and never the result.
* Equal sets are one class: a task lists a class once, so copies meet as one entry per task and are merged.
* Short lists are dealt to the task of their home, the class among theirs that meets most others. A group of near copies
  shares one home, so its lists are merged where its sets are probed, and only links leave the task, at most one for
  each set: pairs whose components are joined already are not probed. A pair's occurrences in lists of other homes are
  bounded by the lists that both have in the homes they share.
* A home with more than ``PART`` classes is searched in pairs of parts, so no task holds more than two parts.
* A first pass without sets finds the classes that have a candidate at all; sets are made and moved for these only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.session import durable, scratch_path

from . import bloom
from . import text as tx
from .components import components

SHINGLE = 5
SHARE = 75  # of 100
PART = 4096  # classes of one home that meet in a task
TASK_ROWS = 20_000
MOST_HOMES = 64  # a class with more homes bounds its occurrences elsewhere by their number alone
COUNTERS = 1 << 22
SLICE = 1 << 16
LIST_ROWS = 50_000  # entries of a list whose size is counted together


def shingle_sets(bodies: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one hash of all words below five, none without words."""
    data, limits = tx.raw(bodies)
    data = tx.LOWER[data]
    start, end, doc = tx.words(data, limits)
    h = tx.Hashes(data).spans(start, end)
    key, at = tx.windows(h, doc, SHINGLE)
    n = len(limits) - 1
    bounds = np.searchsorted(doc[at], np.arange(n + 1)).tolist()
    first = np.searchsorted(doc, np.arange(n + 1)).tolist()
    out = []
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            k = first[i + 1] - first[i]
            out.append(tx.windows(h[first[i] : first[i + 1]], np.zeros(k, np.int64), k)[0] if k else key[:0])
            continue
        s = np.sort(key[a:b])
        out.append(s[np.append(True, s[1:] != s[:-1])])
    return out


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set, together with its size the identity of a class."""
    h = tx.mix(np.asarray([np.add.reduce(tx.mix(s ^ np.uint64(0x5851F42D4C957F2D)))]) ^ np.uint64(len(s)))
    return int(h.view(np.int64)[0])


def _each(batch, column: int):
    bodies = tx.plain(batch.column(column))
    for first, last in tx.pieces(bodies):
        yield first, shingle_sets(bodies[first:last])


def _describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, class, n, null, null) per document, and (null, null, null, slice, counts) per task and slice."""
    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType), T.StructField("class", T.LongType()), T.StructField("n", T.LongType()),
         T.StructField("slice", T.LongType()), T.StructField("counts", T.BinaryType())]
    )

    def run(batches):
        counters, kind = np.zeros(COUNTERS, np.uint32), None
        for batch in batches:
            kind = batch.column(0).type
            classes, sizes = [], []
            for _, sets in _each(batch, 1):
                for s in sets:
                    classes.append(class_of(s) if len(s) else None)
                    sizes.append(len(s))
                if sets:
                    every = np.concatenate(sets)
                    counters += np.bincount((every >> np.uint64(42)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            n = len(classes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                schema.names,
            )
        if kind is not None and counters.any():
            squeeze = zstandard.ZstdCompressor(level=1)
            parts = [squeeze.compress(counters[i : i + SLICE].tobytes()) for i in range(0, COUNTERS, SLICE)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(parts, pa.binary())],
                schema.names,
            )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def _sketch(blobs: DataFrame) -> np.ndarray:
    """The sum of the tasks' counters, of fixed size; added up in two levels, so no group grows with the tasks."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        total = np.zeros(SLICE, np.uint32)
        for blob in frame["counts"]:
            total += np.frombuffer(unpack.decompress(blob), np.uint32)
        packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        return pd.DataFrame({"slice": [frame["slice"].iloc[0]], "counts": [packed]})

    groups = max(1, round((blobs.count() * SLICE / COUNTERS) ** 0.5))
    level = blobs.withColumn("some", F.pmod(F.crc32("counts"), F.lit(groups)))
    level = level.groupBy("slice", "some").applyInPandas(add, "slice long, counts binary")
    out = np.zeros(COUNTERS, np.uint32)
    unpack = zstandard.ZstdDecompressor()
    for r in level.groupBy("slice").applyInPandas(add, "slice long, counts binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(unpack.decompress(bytes(r["counts"])), np.uint32)
    return out


def short_lists(s: np.ndarray, counters: np.ndarray, limit: float) -> np.ndarray:
    """The n - T + 1 shingles of a set whose lists are merged: those with at most the mean count first, then by count."""
    n = len(s)
    most = n - -(-SHARE * n // 100) + 1
    seen = counters[(s >> np.uint64(42)).astype(np.int64)]
    rank = np.where(seen > limit, seen, 0)
    if not rank.any():
        return s[:most]
    return s[np.lexsort((s, rank))[:most]]


def _postings(docs: DataFrame, text: str, counters: np.ndarray) -> DataFrame:
    spark = docs.sparkSession
    mean = float(counters.mean())
    shared = spark.sparkContext.broadcast((counters, mean))

    def run(batches):
        seen = set()
        for batch in batches:
            for _, sets in _each(batch, 0):
                lists, classes = [], []
                for s in sets:
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        lists.append(short_lists(s, *shared.value))
                        classes.append(c)
                if lists:
                    times = [len(x) for x in lists]
                    cols = [np.concatenate(lists).view(np.int64), np.repeat(np.asarray(classes), times)]
                    for i in range(0, len(cols[0]), 20_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000]) for c in cols], ["shingle", "class"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "shingle long, class long")


def _lists(size_of, names: list[str], overlap: int):
    """Streams sorted rows by their first column, whole lists at a time where they are not longer than LIST_ROWS; the parts
    of a longer one share ``overlap`` rows."""

    def run(batches):
        held, again = None, None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            cols = cols if held is None else [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            rest = int(np.searchsorted(cols[0], cols[0][-1]))
            if len(cols[0]) - rest > LIST_ROWS:
                rest = len(cols[0])
            keep = rest - overlap if rest == len(cols[0]) else rest
            held = [c[keep:] for c in cols]
            out, again = size_of([c[:rest] for c in cols], again)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)
        if held is not None:
            out, again = size_of(held, again)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    return run


def _shared(cols, again):
    """(shingle, class, size) of the lists with several classes. Parts of a long list share a class, so none is alone."""
    shingle, c = cols
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (c[1:] != c[:-1]))[: len(shingle)]
    shingle, c = shingle[new], c[new]
    first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])[: len(shingle)])
    length = np.diff(np.append(first, len(shingle)))
    size = np.repeat(length, length)
    some = size > 1
    return [x[some] for x in (shingle, c, size)], None


def _homes(cols, again):
    """(home, shingle, class, total): the home of a list is its first entry; ``again`` is that of a list cut into parts."""
    shingle, _, c, total = cols
    first = np.append(True, shingle[1:] != shingle[:-1])[: len(shingle)]
    home = c[np.flatnonzero(first)][np.cumsum(first) - 1]
    if again is not None and len(shingle):
        home[shingle == again[0]] = again[1]
    last = (shingle[-1], home[-1]) if len(shingle) else again  # a call without rows is still within the list
    return [home, shingle, c, total], last


def _sets(docs: DataFrame, text: str, members: np.ndarray) -> DataFrame:
    """(class, set) of the classes in the filter, with few others."""
    shared = docs.sparkSession.sparkContext.broadcast(members)

    def run(batches):
        seen, bits = set(), shared.value
        for batch in batches:
            for _, sets in _each(batch, 0):
                rows = []
                classes = [class_of(s) for s in sets]
                wanted = bloom.maybe(bits, np.asarray(classes, np.int64)).tolist()
                for s, c, ok in zip(sets, classes, wanted):
                    if ok and len(s) and c not in seen:
                        seen.add(c)
                        rows.append((c, s.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["class", "set"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "class long, set binary")


def _overlap(s: np.ndarray, t: np.ndarray) -> int:
    """Shared values of two sorted sets: every one of the smaller set is searched in the larger one."""
    if len(s) > len(t):
        s, t = t, s
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())


def search(
    n: np.ndarray,
    total: np.ndarray,
    lists: list[np.ndarray],
    part: np.ndarray,
    others: list[tuple[np.ndarray, np.ndarray] | None],
    sets: list[np.ndarray] | None,
):
    """T-occurrence search among the classes of one home: (flags of classes with a candidate, links between positions).

    ``n`` are the set sizes, ``total`` the number of short lists of each class in all homes, ``lists`` those in this
    home, ``others`` the other homes of each class and its number of lists there, if there are not too many. With two kinds of ``part``, only pairs of different parts are searched.
    """
    m = len(n)
    size = np.asarray([len(x) for x in lists])
    owner = np.repeat(np.arange(m), size)
    _, number = np.unique(np.concatenate(lists), return_inverse=True)
    order = np.argsort(number, kind="stable")
    member, bounds = owner[order], np.searchsorted(number[order], np.arange(number.max() + 2))
    first = np.append(0, np.cumsum(size))
    told = np.asarray([o is not None for o in others])
    held = [np.concatenate(x) for x in zip(*[(h, k, np.full(len(h), i)) for i, o in enumerate(others) if o is not None for h, k in [o]])] or [np.zeros(0, np.int64)] * 3
    turn = np.argsort(held[0], kind="stable")
    home, there, whose = (h[turn] for h in held)
    elsewhere, crossed = total - size, len(np.unique(part)) > 1
    aside = -(-SHARE * n // 100) - 1
    found, links, root = np.zeros(m, bool), [], list(range(m))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x in range(m):
        met = np.bincount(np.concatenate([member[bounds[k] : bounds[k + 1]] for k in number[first[x] : first[x + 1]]]), minlength=m)
        needed = -(-SHARE * (n + n[x]) // (100 + SHARE)) - np.maximum(aside, aside[x])
        further = np.minimum(elsewhere, elsewhere[x])
        if told[x]:
            exact = np.zeros(m, np.int64)
            for h, k in zip(*others[x]):
                a, b = np.searchsorted(home, (h, h + 1))
                exact[whose[a:b]] += np.minimum(there[a:b], k)
            further = np.where(told, np.minimum(exact, further), further)
        ok = (met > 0) & (met + further >= needed)
        ok &= (100 * np.minimum(n, n[x]) >= SHARE * np.maximum(n, n[x])) & ((part != part[x]) if crossed else True)
        ok[: x + 1] = False
        some = np.flatnonzero(ok)
        if len(some):
            found[x] = found[some] = True
            for y in some[np.argsort(-met[some], kind="stable")].tolist() if sets is not None else ():
                i, j = top(x), top(y)
                if i != j:
                    both = _overlap(sets[x], sets[y])
                    if 100 * both >= SHARE * (len(sets[x]) + len(sets[y]) - both):
                        root[max(i, j)] = min(i, j)
                        links.append((x, y))
    return found, links


def _home_groups(frame: pd.DataFrame):
    frame = frame.sort_values(["home", "low", "high", "class"], kind="stable")
    keys = frame[["home", "low", "high"]].to_numpy()
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else []
    for a, b in zip(first, np.append(first[1:], len(keys))):
        if b - a > 1:
            yield frame.iloc[a:b]


def _arguments(group: pd.DataFrame) -> tuple:
    own = group["home"].iloc[0]
    lists = [np.asarray(x, np.int64) for x in group["lists"]]
    others = []
    for homes, counts in zip(group["homes"], group["counts"]):
        if homes is None:
            others.append(None)
            continue
        homes, counts = np.asarray(homes, np.int64), np.asarray(counts, np.int64)
        others.append((homes[homes != own], counts[homes != own]))
    return group["n"].to_numpy(), group["total"].to_numpy(), lists, group["part"].to_numpy(), others


def _candidates(frame: pd.DataFrame) -> pd.DataFrame:
    out = []
    for group in _home_groups(frame):
        found, _ = search(*_arguments(group), None)
        out.append(group[["home", "low", "high", "class"]][found])
    return pd.concat(out) if out else frame[["home", "low", "high", "class"]][:0]


def _probed(frame: pd.DataFrame) -> pd.DataFrame:
    out = []
    for group in _home_groups(frame):
        sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
        _, links = search(*_arguments(group), sets)
        classes = group["class"].to_numpy()
        out += [(classes[x], classes[y]) for x, y in links]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _at_home(member: DataFrame, sizes: DataFrame) -> DataFrame:
    """(home, low, high, part, class, n, total, lists): a class with its short lists of one home, for each pair of parts."""
    own = Window.partitionBy("class")  # at most one row for each short list of a set
    known = member.withColumn("degree", -F.sum("size").over(own)).withColumn("total", F.count(F.lit(1)).over(own))
    known = known.select("shingle", "degree", "class", "total")
    known = known.repartition("shingle").sortWithinPartitions("shingle", "degree", "class")
    names = ["home", "shingle", "class", "total"]
    homes = known.mapInArrow(_lists(_homes, names, 0), "home long, shingle long, class long, total long")
    rows = homes.groupBy("home", "class", "total").agg(F.collect_list("shingle").alias("lists")).join(sizes, "class")
    few = F.count(F.lit(1)).over(own) <= MOST_HOMES
    rows = durable(
        rows.withColumn("homes", F.when(few, F.collect_list("home").over(own)))
        .withColumn("counts", F.when(few, F.collect_list(F.size("lists").cast("long")).over(own)))
    )
    parts = durable(rows.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).filter("parts > 1"))
    rows = rows.join(parts, "home", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part")
    rows = rows.select("home", part, "class", "n", "total", "lists", "homes", "counts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return rows.select("home", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "class", "n", "total", "lists", "homes", "counts")


def _links(member: DataFrame, sizes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    rows = durable(_at_home(member, sizes))
    key = ["home", "low", "high"]
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64(*key), F.lit(tasks)))
    some = durable(dealt.groupBy("task").applyInPandas(_candidates, "home long, low int, high int, class long"))
    sets = _sets(docs, text, bloom.build(some.select(F.col("class").alias("v")))).dropDuplicates(["class"])
    full = rows.join(some, [*key, "class"]).join(sets, "class")
    full = full.withColumn("task", F.pmod(F.xxhash64(*key), F.lit(tasks)))
    return durable(full.groupBy("task").applyInPandas(_probed, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links, its own included) of every row.

    Rows without words, or with a null text, have no shingles and are components of their own. Equal sets are linked.
    Repeated keys are rows of their own; null keys never name a component unless it has no other. Further columns are
    not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "shingles")
    _describe(docs, key, text).write.parquet(path)
    found = spark.read.parquet(path)
    counters = _sketch(found.filter("slice is not null").select("slice", "counts"))
    lists = _postings(docs, text, counters).repartition("shingle").sortWithinPartitions("shingle", "class")
    names = ["shingle", "class", "size"]
    member = lists.mapInArrow(_lists(_shared, names, 1), "shingle long, class long, size long")
    sizes = found.filter("n > 0").groupBy("class").agg(F.max("n").alias("n"))
    roots = components(_links(member, sizes, docs, text))
    own = found.filter("slice is null")
    classes = own.filter("n > 0").groupBy("class").agg(F.min("key").alias("low"))
    rooted = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    rooted = durable(rooted.select("class", "low", F.coalesce("root", "class").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = durable(rooted.join(lowest, "root").select("class", "component_id"))
    return own.select("key", "class", "n").join(named, "class", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are no near duplicate of one with a smaller key, with all their columns.

    Rows with a null key all stay. Rows that are equal in key and text count once for the others, and one of them stays
    for each key and text only if the key is the smallest of its component: repeated rows stay repeated.
    """
    found = near_duplicates(docs, key, text)
    gone = found.filter(F.col("component_id") < F.col(key)).select(F.col(key).alias("k"), F.lit(True).alias("gone")).distinct()
    return docs.alias("d").join(gone.alias("g"), F.col(f"d.{key}") == F.col("g.k"), "left_anti")
