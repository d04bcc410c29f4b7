"""Collocations by dynamic itemset counting.

The documents are dealt into shards that are scanned in a cycle. Words are counted from the first scan on. A longer phrase
becomes active with the scan after that in which both its subphrases (all words but the last, all but the first) reached
the threshold, and is counted for one full cycle from there, whatever shard that is; phrases of several lengths are
counted in the same scans. The search ends when no phrase of any length has shards left.

What a scan needs of the earlier ones is the scan at which each subphrase was reached. It is kept per slot of a hash table
of bounded size, the earliest scan of all phrases that share the slot. Phrases that share a slot by chance are activated
too early, which costs counts but changes none: the start follows from the slots, which never change once set, so every
active phrase is counted over each shard exactly once.

A phrase is counted under a 61-bit hash of its language and words with its length in the low bits. Phrases of equal hash would be
counted as one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.session import scratch_path

from .text import CHUNK_BYTES, LOWER, Hashes, mix, pieces, plain, raw, runs

SHARDS = 3
LEAST = 10
LONGEST = 3
TOP = 2000
COVER = 50  # percent of a phrase's occurrences inside a longer one that make it a part of that
MOST_SLOTS = 1 << 25  # bytes of one table of slots, however many phrases there are
SLOTS_EACH = 16
NEVER = 255
HELD = 1 << 20  # counts held by a task before they are given out
LANES = 64
DEALS = 8

BREAK = np.zeros(256, bool)
BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
APART = BREAK.copy()
APART[[9, 32]] = True
NEXT = np.uint64(0xF1357AEA2E62A9C5)


def _stretches(column: pa.Array, words: int):
    """(first row, bytes, limits, fresh): parts of about CHUNK_BYTES; words that start before ``fresh`` were given before.

    A part of a longer value ends between words and starts ``words`` words before the end of the last part.
    """
    for first, last in pieces(column):
        data, limits = raw(column.slice(first, last - first))
        data = LOWER[data]
        start = fresh = 0
        while last - first == 1 and len(data) - fresh > 2 * CHUNK_BYTES:
            stop = fresh + CHUNK_BYTES
            while stop < len(data):
                gap = np.flatnonzero(APART[data[stop : stop + CHUNK_BYTES]])
                stop += int(gap[0]) if len(gap) else CHUNK_BYTES
                if len(gap):
                    break
            stop = min(stop, len(data))
            part = data[start:stop]
            yield first, part, np.asarray([0, len(part)]), fresh - start
            begun, _, _ = runs(~APART[part], np.asarray([0, len(part)]))
            start = start + int(begun[-words]) if words and len(begun) >= words else start if words else stop
            fresh = stop
        yield first, data[start:], limits if start == 0 else np.asarray([0, len(data) - start]), fresh - start


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Grams:
    """The words of one stretch and the keys of its phrases by length; ``place`` is the first word of each phrase."""

    def __init__(self, data: np.ndarray, limits: np.ndarray, fresh: int, salts: np.ndarray, longest: int):
        self.data = data
        self.salts = salts
        self.start, self.end, self.row = runs(~APART[data], limits)
        words = mix(Hashes(data).spans(self.start, self.end) + salts[self.row]) if len(self.start) else np.zeros(0, np.uint64)
        breaks = np.cumsum(BREAK[data])
        piece = breaks[self.start] + self.row if len(self.start) else self.row
        first = int(np.searchsorted(self.start, fresh))
        self.fresh_rows = self.row[first:]
        self.keys = [None]
        self.place = [None]
        h = words
        for m in range(1, longest + 1):
            if m > 1:
                h = mix(h[:-1] * NEXT + words[m - 1 :]) if len(h) else h
            self.keys.append((h & ~np.uint64(7)) | np.uint64(m))
            own = piece[: len(h)] == piece[m - 1 :][: len(h)]
            own[: max(0, first - m + 1)] = False
            self.place.append(np.flatnonzero(own))

    def phrase(self, place: int, m: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[place : place + m], self.end[place : place + m]))


def slot(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - (len(table).bit_length() - 1))).astype(np.int64)


def _batches(batches, longest: int):
    """(Grams, languages, first row) of every stretch of batches of lang and text."""
    salts = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for x in set(langs) - salts.keys():
            salts[x] = _salt(x)
        own = np.asarray([salts[x] for x in langs], np.uint64)
        for first, data, limits, fresh in _stretches(plain(batch.column(1)), longest - 1):
            yield Grams(data, limits, fresh, own[first : first + len(limits) - 1], longest), langs, first


def _scan(shared, step: int, shards: int, longest: int):
    """(key, start, c): counts of a task's active phrases, and the scan from which each is counted."""

    def active(grams: Grams, m: int) -> tuple[np.ndarray, np.ndarray]:
        place = grams.place[m]
        if m == 1:
            keys = grams.keys[1][place] if step < shards else np.zeros(0, np.uint64)
            return keys, np.zeros(len(keys), np.uint8)
        table = shared.value.get(m - 1)
        if table is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        at = slot(grams.keys[m - 1], table)
        reached = np.maximum(table[at[place]], table[at[place + 1]])
        now = (reached < step) & (reached.astype(int) + shards >= step)
        return grams.keys[m][place[now]], reached[now] + np.uint8(1)

    def out(keys, starts, counts):
        for i in range(0, len(keys), 100_000):
            some = slice(i, i + 100_000)
            columns = [pa.array(keys[some].view(np.int64)), pa.array(starts[some].astype(np.int32)), pa.array(counts[some])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "start", "c"])

    def merged(parts):
        keys, starts, counts = (np.concatenate(x) for x in zip(*parts))
        found, first, at = np.unique(keys, return_index=True, return_inverse=True)
        return found, starts[first], np.bincount(at, counts, len(found)).astype(np.int64)

    def run(batches):
        parts, waiting, held = [], 0, 0
        for grams, _, _ in _batches(batches, longest):
            keys, starts = (np.concatenate(x) for x in zip(*[active(grams, m) for m in range(1, longest + 1)]))
            parts.append((keys, starts, np.ones(len(keys), np.int32)))
            waiting += len(keys)
            if waiting > max(HELD, held):
                parts, waiting = [merged(parts)], 0
                held = len(parts[0][0])
                if held > 2 * HELD:
                    yield from out(*parts[0])
                    parts, held = [], 0
        if parts:
            yield from out(*merged(parts))

    return run


def _marks(keys: DataFrame, slots: int) -> np.ndarray:
    """Which slots hold a key: 64 to a row, so at most ``slots / 64`` rows reach the driver."""
    at = F.shiftrightunsigned("key", 64 - (slots.bit_length() - 1)).alias("at")
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(bits).toArrow()
    out = np.zeros(max(1, slots // 64), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")[:slots].astype(bool)


def _slots_for(count: int) -> int:
    slots = 1 << 16
    while slots < min(MOST_SLOTS, SLOTS_EACH * count):
        slots *= 2
    return slots


def _length(key: str = "key"):
    return F.col(key).bitwiseAND(7)


def count_phrases(docs: DataFrame, shard: str, least: int, longest: int, shards: int) -> DataFrame:
    """(key, a): all words and phrases of at most ``longest`` words of (lang, text, shard) that occur ``least`` times.

    Each scan stores the running counts of the phrases whose cycle goes on, and of those that end with it only the ones
    that reached the threshold.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "phrase-counts")
    tables: dict[int, np.ndarray] = {}
    last: dict[int, int] = {}
    step, running = 0, None
    while step < shards or any(step <= x + shards for x in last.values()):
        shared = spark.sparkContext.broadcast(tables)
        scan = docs.filter(F.col(shard) == step % shards).select("lang", "text")
        found = scan.mapInArrow(_scan(shared, step, shards, longest), "key long, start int, c long")
        if running is not None:
            found = found.unionByName(running.select("key", "start", "c"))
        total = found.groupBy("key", "start").agg(F.sum("c").alias("c"))
        total.filter((F.col("start") + shards - 1 > step) | (F.col("c") >= least)).write.parquet(f"{path}/step={step}")
        shared.unpersist()
        now = spark.read.schema("key long, start int, c long").parquet(f"{path}/step={step}")
        running = now.filter(F.col("start") + shards - 1 > step)
        often = now.filter(F.col("c") >= least)
        sizes = {r["m"]: r["count"] for r in often.groupBy(_length().alias("m")).count().collect()}  # a row per length
        for m in sorted(sizes.keys() - {longest}):
            if m not in tables:
                tables = tables | {m: np.full(_slots_for(sizes[m] * shards), NEVER, np.uint8)}
            new = _marks(often.filter(_length() == m).select("key"), len(tables[m])) & (tables[m] == NEVER)
            if new.any():
                tables = tables | {m: np.where(new, np.uint8(step), tables[m])}
                last[m] = step
        step += 1
    counted = spark.read.schema("key long, start int, c long, step int").parquet(path)
    return counted.filter((F.col("start") + shards - 1 == F.col("step")) & (F.col("c") >= least)).select("key", F.col("c").alias("a"))


class Known:
    """The keys a task has given out already, forgotten when they are too many."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)

    def new(self, keys: np.ndarray) -> np.ndarray:
        """Places of the first of each key that is new."""
        keys, at = np.unique(keys, return_index=True)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            fresh = self.keys[near] != keys
            keys, at = keys[fresh], at[fresh]
        self.keys = np.union1d(self.keys, keys) if len(self.keys) < HELD else keys
        return at


def _sides(shared, longest: int):
    """(key, left, right, tongue): both subphrases and the language's number of the phrases in the shared slots."""

    def run(batches):
        known = {m: Known() for m in range(2, longest + 1)}
        for grams, _, _ in _batches(batches, longest):
            for m in known:
                place = grams.place[m]
                keys = grams.keys[m][place]
                hit = np.flatnonzero(shared.value[slot(keys, shared.value)])
                at = place[hit[known[m].new(keys[hit])]]
                below = grams.keys[m - 1]
                columns = [grams.keys[m][at], below[at], below[at + 1], grams.salts[grams.row[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["key", "left", "right", "tongue"])

    return run


def _names(shared, longest: int):
    """The texts of the phrases in the shared slots, and the words per language (key null)."""

    def run(batches):
        known, words = {m: Known() for m in range(2, longest + 1)}, {}
        for grams, langs, first in _batches(batches, longest):
            for row, n in zip(*np.unique(grams.fresh_rows, return_counts=True)):
                words[langs[first + row]] = words.get(langs[first + row], 0) + int(n)
            for m in known:
                place = grams.place[m]
                keys = grams.keys[m][place]
                hit = np.flatnonzero(shared.value[slot(keys, shared.value)])
                at = place[hit[known[m].new(keys[hit])]]
                for i in range(0, len(at), 10_000):
                    some = at[i : i + 10_000]
                    names = [langs[first + r] for r in grams.row[some]]
                    texts = [grams.phrase(x, m).decode("utf-8", "replace") for x in some]
                    columns = [pa.array(grams.keys[m][some].view(np.int64)), pa.array(names), pa.array(texts), pa.nulls(len(some), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "lang", "phrase", "n"])
        if words:
            columns = [pa.nulls(len(words), pa.int64()), pa.array(list(words)), pa.nulls(len(words), pa.string()), pa.array(list(words.values()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang", "phrase", "n"])

    return run


def _related(docs: DataFrame, deal: str, several: DataFrame, longest: int) -> DataFrame:
    """(key, left, right, tongue) of all phrases, from growing shares of the documents for the phrases not yet met."""
    spark = docs.sparkSession
    path = scratch_path(spark, "sides")
    known = None
    for turn, (low, high) in enumerate(((0, 1), (1, 4), (4, DEALS))):
        open_ = several if known is None else several.join(known.select("key"), "key", "left_anti")
        count = open_.count()
        if not count:
            break
        shared = spark.sparkContext.broadcast(_marks(open_.select("key"), _slots_for(count)))
        some = docs.filter((F.col(deal) >= low) & (F.col(deal) < high)).select("lang", "text")
        found = some.mapInArrow(_sides(shared, longest), "key long, left long, right long, tongue long")
        found.dropDuplicates(["key"]).write.parquet(f"{path}/turn={turn}")
        shared.unpersist()
        known = spark.read.schema("key long, left long, right long, tongue long, turn int").parquet(path)
    return known.drop("turn").dropDuplicates(["key"]) if known is not None else spark.createDataFrame([], "key long, left long, right long, tongue long")


def _cuts(related: DataFrame, several: DataFrame, longest: int) -> DataFrame:
    """(key, tongue, a, lefts, rights, inner): both sides of every cut, and all shorter phrases of two words or more inside."""
    all_ = several.join(related, "key")
    found = level = None
    for m in range(2, longest + 1):
        own = all_.filter(_length() == m)
        if m == 2:
            level = own.select("key", "tongue", "a", F.array("left").alias("lefts"), F.array("right").alias("rights"), F.array().cast("array<long>").alias("inner"))
        else:
            low = level.select(F.col("key").alias("left"), F.col("lefts").alias("lefts0"), F.col("inner").alias("inner0"))
            high = level.select(F.col("key").alias("right"), F.col("rights").alias("rights0"), F.col("inner").alias("inner1"))
            level = own.join(low, "left").join(high, "right").select(
                "key", "tongue", "a",
                F.concat("lefts0", F.array("left")).alias("lefts"),
                F.concat(F.array("right"), "rights0").alias("rights"),
                F.array_distinct(F.concat("inner0", "inner1", F.array("left", "right"))).alias("inner"),
            )
        found = level if found is None else found.unionByName(level)
    return found


def collocations(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` best phrases of 2 to ``longest`` words of every language.

    Words are what spaces and tabs separate inside pieces between ``.,;:!?`` and line ends; A-Z are lower-cased. ``a``,
    ``l`` and ``r`` count the phrase and the two sides of its lowest-scoring cut, ``n`` all words of the language. A phrase
    stays out if a longer candidate that contains it has at least half as many occurrences. A null language is ``und``
    and counts with documents of that name; a null text is empty; a null key is a key like others, and keys only deal
    documents into shards, so repeated rows all count. Ties go to the greater ``a``, then to the smaller phrase in byte
    order. Texts of any length are walked in stretches; a single word is not cut. No words or no phrase that occurs ``least``
    times: no rows. Further columns are not read.
    """
    if not 2 <= longest <= 7:
        raise ValueError("longest: 2 to 7 words")
    spark = docs.sparkSession
    deal = F.pmod(F.xxhash64(key), F.lit(DEALS * shards))
    slim = docs.select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"), (deal % shards).alias("shard"), F.floor(deal / shards).alias("deal")
    )
    path = scratch_path(spark, "frequent")
    count_phrases(slim, "shard", least, longest, shards).write.parquet(path)
    frequent = spark.read.parquet(path)
    several = frequent.filter(_length() > 1)
    path = scratch_path(spark, "cuts")
    _cuts(_related(slim, "deal", several, longest), several, longest).write.parquet(path)
    found = spark.read.parquet(path)
    cuts = found.select("key", "tongue", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("cut", "sides"))
    for side, name in (("lefts", "l"), ("rights", "r")):
        cuts = cuts.join(frequent.select(F.col("key").alias(f"{name}_key"), F.col("a").alias(name)), F.col(f"sides.{side}") == F.col(f"{name}_key"))
    big = lambda c: F.col(c).cast("decimal(15,0)")
    parts = cuts.withColumn("above", F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a"))).withColumn("under", big("l") * big("r"))
    parts = parts.withColumn("score", F.expr("above div under"))
    lowest = parts.groupBy("key", "tongue", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    scored = lowest.select("key", "tongue", "a", "s.l", "s.r", "s.score")
    around = found.select(F.explode("inner").alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    kept = scored.join(around, "key", "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * COVER)).drop("longer")
    order = [F.desc("score"), F.desc("a")]
    lanes = kept.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(LANES)))
    for by in (["tongue", "lane"], ["tongue"]):  # ties at the limit all stay until they have names
        lanes = lanes.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    path = scratch_path(spark, "chosen")
    lanes.select("key", "a", "l", "r", "score").write.parquet(path)
    chosen = spark.read.parquet(path)
    shared = spark.sparkContext.broadcast(_marks(chosen.select("key"), _slots_for(chosen.count())))
    path = scratch_path(spark, "names")
    named = slim.select("lang", "text").mapInArrow(_names(shared, longest), "key long, lang string, phrase string, n long")
    named.groupBy("key", "lang", "phrase").agg(F.sum("n").alias("n")).write.parquet(path)
    named = spark.read.parquet(path)
    words = named.filter("key IS NULL").select("lang", "n")
    best = chosen.join(named.filter("key IS NOT NULL").select("key", "lang", "phrase"), "key")
    order = Window.partitionBy("lang").orderBy(*order, "phrase")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
