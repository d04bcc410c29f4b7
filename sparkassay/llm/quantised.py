"""Near duplicates of vectors by cosine with product quantisation.

Unit vectors are dealt to the inverted list of their nearest coarse centroid and stored with a code: the residual to the
centroid is cut into subspaces, each replaced by the nearest entry of its codebook. A query scores a list by table lookups
of its own, unquantised subspaces (asymmetric distances), and the vectors that pass are compared exactly.

Nothing is lost on the way. A pair within distance D of which one lies on either side of the plane between two centroids
has one within D / 2 of that plane; so a list is probed by every vector that is at most D / 2 away from the plane, and one
of the two finds the other. Each code keeps the length of what it leaves out, which bounds how far a lookup distance may
be from the true one. Centroids and codebooks are fitted to a bounded sample: they decide how much is compared, not what
is found.

Lists are joined to blocks of neighbours. A block is a task, a list longer than a block is cut into parts that meet in
pairs, and visitors beyond a number meet copies of the block. A task gives counts and a forest of links, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.session import scratch_path

from .components import components

COSINE = 0.95
MOST_CELLS = 4096
CELL_ROWS = 64  # rows of a list, while there are fewer than MOST_CELLS lists
SAMPLE_EACH = 32  # sampled vectors per list
SAMPLE_BYTES = 64 << 20
SUBSPACE = 8  # dimensions
ENTRIES = 256  # of a codebook
ROUNDS = 6
BLOCK_ROWS = 8192
LEAST_ROWS = 512
BLOCKS = 32  # blocks wanted of a small table
VISITORS = 32_768
STEP = 64  # queries with lookup tables at a time
SLACK = 1e-5  # rounding of single-precision lookups
KEPT = "id long, size int, v binary"


def _packed(v: np.ndarray) -> list[bytes]:
    """Vectors as bytes, in single precision where that loses nothing; equal vectors give equal bytes."""
    with np.errstate(over="ignore", under="ignore"):
        single = v.astype(np.float32)
    narrow = (single == v).all(1)
    return [b"f" + s.tobytes() if short else b"d" + x.tobytes() for s, x, short in zip(single, v + 0.0, narrow)]


def units(strings: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(strings), size))
    for i, row in enumerate(strings):
        out[i] = np.frombuffer(row, np.float32 if row[:1] == b"f" else np.float64, offset=1)
    out /= np.abs(out).max(1, initial=0)[:, None]
    return out / np.sqrt((out * out).sum(1))[:, None]


def _read(batches):
    for batch in batches:
        lists = batch.column(1)
        limits, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        size = np.diff(limits)
        usable = batch.column(2).to_numpy(zero_copy_only=False)
        v = np.full(len(batch), None, object)
        for s in np.unique(size[usable]):
            at = np.flatnonzero(usable & (size == s))
            v[at] = _packed(flat[limits[at][:, None] + np.arange(s)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(v.tolist(), pa.binary())], ["id", "size", "v"])


def readable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, size, v) of every row; v is null where the vector is null, zero or holds null or non-finite entries."""
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    kept = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    kept = kept.withColumn("good", F.coalesce(good, F.lit(False)))
    return kept.withColumn("v", F.when(F.col("good"), F.col("v")).otherwise(F.array().cast("array<double>"))).mapInArrow(_read, KEPT)


def _means(x: np.ndarray, k: int, sphere: bool, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct rows of the sample; a centroid that loses all its rows stays where it is."""
    rng = np.random.default_rng(seed)
    centre = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centre)
        count = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        some = count > 0
        centre[some] = total[some] / count[some][:, None]
        if sphere:
            length = np.sqrt((centre * centre).sum(1))
            centre[length > 0] /= length[length > 0][:, None]
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centre.T - half, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Quantiser:
    """Coarse centroids on the unit sphere, codebooks of the residuals, and the blocks of lists."""

    def __init__(self, sample: np.ndarray, cells: int, cosine: float):
        self.size = sample.shape[1]
        self.cosine = cosine
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        self.centres = _means(sample, min(cells, len(sample)), True, 1)
        subspaces = -(-self.size // SUBSPACE)
        rest = self.cut(sample - self.centres[_nearest(sample, self.centres)])
        self.books = [_means(rest[:, m], min(ENTRIES, len(rest)), False, 2 + m) for m in range(subspaces)]
        half = (self.centres * self.centres).sum(1) / 2
        self.half = half
        apart = half[:, None] * 2 + half * 2 - 2 * self.centres @ self.centres.T
        self.apart = np.sqrt(np.maximum(apart, 0)).astype(np.float32)

    def cut(self, x: np.ndarray) -> np.ndarray:
        subspaces = -(-self.size // SUBSPACE)
        wide = np.zeros((len(x), subspaces * SUBSPACE))
        wide[:, : self.size] = x
        return wide.reshape(len(x), subspaces, SUBSPACE)

    def encode(self, u: np.ndarray):
        """List, codes, squared length of what list and codes stand for, and the distance from it."""
        cell = _nearest(u, self.centres)
        rest = self.cut(u - self.centres[cell])
        codes = np.stack([_nearest(rest[:, m], book) for m, book in enumerate(self.books)], 1)
        made = np.stack([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        error = np.sqrt(((rest - made) ** 2).sum((1, 2)))
        stood = self.centres[cell] + made.reshape(len(u), -1)[:, : self.size]
        return cell, codes.astype(np.uint8), (stood * stood).sum(1), error

    def tables(self, u: np.ndarray) -> np.ndarray:
        parts = self.cut(u)
        out = np.zeros((len(u), len(self.books), ENTRIES), np.float32)
        for m, book in enumerate(self.books):
            out[:, m, : len(book)] = parts[:, m] @ book.T
        return out.reshape(len(u), -1)

    def probed(self, u: np.ndarray, cell: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which of ``cells`` each vector of the list ``cell`` has to look into: the plane is near enough."""
        score = u @ self.centres[cells].T - self.half[cells]
        own = (u * self.centres[cell]).sum(1) - self.half[cell]
        return own[:, None] - score <= (self.reach / 2 + SLACK) * self.apart[cell][:, cells] + SLACK


def _blocks(centres: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of every list, and the parts of every block: neighbours together, about ``most`` rows each."""
    block = np.zeros(len(centres), np.int64)
    parts, waiting = [], [np.arange(len(centres))]
    while waiting:
        some = waiting.pop()
        total = int(rows[some].sum())
        if total <= most or len(some) == 1:
            block[some] = len(parts)
            parts.append(max(1, -(-total // most)))
            continue
        x = centres[some] - centres[some].mean(0)
        way = x[np.argmax((x * x).sum(1))]
        order = np.argsort(x @ way, kind="stable")
        held = rows[some][order].cumsum()
        at = min(max(1, int(np.searchsorted(held, total / 2))), len(some) - 1)
        waiting += [some[order[:at]], some[order[at:]]]
    return block, np.asarray(parts)


class Forest:
    """Union by the smaller number, over many links at once."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.root[a], self.root[b]
        if not (x != y).any():
            return
        root = self.root
        for i, j in np.unique(np.stack([x, y], 1)[x != y], axis=0).tolist():
            p, q = i, j
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                self.links.append((i, j))
        while (root[root] != root).any():
            root[:] = root[root]


def _compare(q, u, own, cell, a, b, times, counts, forest) -> None:
    for i in range(0, len(a), 50_000):
        x, y = a[i : i + 50_000], b[i : i + 50_000]
        near = np.einsum("ij,ij->i", u[x], own[y]) >= q.cosine
        x, y = x[near], y[near]
        back = np.flatnonzero(cell[x] > cell[y])  # found from both lists: only the visit from the lower one counts
        if len(back):
            theirs, mine = cell[x[back]], cell[y[back]]
            score = (own[y[back]] * q.centres[theirs]).sum(1) - q.half[theirs]
            at_home = (own[y[back]] * q.centres[mine]).sum(1) - q.half[mine]
            both = at_home - score <= (q.reach / 2 + SLACK) * q.apart[mine, theirs] + SLACK
            stay = np.ones(len(x), bool)
            stay[back[both]] = False
            x, y = x[stay], y[stay]
        np.add.at(counts, x, times[y])
        np.add.at(counts, y, times[x])
        forest.add(x, y)


def _search(shared):
    """What a task does with the members of one block (or part of one) and their visitors."""

    def run(table: pa.Table) -> pa.Table:
        q: Quantiser = shared.value
        member = table.column("member").to_numpy()
        order = np.lexsort((table.column("class").to_numpy(), ~member))
        table = table.take(pa.array(order))
        number, times, cell = (table.column(c).to_numpy() for c in ("class", "n", "cell"))
        u = units(table.column("v").to_pylist(), q.size)
        many = int(member.sum())
        own = u[:many]
        codes = np.frombuffer(b"".join(table.column("codes").slice(0, many).to_pylist()), np.uint8).reshape(many, len(q.books))
        length, error = (table.column(c).slice(0, many).to_numpy() for c in ("length", "error"))
        lists = [np.flatnonzero(cell[:many] == c) for c in np.unique(cell[:many])]
        cells = np.asarray([cell[x[0]] for x in lists], np.int64)
        columns = [codes[x].astype(np.int64) + ENTRIES * np.arange(len(q.books)) for x in lists]
        within = [(q.reach + error[x] + SLACK) ** 2 - 1 - length[x] + SLACK for x in lists]
        counts, forest = np.zeros(len(u), np.int64), Forest(len(u))
        begin = 0 if table.column("lane")[0].as_py() == 0 else many  # members meet each other in one of the copies only
        for i in range(begin, len(u) if many else 0, STEP):
            some = np.arange(i, min(i + STEP, len(u)))
            tables = q.tables(u[some])
            near = (u[some] @ q.centres[cells].T).astype(np.float32)
            asks = q.probed(u[some], cell[some], cells) | (cell[some][:, None] == cells)
            for j, x in enumerate(lists):
                here = np.flatnonzero(asks[:, j])
                if not len(here):
                    continue
                score = np.repeat(near[here, j][:, None], len(x), 1)
                mine = tables[here]
                for m in range(len(q.books)):
                    score += mine[:, columns[j][:, m]]
                a, b = np.nonzero(-2 * score <= within[j])
                a, b = some[here[a]], x[b]
                first = (a < b) | (a >= many) | (cell[a] != cell[b])  # pairs of one list, both members, once
                first &= a != b
                _compare(q, u, own, cell, a[first], b[first], times, counts, forest)
        hit = np.flatnonzero(counts)
        links = np.asarray(forest.links, np.int64).reshape(-1, 2)
        ends = number[links]
        return pa.table(
            {
                "a": np.concatenate([number[hit], ends[:, 0]]),
                "b": pa.array(np.concatenate([number[hit], ends[:, 1]])),
                "n": pa.array(np.concatenate([counts[hit], np.zeros(len(links), np.int64)])),
            }
        )

    return run


CODED = "class long, n long, v binary, cell int, codes binary, length double, error double"


def _coded(shared):
    def run(batches):
        q = shared.value
        for batch in batches:
            if len(batch):
                cell, codes, length, error = q.encode(units(batch.column(2).to_pylist(), q.size))
                rest = [pa.array(cell, pa.int32()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(length), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *rest], ["class", "n", "v", "cell", "codes", "length", "error"])

    return run


def _visits(shared, block: np.ndarray, blocks: int):
    """(place, block): the blocks other than its own that each row has to visit."""
    cells = np.arange(len(block))
    first = np.unique(np.sort(block), return_index=True)[1]
    order = np.argsort(block, kind="stable")

    def visits(batch):
        q = shared.value
        u = units(batch.column("v").to_pylist(), q.size)
        cell = batch.column("cell").to_numpy()
        out = []
        for i in range(0, len(u), 512):
            asks = q.probed(u[i : i + 512], cell[i : i + 512], cells)[:, order]
            into = np.logical_or.reduceat(asks, first, axis=1)
            into[np.arange(len(into)), block[cell[i : i + 512]]] = False
            place, to = np.nonzero(into)
            out.append((place + i, to))
        return (np.concatenate(x) for x in zip(*out))

    def count(batches):
        total = np.zeros(blocks, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(list(visits(batch))[1], minlength=blocks)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["block", "visits"])

    def copy(batches):
        for batch in batches:
            if len(batch):
                place, to = visits(batch)
                for i in range(0, len(place), 10_000):
                    rows = batch.take(pa.array(place[i : i + 10_000]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to[i : i + 10_000], pa.int32())], [*rows.schema.names, "block"])

    return count, copy


def _links(classes: DataFrame, size: int, rows: int, cosine: float) -> DataFrame:
    """(a, b, n): counts of a class where a = b, else a link between two classes."""
    spark = classes.sparkSession
    cells = min(MOST_CELLS, max(1, -(-rows // CELL_ROWS)))
    wanted = max(1, min(SAMPLE_EACH * cells, SAMPLE_BYTES // (8 * size)))
    sample = classes
    if rows > wanted:
        sample = classes.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * wanted / rows))
    sample = units([r["v"] for r in sample.select("v").collect()] or [classes.select("v").first()["v"]], size)
    quantiser = Quantiser(sample, cells, cosine)
    shared = spark.sparkContext.broadcast(quantiser)
    path = scratch_path(spark, "coded")
    classes.select("class", "n", "v").mapInArrow(_coded(shared), CODED).write.parquet(path)
    coded = spark.read.parquet(path)
    held = np.zeros(len(quantiser.centres), np.int64)
    for r in coded.groupBy("cell").count().collect():  # at most MOST_CELLS rows
        held[r["cell"]] = r["count"]
    most = min(BLOCK_ROWS, max(LEAST_ROWS, -(-rows // BLOCKS)))
    block, parts = _blocks(quantiser.centres, held, most)
    count, copy = _visits(shared, block, len(parts))
    visits = np.zeros(len(parts), np.int64)
    for r in coded.select("v", "cell").mapInArrow(count, "block long, visits long").groupBy("block").agg(F.sum("visits").alias("visits")).collect():
        visits[r["block"]] = r["visits"]
    lanes = np.maximum(1, -(-visits // VISITORS))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(int(x)) for x in values]), at + 1)
    home = coded.withColumn("block", pick(block, F.col("cell")).cast("int"))
    home = home.withColumn("part", F.pmod(F.xxhash64("class"), pick(parts, F.col("block"))).cast("int"))
    every = lambda values: F.explode(F.sequence(F.lit(0), pick(values, F.col("block")) - 1))
    members = home.withColumn("lane", every(lanes)).withColumn("member", F.lit(True))
    slim = ["class", "n", "v", "cell"]
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("length", "double"), ("error", "double"))]
    away = coded.select(*slim).mapInArrow(copy, "class long, n long, v binary, cell int, block int").withColumn("part", every(parts))
    inside = home.select(*slim, "block", "part", (pick(parts, F.col("block")) - 1).alias("last")).filter("part < last")
    inside = inside.withColumn("part", F.explode(F.sequence(F.col("part") + 1, F.col("last")))).drop("last")
    visitors = away.unionByName(inside).withColumn("lane", F.pmod(F.xxhash64("class"), pick(lanes, F.col("block"))).cast("int"))
    visitors = visitors.select("*", *blank, F.lit(False).alias("member"))
    met = members.select(*visitors.columns).unionByName(visitors)
    out = scratch_path(spark, "links")
    met.groupBy("block", "part", "lane").applyInArrow(_search(shared), "a long, b long, n long").write.parquet(out)
    return spark.read.parquet(out)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """key, n_links, component_id and kept of every row: rows link when their cosine is at least ``cosine``.

    n_links counts the other rows linked directly, copies included. component_id is the smallest key reachable by links,
    the row's own included; kept holds for the rows with that key. Vectors that are null, zero, or hold null or
    non-finite entries link with nothing, and vectors link only with those of their own size. Repeated keys are rows of
    their own: copies link with each other, and rows with the smallest key of their component all stay. A row with a null
    key counts as a link of others, and stays only if no row of its component has a key. An empty table gives no rows.
    Further columns are not read.
    """
    spark = vectors.sparkSession
    path, distinct = scratch_path(spark, "vectors"), scratch_path(spark, "classes")
    readable(vectors, key, column).write.parquet(path)
    rows = spark.read.parquet(path)
    grouped = rows.filter("v IS NOT NULL").groupBy("size", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    grouped.withColumn("class", F.monotonically_increasing_id()).write.parquet(distinct)
    classes = spark.read.parquet(distinct)
    sizes = classes.groupBy("size").count().collect()  # one row per size of vectors
    found = None
    for r in sorted(sizes, key=lambda r: r["size"]):
        part = _links(classes.filter(F.col("size") == r["size"]), r["size"], r["count"], cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    counts = found.filter("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    roots = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "class")
    rooted = classes.select("class", "low", "n", "size", "v").join(roots, "class", "left").join(counts, "class", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "class"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    links = (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    named = rooted.join(lowest, "root").select("v", "component", links)
    out = rows.select("id", "v").join(named, "v", "left").withColumn("component", F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component")))
    return out.select(
        F.col("id").alias(key),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()).alias("kept"),
    )
