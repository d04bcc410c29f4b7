import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sparkassay.llm import jaccard
from sparkassay.llm.components import components
from sparkassay.llm.queries import QUERIES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[top(i)].append(key)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((key, len(sets[i]), low[top(i)] if low[top(i)] is not None else key) for i, (key, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op3_jaccard"](spark, sf)) == brute(rows)


def near_copies(seed, n, words=60, edits=4, passage=0):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9999)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    shared = " ".join(f"p{i}" for i in range(passage))
    return rows + [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) + " " + shared) for i in range(20)]


@pytest.mark.parametrize("part", [4096, 7])
def test_a_group_of_near_copies_with_borderline_pairs(docs, monkeypatch, part):
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "TASK_ROWS", 30)
    rows = near_copies(3, 40, passage=30) + [(2000 + i, t) for i, (_, t) in enumerate(near_copies(3, 5))]
    assert found(jaccard.near_duplicates(docs([(i, t, "en", "a") for i, t in rows]))) == brute(rows)


def test_parts_of_a_long_list_share_a_home(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "LIST_ROWS", 5)
    shingle, c = np.repeat([7, 8, 9], [3, 40, 4]), np.arange(47)
    cols, names = [shingle, np.zeros(47, np.int64), c, c], ["home", "shingle", "class", "total"]
    for size in (1, 2, 3, 6, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in cols], ["s", "d", "c", "t"]) for i in range(0, 47, size)]
        out = pa.Table.from_batches(jaccard._lists(jaccard._homes, names, 0)(batches))
        assert out["class"].to_pylist() == c.tolist()
        assert out["home"].to_pylist() == np.repeat([0, 3, 43], [3, 40, 4]).tolist()


def test_borderline_pairs_across_the_cut_of_a_list(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_ROWS", 5)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        rng = random.Random(5)
        base, rows = [f"w{i}" for i in range(80)], []
        for i in range(40):
            w = list(base)
            w[rng.choice(range(6, 74, 6))] = f"e{i}"  # any two have 66 or 71 of 76 shingles in common
            rows.append((i, " ".join(w), "en", "a"))
        assert found(jaccard.near_duplicates(docs(rows))) == brute([r[:2] for r in rows])
    finally:
        spark.conf.set(size, before)


def test_edges(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert found(jaccard.near_duplicates(edge)) == brute(rows)
    assert jaccard.near_duplicates(empty).collect() == []
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == len(rows)


def test_case_and_words():
    import pyarrow as pa

    from sparkassay.llm import text as tx

    texts = ["A B C D E f", "a b\tc\nd e F", "É b c d e f", "é b c d e f", "a b", "B a", "", "  "]
    sets = jaccard.shingle_sets(tx.plain(pa.array(texts)))
    assert [len(s) for s in sets] == [2, 2, 2, 2, 1, 1, 0, 0]
    assert np.array_equal(sets[0], sets[1]) and not np.array_equal(sets[2], sets[3]) and sets[4] != sets[5]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 33)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(34)}, **{100 + i: 100 for i in range(30)}}
