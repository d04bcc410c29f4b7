import collections
import hashlib
import random

import numpy as np
import pytest

from sparkassay.llm import repeats
from sparkassay.llm.queries import QUERIES


def brute(rows):
    texts = [(k, (t or "").encode()) for k, t in rows]
    times = collections.Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    out = []
    for key, t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if times[t[i : i + 200]] > 1:
                mark[i] += 1
                mark[i + 200] -= 1
        cover = np.cumsum(mark)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.append(0, cover.astype(int))) == 1).sum())
        out.append((key, len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op6_repeats"](spark, sf)) == brute(rows)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(90), prose(250)
    rows = [(i, prose(rng.randrange(5, 120)) + " " + passage[rng.randrange(150) :] + " " + prose(20)) for i in range(25)]
    for i in range(25):
        w = base.split(" ")
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = word()
        rows.append((100 + i, " ".join(w)))
    return rows + [(200, base), (201, base), (202, "z" * 700), (203, "ab" * 300), (204, passage + passage), (205, "y" * 199), (206, "q" * 200)]


@pytest.mark.parametrize("limits", [None, (3, 10_000), (3, 2)])
def test_passages_copies_and_runs(docs, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(repeats, "HOT", limits[0])
        monkeypatch.setattr(repeats, "HOT_ANCHOR", limits[1])
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    rows = corpus(5)
    assert found(repeats.remove_repeats(docs([(i, t, "en", "a") for i, t in rows]))) == brute(rows)


def test_edges(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert found(repeats.remove_repeats(edge)) == brute(rows)
    assert repeats.remove_repeats(empty).collect() == []


def test_large_groups_are_settled_in_parts():
    import pyarrow as pa

    names = ["anchor", "around", "row", "place", "size"]
    rows = sorted([(1, i // 3, i, 0, 900) for i in range(90_000)] + [(2, 5, 7, 0, 900), (2, 5, 8, 0, 900), (3, 1, 1, 1, 900)])
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 9000])], names) for i in range(0, len(rows), 9000)]
    marks, probes, homes = set(), set(), set()
    for b in repeats._settle(batches):
        for r in b.to_pylist():
            (marks if r["what"] == "m" else probes).add((r["anchor"], r["row"]))
            if r["what"] == "p":
                homes.add(r["home"])
    assert marks == {(1, i) for i in range(90_000)} | {(2, 7), (2, 8)}
    assert len({r // 3 for _, r in probes}) == 30_000 and homes == {1}


@pytest.mark.parametrize("seed", range(8))
def test_index_of_a_block(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"abc\0") for _ in range(rng.randrange(1, 700))) for _ in range(4)]
    segments = [b"".join(rng.choice(base)[rng.randrange(200) :][: rng.randrange(100, 600)] for _ in range(2)) for _ in range(8)]
    segments = [s for s in [*segments, b"x" * 450] if s]
    times = collections.Counter(s[i : i + 200] for s in segments for i in range(len(s) - 199))
    for s, got in zip(segments, repeats.repeated_starts(segments)):
        assert got.tolist() == [i for i in range(len(s) - 199) if times[s[i : i + 200]] > 1]
