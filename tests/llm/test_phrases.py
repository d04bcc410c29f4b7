import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from sparkassay.llm import phrases


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", low)]


def brute(rows, least, longest=3, top=2000):
    """Rows (lang, text) -> expected result rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = []
    for lang in n:
        candidates = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            cuts = [(int(Fraction(1_000_000 * a * a, f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        scored.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(scored[:top])]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


WORDS = "alpha beta Gamma delta 日本 é x1 zeta eta theta".split()


def texts(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = rng.choice(WORDS, size=rng.integers(1, 40), p=np.arange(10, 0, -1) / 55)
        seps = rng.choice([" ", "  ", "\t", ", ", ".\n", " \r", "\x0b"], size=len(words), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
        out.append("".join(w + s for w, s in zip(words, seps)))
    return out


def test_against_brute_force(spark, docs):
    rows = [(i if i % 7 else None, t, [None, "und", "en", "de"][i % 4], "s") for i, t in enumerate(texts(1, 120))]
    rows += [(500 + i, "rare words met late in one place only", "fr", "s") for i in range(12)]  # one shard after the other
    rows += [(9, "same row", "en", "s")] * 11
    df = docs(rows, parts=5)
    assert found(phrases.collocations(df)) == brute([(r[2], r[1]) for r in rows], 10)
    assert found(phrases.collocations(df, least=4, longest=4, shards=5, top=7)) == brute([(r[2], r[1]) for r in rows], 4, 4, 7)


def test_edges(spark, edge, empty, docs):
    assert phrases.collocations(empty).collect() == []
    got = phrases.collocations(edge, least=2)
    rows = [(r["lang"], r["text"]) for r in edge.select("lang", "text").collect()]
    assert found(got) == brute(rows, 2)
    hot = docs([(1, "again and again " * 500, "en", "s")] * 40)
    assert found(phrases.collocations(hot)) == brute([("en", "again and again " * 500)] * 40, 10)


def counted(batches):
    out = Counter()
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            out[k] += c
    return out


class Shared:
    value: dict = {}


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_long_texts_are_walked_in_stretches(monkeypatch, longest):
    """A text cut into many stretches counts like the whole one; a word longer than a stretch stays whole."""
    everything = Shared()
    everything.value = {m: np.zeros(1 << 16, np.uint8) for m in range(1, longest)}
    text = " ".join(texts(4, 60)) + " " + "w" * 700 + ", " + "end of it all"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([text, "short one"])], ["lang", "text"])
    whole = counted(phrases._scan(everything, 1, 3, longest)([batch]))
    for size in (50, 97, 400):
        monkeypatch.setattr(phrases, "CHUNK_BYTES", size)
        monkeypatch.setattr(phrases, "pieces", lambda column: ((i, i + 1) for i in range(len(column))))
        assert counted(phrases._scan(everything, 1, 3, longest)([batch])) == whole


def test_every_active_phrase_has_one_full_cycle():
    """Over any reach of its subphrases a phrase is counted on each shard exactly once."""
    for shards in (1, 2, 3, 5):
        for reached in range(0, 2 * shards):
            steps = [t for t in range(60) if reached < t and reached + shards >= t]
            assert sorted(t % shards for t in steps) == list(range(shards))


def test_crowded_slots_change_no_count(spark, docs, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_SLOTS", 1 << 16)
    monkeypatch.setattr(phrases, "SLOTS_EACH", 1)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(9, 60))]
    assert found(phrases.collocations(docs(rows))) == brute([("en", r[1]) for r in rows], 10)
