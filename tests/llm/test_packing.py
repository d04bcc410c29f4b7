import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkassay.llm import packing
from sparkassay.llm.queries import QUERIES

FILES = [public_tokenizers.path(f"byte_bpe_50k.{e}") for e in ("json", "tiktoken")]


def checked(rows, texts, size=packing.SIZE):
    """Every id of every row once, in sequences without gaps."""
    model = Tokenizer.from_file(FILES[0])
    ids = {}
    for key, text in texts:
        ids.setdefault(key, []).append(model.encode(text or "", add_special_tokens=False).ids + [1])
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    assert found.keys() == ids.keys()
    for key, pieces in found.items():
        assert sum(p["length"] for p in pieces) == sum(map(len, ids[key]))
        for p in pieces:
            same = [x for x in ids[key] if len(x) == p["doc_tokens"]]
            part = np.asarray(same[0][p["start"] : p["start"] + p["length"]], "<u4")
            assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sequences


def test_whole_table(spark, sf):
    rows = QUERIES["op1_packing"](spark, sf).collect()
    texts = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sequences = checked(rows, texts)
    total = sum(r["length"] for r in rows)
    assert 1 - total / (packing.SIZE * len(sequences)) < 0.03


def test_edges(edge):
    rows = packing.pack(edge, *FILES).collect()
    checked(rows, [(r["doc_id"], r["text"]) for r in edge.collect()])
    assert all(len(r["ids"]) == r["length"] for r in rows)


def test_empty(empty):
    assert packing.pack(empty, *FILES).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from([0, 2, 5])), min_size=1, max_size=9), st.just(16))
def test_cuts_are_the_cheapest(steps, size):
    places = np.cumsum([0] + [s for s, _ in steps])
    penalty = np.asarray([0] + [p for _, p in steps])
    penalty[-1] = 0

    def cost(chosen):
        return sum(size - (b - a) + penalty[list(places).index(b)] for a, b in zip(chosen, chosen[1:]))

    best = None
    for mask in range(1 << max(0, len(places) - 2)):
        chosen = [0] + [int(p) for i, p in enumerate(places[1:-1]) if mask >> i & 1] + [int(places[-1])]
        if all(b - a <= size for a, b in zip(chosen, chosen[1:])):
            best = min(best, cost(chosen)) if best is not None else cost(chosen)
    assert cost(packing.cuts(places, penalty, size).tolist()) == best


def test_cuts_prefer_document_ends():
    places = np.asarray([0, 10, 20, 30])
    assert packing.cuts(places, np.asarray([0, 50, 0, 0]), 20).tolist() == [0, 20, 30]


@pytest.mark.parametrize("text", ["", " ", "a  b", "x \n y", "<|endoftext|> and more", "a  b c d", "don't  stop.\n"])
def test_ids_are_those_of_the_tokenizer(text):
    from sparkassay.llm.tokens import DroppedSpace, LeadingSpace

    word = public_tokenizers.path("word_bpe_49k.json")
    for encoder, path in ((LeadingSpace(*FILES), FILES[0]), (DroppedSpace(word), word)):
        wanted = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder([text.encode()])[0], "<u4").tolist() == wanted


def test_the_tokenizer_is_loaded_for_the_special_token_only():
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparkassay.llm.tokens import LeadingSpace

    path, ranks = (public_tokenizers.path(f"byte_bpe_50k.{end}") for end in ("json", "tiktoken"))
    coder, special = LeadingSpace(path, ranks), "a <|endoftext|> b"
    coder([b"some words and more of them", b"", "\n\t é 日本".encode()])
    assert "exact" not in vars(coder)
    assert coder([special.encode()])[0] == np.asarray(Tokenizer.from_file(path).encode(special, add_special_tokens=False).ids, "<u4").tobytes()
