import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkassay.llm import tokenfiles
from sparkassay.llm.queries import QUERIES

WORD = public_tokenizers.path("word_bpe_49k.json")


def wanted(rows):
    model, at, out = Tokenizer.from_file(WORD), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.asarray(model.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark, sf):
    found = QUERIES["op10_token_files"](spark, sf).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, found)) == wanted(texts)


def test_edges_and_single_reads(spark, edge, folder):
    path = f"{folder}/ids"
    tokenfiles.write_token_files(edge, path, WORD)
    found = tokenfiles.read_token_files(spark, path).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    told = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=str)
    assert told == sorted(((k, n, c) for k, _, n, c in wanted(rows)), key=str)
    assert sorted(r["start"] for r in found) == [s for _, s, _, _ in wanted(rows)]
    one = tokenfiles.read_token_files(spark, path, keys=[3]).collect()
    assert [r["ids"] for r in one] == [Tokenizer.from_file(WORD).encode("one", add_special_tokens=False).ids + [1]]


def test_words_are_encoded_as_by_the_library():
    from sparkassay.llm.tokens import DroppedSpace

    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}ord" + "!" * (i % 3) for i in range(1500)]
    odd = ["Été,", "ÀÿÖ", "x" * 5000, "\u2028a\u2028", "\x1cb", "don't", "3.5", "\u00d7", "日本語", "a\u0130", "\U0001f600", "--", "\u0085"]
    texts = [" ".join(words), " ".join(odd), "\n\n\t", "", *odd]
    model, coded = Tokenizer.from_file(WORD), DroppedSpace(WORD)
    for _ in range(2):  # as new and as known words
        got = coded([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty(spark, empty, folder):
    tokenfiles.write_token_files(empty, f"{folder}/none", WORD)
    assert tokenfiles.read_token_files(spark, f"{folder}/none").collect() == []


def test_a_short_document_is_read_alone():
    import hashlib

    import zstandard

    frames = [zstandard.compress(np.asarray(x, "<u2").tobytes()) for x in ([1, 2, 3], [4], [])]
    data = b"".join(tokenfiles.shard_bytes(hashlib.sha256(b"").digest(), 2, [5, None, 9], [3, 1, 0], frames))
    assert [(i, k, x.tolist()) for i, k, x in tokenfiles.read_shard(data, b"")] == [(0, 5, [1, 2, 3]), (1, None, [4]), (2, 9, [])]
    assert [x.tolist() for _, _, x in tokenfiles.read_shard(data, b"", {None})] == [[4]]
