import numpy as np
import public_tokenizers
import sentencepiece

from sparkassay.llm import transducer
from sparkassay.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CASES = ["Hello world", "  two  spaces\n\tx ", "ﬁ Ⅷ é 日本 \U0001f600", "", " a", "aaaa", "     ", "a     b", "<s> </s> <0x41> <unk>", "\x00 a", "x" * 300, "def f(x):\n    return  x+1\n", "▁a▁▁b"]


def test_ids_are_those_of_the_library():
    library, machine = sentencepiece.SentencePieceProcessor(model_file=MODEL), transducer.Transducer(MODEL)
    for text, ids in zip(CASES, machine.encode([t.encode() for t in CASES])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text


def test_whole_table(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op9_transducer"](spark, sf).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    assert all(r["n_pieces"] == len(library.encode(texts[r["doc_id"]] or "")) for r in rows)


def test_edges_and_decoding(edge, empty):
    coded = transducer.encode(edge, MODEL)
    told = sorted(((r["doc_id"], r["text"]) for r in transducer.decode(coded, MODEL).collect()), key=str)
    assert told == sorted(((r["doc_id"], r["text"] or "") for r in edge.collect()), key=str)
    assert transducer.encode(empty, MODEL).collect() == []


def test_long_units_hold_no_square_of_their_length():
    library, machine = sentencepiece.SentencePieceProcessor(model_file=MODEL), transducer.Transducer(MODEL)
    rng = np.random.default_rng(2)
    signs = list("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/éß日本語\n")
    texts = ["".join(rng.choice(signs, 3000)), "日本語の文章" * 500, "thequickbrownfox" * 200, " " * 3000, "a" + " " * 500 + "b", "=" * 1000]
    for text, ids in zip(texts, machine.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
    assert sum(map(len, machine.state)) <= 10_000
