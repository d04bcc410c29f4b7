import hashlib
import re

import numpy as np

from sparkassay.llm import personal
from sparkassay.llm.queries import QUERIES


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ip = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
    out += [("ip", *m.span()) for m in ip if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    phone = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
    return out + [("phone", *m.span()) for m in phone if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


CASES = [
    "", "a@b.c_x@d.e and é +1 (499) 555-6503.", "x@y", "@a.b", "..%+-@a-.b", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.255.0",
    "4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111111", "+12 3 +12345678 +(1) 2", "a@b.c@d.e.f", "1" * 5000,
]


def test_base_patterns():
    for t in CASES:
        assert personal.base_spans(t) == brute(t), t


def test_whole_table(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op7_personal"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]] or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and r["spans"].startswith(told)
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(x == k for x, _, _ in base) for k in personal.KINDS]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    emit, step = rng.normal(size=(14, 3)), rng.normal(size=(3, 3))
    opening = np.asarray([0, 1, 5, 11])
    got = personal.viterbi(emit, step, opening)
    for a, b in zip(opening, [*opening[1:], 14]):
        best = max(np.ndindex(*[3] * (b - a)), key=lambda p: sum(emit[a + i, x] for i, x in enumerate(p)) + sum(step[x, y] for x, y in zip(p, p[1:])))
        assert tuple(got[a:b]) == best


def test_the_field_learns_and_is_held_out():
    rng = np.random.default_rng(3)

    def lines(n):
        out = []
        for _ in range(n):
            words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(8)]
            at = int(rng.integers(0, 8))
            words[at] = f"{''.join(rng.choice(list('abcdef'), 4))}.{rng.integers(10, 99)}@mail.example.com"
            text = " ".join(words)
            start = text.index(words[at])
            out.append((text.encode(), [(start, start + len(words[at]))]))
        return out

    table, held = lines(150), lines(60)
    model = personal.train([t for t, _ in table], [s for _, s in table])
    import pyarrow as pa

    from sparkassay.llm import text as tx

    data, limits = tx.raw(tx.plain(pa.array([t.decode() for t, _ in held])))
    start, _, doc, opening, found = personal.features(data, limits)
    label = personal.viterbi(personal.emissions(model[0], found), model[1], opening)
    gold = [any(a <= s - limits[d] < b for a, b in held[d][1]) for s, d in zip(start, doc)]
    assert np.mean((label > 0) == np.asarray(gold)) > 0.99


def test_edges_and_redaction(edge, empty, docs):
    assert personal.redact_documents(edge).columns == edge.columns
    assert sorted(map(str, personal.redact_documents(edge).collect())) == sorted(map(str, edge.collect()))
    assert personal.find(empty, keep=["doc_id"]).collect() == []
    rows = [(1, "é: a@b.example.com or +1 (499) 555-6503 now", "en", "a"), (2, None, "en", "a")]
    out = {r["doc_id"]: r["text"] for r in personal.redact_documents(docs(rows)).collect()}
    assert out == {1: "é: [EMAIL] or [PHONE] now", 2: None}
