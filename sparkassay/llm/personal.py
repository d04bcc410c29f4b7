"""Personal data: four fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns are base findings that always stay. The field labels the words of every line with outside, begin and
inside, from the shape of a word and of its neighbours; it is trained on a small labelled table and adds spans that the
patterns miss, such as other ways of writing a number. Decoding is Viterbi over many lines at once in numpy.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .sampling import distinct_sample

KINDS = ["email", "ip", "card", "phone"]
ADDED = "other"  # kind of the spans that only the field finds
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

# The patterns of the four kinds. Those of email and ip are split so that long runs take linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the conditional random field

LINE_WORDS = 256  # a longer line is decoded in parts
BUCKETS = 4096
SIZES = [BUCKETS] * 4 + [16] * 4  # shape, shape with run lengths, shape before, shape after, digits, length, first, last
OFFSETS = np.cumsum([0, *SIZES[:-1]])
LABEL_LINES = 1000  # lines with a digit or @ of the labelled table, and half as many others
LABEL_BYTES = 500  # longest of them
EPOCHS, RATE, DECAY = 40, 0.1, 1e-4


def _classes() -> np.ndarray:
    kind = np.full(256, 12, np.int64)
    kind[97:123], kind[0x80:], kind[65:91], kind[48:58] = 0, 0, 1, 2
    for i, c in enumerate(b".,-@+()"):
        kind[c] = 3 + i
    kind[list(b"_%")], kind[list(b":/")] = 10, 11
    return kind


CLASS = _classes()
SHAPE = tx.mix(np.arange(32 * 16, dtype=np.uint64) + np.uint64(1)).reshape(32, 16)
SHAPE_RUNS = tx.mix(np.arange(32 * 16 * 8, dtype=np.uint64) + np.uint64(99_999)).reshape(32, 16, 8)


def features(data: np.ndarray, limits: np.ndarray):
    """Words (start, end, text), first word of every sequence, and the feature numbers of each word."""
    start, end, doc = tx.words(data, limits)
    n = len(start)
    if not n:
        return start, end, doc, np.zeros(0, np.int64), np.zeros((len(SIZES), 0), np.int64)
    kind = CLASS[data]
    opens = np.zeros(len(data), bool)
    opens[1:] = kind[1:] != kind[:-1]
    opens &= ~tx.SPACE[data]
    opens[start] = True
    run = np.flatnonzero(opens)
    first = np.searchsorted(run, start)
    word = np.repeat(np.arange(n), np.diff(np.append(first, len(run))))
    place = np.minimum(np.arange(len(run)) - first[word], 31)
    length = np.minimum(np.append(run[1:], len(data)), end[word]) - run
    shape = np.add.reduceat(SHAPE[place, kind[run]], first)
    runs = np.add.reduceat(SHAPE_RUNS[place, kind[run], np.minimum(length, 7)], first)
    digits = np.concatenate([[0], np.cumsum(kind == 2)])
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[start]
    opening = np.append(True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]))
    at = np.flatnonzero(opening)
    within = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    opening |= within % LINE_WORDS == 0
    shape = (tx.mix(shape) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    before, after = np.append(0, shape[:-1]), np.append(shape[1:], 0)
    before[opening] = 0
    after[np.flatnonzero(opening)[1:] - 1] = 0
    found = [
        shape,
        (tx.mix(runs) % np.uint64(BUCKETS)).astype(np.int64),
        before,
        after,
        np.minimum(digits[end] - digits[start], 15),
        np.minimum(end - start, 15),
        kind[start],
        kind[end - 1],
    ]
    return start, end, doc, np.flatnonzero(opening), np.stack(found) + OFFSETS[:, None]


def emissions(weight: np.ndarray, found: np.ndarray) -> np.ndarray:
    out = weight[found[0]]
    for f in found[1:]:
        out += weight[f]
    return out


def viterbi(emit: np.ndarray, step: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Best labels of all sequences; they advance together, longest first."""
    size = np.diff(np.append(opening, len(emit)))
    order = np.argsort(-size, kind="stable")
    first, size = opening[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    back = np.zeros(emit.shape, np.int8)
    ends = np.zeros((len(first), emit.shape[1]), emit.dtype)
    best = emit[first]
    for t, n in enumerate(active[1:], 1):
        ends[n : len(best)] = best[n:]
        reach = best[:n, :, None] + step
        back[first[:n] + t] = reach.argmax(1)
        best = reach.max(1) + emit[first[:n] + t]
    ends[: len(best)] = best
    label = np.zeros(len(emit), np.int8)
    state = ends.argmax(1)
    label[first + size - 1] = state
    for t in range(len(active) - 1, 0, -1):
        n = active[t]
        state[:n] = back[first[:n] + t, state[:n]]
        label[first[:n] + t - 1] = state[:n]
    return label


def train(bodies: list[bytes], spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of label steps by gradient ascent; ``spans`` are byte ranges of personal data per line."""
    weight, step = np.zeros((sum(SIZES), 3)), np.zeros((3, 3))
    data, limits = tx.raw(pa.array(bodies, pa.large_binary()))
    start, end, doc, opening, found = features(data, limits)
    if not len(start):
        return weight, step
    gold = np.zeros(len(start), np.int64)
    for i, ranges in enumerate(spans):
        for a, b in ranges:
            inside = np.flatnonzero((doc == i) & (end > limits[i] + a) & (start < limits[i] + b))
            gold[inside], gold[inside[:1]] = INSIDE, BEGIN
    size = np.diff(np.append(opening, len(start)))
    place = np.arange(size.max())[None] + opening[:, None]
    real = np.arange(size.max())[None] < size[:, None]
    place = np.where(real, place, 0)
    both = real[:, 1:]
    wanted = np.zeros((len(start), 3))
    wanted[np.arange(len(start)), gold] = 1
    pair = np.zeros((3, 3))
    np.add.at(pair, (gold[place[:, :-1]][both], gold[place[:, 1:]][both]), 1)
    moment = [np.zeros_like(weight), np.zeros_like(step)]
    power = [np.zeros_like(weight), np.zeros_like(step)]
    n = len(opening)
    for epoch in range(1, EPOCHS + 1):
        emit = np.where(real[..., None], emissions(weight, found)[place], 0.0)
        ahead, behind = np.zeros(emit.shape), np.zeros(emit.shape)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, emit.shape[1]):
            reach = np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], reach, ahead[:, t - 1])
        for t in range(emit.shape[1] - 2, -1, -1):
            reach = np.logaddexp.reduce(step + (emit[:, t + 1] + behind[:, t + 1])[:, None], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], reach, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        likely = np.exp(ahead + behind - total[:, None, None])[real]
        joint = np.exp(
            ahead[:, :-1, :, None] + step + (emit + behind)[:, 1:, None] - total[:, None, None, None]
        )[both].sum(0)
        miss = wanted[place[real]] - likely
        slope = np.zeros_like(weight)
        for f in found:
            for k in range(3):
                slope[:, k] += np.bincount(f[place[real]], miss[:, k], len(slope))
        for k, (value, g) in enumerate(((weight, slope / n - DECAY * weight), (step, (pair - joint) / n - DECAY * step))):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            power[k] = 0.99 * power[k] + 0.01 * g * g
            value += RATE * (moment[k] / (1 - 0.9**epoch)) / (np.sqrt(power[k] / (1 - 0.99**epoch)) + 1e-8)
    return weight, step


def labelled_lines(docs: DataFrame, text: str = "text") -> list[str]:
    """The small table: lines of bounded number and length with the smallest hashes, most of them with a digit or @."""
    every = docs.select(F.explode(F.split(F.col(text), "\n", -1)).alias("line"))
    every = every.filter((F.octet_length("line") <= LABEL_BYTES) & (F.octet_length("line") > 0))
    sign = F.col("line").rlike("[0-9@]")
    picked = ((sign, LABEL_LINES), (~sign, LABEL_LINES // 2))
    return [x for c, n in picked for x in distinct_sample(every.filter(c), F.col("line"), n)]


def fit(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    lines = labelled_lines(docs, text)
    spans = [[(len(t[:a].encode()), len(t[:b].encode())) for _, a, b in base_spans(t)] for t in lines]
    weight, step = train([t.encode() for t in lines], spans)
    return weight.astype(np.float32), step.astype(np.float32)


STRIP_END = frozenset(b".,;:!?)\"'")
STRIP_START = frozenset(b"(\"'")


def find_batch(bodies: pa.Array, model) -> list[tuple[list, list]]:
    """(base spans, spans that the field adds) of each text, in code points."""
    data, limits = tx.raw(bodies)
    start, end, doc, opening, found = features(data, limits)
    label = viterbi(emissions(model[0], found), model[1], opening) if len(start) else np.zeros(0, np.int8)
    signed = np.concatenate([[0], np.cumsum((CLASS[data] == 2) | (data == 64))])
    some = np.flatnonzero(signed[limits[1:]] > signed[limits[:-1]])
    marked = np.flatnonzero(label)
    opens = np.zeros(len(start), bool)
    opens[opening] = True
    out: dict[int, tuple[list, list]] = {}
    for i in np.union1d(some, doc[marked]).tolist():
        out[i] = (base_spans(data[limits[i] : limits[i + 1]].tobytes().decode()), [])
    ranges = []
    for w in marked.tolist():
        fresh = label[w] == BEGIN or not ranges or ranges[-1][1] != w - 1 or opens[w]
        if fresh:
            ranges.append([w, w])
        else:
            ranges[-1][1] = w
    for a, b in ranges:
        i, first, last = int(doc[a]), int(start[a]), int(end[b])
        while last > first and data[last - 1] in STRIP_END:
            last -= 1
        while first < last and data[first] in STRIP_START:
            first += 1
        if first == last:
            continue
        point = lambda at: int(((data[limits[i] : at] & 0xC0) != 0x80).sum())
        x, y = point(first), point(last)
        base, added = out[i]
        if all(y <= s or e <= x for _, s, e in base):
            added.append((ADDED, x, y))
    return [out.get(i, ([], [])) for i in range(len(limits) - 1)]


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """``keep`` (all columns by default), n_email, n_ip, n_card, n_phone (base findings), base_sha256, spans; ``redacted`` if wanted.

    ``spans`` lists base spans by kind and start, then those the field adds; ``redacted`` is the text with every span
    replaced by its kind in brackets. A null text counts as empty and stays null in ``redacted``. Equal texts have equal
    findings.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text))
    keep = docs.columns if keep is None else keep
    fields = [docs.schema[c] for c in keep] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", *(["redacted"] if redacted else []))]
    schema = T.StructType(fields)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            bodies, rows = tx.plain(column), []
            for first, last in tx.pieces(bodies):
                for body, (base, added) in zip(bodies[first:last], find_batch(bodies[first:last], shared.value)):
                    digest = hashlib.sha256(written(base).encode()).hexdigest()
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    row = (*counts, digest, written(base + added))
                    rows.append(row + ((redact(body.as_py().decode(), base + added),) if redacted else ()))
            if rows:
                cols = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]]
                if redacted and column.null_count:
                    arrays[-1] = pa.array([r if ok else None for r, ok in zip(cols[6], column.is_valid().to_pylist())])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("body of the text")).mapInArrow(run, schema)


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; all columns keep their names and order."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = {n: f"c{i}" for i, n in enumerate(names)}
    found = find(plain, own[text], redacted=True)
    return found.select(*[F.col("redacted" if n == text else own[n]).alias(n) for n in names])


def redact(text: str, spans) -> str:
    """Replace the spans; of overlapping ones the union is replaced under the name of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text
