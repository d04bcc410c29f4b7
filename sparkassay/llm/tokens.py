"""Token ids of whole texts by public tokenizers, with a bounded cache of the words of a task."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np

CACHE_WORDS = 400_000
END_ID = 1
SPECIAL = b"<|endoftext|>"


def _bytes(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _cut(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    body = ids.astype("<u4").tobytes()
    return [body[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist())]


class Words:
    """Bytes of a word -> bytes of its ids. Words beyond the limit are forgotten after the batch that met them."""

    def __init__(self, most: int = CACHE_WORDS):
        self.known: dict[bytes, bytes | None] = {}
        self.most = most

    def missing(self, parts) -> list[bytes]:
        new: set[bytes] = set()
        for p in parts:
            new.update(p)
        return list(new.difference(self.known))

    def forget(self, new: list[bytes]) -> None:
        if len(self.known) > self.most:
            for w in new[max(0, len(new) - (len(self.known) - self.most)) :]:
                self.known.pop(w, None)


class DroppedSpace:
    """A tokenizer that drops white space and lower-cases: a text's ids are those of its words in order.

    A word of Latin letters, with ASCII punctuation behind it or not, is two pieces for the model, and those are
    remembered too; every other word goes through the tokenizer's own normaliser and splitter. New pieces are encoded
    ``TOGETHER`` at a time, as one text cut at line feeds, which no piece holds.
    """

    SIMPLE = re.compile(r"^(?:([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)|.+)$", re.MULTILINE)
    TOGETHER = 200

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = None
        whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), whole])
        self.words, self.pieces = Words(), Words()
        self.pieces.known[""] = b""

    def _learn(self, new: list[bytes]) -> None:
        known, simple = self.words.known, []
        found = self.SIMPLE.findall(b"\n".join(new).decode()) if new else []
        for w, (letters, signs) in zip(new, found, strict=True):
            if letters:
                simple.append((w, letters.lower(), signs))
            else:
                known[w] = _bytes(self.model.encode(w.decode(), add_special_tokens=False).ids)
        pieces = self.pieces.known
        fresh = list({x for _, a, b in simple for x in (a, b) if x not in pieces})
        for i in range(0, len(fresh), self.TOGETHER):
            some = fresh[i : i + self.TOGETHER]
            coded = self.bare.encode("\n".join(some), add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.asarray(coded.word_ids, np.int64), minlength=len(some)))
            pieces.update(zip(some, _cut(np.asarray(coded.ids), np.append(0, ends[:-1]), ends)))
        known.update((w, pieces[a] + pieces[b]) for w, a, b in simple)
        self.pieces.forget(fresh)

    def __call__(self, bodies: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        parts = [body.split() for body in bodies]
        new = self.words.missing(parts)
        self._learn(new)
        out = [b"".join(map(self.words.known.__getitem__, p)) for p in parts]
        self.words.forget(new)
        return out


class LeadingSpace:
    """A byte-level tokenizer whose pieces start with the space before a word.

    No piece spans from a character that is no white space to one that is, so a text may be cut before every space
    that follows such a character. The parts are encoded by the rank file of the same vocabulary, which gives the same
    ids faster; texts with the special token or with other runs of white space are encoded whole.
    """

    def __init__(self, path: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.opens = np.zeros(max(table.values()) + 2, bool)
        self.opens[[i for t, i in table.items() if t[:1] == b" "]] = True
        self.closes = np.zeros(len(self.opens), bool)
        self.closes[[i for t, i in table.items() if t[-1:] in b".!?\n"]] = True
        self.path, self.words = path, Words()

    @functools.cached_property
    def exact(self):
        """The tokenizer itself, which takes more memory than the ranks; loaded with the first text that needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def sentence_end(self) -> np.ndarray:
        """Whether a sentence may end behind each id."""
        return self.closes

    def whole(self, body: bytes) -> bytes:
        if SPECIAL in body:
            return _bytes(self.exact.encode(body.decode(), add_special_tokens=False).ids)
        return _bytes(self.fast.encode_ordinary(body.decode()))

    def _learn(self, new: list[bytes]) -> None:
        known = self.words.known
        for w in [w for w in new if not w or w.decode()[-1].isspace()]:
            known[w] = None
        new = [w for w in new if w not in known]
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            ids = np.asarray(self.fast.encode_ordinary((b" " + b" ".join(some)).decode()), np.uint32)
            at = np.flatnonzero(self.opens[ids])
            known.update(zip(some, _cut(ids, at, np.append(at[1:], len(ids)))))

    def __call__(self, bodies: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        parts = [body.split(b" ") for body in bodies]
        new = self.words.missing(p[1:-1] for p in parts)
        self._learn(new)
        out = [self._joined(b, p) for b, p in zip(bodies, parts)]
        self.words.forget(new)
        return out

    def _joined(self, body: bytes, parts: list[bytes]) -> bytes:
        first = parts[0]
        if len(parts) < 3 or SPECIAL in body or not first or first.decode()[-1].isspace():
            return self.whole(body)
        try:
            middle = b"".join(map(self.words.known.__getitem__, parts[1:-1]))
        except TypeError:  # a part that ends in white space
            return self.whole(body)
        return self.whole(first) + middle + self.whole(b" " + parts[-1])


@functools.cache
def dropped_space(path: str) -> DroppedSpace:
    """One per worker process: the next task finds the words of the last."""
    return DroppedSpace(path)


@functools.cache
def leading_space(path: str, ranks: str) -> LeadingSpace:
    return LeadingSpace(path, ranks)


def end_mark(end_id: int = END_ID) -> bytes:
    return _bytes([end_id])
