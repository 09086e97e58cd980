"""Byte-level BPE over whole columns: the pre-tokens of a batch are found and hashed with numpy, and each distinct one is encoded once."""

from __future__ import annotations

from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from arachne.llm import kernels as K

U64 = K.U64
#: Code points handled at once.
CHUNK = 1 << 19
#: Distinct pre-tokens that a worker remembers before it starts again.
REMEMBERED = 500_000
#: Classes of code points in the vocabulary's pattern.
OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """The class and a random 64-bit code of each code point."""
    import regex

    kind = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, e = ord(m[0][0]), ord(m[0][-1])
            kind[a : e + 1] = value
    return kind, K.mix(np.arange(1, 0x110001, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def starts_of(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a pre-token begins. c: code points of texts one after the other; first: True where a text begins.

    The pattern: contractions, or an optional space and a run of letters, of numbers or of others, or white space of
    which the last character before a word is left over.
    """
    kind = code_points()[0][c]
    n = len(c)
    space = kind == SPACE
    prev_space = np.zeros(n, bool)
    prev_space[1:] = space[:-1]
    prev_space[first] = False
    next_word = np.zeros(n, bool)
    next_word[:-1] = ~space[1:] & ~first[1:]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first
    after_blank = np.zeros(n, bool)
    after_blank[1:] = c[:-1] == 0x20
    after_blank[first] = False
    start = np.where(space, ~prev_space | next_word, change & ~after_blank)
    quotes = np.flatnonzero((c == 0x27) & start)
    if len(quotes):
        ends = np.append(np.flatnonzero(first)[1:], n)
        stop = ends[np.searchsorted(ends, quotes, "right")]
        for q, e in zip(quotes.tolist(), stop.tolist(), strict=True):
            two = "".join(map(chr, c[q + 1 : min(q + 3, e)]))
            size = 1 if two[:1] in ("s", "t", "m", "d") else 2 if two in ("re", "ve", "ll") else 0
            if size:
                start[q + 1 : q + 1 + size] = False
                if q + 1 + size < e:
                    nxt = q + 1 + size
                    start[nxt] = True
    return start


def byte_characters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself if it is printable and no space, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(n))
        n += b not in plain
    return out


class Encoder:
    """ids of texts, equal to those of the tokenizers library for a byte-level vocabulary in its JSON format, without post-processing.

    special: the string of a special token in a text is that token, as by the library's default; else it is ordinary text.
    """

    def __init__(self, path: str, special: bool):
        import json
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = file["added_tokens"] if special else []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["special"] for t in added):
            raise ValueError(f"{path}: only plain special tokens are known here")
        # The file writes bytes as printable characters. Ids must be ranks: a merge of a lower id comes first.
        vocabulary, byte = file["model"]["vocab"], {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if all(c in byte for c in t) and t not in {x["content"] for x in file["added_tokens"]}}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        # Each text that it gets is one pre-token.
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.special = {t["content"]: t["id"] for t in added}
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile(b"|".join(re.escape(x.encode()) for x in longest)) if longest else None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, U64)  # hashes of known pre-tokens, sorted
        self.number = np.zeros(0, np.int32)  # the number of each
        self.pool = np.zeros(1 << 16, np.uint32)  # ids, one pre-token after the other
        self.begin = np.zeros(1 << 16, np.int32)  # by number
        self.size = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> np.ndarray:
        """Encodes new pre-tokens; each gets the next number."""
        one = self.bpe.encode_ordinary
        many = [[self.special[x]] if x in self.special else one(x) for x in texts]
        k, n = len(self.keys), len(texts)
        while k + n > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        sizes = np.fromiter(map(len, many), np.int64, n)
        total = int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(many), np.uint32, total)
        self.size[k : k + n] = sizes
        self.begin[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        numbers = np.arange(k, k + n, dtype=np.int32)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.number = np.insert(self.keys, at, keys[order]), np.insert(self.number, at, numbers[order])
        return numbers

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each text); a null counts as empty."""
        data, offsets = K.utf8(column)
        counts = np.zeros(len(offsets) - 1, np.int64)
        out = []
        lo = 0
        while lo < len(counts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
            part, edges = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            cuts, marked = self._cuts(part, edges)
            if marked is None:
                out.append(self._chunk(part, edges, counts[lo:hi]))
            else:  # what stands between special tokens is encoded as a text of its own
                each = np.zeros(len(cuts) - 1, np.int64)
                out.append(self._chunk(part, cuts, each, marked))
                own = np.searchsorted(edges, cuts[:-1], "right") - 1
                counts[lo:hi] += np.bincount(own[each > 0], weights=each[each > 0], minlength=hi - lo).astype(np.int64)
            lo = hi
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(offsets, marked): the texts cut around special tokens, and which of the cuts are such tokens; (offsets, None) without any."""
        if self.marks is None:
            return offsets, None
        inside = np.array([m.span() for m in self.marks.finditer(data.tobytes())], np.int64).reshape(-1, 2)
        inside = inside[np.searchsorted(offsets, inside[:, 0], "right") == np.searchsorted(offsets, inside[:, 1], "left")]
        if not len(inside):
            return offsets, None
        cuts = np.unique(np.concatenate([offsets, inside.ravel()]))
        return cuts, np.isin(cuts[:-1], inside[:, 0])

    def _chunk(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, marked: np.ndarray | None = None) -> np.ndarray:
        """The ids of the texts that offsets cut from data; adds their numbers to counts. marked: texts that are one special token."""
        if not len(data):
            return np.zeros(0, np.uint32)
        c = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(c) == len(data):
            edges = offsets
        else:
            edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        first = np.zeros(len(c) + 1, bool)
        first[edges] = True
        first = first[:-1]
        first[0] = True
        begins = starts_of(c, first)
        if marked is not None:
            for a, e in zip(edges[:-1][marked].tolist(), edges[1:][marked].tolist(), strict=True):
                begins[a + 1 : e] = False
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(c))
        keys = K.span_hashes(code_points()[1][c], start, end)
        import pandas as pd

        which, distinct = pd.factorize(keys)
        if len(self.keys) > REMEMBERED:
            self._forget()
        number = np.zeros(len(distinct), np.int64)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        number[known] = self.number[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            at_first = np.zeros(len(distinct), np.int64)
            at_first[which[::-1]] = np.arange(len(which))[::-1]
            w = at_first[new]
            number[new] = self._learn(distinct[new], [c[i:j].tobytes().decode("utf-32-le") for i, j in zip(start[w].tolist(), end[w].tolist(), strict=True)])
        token = number[which]
        size = self.size[token]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1]) + np.repeat(self.begin[token] - (ends - size), size)
        own = np.searchsorted(edges, start, "right") - 1
        counts += np.bincount(own, weights=size, minlength=len(counts)).astype(np.int64)
        return self.pool[flat]


@cache
def encoder(path: str, special: bool = False) -> Encoder:
    return Encoder(path, special)
