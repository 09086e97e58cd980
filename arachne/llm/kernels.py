"""numpy kernels over the buffers of Arrow string columns: words, their hashes and shingle sets, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; a longer text is cut at a separator, so the buffers stay bounded.
CHUNK = 1 << 18
#: Separators between words are the space and the control characters 9 to 13.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
STEP = [U64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(16)]
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, CHUNK), base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of codes: polynomial over the span's codes, mixed with the length."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * STEP[1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls as empty; no copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def pieces(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray = IS_SEP, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Cuts [offsets[0], offsets[-1]) into ranges of about chunk bytes that end between texts, or at a separator in a long text."""
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        to = min(at + chunk, stop)
        if to < stop:
            edge = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if edge > at:
                to = edge
            else:
                text_end = int(offsets[np.searchsorted(offsets, at, "right")])
                seps = np.flatnonzero(is_sep[data[at:to]])
                while not len(seps) and to < text_end:
                    lo, to = to, min(to + chunk, text_end)
                    seps = np.flatnonzero(is_sep[data[lo:to]]) + (lo - at)
                to = text_end if to >= text_end else at + int(seps[-1]) + 1
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, in order, and the words of each text: (hashes, counts)."""
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for at, to in pieces(data, offsets):
        b = LOWER[data[at:to]]
        gap = np.ones(to - at + 1, bool)
        gap[:-1] = IS_SEP[b]
        edge = np.zeros(to - at + 1, bool)
        lo, hi = np.searchsorted(offsets, [at, to])
        edge[offsets[lo:hi] - at] = True
        edge[0] = edge[-1] = True
        solid = ~gap[:-1]
        first = solid.copy()
        first[1:] &= gap[:-2] | edge[1:-1]
        last = solid & (gap[1:] | edge[1:])
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(start):
            found.append(span_hashes(BYTE_CODE[b], start, end))
            own = np.searchsorted(offsets, start + at, "right") - 1
            counts += np.bincount(own, minlength=len(counts))
    return (np.concatenate(found) if found else np.zeros(0, U64)), counts


#: Bytes of text whose shingles are made at once, unless one text is longer.
GROUP = 1 << 21


#: log2 of the places of a table of costs of words.
COST_BITS = 20


def shingle_sets(column: pa.Array, n: int = 5, cost: np.ndarray | None = None) -> list:
    """For each text the sorted hashes of its distinct n-word shingles; with fewer words, of the whole sequence as one; empty without words.

    cost: a table by word hash; the answer then has pairs (hashes, sums of the costs of each shingle's words).
    """
    data, offsets = utf8(column)
    out: list = []
    while len(out) < len(offsets) - 1:
        lo = len(out)
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + GROUP, "right")) - 1)
        out += _shingle_sets(data, offsets[lo : hi + 1], n, cost)
    return out


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, cost: np.ndarray | None) -> list:
    none = np.zeros(0, U64)
    out: list = [none if cost is None else (none, np.zeros(0, np.uint32))] * (len(offsets) - 1)
    h, counts = words(data, offsets)
    if not len(h):
        return out
    ends = np.cumsum(counts)
    if len(h) >= n:
        v = np.zeros(len(h) - n + 1, U64)
        for k in range(n):
            v += h[k : len(h) - n + 1 + k] * STEP[k + 1]
        v = mix(v)
        if cost is not None:
            each = np.concatenate([[0], np.cumsum(cost[(h >> U64(64 - COST_BITS)).astype(np.int64)], dtype=np.int64)])
            price = (each[n:] - each[:-n]).astype(np.uint32)
    for i in np.flatnonzero(counts):
        a, e = int(ends[i] - counts[i]), int(ends[i])
        if e - a >= n and cost is None:
            out[i] = np.unique(v[a : e - n + 1])
        elif e - a >= n:
            own, first = np.unique(v[a : e - n + 1], return_index=True)
            out[i] = own, price[a : e - n + 1][first]
        else:
            x = h[a:e] * np.array(STEP[1 : e - a + 1], U64)
            one = mix(np.sum(x, keepdims=True, dtype=U64) + STEP[15] * np.array([e - a], U64))
            out[i] = one if cost is None else (one, np.zeros(1, np.uint32))
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed integers: sums of two mixes of the members."""
    if not len(s):
        return 0, 0
    a, b = mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64), mix(s ^ U64(0x14057B7EF767814F)).sum(dtype=U64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
