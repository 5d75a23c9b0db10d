"""Whole-batch text primitives in numpy: words, lines, hashes and windows of many documents at once.

An Arrow string column is one byte buffer plus offsets. All functions here work on that buffer for all
documents of a slice together, so the Python cost is per slice, not per word. Words are runs of bytes other
than 0x20 and 0x09-0x0D, which are single bytes in UTF-8; a word never crosses a document's border.

Hashes are 64 bits: a polynomial in an odd base modulo 2**64 over a fixed random byte table, then mixed.
Two different words (or windows) of one comparison collide with a chance of about 2**-63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
SLICE_BYTES = 1 << 20

WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: a bijection of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) for i <= n; kept for ordinary slices, made anew for longer ones."""
    size = SLICE_BYTES + 1 if n < SLICE_BYTES + 1 else n + 1
    if size in _powers:
        return _powers[size]
    with np.errstate(over="ignore"):
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE, U64), np.full(size, inverse, U64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size == SLICE_BYTES + 1:
        _powers[size] = up, down
    return up, down


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len(column) + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) in pieces of about `limit` bytes; a longer text is a piece of its own."""
    raw, offs = buffer_of(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a slice: `start`, `end` (byte offsets), `at` (first word of each document, and the total)."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.raw = _LOWER[raw] if lower else raw
        self.offs = offs
        n = len(raw)
        inside = WORD[raw]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.inside = inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.start, offs)
        self._prefix: np.ndarray | None = None

    @property
    def count(self) -> np.ndarray:
        """Words of each document."""
        return np.diff(self.at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.count)

    def prefix(self) -> np.ndarray:
        """Prefix sums of byte value times base**i, from which any span's hash follows."""
        if self._prefix is None:
            n = len(self.raw)
            up, _ = powers(n)
            out = np.zeros(n + 1, U64)
            with np.errstate(over="ignore"):
                np.cumsum(BYTE_TABLE[self.raw] * up[:n], out=out[1:])
            self._prefix = out
        return self._prefix

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = self.prefix()
        _, down = powers(len(self.raw))
        with np.errstate(over="ignore"):
            return mix((p[end] - p[start]) * down[start] + (end - start).astype(U64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=lead[1:])
        return lead[self.end] - lead[self.start]


def windows(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of n words that lies within a document, in text order."""
    if len(h) < n:
        return np.empty(0, np.int64), np.empty(0, U64)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(h) - n + 1, U64)
        for k in range(n):
            acc = (acc + h[k : k + len(acc)]) * U64(0xD6E8FEB86659FD93 + 2 * n)
        acc = mix(acc)
    ok = np.ones(len(acc), bool)
    inner = at[1:-1]
    for k in range(1, n):  # a window that starts k words before a document's first word crosses its border
        p = inner - k
        p = p[(p >= 0) & (p < len(acc))]
        ok[p] = False
    first = np.flatnonzero(ok)
    return first, acc[first]


def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of a word-wise array over each document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def grouped_flags(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs more than once, is a second or later occurrence) for each element, in the elements' order."""
    if not len(keys):
        return np.empty(0, bool), np.empty(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later_s = np.concatenate(([False], same))
    many_s = later_s | np.concatenate((same, [False]))
    many, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    many[order], later[order] = many_s, later_s
    return many, later


def in_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A key that is equal for equal hashes of one document and differs between documents."""
    with np.errstate(over="ignore"):
        return mix(h + (doc.astype(U64) + U64(1)) * U64(0xA24BAED4963EE407))


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct n-word shingles. With 1 to n - 1 words, the whole sequence is one shingle."""
    h, docs = w.hashes(), np.arange(len(w.offs) - 1)
    first, hs = windows(h, w.at, n)
    doc = np.searchsorted(w.at, first, "right") - 1
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        extra = np.empty(len(short), U64)
        with np.errstate(over="ignore"):
            for i, d in enumerate(short):
                acc = U64(0)
                for x in h[w.at[d] : w.at[d + 1]]:
                    acc = (acc + x) * U64(0xD6E8FEB86659FD93 + 2 * int(w.count[d]))
                extra[i] = acc
            extra = mix(extra)
        doc, hs = np.concatenate((doc, docs[short])), np.concatenate((hs, extra))
    _, later = grouped_flags(in_doc(hs, doc))
    doc, hs = doc[~later], hs[~later]
    if len(short):
        order = np.argsort(doc, kind="stable")
        doc, hs = doc[order], hs[order]
    return doc, hs
