"""Pre-tokens of whole batches and a bounded cache of what they encode to, shared by the tokenizer operators.

A tokenizer's merges never cross certain borders. The texts of a slice are cut at these borders in numpy, pre-tokens are
told apart by 64-bit hashes, and only pre-tokens that the worker hasn't seen go to the encoder. The cache is bounded by
CACHE_WORDS and starts anew beyond it, so memory doesn't follow the data.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from weftline.llm.spans import U64, Words, mix

CACHE_WORDS = 700_000


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; the package is looked up on whichever machine runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


class IdCache:
    """Hash of a pre-token -> its ids, in sorted arrays. encode: list of bytes -> (ids of all, count of each)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], keep_ids: bool = True, limit: int = CACHE_WORDS):
        self.encode, self.keep_ids, self.limit = encode, keep_ids, limit
        self.base: tuple[np.ndarray, np.ndarray] | None = None  # hashes and counts that hold without asking the encoder
        self._clear()

    def _clear(self) -> None:
        self.keys, self.count = (np.empty(0, U64), np.empty(0, np.int32)) if self.base is None else self.base
        self.at = np.zeros(len(self.keys), np.int64)
        self.pool, self.used = np.empty(1 << 16, np.int32), 0

    def preset(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.base = keys[order], counts[order].astype(np.int32)
        self._clear()

    def look_up(self, h: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the cache, count) of every pre-token; unknown ones are encoded first."""
        if len(self.keys) > self.limit:
            self._clear()
        order = np.argsort(h)
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        distinct, inverse = s[new], np.empty(len(s), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if len(distinct):
            pos = np.searchsorted(self.keys, distinct)
            known = np.zeros(len(distinct), bool)
            inside = pos < len(self.keys)
            known[inside] = self.keys[pos[inside]] == distinct[inside]
            if not known.all():
                ask = order[new][~known]
                text = raw.tobytes()
                ids, counts = self.encode([text[a:b] for a, b in zip(start[ask].tolist(), end[ask].tolist(), strict=True)])
                self._add(distinct[~known], ids, counts, pos[~known])
                pos = np.searchsorted(self.keys, distinct)
        else:
            pos = np.empty(0, np.int64)
        where = pos[inverse]
        return where, self.count[where]

    def _add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, pos: np.ndarray) -> None:
        at = self.used + np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.empty(0, np.int64)
        if self.keep_ids:
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        self.keys, self.count, self.at = (np.insert(a, pos, b.astype(a.dtype)) for a, b in ((self.keys, keys), (self.count, counts), (self.at, at)))

    def ids(self, where: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids of the pre-tokens in order, as one array."""
        total = int(count.sum())
        begin = np.cumsum(count, dtype=np.int64) - count
        return self.pool[np.arange(total) + np.repeat(self.at[where] - begin, count)]


# --- SentencePiece: words marked by a leading space ---------------------------------------------------------------

MARK = "▁".encode()


def marked_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space before each non-empty text, start, end, first word of each document).

    Borders: before a space that follows something else, and on both sides of a line feed. A vocabulary in which no piece
    holds a mark after another character, or a line feed, has no merge across them.
    """
    n, some = len(offs) - 1, np.diff(offs) > 0
    length = np.diff(offs) + some
    at = np.concatenate(([0], np.cumsum(length)))
    text = np.full(at[-1], 0x20, np.uint8)
    if len(raw):
        text[np.arange(len(raw)) + np.repeat(np.cumsum(some), np.diff(offs))] = raw
    border = np.zeros(len(text) + 1, bool)
    border[at] = True
    space, feed = text == 0x20, text == 0x0A
    border[1:-1] |= (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    cut = np.flatnonzero(border)
    start, end = cut[:-1], cut[1:]
    return text, start, end, np.searchsorted(start, at[: n + 1])


def hash_spans(text: np.ndarray, offs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    w = Words.__new__(Words)
    w.raw, w.offs, w._prefix = text, offs, None
    return w.span_hash(start, end) if len(start) else np.empty(0, U64)


def piece_model(path: str):
    """(pieces with scores, their ids, byte piece ids, model type, unknown id) of a SentencePiece file, with what marked_words() relies on proved."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.name != "identity" or not m.normalizer_spec.add_dummy_prefix or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with identity normalization, a dummy prefix and kept white space are supported")
    score, ids, byte = {}, {}, {}
    for i, p in enumerate(m.pieces):
        if p.type in (1, 4, 5):
            score[p.piece], ids[p.piece] = p.score, i
        elif p.type == 6:
            byte[int(p.piece[3:5], 16)] = i
    mark = MARK.decode()
    if any("\n" in p or mark in p.lstrip(mark) for p in score) or any(p.type == 4 for p in m.pieces):
        raise ValueError("a piece crosses a word border")
    return score, ids, byte, m.trainer_spec.model_type, m.trainer_spec.unk_id


# --- Byte-level BPE: the splitting pattern as character classes ----------------------------------------------------

LETTER, NUMBER, SPACE, OTHER, UNSEEN = 1, 2, 3, 4, 0


class BytePattern:
    """Cuts texts as 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces(?!non-space)|spaces does.

    The class of a character is asked from the tokenizer itself when the character first occurs.
    """

    def __init__(self, tokenizer):
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.kind = np.zeros(0x110000, np.uint8)
        self._learn(range(128))

    def _learn(self, points) -> None:
        for c in points:
            x = chr(c)
            self.kind[c] = next((k for k, front in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.split(front + x)) == 1), SPACE)

    def spans(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets (start, end) of all pre-tokens."""
        n_bytes = len(raw)
        if not n_bytes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if n_bytes and raw.max() < 128:
            lead, point = None, raw
        else:
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            point = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = self.kind[point]
        if (kind == UNSEEN).any():
            self._learn(np.unique(point[kind == UNSEEN]).tolist())
            kind = self.kind[point]
        n = len(point)
        doc = offs if lead is None else np.searchsorted(lead, offs)
        edge = np.zeros(n + 1, bool)
        edge[doc] = True
        border = edge.copy()
        border[1:-1] |= kind[1:] != kind[:-1]
        blank = kind == SPACE
        # the last space of a run goes with what follows: into it if it is U+0020, else alone
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:-1])
        plain = point[last] == 0x20
        border[last] = True
        border[last[plain] + 1] = False
        # contractions, where an apostrophe begins a match and letters follow
        quote = np.flatnonzero(point == 0x27)
        if len(quote):
            quote = quote[border[quote] & border[quote + 1]]
            for q in quote.tolist():
                stop = q + 1
                while stop < n and stop < q + 3 and not edge[stop]:
                    stop += 1
                tail = "".join(map(chr, point[q + 1 : stop].tolist()))
                size = 1 if tail[:1] in ("s", "t", "m", "d") and tail[:1] else 2 if tail in ("re", "ve", "ll") else 0
                if size:
                    border[q + 1] = False
                    border[q + 1 + size] = True
        cut = np.flatnonzero(border)
        if lead is not None:
            cut = np.append(lead, n_bytes)[cut]
        return cut[:-1], cut[1:]


def quiet_tokenizers() -> None:
    """One thread to a task: parallelism comes from the partitions."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


__all__ = ["BytePattern", "IdCache", "hash_spans", "marked_words", "mix", "piece_model", "quiet_tokenizers", "tokenizer_path"]
