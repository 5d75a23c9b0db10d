"""SentencePiece encoding and decoding by shared-prefix Viterbi (operator 7).

The distinct marked words of a slice that the worker hasn't met are sorted, which makes them a trie in depth-first order:
each word shares with its predecessor the forward states of their common prefix, and only the rest is extended. A forward
state at a position is the best path's score, its last piece and where that piece starts, with the starts from which a longer
piece is still possible: what is tried at the next position follows from these, not from the longest piece.

For a unigram model an arc adds its piece's score. A BPE model has ranks, not additive scores, and the highest sum of them
isn't what the library returns. There an arc from piece a to piece b is open (score 0) if a and b, merged by rank as one
string, come back as a and b, and closed else; the one open path through a prefix is its BPE encoding, because merges of a
prefix don't depend on what follows, and a merge across a border shows in the two pieces beside it. So the ids equal the library's.

The memory of a task is bounded by the vocabulary, two bounded caches and a slice of text; there is no shuffle.
Defined cases: a null or empty text has no pieces and decodes to the empty text. Repeated rows are encoded row by row; extra
columns are ignored by `encode`. In a list to decode, a null id gives nothing and an id outside the vocabulary the unknown piece's
text. Characters outside the vocabulary become byte pieces. U+2581 in a text is a space, as in the
library, and decodes to one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weftline.llm.common import arrow_map, give_back, kept
from weftline.llm.pieces import MARK, IdCache, hash_spans, marked_words, piece_model, tokenizer_path
from weftline.llm.spans import slices

PAIRS, WORDS = 250_000, 600_000
#: Stands for a null id.
NOTHING = np.iinfo(np.int64).min


class PieceCoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, unigram: bool | None = None):
        self.score, self.ids, self.byte, kind, self.unknown = piece_model(path)
        self.unigram = kind == 1 if unigram is None else unigram
        self.fronts = {p[:k] for p in self.score for k in range(1, len(p))}  # each string that a longer piece begins with
        self.floor = min(self.score.values()) - 10.0
        self.pairs: dict[int | tuple[str, str], bool] = {}
        self.strings = {i: p for p, i in self.ids.items()}
        self.bytes_of = {i: b for b, i in self.byte.items()}
        self.cache = IdCache(self._encode_bytes, limit=WORDS)

    # encoding

    def merge(self, text: str) -> list[str]:
        """BPE of a short string: the neighbours whose union has the best score are joined first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def open_arc(self, a: str, b: str) -> bool:
        x, y = self.ids.get(a), self.ids.get(b)
        key = (a, b) if x is None or y is None else x << 24 | y  # a number takes a third of the memory
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.merge(a + b) == [a, b]
        return got

    def extend(self, word: str, j: int, states: list) -> tuple[float, str, int, list[int]]:
        """The forward state at position j, from those before it."""
        best, live = None, []
        for i in (*states[j - 1][3], j - 1):
            piece = word[i:j]
            if piece in self.fronts:
                live.append(i)
            s = self.score.get(piece)
            if s is None:
                if i < j - 1:
                    continue
                s = self.floor
            if self.unigram:
                total = states[i][0] + s
                if best is None or total > best[0]:
                    best = (total, piece, i)
            elif best is None and (self.open_arc(states[i][1], piece) if i else self.merge(piece) == [piece]):
                best = (0.0, piece, i)
        if best is None:
            raise AssertionError(f"no path to {word[:j]!r}")
        return *best, live

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words are visited in sorted order, so that common prefixes are scored once."""
        out: list[list[int]] = [[] for _ in words]
        states: list = [(0.0, "", 0, [])]
        before = ""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            same, top = 0, min(len(word), len(before))
            while same < top and word[same] == before[same]:
                same += 1
            del states[same + 1 :]
            for j in range(same + 1, len(word) + 1):
                states.append(self.extend(word, j, states))
            path, j = [], len(word)
            while j:
                _, piece, i, _ = states[j]
                path.append(piece)
                j = i
            for piece in reversed(path):
                n = self.ids.get(piece)
                out[k].extend([n] if n is not None else [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown])
            before = word
        return out

    def _encode_bytes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        mark = MARK.decode()
        got = self.encode_words([w.decode().replace(" ", mark) for w in words])
        return np.fromiter((i for x in got for i in x), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    def encode_slice(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a slice, offsets)."""
        if MARK in (whole := raw.tobytes()):
            texts = [whole[offs[d] : offs[d + 1]].replace(MARK, b" ") for d in range(len(offs) - 1)]
            raw, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        text, start, end, first = marked_words(raw, offs)
        where, count = self.cache.look_up(hash_spans(text, offs, start, end), text, start, end)
        total = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        return self.cache.ids(where, count), total[first]

    # decoding

    def decode_slice(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """The texts of id lists: pieces are joined, marks become spaces, the space put before each text goes, runs of byte pieces become UTF-8."""
        size, blob, at = self._tables()
        top = len(size) - 1
        ids = np.where(ids == NOTHING, top, np.where((ids < 0) | (ids >= top), self.unknown, ids))
        n = size[ids]
        begin = np.cumsum(n) - n
        flat = blob[np.arange(int(n.sum())) + np.repeat(at[ids] - begin, n)]
        ends = np.concatenate(([0], np.cumsum(n)))[offs]
        data = flat.tobytes()
        return [data[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _tables(self):
        if not hasattr(self, "_table"):
            mark, top = MARK.decode(), max(max(self.strings), max(self.bytes_of, default=0)) + 1
            parts = [self.strings[i].replace(mark, " ").encode() if i in self.strings else bytes([self.bytes_of[i]]) if i in self.bytes_of else b" \xe2\x81\x87 " if i == self.unknown else b"" for i in range(top)] + [b""]
            size = np.array([len(p) for p in parts])
            self._table = size, np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size
        return self._table


def coder(path: str) -> PieceCoder:
    """One to a worker process and file."""
    own = kept("pieces")
    if path not in own:
        own[path] = PieceCoder(path)
        give_back()  # what reading the file took
    return own[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", path: str | None = None) -> DataFrame:
    """One row per input row: id, piece_ids array<int>."""

    def run(batch):
        c = coder(path or tokenizer_path(model))
        for lo, hi, raw, offs in slices(batch.column(1)):
            ids, at = c.encode_slice(raw, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=[id_col, "piece_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, piece_ids array<int>", "pieces")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "piece_ids", model: str = "piece_bpe_32k.model", path: str | None = None) -> DataFrame:
    """One row per input row: id, text. A null list decodes to the empty text."""

    def run(batch):
        c = coder(path or tokenizer_path(model))
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            lists = part.column(1)
            size = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
            ids = lists.flatten().cast(pa.int64()).fill_null(NOTHING).to_numpy()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.decode_slice(ids, np.concatenate(([0], np.cumsum(size)))), pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return arrow_map(encoded.select(id_col, ids_col), run, f"`{id_col}` {kind}, text string", "pieces")


def encode_and_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", path: str | None = None) -> DataFrame:
    """One row per input row: id, n_pieces, piece_ids, round_trip (the decoded ids are the text, U+2581 read as a space)."""

    def run(batch):
        c = coder(path or tokenizer_path(model))
        for lo, hi, raw, offs in slices(batch.column(1)):
            ids, at = c.encode_slice(raw, offs)
            back, whole = c.decode_slice(ids.astype(np.int64), at), raw.tobytes()
            same = [t.encode() == whole[a:b].replace(MARK, b" ") for t, a, b in zip(back, offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(same)], names=[id_col, "n_pieces", "piece_ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_pieces long, piece_ids array<int>, round_trip boolean", "pieces")

