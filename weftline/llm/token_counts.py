"""Token counts by whole-token shortcut (operator 10).

Before any text is read, every vocabulary string is given to the tokenizer alone; those that come back as one token are
proved whole, and a marked word of a text that equals one of them counts 1 without merging. Other words are merged once
for each worker and kept in a bounded cache. The vocabulary is a constant of the file, so the memory of a task is bounded
by it, the cache and one slice of text.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Repeated rows are counted row by row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import arrow_map
from weftline.llm.pieces import MARK, IdCache, hash_spans, marked_words, piece_model, tokenizer_path
from weftline.llm.spans import slices

_counters: dict[str, IdCache] = {}


def piece_counter(path: str) -> IdCache:
    """The cache of a SentencePiece file, with the proved whole tokens in it; one to a worker process."""
    if path in _counters:
        return _counters[path]
    import sentencepiece

    score, ids, _, _, _ = piece_model(path)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    unmarked = len(lib.encode("\n"))  # a word without a mark is shown to the library behind a line feed

    def counts(words: list[bytes]) -> np.ndarray:
        texts = [w[1:].decode() if w[:1] == b" " and len(w) > 1 else "\n" + w.decode() if w[:1] != b" " else "" for w in words]
        n = np.fromiter(map(len, lib.encode(texts, num_threads=1)), np.int64, len(texts))
        front = np.fromiter((w[:1] != b" " for w in words), bool, len(words))
        n[front] -= unmarked
        n[np.fromiter((w == b" " for w in words), bool, len(words))] = 1
        return n

    cache = IdCache(lambda words: (np.empty(0, np.int32), counts(words)), keep_ids=False)
    mark = MARK.decode()
    strings = [p.replace(mark, " ").encode() for p in ids]
    whole = [s for s, n in zip(strings, counts(strings).tolist(), strict=True) if n == 1]
    text = np.frombuffer(b"".join(whole), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(s) for s in whole])))
    cache.preset(hash_spans(text, at, at[:-1], at[1:]), np.ones(len(whole), np.int32))
    _counters[path] = cache
    return cache


def count_pieces(path: str, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Tokens of each document of a slice."""
    n = len(offs) - 1
    if not len(raw):
        return np.zeros(n, np.int64)
    cache = piece_counter(path)
    text, start, end, first = marked_words(raw, offs)
    _, count = cache.look_up(hash_spans(text, offs, start, end), text, start, end)
    total = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=total[1:])
    out = total[first[1:]] - total[first[:-1]]
    if MARK in (whole := raw.tobytes()):  # the mark itself in a text is a space to the library
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        for d in range(n):
            own = whole[offs[d] : offs[d + 1]]
            if MARK in own:
                out[d] = len(lib.encode(own.decode()))
    return out


def token_counts(docs: DataFrame, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", path: str | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit). path: the model file, else the public one of that name."""

    def run(batch):
        file = path or tokenizer_path(model)
        for lo, hi, raw, offs in slices(batch.column(1)):
            n = count_pieces(file, raw, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
