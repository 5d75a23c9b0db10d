"""Quality rules by repetition coverage (operator 9).

Rolling hashes of word windows of several lengths are compared within each text; what counts is the share of
word characters inside windows that occur twice or more, and inside lines that repeat an earlier line.
Everything is computed from the whole text, one document at a time, in numpy over Arrow batches: no shuffle,
memory bounded by one batch (or one text, if that is longer).

Defined cases: a null, empty or blank text has no words, all counts 0, base_failed true and kept false. Repeated
rows are judged row by row. Extra columns of the input are ignored by `quality_report` and kept by `quality_filter`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import arrow_map
from weftline.llm.spans import Words, grouped_flags, in_doc, per_doc, slices, windows

#: Percent of word characters inside repeated windows of n words above which a text is rejected.
WINDOW_LIMITS = {3: 50, 5: 40, 10: 40}
#: Percent of word characters inside lines that repeat an earlier line, and symbols to 100 words, above which a text is rejected.
LINE_LIMIT = 30
SYMBOL_LIMIT = 10
BASE_WINDOW, BASE_PERCENT, BASE_WORDS = 8, 30, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

REPORT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in WINDOW_LIMITS)
)


def _covered(first: np.ndarray, hit: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which words lie in a window that is hit."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, first[hit], 1)
    np.add.at(step, first[hit] + n, -1)
    return np.cumsum(step)[:-1] > 0


def _lines(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every non-empty line of each document; lines end at line feeds and at the document's end."""
    cut = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate((offs[:-1], cut + 1)))
    start = start[start < len(raw)]
    doc_end = offs[np.searchsorted(offs, start, "right")]
    feed = np.append(cut, len(raw))
    end = np.minimum(feed[np.searchsorted(feed, start, "left")], doc_end)
    some = end > start
    return start[some], end[some]


def measure(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of REPORT for the documents of one slice."""
    w = Words(raw, offs)
    n_docs = len(offs) - 1
    chars, h, doc = w.chars(), w.hashes(), w.doc_of_word()
    sym = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_SYMBOL[raw], out=sym[1:])
    out = {"n_words": w.count.astype(np.int64), "word_chars": per_doc(chars, w.at), "n_symbols": sym[offs[1:]] - sym[offs[:-1]]}

    start, end = _lines(raw, offs)
    first_word = np.searchsorted(w.start, start)
    last_word = np.searchsorted(w.start, end)
    some = last_word > first_word
    start, end, first_word, last_word = start[some], end[some], first_word[some], last_word[some]
    line_doc = np.searchsorted(offs, start, "right") - 1
    _, later = grouped_flags(in_doc(w.span_hash(start, end), line_doc))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n_docs).astype(np.int64)
    total = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    in_line = (total[last_word] - total[first_word])[later]
    out["dup_line_chars"] = np.bincount(line_doc[later], weights=in_line, minlength=n_docs).astype(np.int64)

    for n in sorted({BASE_WINDOW, *WINDOW_LIMITS}):
        first, hs = windows(h, w.at, n)
        many, _ = grouped_flags(in_doc(hs, doc[first]))
        inside = _covered(first, many, n, len(h))
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_doc(inside.astype(np.int64), w.at)
        if n in WINDOW_LIMITS:
            out[f"dup_chars_{n}"] = per_doc(np.where(inside, chars, 0), w.at)

    out["base_failed"] = (out["n_words"] < BASE_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"])
    bad = (100 * out["dup_line_chars"] > LINE_LIMIT * out["word_chars"]) | (100 * out["n_symbols"] > SYMBOL_LIMIT * out["n_words"])
    for n, limit in WINDOW_LIMITS.items():
        bad |= 100 * out[f"dup_chars_{n}"] > limit * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ~bad
    return out


_FIELDS = [x.split()[0] for x in REPORT.split(", ")]


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and the columns of REPORT."""

    def run(batch):
        for lo, hi, raw, offs in slices(batch.column(1)):
            m = measure(raw, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(m[f]) for f in _FIELDS)], names=[id_col, *_FIELDS])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, {REPORT}")


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows, all columns, that the rules keep."""
    at = docs.columns.index(text_col)

    def run(batch):
        keep = [measure(raw, offs)["kept"] for _, _, raw, offs in slices(batch.column(at))]
        if keep:
            yield batch.filter(pa.array(np.concatenate(keep)))

    return arrow_map(docs, run, docs.schema)

