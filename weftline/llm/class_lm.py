"""LM scoring by Brown class-based bigrams (operator 8).

P(word | before) = P(class of word | class of before) * P(word | its class). Counting covers every training text: word counts are
summed per Arrow batch, then by Spark, and stay a distributed table of any size. Every word that occurs twice or more has one of
CLASSES classes, found by exchange. The CLUSTERED most frequent are clustered on one machine, on a matrix of bounded size. All others
are placed in ROUNDS distributed rounds: each word's counts of neighbour classes meet in one task, and the word moves to the class
that raises the likelihood most, against the class bigrams of the round before. In a round's contexts the HEAD most frequent words,
which travel with the tasks (some MB, a constant), count by class (in the first round by rank band, unless clustered) and rarer ones
as one class. Word classes are a distributed table like the counts. Words that occur once and unknown words are the tail class,
whose words give RARE_DISCOUNT of each count to the one unknown word. Class transitions are counted with every word's own class;
they discount absolutely and fall back to class frequencies.

Scoring maps every text once to its classes, a byte for each word; its words outside the head are looked up in the distributed
table, one row for each such word of a text, by a shuffled join, and their classes are put into the text's. These words are rare,
so no key is hot, and frequent words never reach the shuffle.

Words are told apart by 64-bit hashes. Defined cases: null and empty texts are their end token alone; without training texts all
counts are 0 (base score 0). Rows with a null id train. Repeated rows are scored row by row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, give_back, materialize, most_frequent, release
from weftline.llm.spans import U64, Words, mix, per_doc, slices

HEAD, CLUSTERED, CLASSES, SWEEPS, ROUNDS, DISCOUNT, RARE_DISCOUNT = 1 << 18, 1000, 48, 6, 2, 0.5, 0.75


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """h, c: every word's count."""

    def run(batch):
        keys, counts = [], []
        for _, _, raw, offs in slices(batch.column(0)):
            k, c = np.unique(Words(raw, offs, lower=True).hashes(), return_counts=True)
            keys.append(k)
            counts.append(c)
        if keys:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(c)], names=["h", "c"])
        return None

    return arrow_map(texts.select(text_col), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass(eq=False)
class Head:
    """The most frequent words, sorted by hash: hash, count, and unit (own number, or that of a rank band). Units go on with the tail and the end."""

    keys: np.ndarray
    count: np.ndarray
    unit: np.ndarray
    n_units: int

    @property
    def tail(self) -> int:
        return self.n_units

    @property
    def end(self) -> int:
        return self.n_units + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1. Sorted hashes are found several times faster than others, sorting included."""
        if not len(self.keys):
            return np.full(len(h), -1)
        order = np.argsort(h)
        ask = h[order]
        at = np.minimum(np.searchsorted(self.keys, ask), len(self.keys) - 1)
        out = np.empty(len(h), np.int64)
        out[order] = np.where(self.keys[at] == ask, at, -1)
        return out


def head_of(h: np.ndarray, c: np.ndarray, clustered: int) -> Head:
    """Of words and their counts: the most frequent ones are numbered, the others dealt to bands of ranks."""
    down = np.lexsort((h, -c))
    h, c, rank = h[down], c[down], np.arange(len(h))
    unit = np.where(rank < clustered, rank, clustered + np.floor(np.log2(np.maximum(rank, 1) / max(1, clustered))).astype(np.int64))
    order = np.argsort(h)
    return Head(h[order], c[order], unit[order], int(unit.max()) + 1 if len(unit) else 0)


def _sequence(head: Head, w: Words, unit_of_head: np.ndarray, tail: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head positions of the words; units of each text's words and its end; units before them)."""
    at = head.find(w.hashes())
    n_docs = len(w.offs) - 1
    stop = w.at[1:] + np.arange(n_docs)
    now = np.empty(len(at) + n_docs, np.int64)
    inner = np.ones(len(now), bool)
    inner[stop] = False
    now[inner] = np.where(at >= 0, unit_of_head[np.maximum(at, 0)], tail) if len(unit_of_head) else tail
    now[stop] = end
    before = np.empty_like(now)
    before[1:] = now[:-1]
    if len(before):
        before[w.at[:-1] + np.arange(n_docs)] = end
    return at, now, before


def bigram_counts(texts: DataFrame, text_col: str, head: Head) -> np.ndarray:
    """Matrix of unit pairs (before, now) over all training texts."""
    size = head.n_units + 2
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def run(batch):
        hd, codes, counts = shared.value, [], []
        for _, _, raw, offs in slices(batch.column(0)):
            _, now, before = _sequence(hd, Words(raw, offs, lower=True), hd.unit, hd.tail, hd.end)
            k, c = np.unique(before * size + now, return_counts=True)
            codes.append(k)
            counts.append(c)
        if codes:
            k, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bincount(inverse, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64))], names=["pair", "n"])
        return None

    got = arrow_map(texts.select(text_col), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most size * size rows
    out = np.zeros(size * size)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, movable: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit. Units below `movable` move to the class that raises the class bigrams' likelihood most; the others keep a class of their own."""
    size = len(pairs)
    k = min(classes, max(1, movable))
    of = np.concatenate((np.arange(movable) % k, k + np.arange(size - movable)))
    n = k + size - movable
    m = np.zeros((n, n))
    np.add.at(m, (of[:, None], of[None, :]), pairs)
    for _ in range(sweeps if movable > 1 else 0):
        moved = 0
        for u in range(movable):
            a = of[u]
            right = np.bincount(of, weights=pairs[u], minlength=n)  # u before each class
            left = np.bincount(of, weights=pairs[:, u], minlength=n)
            own = pairs[u, u]
            right[a] -= own
            left[a] -= own
            m[a] -= right
            m[:, a] -= left
            m[a, a] -= own
            rows, cols = m.sum(axis=1)[:k], m.sum(axis=0)[:k]
            r, c = right.sum() + own, left.sum() + own
            # gain of putting u into class b: changed cells of row b and of column b, and the changed margins
            gain = (_xlogx(m[:k] + right) - _xlogx(m[:k])).sum(axis=1) + (_xlogx(m[:, :k] + left[:, None]) - _xlogx(m[:, :k])).sum(axis=0)
            d = np.arange(k)
            x, rb, lb = m[d, d], right[:k], left[:k]
            gain += _xlogx(x + rb + lb + own) + _xlogx(x) - _xlogx(x + rb) - _xlogx(x + lb)
            gain -= _xlogx(rows + r) - _xlogx(rows) + _xlogx(cols + c) - _xlogx(cols)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[u] = b
            m[b] += right
            m[:, b] += left
            m[b, b] += own
        if not moved:
            break
    return of


@dataclass(eq=False)
class ClassModel:
    """What the tasks need: the head's class, emission and base score of each word; transitions; the tail's constants. Logarithms to base 10."""

    head: Head
    class_of: np.ndarray
    emission: np.ndarray
    base: np.ndarray
    transition: np.ndarray
    tail_class: int
    end_class: int
    base_end: float
    train_docs: int
    base_total: float
    tail_total: float
    unknown: float


def transitions(pairs: np.ndarray) -> np.ndarray:
    """P(class now | class before) of class bigram counts."""
    n = len(pairs)
    mass, row = pairs.sum(axis=0), pairs.sum(axis=1)
    prior = (mass + 1) / (mass.sum() + n)
    left = np.where(row > 0, DISCOUNT * (pairs > 0).sum(axis=1) / np.maximum(row, 1), 1.0)
    return np.maximum(pairs - DISCOUNT, 0) / np.maximum(row, 1)[:, None] + left[:, None] * prior


def build(head: Head, pairs: np.ndarray, n_docs: int, n_tokens: int, n_words: int, classes: tuple[np.ndarray, int] | None = None) -> ClassModel:
    """n_tokens and n_words: N and V of the training tokens, ends included. classes: (tokens of each class, words in all) where units are classes already."""
    of = exchange(pairs, min(CLUSTERED, head.n_units), CLASSES) if classes is None else np.arange(head.n_units + 2)
    n = int(of.max()) + 1
    m = np.zeros((n, n))
    np.add.at(m, (of[:, None], of[None, :]), pairs)
    class_of = of[head.unit] if len(head.unit) else np.empty(0, np.int64)
    total, words = (np.bincount(class_of, weights=head.count, minlength=n), len(head.keys)) if classes is None else classes
    tail_tokens, tail_words = n_tokens - n_docs - int(total.sum()), n_words - (n_docs > 0) - words
    base_total = float(np.log10(n_tokens + n_words + 1))
    return ClassModel(
        head, class_of, np.log10(head.count / total[class_of]), np.log10(head.count + 1.0) - base_total, np.log10(transitions(m)), int(of[head.tail]), int(of[head.end]),
        float(np.log10(n_docs + 1.0)) - base_total, n_docs, base_total, float(np.log10(max(tail_tokens, 1))), float(np.log10(RARE_DISCOUNT * tail_words / tail_tokens)) if tail_tokens else 0.0,
    )


def blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def as_blobs(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Binary column of the values between offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def contexts(texts: DataFrame, text_col: str, head: Head, seed: np.ndarray) -> DataFrame:
    """h, seen: each batch's counts of a word's neighbour units, code << 40 | count in 8 bytes, code the unit before it or size + that after it. Seeds (a mask of the head) have no rows."""
    size = head.n_units + 2
    shared = texts.sparkSession.sparkContext.broadcast((head, np.append(seed, False)))

    def run(batch):
        (hd, fixed), keys, left, right = shared.value, [], [], []
        for _, _, raw, offs in slices(batch.column(0)):
            w = Words(raw, offs, lower=True)
            at, now, before = _sequence(hd, w, hd.unit, hd.tail, hd.end)
            free = np.flatnonzero(~fixed[at])
            place = free + w.doc_of_word()[free]  # each text's end lies between
            keys.append(w.hashes()[free])
            left.append(before[place])
            right.append(now[place + 1])
        if not keys or not sum(map(len, keys)):
            return None
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        first = inverse * (2 * size)
        cell, n = np.unique(np.concatenate((first + np.concatenate(left), first + size + np.concatenate(right))), return_counts=True)
        word, code = np.divmod(cell, 2 * size)
        return pa.RecordBatch.from_arrays([pa.array(signed(u)), as_blobs((code << 40) | n, np.searchsorted(word, np.arange(len(u) + 1)))], names=["h", "seen"])

    return arrow_map(texts.select(text_col), run, "h long, seen binary")


def best_classes(seen: np.ndarray, own: np.ndarray, pairs: np.ndarray, k: int) -> np.ndarray:
    """Class of each word that raises the likelihood of the class bigrams most. seen: counts of the units before, then after, each word. own: its present unit.

    A word is small beside a class, so the gain is the likelihood's derivative; its present class counts without it.
    """
    size = len(pairs)
    left, right = seen[:, :size], seen[:, size:]
    l_sum, r_sum = left.sum(axis=1), right.sum(axis=1)
    rows, cols, half = pairs.sum(axis=1), pairs.sum(axis=0), 0.5 * size
    gain = right @ np.log(pairs[:k] + 0.5).T + left @ np.log(pairs[:, :k] + 0.5) - np.outer(r_sum, np.log(rows[:k] + half)) - np.outer(l_sum, np.log(cols[:k] + half))
    at = np.flatnonzero(own < k)
    a, r, c = own[at], right[at], left[at]
    rest_r, rest_c = np.maximum(pairs[a] - r, 0), np.maximum(pairs[:, a].T - c, 0)
    gain[at, a] = (r * np.log(rest_r + 0.5)).sum(axis=1) + (c * np.log(rest_c + 0.5)).sum(axis=1) - r_sum[at] * np.log(np.maximum(rows[a] - r_sum[at], 0) + half) - l_sum[at] * np.log(np.maximum(cols[a] - l_sum[at], 0) + half)
    return gain.argmax(axis=1)


def one_round(texts: DataFrame, text_col: str, head: Head, pairs: np.ndarray, seed: np.ndarray, k: int) -> DataFrame:
    """h, c, k: count and class of every training word but the seeds; k, the tail, for words that occur once."""
    size = head.n_units + 2
    shared = texts.sparkSession.sparkContext.broadcast((head, pairs))

    def run(batches):
        got = [(b.column(0).to_numpy(), *blobs(b.column(1))) for b in batches if b.num_rows]
        if not got:
            return
        hd, m = shared.value
        h, of_row = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        cell = np.concatenate([g[1] for g in got]).view(np.int64)
        word = np.repeat(of_row, np.concatenate([np.diff(g[2]) // 8 for g in got]))
        del got
        order = np.argsort(word, kind="stable")
        word, code, n = word[order], cell[order] >> 40, cell[order] & ((1 << 40) - 1)
        c = np.bincount(word, weights=n * (code < size), minlength=len(h)).astype(np.int64)
        own = hd.find(h.view(U64))
        own = np.where(own >= 0, hd.unit[np.maximum(own, 0)], hd.tail) if len(hd.keys) else np.full(len(h), hd.tail)
        many = c > 1
        kept = many[word]
        place = np.cumsum(many) - 1
        word, code, n, own = place[word[kept]], code[kept], n[kept], own[many]
        best = np.empty(len(own), np.int64)
        for lo in range(0, len(own), 1 << 13):
            hi = min(lo + (1 << 13), len(own))
            a, b = np.searchsorted(word, (lo, hi))
            seen = np.bincount((word[a:b] - lo) * (2 * size) + code[a:b], weights=n[a:b], minlength=(hi - lo) * 2 * size).reshape(hi - lo, 2 * size)
            best[lo:hi] = best_classes(seen, own[lo:hi], m, k)
        to = np.full(len(h), k)
        to[many] = best
        for lo in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (h, c, to.astype(np.int32))], names=["h", "c", "k"])
        give_back()

    rows = contexts(texts, text_col, head, seed).repartition("h")
    return rows.mapInArrow(run, "h long, c long, k int")


def cluster(texts: DataFrame, text_col: str, head: Head) -> tuple[Head, DataFrame, np.ndarray, int]:
    """(the head with classes as units; h, c, k of all words but the seeds; tokens of each class; number of words with a class)."""
    pairs = bigram_counts(texts, text_col, head)
    movable = min(CLUSTERED, head.n_units)
    of = exchange(pairs, movable, CLASSES)
    k, n = min(CLASSES, max(1, movable)), int(of.max()) + 1
    grouped = np.zeros((n, n))
    np.add.at(grouped, (of[:, None], of[None, :]), pairs)
    seed = head.unit < movable
    unit, units, words = of[head.unit] if len(head.unit) else head.unit, n - 2, None
    for turn in range(ROUNDS):
        now = Head(head.keys, head.count, unit, units)
        if turn:
            grouped = bigram_counts(texts, text_col, now)
        old, words = words, materialize(one_round(texts, text_col, now, grouped, seed, k), "word-classes")
        if old is not None:
            release(old)
        top = most_frequent(words.where("c > 1"), "c", HEAD).toArrow()  # a constant number of rows
        of_word = Head(*(x[np.argsort(top["h"].to_numpy().view(U64))] for x in (top["h"].to_numpy().view(U64), top["c"].to_numpy(), top["k"].to_numpy().astype(np.int64))), k)
        at = of_word.find(head.keys)
        unit, units = np.where(seed, unit, np.append(of_word.unit, k)[at]), k
    sums = words.where(F.col("k") < k).groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow()  # a row for each class
    total = np.bincount(unit[seed], weights=head.count[seed], minlength=k + 2)
    total[sums["k"].to_numpy()] += sums["c"].to_numpy()
    return Head(head.keys, head.count, unit, k), words, total, int(seed.sum()) + int(sums["v"].to_numpy().sum())


def class_pairs(sequences: DataFrame, k: int) -> np.ndarray:
    """Matrix of class pairs (before, now) over the training texts' codes."""
    n = k + 2

    def run(batch):
        now, before = _before(*blobs(batch.column(0)), n - 1)
        count = np.bincount(before * n + now, minlength=n * n)
        pair = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count[pair])], names=["pair", "n"])

    got = arrow_map(sequences.where("NOT held_out").select("codes"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most n * n rows
    out = np.zeros(n * n)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(n, n)


def _before(codes: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes, classes before them) of texts that all have their end."""
    now = codes.astype(np.int64)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[offs[:-1]] = end
    return now, before


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    own = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    texts = own.where(~F.col("held_out"))
    counts = materialize(word_counts(texts, "_text"), "word-counts")
    n_docs = texts.count()
    s = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_words = s["n"] + n_docs, s["v"] + (n_docs > 0)
    top = most_frequent(counts.where(F.col("c") > 1), "c", HEAD).toArrow()  # a constant number of rows
    head = head_of(top["h"].to_numpy().view(U64), top["c"].to_numpy(), CLUSTERED)
    release(counts)
    head, words, total, clustered = cluster(texts, "_text", head)
    k = head.n_units
    model = build(head, np.zeros((k + 2, k + 2)), n_docs, n_tokens, n_words, (total, clustered))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m = shared.value
        for lo, hi, raw, offs in slices(batch.column(2)):
            w = Words(raw, offs, lower=True)
            at, now, _ = _sequence(m.head, w, m.class_of, m.tail_class, m.end_class)
            n_docs_here, known = hi - lo, at >= 0
            ends = w.at + np.arange(n_docs_here + 1)
            place = np.maximum(at, 0)
            emit = np.where(known, m.emission[place], 0.0) if len(m.emission) else np.zeros(len(at))
            base = np.where(known, m.base[place], 0.0) if len(m.base) else np.zeros(len(at))
            emit, base = np.concatenate(([0.0], np.cumsum(emit))), np.concatenate(([0.0], np.cumsum(base)))
            score = emit[w.at[1:]] - emit[w.at[:-1]]
            base = base[w.at[1:]] - base[w.at[:-1]] + m.base_end
            n_known = per_doc(known.astype(np.int64), w.at) + (m.train_docs > 0)
            uid = batch.column(3).slice(lo, hi - lo)
            with np.errstate(over="ignore"):
                spread = signed(mix(uid.to_numpy().view(U64) + U64(0x5851F42D4C957F2D)))  # a join key that spreads the texts' own rows
            yield pa.RecordBatch.from_arrays(
                [uid, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(w.count + 1), pa.array(n_known), pa.array(base), pa.array(score), pa.array(spread), pa.nulls(n_docs_here, pa.int64()), as_blobs(now.astype(np.uint8), ends), pa.nulls(n_docs_here, pa.binary())], names=_COLS)
            rare = np.flatnonzero(~known)
            if len(rare):
                h, doc = w.hashes()[rare], w.doc_of_word()[rare]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                place = (rare[order] - w.at[doc]).astype(np.int32)
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
                n = np.diff(np.append(new, len(h)))
                n_new = len(new)
                yield pa.RecordBatch.from_arrays(
                    [uid.take(pa.array(doc[new])), pa.nulls(n_new, batch.schema.field(0).type), pa.nulls(n_new, pa.bool_()), pa.nulls(n_new, pa.int64()), pa.nulls(n_new, pa.int64()), pa.nulls(n_new, pa.float64()), pa.nulls(n_new, pa.float64()), pa.array(signed(h[new])), pa.array(n.astype(np.int64)), pa.nulls(n_new, pa.binary()), as_blobs(place, np.append(new, len(h)))], names=_COLS)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = arrow_map(own.withColumn("_uid", F.monotonically_increasing_id()), run, f"uid long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, h long, n long, codes binary, at binary")
    rows = rows.join(words, "h", "left")
    c, n, of_class = F.coalesce("c", F.lit(0)), F.col("n"), F.col("k") < k
    class_total = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(np.maximum(total, 1))]), F.col("k") + 1)
    emission = F.when(of_class, F.log10(c) - class_total).when(c > 0, F.log10(c - RARE_DISCOUNT) - model.tail_total).otherwise(model.unknown)
    whole = rows.groupBy("uid").agg(
        F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        (F.coalesce(F.sum("n_known"), F.lit(0)) + F.coalesce(F.sum(F.when(c > 0, n)), F.lit(0))).alias("n_known"),
        (F.sum("base") + F.coalesce(F.sum(n * (F.log10(c + 1.0) - model.base_total)), F.lit(0.0))).alias("base_score"),
        (F.sum("score") + F.coalesce(F.sum(n * emission), F.lit(0.0))).alias("score"),
        F.max("codes").alias("codes"), F.collect_list(F.when(of_class, F.struct("at", "k"))).alias("put"),
    ).drop("uid")

    def put(batch):
        raw, offs = blobs(batch.column(6))
        codes, flat = raw.copy(), batch.column(7).flatten()
        at, ends = blobs(flat.field("at"))
        many = np.diff(ends) // 4
        doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(7)).to_numpy())
        codes[at.view(np.int32) + np.repeat(offs[doc], many)] = np.repeat(flat.field("k").to_numpy().astype(np.uint8), many)
        return pa.RecordBatch.from_arrays([*batch.columns[:6], as_blobs(codes, offs)], names=batch.schema.names[:7])

    fields = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    whole = materialize(arrow_map(whole, put, f"{fields}, codes binary"), "class-sequences")
    release(words)
    step = docs.sparkSession.sparkContext.broadcast(np.log10(transitions(class_pairs(whole, k))))

    def add(batch):
        codes, offs = blobs(batch.column(6))
        now, before = _before(codes, offs, k + 1)
        steps = np.concatenate(([0.0], np.cumsum(step.value[before, now])))
        score = batch.column(5).to_numpy() + steps[offs[1:]] - steps[offs[:-1]]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], names=batch.schema.names[:6])

    out = arrow_map(whole, add, fields)
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


_COLS = ["uid", "id", "held_out", "n_tokens", "n_known", "base", "score", "h", "n", "codes", "at"]
