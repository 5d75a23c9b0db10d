"""Toxicity by class-conditional Kneser-Ney models (operator 5).

Each class has an interpolated model of words after words: P(w | v) comes from the class's own word pairs (documents that have them),
then from the class's own words, counted by continuation (how many different words stand before w in the class), and at the bottom from
the word's characters: bytes of the A-Z-lowered word after ORDER - 1 start marks, then an end mark, of which only the highest order
counts the class's own words and all lower orders are continuation counts shared by both classes. So a rare or unseen expression falls
back to the same evidence in both models, and only its known part speaks for a class. Counting different predecessors, less
WORD_DISCOUNT, keeps words of copied passages from being evidence.

A text's features are the toxic less the ordinary log-likelihood per word, over the whole text and over its highest words, and the log of
its words. The highest words count twice: as they are (up to MOST), and up to CAP each, where one accident isn't enough. A logistic curve
turns the features into a score; it is fitted on rows that the models in use haven't seen (FOLDS folds).

Training reads a bounded sample: at most SAMPLE labelled ids of each class, one text each, taken in the order of a hash of the id.
Model size follows the sample, not the corpus, and is broadcast (some 10 MB); pairs seen in one document only aren't listed, since
their own probability is next to nothing, but count for what their first word leaves to the lower order. All texts are scored whole,
one Arrow batch at a time; word scores are cached in a bounded table. Nothing but the sample is shuffled.

Defined cases: null, empty and wordless texts have zero features and get the curve's value there. A labelled id with several
label rows is toxic if one says so; with several texts it trains with the smallest; ids without text rows don't train. With fewer than
FOLDS sample texts of a class the score is the share of toxic labels (0 without labels). Repeated rows are scored row by row; extra
columns are ignored by `score` and kept by `drop_toxic`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, give_back, kept, materialize, release
from weftline.llm.spans import BYTE_TABLE, U64, Words, in_doc, mix, slices

ORDER, DISCOUNT, WORD_DISCOUNT = 5, 0.95, 1.9
#: Features of the highest words: (how many, what one counts at most).
MOST, CAP = 30.0, 6.0
HIGHEST = ((3, MOST), (3, CAP), (8, CAP))
N_FEATURES = 2 + len(HIGHEST)
SAMPLE, FOLDS = 2000, 3
CACHE_WORDS = 250_000
START, END = 0, 1
#: Stands before a text's first word.
BORDER = U64(0)


@dataclass(eq=False)
class Table:
    """Sorted hashes with values; what is not there has the default."""

    keys: np.ndarray
    values: np.ndarray

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]


def _characters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(marked bytes of all words, position of each predicted character): after ORDER - 1 start marks, the word and an end mark."""
    pad = bytes([START]) * (ORDER - 1)
    text = np.frombuffer(b"".join(pad + w + bytes([END]) for w in words), np.uint8)
    size = np.array([len(w) for w in words], np.int64) + 1
    ends = np.cumsum(size + ORDER - 1)
    at = np.arange(int(size.sum())) + np.repeat(ends - size - (np.cumsum(size) - size), size)
    return text, at


def _grams(text: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n characters up to each position, and of the n - 1 before it."""
    with np.errstate(over="ignore"):
        context = np.full(len(at), n, U64)
        for k in range(n - 1, 0, -1):
            context = (context + BYTE_TABLE[text[at - k]]) * U64(0xD6E8FEB86659FD93)
        return mix((context + BYTE_TABLE[text[at]]) * U64(0xA0761D6478BD642F)), mix(context)


def _estimate(gram: np.ndarray, context: np.ndarray, count: np.ndarray, lower: np.ndarray) -> tuple[Table, Table]:
    """Interpolated probability of each gram, and the weight each context leaves to the lower order."""
    order = np.argsort(context, kind="stable")
    keys, first = np.unique(context[order], return_index=True)
    total, kinds = np.add.reduceat(count[order], first), np.diff(np.append(first, len(order)))
    left = DISCOUNT * kinds / total
    of = np.searchsorted(keys, context)
    p = np.maximum(count - DISCOUNT, 0) / total[of] + left[of] * lower
    by = np.argsort(gram)
    return Table(gram[by], p[by]), Table(keys, left)


@dataclass(eq=False)
class Model:
    """Characters: shared lower orders, and of each class (ordinary, toxic) the highest. Of each class its words and what they leave to the characters; its pairs,
    and what each first word leaves to the words. The curve's weights."""

    shared: list[tuple[Table, Table]] = field(default_factory=list)
    top: list[tuple[Table, Table]] = field(default_factory=list)
    own: list[tuple[Table, float]] = field(default_factory=list)
    pairs: list[tuple[Table, Table]] = field(default_factory=list)
    after: list[Table] = field(default_factory=list)
    listed: np.ndarray = field(default_factory=lambda: np.empty(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    constant: float | None = None

    def lower(self, text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Probability of each character by the orders up to n."""
        p = np.full(len(at), 1 / 256)
        for k in range(1, n + 1):
            gram, context = _grams(text, at, k)
            seen, own = self.shared[k - 1][0].find(gram)
            p = np.where(seen, own, self.shared[k - 1][1].get(context, 1.0) * p)
        return p

    def spelled(self, words: list[bytes]) -> list[np.ndarray]:
        """Log-probability of each word's characters in both classes."""
        text, at = _characters(words)
        gram, context = _grams(text, at, ORDER)
        low, size = self.lower(text, at, ORDER - 1), np.array([len(w) for w in words], np.int64) + 1
        out = []
        for grams, contexts in self.top:
            seen, own = grams.find(gram)
            out.append(np.add.reduceat(np.log(np.where(seen, own, contexts.get(context, 1.0) * low)), np.cumsum(size) - size))
        return out

    def alone(self, words: list[bytes], h: np.ndarray) -> np.ndarray:
        """(classes, words): log-probability of each word without its predecessor."""
        if not words:
            return np.empty((2, 0))
        return np.stack([np.log(own.get(h, 0.0) + left * np.exp(spelled)) for spelled, (own, left) in zip(self.spelled(words), self.own, strict=True)])

    def halve(self) -> None:
        """Single precision for what travels: half the memory of every worker."""
        tables = {id(t): t for group in (self.shared, self.top, self.pairs) for pair in group for t in pair} | {id(t): t for t in [*self.after, *(t for t, _ in self.own)]}
        for t in tables.values():
            t.values = t.values.astype(np.float32)

    def left_of(self, h: np.ndarray) -> np.ndarray:
        """(classes, words): log of what each word, as a predecessor, leaves to the lower order."""
        return np.log(np.stack([contexts.get(h, 1.0) for _, contexts in self.pairs]))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * U64(0xA24BAED4963EE407) + second)


def fit(words: list[bytes], h: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], befores: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Model:
    """The two models. counts: (2, words) different words before each word, by class; pairs: (sorted hashes, (2, pairs) documents) of the listed pairs;
    befores: (sorted hashes, (2, words) pairs after each first word, (2, words) different ones)."""
    model = Model()
    text, at = _characters(words)
    size = np.array([len(w) for w in words], np.int64) + 1
    for n in range(1, ORDER):  # continuation counts: how many different characters stand before a gram
        longer, _ = _grams(text, at, n + 1)
        _, some = np.unique(longer, return_index=True)
        gram, context = _grams(text, at[some], n)
        distinct, first, count = np.unique(gram, return_index=True, return_counts=True)
        pos = at[some][first]
        model.shared.append(_estimate(distinct, context[first], count.astype(float), model.lower(text, pos, n - 1)))
    low = model.lower(text, at, ORDER - 1)
    gram, context = _grams(text, at, ORDER)
    distinct, first, which = np.unique(gram, return_index=True, return_inverse=True)
    by = np.argsort(h)
    h = h[by]
    for k in (0, 1):
        n = np.bincount(which, weights=np.repeat(counts[k], size).astype(float), minlength=len(distinct))
        some = n > 0
        model.top.append(_estimate(distinct[some], context[first][some], n[some], low[first][some]) if some.any() else (Table(distinct[:0], n[:0]), Table(distinct[:0], n[:0])))
        total = max(1.0, float(counts[k].sum()))
        model.own.append((Table(h, np.maximum(counts[k] - WORD_DISCOUNT, 0)[by] / total), float(np.minimum(counts[k], WORD_DISCOUNT).sum()) / total if counts[k].any() else 1.0))
        after, kinds = befores[1][k], befores[2][k]
        model.pairs.append((Table(pairs[0], np.maximum(pairs[1][k] - DISCOUNT, 0)), Table(befores[0], np.where(after > 0, DISCOUNT * kinds / np.maximum(after, 1), 1.0))))
        model.after.append(Table(befores[0], np.maximum(after, 1).astype(float)))
    model.listed = pairs[0]
    return model


class WordScores:
    """A model's log-probabilities of words, and what they leave to the lower order, kept by hash in a bounded sorted table."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values = np.empty(0, U64), np.empty((4, 0))

    def __call__(self, w: Words, h: np.ndarray) -> np.ndarray:
        """(4, words): log-probability in both classes, then log of the mass left, in both classes."""
        if len(self.keys) > CACHE_WORDS:
            self._clear()
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = pos < len(self.keys)
        known[inside] = self.keys[pos[inside]] == distinct[inside]
        if not known.all():
            raw, ask, new = w.raw.tobytes(), first[~known], distinct[~known]
            words = [raw[a:b] for a, b in zip(w.start[ask].tolist(), w.end[ask].tolist(), strict=True)]
            got = np.concatenate((self.model.alone(words, new), self.model.left_of(new)))
            self.keys, self.values = np.insert(self.keys, pos[~known], new), np.insert(self.values, pos[~known], got, axis=1)
            pos = np.searchsorted(self.keys, distinct)
        return self.values[:, pos[inverse]]


def word_ratios(scores: WordScores, w: Words) -> np.ndarray:
    """Toxic less ordinary log-likelihood of each word after its predecessor, which for a text's first word is its border."""
    h, model = w.hashes(), scores.model
    before = predecessors(w, h)
    value = scores(w, h)
    out = value[:2].copy()
    inner = np.flatnonzero(before != BORDER)
    out[:, inner] += value[2:, inner - 1]
    first = np.flatnonzero(before == BORDER)
    out[:, first] += model.left_of(np.full(1, BORDER))
    if len(model.listed) and len(h):
        pair = pair_hash(before, h)
        order = np.argsort(pair)
        ask = pair[order]
        at = np.minimum(np.searchsorted(model.listed, ask), len(model.listed) - 1)
        hit = order[model.listed[at] == ask]
        for k in (0, 1):
            own = model.pairs[k][0].get(pair[hit], 0.0) / model.after[k].get(before[hit], 1.0)
            out[k, hit] = np.log(own + np.exp(out[k, hit]))
    return out[1] - out[0]


def predecessors(w: Words, h: np.ndarray) -> np.ndarray:
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[w.at[:-1][w.count > 0]] = BORDER
    return out


def features(scores: WordScores, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, N_FEATURES): log-likelihood ratio per word of the whole text, and of its highest words by HIGHEST; log of the words."""
    w = Words(raw, offs, lower=True)
    n = w.count
    out = np.zeros((len(n), N_FEATURES))
    if not len(w.start):
        return out
    value, doc = np.minimum(word_ratios(scores, w), MOST), w.doc_of_word()
    out[:, 0] = np.bincount(doc, weights=value, minlength=len(n)) / np.maximum(n, 1)
    high = np.maximum(value[np.lexsort((-value, doc))], 0)
    rank = np.arange(len(value)) - np.repeat(w.at[:-1], n)
    for k, (top, most) in enumerate(HIGHEST):
        first = rank < top
        out[:, 1 + k] = np.bincount(doc[first], weights=np.minimum(high[first], most), minlength=len(n)) / top
    out[:, -1] = np.log(np.maximum(n, 1))
    return out


def curve(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -50, 50)))


def fit_curve(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 100, l2: float = 1e-4) -> np.ndarray:
    """Logistic weights by Newton's method, moved from the sample's share of toxic rows to the labels'."""
    a, w = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1)
    ridge = np.diag([l2] * x.shape[1] + [0.0])
    for _ in range(rounds):
        p = curve(w, x)
        h = (a * (np.maximum(p * (1 - p), 1e-9) / len(y))[:, None]).T @ a + ridge + 1e-12 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ ((y - p) / len(y)) - ridge @ w)
        w = w + step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
    odds = lambda q: np.log(min(max(q, 1e-6), 1 - 1e-6) / (1 - min(max(q, 1e-6), 1 - 1e-6)))
    w[-1] += odds(prior) - odds(float(y.mean()))
    return w


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def _distinct_words(batch):
    """word, h: the words of each batch."""
    for _, _, raw, offs in slices(batch.column(0)):
        ws = Words(raw, offs, lower=True)
        text = ws.raw.tobytes()
        distinct, first = np.unique(ws.hashes(), return_index=True)
        strings = [text[a:b] for a, b in zip(ws.start[first].tolist(), ws.end[first].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), pa.array(distinct.view(np.int64))], names=["word", "h"])


_KINDS = [f"n{k}" for k in range(2 * FOLDS)]


def _count_pairs(batch):
    """v, w, and the documents of each kind (twice the fold, plus the class) that have w after v."""
    for lo, hi, raw, offs in slices(batch.column(0)):
        ws = Words(raw, offs, lower=True)
        h, doc = ws.hashes(), ws.doc_of_word()
        v = predecessors(ws, h)
        pair = pair_hash(v, h)
        _, once = np.unique(in_doc(pair, doc), return_index=True)
        kind = batch.column(1).to_numpy()[lo:hi][doc[once]]
        distinct, first, inverse = np.unique(pair[once], return_index=True, return_inverse=True)
        n = [np.bincount(inverse, weights=kind == k, minlength=len(distinct)).astype(np.int64) for k in range(len(_KINDS))]
        at = once[first]
        yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(h[at].view(np.int64)), *map(pa.array, n)], names=["v", "w", *_KINDS])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows that aren't held out."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    n = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("k")).first()
    prior = n["k"] / n["n"] if n["n"] else 0.0
    if not 0 < n["k"] < n["n"]:
        return Model(constant=float(prior))
    order = (F.xxhash64("_id"), F.col("_id"))
    part = [known.where(F.col("_y") == y).orderBy(*order).limit(SAMPLE) for y in (0, 1)]
    ids = materialize(part[0].unionByName(part[1]), "toxic-ids")  # at most 2 * SAMPLE rows
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    rank = F.row_number().over(Window.partitionBy("_y").orderBy(*order))  # of at most SAMPLE rows
    rows = materialize(texts.select(F.coalesce("_text", F.lit("")).alias("_text"), F.col("_y").cast("long").alias("_y"), (rank % FOLDS * 2 + F.col("_y")).cast("long").alias("_kind")), "toxic-rows")
    sizes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < FOLDS:
        release(ids, rows)
        return Model(constant=float(prior))
    pairs = arrow_map(rows.select("_text", "_kind"), _count_pairs, "v long, w long, " + ", ".join(f"{k} long" for k in _KINDS))
    pairs = materialize(pairs.groupBy("v", "w").agg(*[F.sum(k).alias(k) for k in _KINDS]), "toxic-pairs")
    words = arrow_map(rows.select("_text"), _distinct_words, "word binary, h long").distinct().orderBy("word").toArrow()  # the words of a bounded sample
    if not words.num_rows:
        release(ids, rows, pairs)
        return Model(constant=float(prior))
    strings, hashes = words["word"].to_pylist(), words["h"].to_numpy().view(U64)
    spark = docs.sparkSession

    def model_without(out: int) -> Model:
        own = [sum((F.col(f"n{f * 2 + c}") for f in range(FOLDS) if f != out), F.lit(0)).alias(x) for c, x in ((0, "a"), (1, "b"))]
        seen = pairs.select("v", "w", *own).where("a + b > 0")
        kinds = seen.groupBy("w").agg(*[F.count_if(F.col(x) > 0).alias(x) for x in "ab"]).toArrow()
        before = seen.groupBy("v").agg(*[F.sum(x).alias(f"n{x}") for x in "ab"], *[F.count_if(F.col(x) > 0).alias(f"k{x}") for x in "ab"]).toArrow()
        listed = seen.where("a > 1 OR b > 1").toArrow()
        kinds, before = ((t[c].to_numpy().view(U64), t) for t, c in ((kinds, "w"), (before, "v")))
        pair = pair_hash(listed["v"].to_numpy().view(U64), listed["w"].to_numpy().view(U64))
        sort = lambda keys, t, *groups: (keys[o := np.argsort(keys)], *(np.stack([t[f].to_numpy() for f in g])[:, o] for g in groups))
        h, counts = sort(*kinds, "ab")
        at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
        use = h[at] == hashes
        return fit([w for w, u in zip(strings, use.tolist(), strict=True) if u], hashes[use], counts[:, at[use]], sort(pair, listed, "ab"), sort(*before, ("na", "nb"), ("ka", "kb")))

    xs, ys, names = [], [], [f"x{k}" for k in range(N_FEATURES)]
    for out in range(FOLDS):
        shared = spark.sparkContext.broadcast(model_without(out))

        def measure(batch, shared=shared):
            scores = WordScores(shared.value)
            for lo, hi, raw, offs in slices(batch.column(0)):
                x = features(scores, raw, offs)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(N_FEATURES)), batch.column(1).slice(lo, hi - lo)], names=[*names, "y"])

        got = arrow_map(rows.where(F.floor(F.col("_kind") / 2) == out).select("_text", "_y"), measure, ", ".join(f"{k} double" for k in names) + ", y long").toArrow()  # rows of the sample
        xs.append(np.column_stack([got[k].to_numpy() for k in names]))
        ys.append(got["y"].to_numpy())
        shared.destroy()  # the driver's copy goes too: one model is held at a time
        del shared, measure
        give_back()
    model = model_without(-1)
    model.weights = fit_curve(np.concatenate(xs), np.concatenate(ys), prior)
    model.halve()
    give_back()
    release(ids, rows, pairs)
    return model


def _scorer(shared) -> WordScores:
    """One to a worker process and broadcast model."""
    own = kept("toxicity")
    if "scorer" not in own or own["scorer"].model is not shared.value:
        own["scorer"] = WordScores(shared.value)
    return own["scorer"]


def _scores(shared, column: pa.Array) -> np.ndarray:
    model, out = shared.value, [np.empty(0)]
    for lo, hi, raw, offs in slices(column):
        out.append(np.full(hi - lo, model.constant) if model.constant is not None else curve(model.weights, features(_scorer(shared), raw, offs)))
    return np.concatenate(out)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        s = _scores(shared, batch.column(2))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), text_col), run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int", "toxicity")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The input's rows, all columns, whose score stays below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    return arrow_map(docs, lambda batch: batch.filter(pa.array(_scores(shared, batch.column(at)) < threshold)), docs.schema, "toxicity")


__all__ = ["Model", "drop_toxic", "fit", "held_out", "score", "train"]
