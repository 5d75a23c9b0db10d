"""URL filters (operator 2): allow and block rules on host and path, and a logistic regression for every other URL.

The features are hashed character n-grams of the host and of the path, told apart by a prefix. The model is trained
on the driver from a small labelled URL table, whose rows are bounded by MAX_LABELLED, and has DIM weights, so what
travels to the executors is a constant 512 KB. Rules and URL parts are plain column expressions.

Defined cases: a null URL, or one without "://", has an empty host and path, no rule, and the model's verdict on the
empty features. Repeated rows are judged row by row; extra columns are ignored. An empty rule list or table is allowed.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map
from weftline.llm.spans import BYTE_TABLE, U64, buffer_of, mix

DIM = 1 << 16
GRAMS = (3, 4, 5)
MAX_LABELLED = 50_000


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end; empty without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; both null if none does. A rule is (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def features(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) pairs of all n-grams; `parts` holds the bytes and offsets of the hosts, then of the paths."""
    rows, cells = [], []
    for k, (raw, offs) in enumerate(parts):
        n_rows = len(offs) - 1
        length = np.diff(offs) + 2
        start = np.concatenate(([0], np.cumsum(length)))
        text = np.full(start[-1], 1, np.uint8)  # a border byte on both sides of each text
        if len(raw):
            text[np.arange(len(raw)) + np.repeat(1 + 2 * np.arange(n_rows), length - 2)] = raw
        v, row = BYTE_TABLE[text], np.repeat(np.arange(n_rows), length)
        for n in GRAMS:
            if len(v) < n:
                continue
            with np.errstate(over="ignore"):
                acc = np.zeros(len(v) - n + 1, U64)
                for j in range(n):
                    acc = (acc + v[j : j + len(acc)]) * U64(0xD6E8FEB86659FD93 + 2 * (n + 16 * k))
                acc = mix(acc)
            inside = row[: len(acc)] == row[n - 1 :]
            rows.append(row[: len(acc)][inside])
            cells.append((acc[inside] % U64(DIM)).astype(np.int64))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cells)


def _margin(w: np.ndarray, bias: float, row: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(row, weights=w[cell], minlength=n)
    size = np.bincount(row, minlength=n)
    return total / np.sqrt(np.maximum(size, 1)) + bias


def train(hosts: list[str], paths: list[str], labels: list[int], epochs: int = 300, rate: float = 1.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent with momentum; the rows are few and bounded, so this is one machine's work."""
    if len(labels) > MAX_LABELLED:
        raise ValueError(f"the labelled URL table has {len(labels)} rows; at most {MAX_LABELLED} are taken")
    row, cell = features([buffer_of(pa.array(hosts, pa.string())), buffer_of(pa.array(paths, pa.string()))])
    y, n = np.asarray(labels, float), len(labels)
    w, bias, pace, pace_b = np.zeros(DIM), 0.0, np.zeros(DIM), 0.0
    if not n:
        return w, bias
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    for _ in range(epochs):
        gap = (1 / (1 + np.exp(-_margin(w, bias, row, cell, n))) - y) * weight
        g = np.bincount(cell, weights=(gap * scale)[row], minlength=DIM) + l2 * w
        pace, pace_b = 0.9 * pace - rate * g, 0.9 * pace_b - rate * gap.sum()
        w, bias = w + pace, bias + pace_b
    return w, float(bias)


def url_verdicts(pages: DataFrame, labelled: list[tuple[str, int]], rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict (the rule's, else block where the model's score reaches the threshold), score.

    labelled: (url, 1 for block or 0 for allow). rules: (verdict, host, path).
    """
    spark = pages.sparkSession
    split = [_split(u) for u, _ in labelled]
    w, bias = train([h for h, _ in split], [p for _, p in split], [y for _, y in labelled])
    model = spark.sparkContext.broadcast((w.astype(np.float32), bias))

    def run(batch):
        weights, b = model.value
        row, cell = features([buffer_of(batch.column(1)), buffer_of(batch.column(2))])
        score = 1 / (1 + np.exp(-_margin(weights, b, row, cell, batch.num_rows)))
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], names=[*batch.schema.names[:5], "score"])

    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).select(id_col, "host", "path", rule.alias("rule"), said.alias("said"))
    kind = pages.schema[id_col].dataType.simpleString()
    scored = arrow_map(parts, run, f"`{id_col}` {kind}, host string, path string, rule string, said string, score double")
    model_says = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("said", model_says).alias("verdict"), "score")


def _split(url: str) -> tuple[str, str]:
    """host_of and path_of for a URL of the labelled table."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[stop:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop]), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


# A small labelled URL table, made by rule: what junk sites and ordinary sites are about, each with names of the same shapes, hyphens included.
BLOCK_TOPICS = (
    "casino", "poker", "slots", "betting", "jackpot", "roulette", "lottery", "viagra", "pills", "pharmacy", "replica", "payday", "loans", "escorts", "porn", "xxx", "adult", "webcam", "spam", "mailer",
    "tracker", "adserver", "adsense", "popunder", "clickbait", "malware", "phishing", "keygen", "warez", "torrent", "cracked", "giveaway", "miracle", "weightloss",
)
ALLOW_TOPICS = (
    "news", "library", "university", "museum", "weather", "garden", "kitchen", "history", "science", "physics", "school", "travel", "maps", "music", "books", "recipes", "health", "sports", "football",
    "railway", "archive", "journal", "gazette", "council", "hospital", "language", "dictionary", "forum", "docs", "support", "research", "theatre", "cinema", "nature", "birds", "rivers", "mountains", "poetry",
    "blogger", "overflow", "institute", "academy", "charity", "parks", "cooking", "gardening", "hiking", "painting", "writing", "building", "learning", "engineering", "housing", "parenting", "farming", "sailing",
)
SHAPES = ("{}", "my-{}", "the{}", "{}-online", "{}hub", "best-{}", "{}24", "{}-zone", "city{}", "new-{}-site")
ZONES, FRONTS = ("example.net", "example.com", "example.org", "org", "net", "com", "info"), ("", "www.", "m.", "blog.")
TAILS = ("/en/1204", "/de/88/", "/fr/7.html", "/", "/2024/05/item", "")
CONSONANTS, VOWELS = "bdfgklmnprstvz", "aeiou"


def brand(i: int) -> str:
    """The i-th made-up name of three or four syllables: ordinary sites are often called like that."""
    out, x = "", i * 7919 + 13
    for _ in range(3 + i % 2):
        x, c = divmod(x, len(CONSONANTS))
        x, v = divmod(x + i, len(VOWELS))
        out += CONSONANTS[c] + VOWELS[v]
        x += 1 + i * (c + 1)
    return out


def labelled_names() -> list[tuple[str, str, int]]:
    """(topic, host name, 1 for block or 0 for allow) of the table."""
    made = [brand(i) for i in range(60)]
    return [(t, shape.format(t), y) for y, topics in ((1, BLOCK_TOPICS), (0, (*ALLOW_TOPICS, *made))) for t in topics for shape in SHAPES]


def default_labelled() -> list[tuple[str, int]]:
    """The labelled URL table of the registered query. Zones, fronts and paths go through the same turns in both classes, so only names tell them apart."""
    return [(f"https://{FRONTS[i % len(FRONTS)]}{name}.{ZONES[i % len(ZONES)]}{TAILS[i % len(TAILS)]}", y) for y in (1, 0) for i, (_, name, _) in enumerate(x for x in labelled_names() if x[2] == y)]
