"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3), in DataFrame functions only.

Words are lower-cased runs of letters and digits; a test item is the set of its q five-word shingles (all its words, if fewer).
A document holds the item if it has at least `percent` of them, so it lacks at most miss(q) = q - ceil(percent * q / 100).

Items are partitioned by size: band p holds those of 2^p to 2^(p+1) - 1 shingles. A band has one signature length k, a bottom-k MinHash
of miss(largest q of the band) + EXTRA hashes; an item with fewer shingles has them all. Of an item's signature of length l = min(k, q),
a document that holds the item has at least l - miss(q) hashes, whatever the document's own size: that is the containment estimate which
makes a candidate. So the search loses no leak in long documents, and the extra hashes leave few false candidates. Documents of
candidates are read again and verified by exact shingles (words, not hashes).

The items' side is counted: up to BROADCAST_ROWS signature rows (24 bytes each) are broadcast, so no document row is shuffled. Beyond
that the join is shuffled, after a bit table of fixed size (2^BITS bits, broadcast as rows of 64) has taken out most shingles that no
signature has; AQE splits hot hashes. A hot passage costs some rows for each document that has it. A text is split into words once and its
shingles of all lengths in use leave in one pass.

Defined cases: null, empty or wordless texts and items hold nothing and are held by nothing; rows with equal ids are one
document (or item) with the shingles of all its rows; extra columns are ignored by `leaks` and kept by `drop_leaks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import by_ids, materialize

SHINGLE, PERCENT, EXTRA = 5, 80, 4
BROADCAST_ROWS, BITS = 1_000_000, 27


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def windows(w: Column, n: int, joined: bool) -> Column:
    """All runs of n words: as text, or as 64-bit hashes."""
    make = (lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])) if joined else (lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), make)).otherwise(F.array().cast("array<string>" if joined else "array<bigint>"))


def item_shingles(items: DataFrame, item_col: str, text_col: str, n: int = SHINGLE) -> DataFrame:
    """item_id, length (words of a shingle), shingle, h, q (shingles of the item), nth (rank of h in the item)."""
    w = items.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    some = w.select("item_id", F.least(F.size("w"), F.lit(n)).alias("length"), F.explode(
        F.when(F.size("w") < n, F.array(F.array_join("w", " "))).otherwise(windows(F.col("w"), n, True))).alias("shingle")).distinct()
    hashed = some.withColumn("h", F.xxhash64(F.split("shingle", " ")))
    q = some.groupBy("item_id").agg(F.count("*").alias("q"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle"))
    return hashed.join(q, "item_id").withColumn("nth", rank)


def signatures(known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, length, h, band, need: each item's signature in its size partition, and how many of its hashes a document that holds the item has at least."""
    miss = lambda q: q - F.ceil(q * percent / 100)
    band = F.floor(F.log2("q") + 1e-9).cast("int")
    largest = F.pow(F.lit(2.0), F.col("band") + 1).cast("long") - 1
    k = F.least(F.col("q"), miss(largest) + EXTRA)
    return known.withColumn("band", band).withColumn("k", k).where("nth <= k").select("item_id", "length", "h", "band", (F.col("k") - miss(F.col("q"))).alias("need"))


def _probe(docs: DataFrame, lengths: list[int], id_col: str, text_col: str, joined: bool) -> DataFrame:
    """doc, length and every distinct shingle of each document row, of each length in use, in one pass over the text."""
    w = docs.select(F.col(id_col).alias("_doc"), words(F.col(text_col)).alias("w"))
    name = "shingle" if joined else "h"
    of_length = lambda n: F.transform(F.array_distinct(windows(F.col("w"), n, joined)), lambda x: F.struct(x.alias(name), F.lit(n).alias("length")))
    every = [of_length(n) for n in lengths]
    return w.select("_doc", F.inline(F.flatten(F.array(*every)) if len(every) > 1 else every[0]))


def _possible(probe: DataFrame, sketch: DataFrame) -> DataFrame:
    """Probe rows whose hash some signature may have: a bit table of at most 2^(BITS - 6) rows is broadcast, whatever the number of items."""
    cell = lambda h: F.pmod(h, F.lit(1 << BITS))
    table = sketch.select(cell(F.col("h")).alias("v")).groupBy(F.shiftright("v", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(v & 63 AS INT))")).alias("_bits"))
    kept = probe.withColumn("_v", cell(F.col("h"))).withColumn("_word", F.shiftright("_v", 6)).join(F.broadcast(table), "_word")
    return kept.where(F.expr("shiftrightunsigned(_bits, cast(_v & 63 AS INT)) & 1 = 1")).drop("_v", "_word", "_bits")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per (document, item) of which the document holds at least `percent` of the shingles: id, item_id, n_shingles, n_shared, containment."""
    known = materialize(item_shingles(items, item_col, item_text_col), "items")
    small = known.count() <= BROADCAST_ROWS
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect()) or [SHINGLE]  # at most SHINGLE values
    sketch = signatures(known, percent)
    side = F.broadcast if small else lambda x: x
    probe = _probe(docs, lengths, id_col, text_col, joined=False)
    hits = (probe if small else _possible(probe, sketch)).join(side(sketch), ["h", "length"])
    # rows that share an id may count a hash twice, which only adds candidates
    likely = hits.groupBy("_doc", "item_id", "need").agg(F.count("*").alias("n")).where("n >= need")
    candidates = materialize(likely.select("_doc", "item_id"), "candidates")
    held = by_ids(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")), materialize(candidates.select("_doc").distinct(), "held"), "left_semi", "_doc")
    exact = _probe(held, lengths, "_doc", "_text", joined=True).join(side(known.select("shingle", "length", "item_id", "q")), ["shingle", "length"]).join(candidates, ["_doc", "item_id"], "left_semi")
    n = exact.select("_doc", "item_id", "q", "shingle").distinct().groupBy("_doc", "item_id", "q").agg(F.count("*").alias("n_shared"))
    return n.where(F.col("n_shared") * 100 >= F.col("q") * percent).select(
        F.col("_doc").alias(id_col), F.col("item_id").alias(item_col), F.col("q").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, all columns, that hold no item."""
    found = materialize(leaks(docs, items, id_col=id_col, **options).select(id_col).distinct(), "leaks")  # read by the result, so it stays until that is written
    return by_ids(docs, found, "left_anti", id_col)


def oracle(percent: int = PERCENT) -> str:
    """leaks() over documents and benchmark as DuckDB SQL."""
    n = SHINGLE
    cut = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH items AS (SELECT item_id, {cut} AS w FROM benchmark), docs AS (SELECT doc_id, {cut} AS w FROM documents),
item_s AS (SELECT DISTINCT item_id, least(len(w), {n}) AS length, unnest(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END) AS shingle FROM items WHERE len(w) > 0),
q AS (SELECT item_id, count(*) AS q FROM item_s GROUP BY 1),
doc_s AS (SELECT DISTINCT doc_id, k AS length, unnest(CASE WHEN len(w) < k THEN [] ELSE list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) END) AS shingle
    FROM docs, (SELECT DISTINCT length AS k FROM item_s))
SELECT doc_id, item_id, q AS n_shingles, count(*) AS n_shared, count(*)::DOUBLE / q AS containment
FROM doc_s JOIN item_s USING (shingle, length) JOIN q USING (item_id)
GROUP BY doc_id, item_id, q HAVING count(*) * 100 >= q * {percent}"""
