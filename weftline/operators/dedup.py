"""Claims, duplicates, exclusions and set proofs over fingerprints and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.select import small
from weftline.sources.shared import stored


class CoverageError(ValueError):
    """Two tables that must hold the same keys once don't."""


def claims(rows: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """First owner of each digest wins (U1): one aggregate with partial minima, so that a digest of any frequency isn't one task's work."""
    first = rows.groupBy(digest).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("copies"))
    return first.select(digest, "copies", *[F.col(f"_first.{c}").alias(c) for c in order])


def split_duplicates(rows: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """Adds is_duplicate: true for all but the first owner of a digest."""
    first = rows.groupBy(digest).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(first, digest).withColumn("is_duplicate", F.struct(*order) != F.col("_first")).drop("_first")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; must be empty at a gate."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def excluded(rows: DataFrame, exclusions: DataFrame, key: str) -> DataFrame:
    """Rows without those of the exclusion list."""
    return rows.join(exclusions.select(key).distinct(), key, "left_anti")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that aren't exactly once on both sides."""
    a, b = (x.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((left, "in_left"), (right, "in_right")))
    both = a.join(b, key, "full").select(key, F.coalesce("in_left", F.lit(0)).alias("in_left"), F.coalesce("in_right", F.lit(0)).alias("in_right"))
    return both.where("in_left <> 1 OR in_right <> 1")


def require_coverage(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise unless both tables hold the same keys once."""
    bad = coverage(left, right, key).limit(5).collect()
    if bad:
        raise CoverageError(f"{key} isn't covered exactly once: {[r[key] for r in bad]}")


def overlap(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """For each key column, how many rows of `new` share it with `old`, and how many repeat it within `new`."""
    out = None
    for k in keys:
        shared = new.join(old.select(k).distinct(), k, "left_semi").agg(F.count(F.lit(1)).alias("shared"))
        twice = new.groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"))
        one = shared.join(twice, F.lit(True)).select(F.lit(k).alias("key"), "shared", "repeated")
        out = one if out is None else out.unionByName(one)
    return out


def subset_proof(subset: DataFrame, superset: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of the subset that the superset lacks or holds with other content (J11); must be empty."""
    s = superset.select(key, F.col(content).alias("_other"))
    return subset.join(s, key, "left").where(~F.col(content).eqNullSafe(F.col("_other"))).select(key, F.when(F.col("_other").isNull(), "absent").otherwise("changed").alias("problem"))


def mixture(mixed: DataFrame, original: DataFrame, key: str, content: str) -> DataFrame:
    """Counts of a mixture's retained, changed and new rows."""
    o = original.select(key, F.col(content).alias("_other"), F.lit(True).alias("_known"))
    m = mixed.join(o, key, "left")
    kind = F.when(F.col("_known").isNull(), "new").when(F.col(content).eqNullSafe(F.col("_other")), "retained").otherwise("changed")
    return m.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def matched_entries(left: DataFrame, right: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Pairs entries of equal content within a group, the k-th copy with the k-th (J6). Both: group, key, order."""
    w = Window.partitionBy(group, key).orderBy(order)
    a = left.select(group, key, F.col(order).alias("left_pos"), F.row_number().over(w).alias("nth"))
    b = right.select(group, key, F.col(order).alias("right_pos"), F.row_number().over(w).alias("nth"))
    return a.join(b, [group, key, "nth"])


def fills(accepted: DataFrame, slots: DataFrame, slot: str = "quota_slot_id") -> DataFrame:
    """Accepted rows on their slots, with a problem where a slot is unknown or filled more than once."""
    n = accepted.groupBy(slot).agg(F.count(F.lit(1)).alias("fills"))
    known = slots.select(F.col("id").alias(slot), F.lit(True).alias("_known"))
    return n.join(known, slot, "left").withColumn("problem", F.when(F.col("_known").isNull(), "unknown_slot").when(F.col("fills") > 1, "filled_twice")).drop("_known")


def distinct_responses(rows: DataFrame, attempt: str, fallback: list[str]) -> DataFrame:
    """One row for each observed response: by attempt id, else by the fallback columns."""
    key = F.coalesce(F.concat(F.lit("id:"), F.col(attempt).cast("string")), F.concat(F.lit("of:"), F.to_json(F.struct(*fallback), {"ignoreNullFields": "false"})))
    return rows.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")


def manifest_difference(expected: DataFrame, actual: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Files that are missing, unexpected or changed between two manifests."""
    a, b = expected.select(key, F.col(digest).alias("_a")), actual.select(key, F.col(digest).alias("_b"))
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem IS NOT NULL")


#: Items of one or two words that are compared with every text at once; more go in several blocks.
SHORT_ITEMS = 1_000


def contained(texts: DataFrame, items: DataFrame, key: str, text: str, item: str) -> DataFrame:
    """key and item of every text that holds an item literally.

    White space around the inner words of an item stands in the text too, so an item of three or more words is looked up by its longest inner word among the text's distinct words (a hash join), and verified
    on the rows that have it. Shorter items are compared with all texts, in blocks of SHORT_ITEMS.
    """
    words = F.split(F.col(item), r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    known = stored(items.select(F.col(item), longest.alias("_word")).distinct(), "items")
    anchored, short = known.where("_word IS NOT NULL"), known.where("_word IS NULL").select(item)
    has = texts.select(key, F.explode(F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"))).alias("_word"))
    pairs = has.join(small(anchored), "_word").select(key, item).distinct()
    out = texts.select(key, F.col(text).alias("_text")).join(pairs, key).where(F.contains("_text", F.col(item))).select(key, item)
    n = short.count()
    blocks = -(-n // SHORT_ITEMS)
    for b in range(blocks):
        some = F.broadcast(short.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b))
        out = out.unionByName(texts.join(some, F.contains(F.col(text), F.col(item))).select(key, item))
    return out
