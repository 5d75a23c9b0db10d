"""Descriptions and composition gates of a pool: difficulty, distributions, allocation and coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.expr import flag, ratio


def difficulty(df: DataFrame, fields: Column, plain: Column | None = None) -> DataFrame:
    """By family and overall: answerable episodes, positives that stand literally in a visible field, same-kind negatives, several positives.

    fields: array of visible texts. plain: predicate column factory over entries is fixed to text entries where capabilities exist.
    """
    positive = lambda e: F.array_contains("label.acceptable_ids", e["id"])
    good = F.filter("entries", positive)
    exact = F.exists(good, lambda e: (e["text"] != "") & F.exists(fields, lambda f: F.contains(f, e["text"])))
    kinds = F.transform(good, lambda e: e["kind"])
    hard = F.exists("entries", lambda e: ~positive(e) & F.array_contains(kinds, e["kind"]))
    s = df.where(F.col("label.decision") == "select").select("family", exact.alias("exact"), hard.alias("hard"), (F.size(good) > 1).alias("several"))
    level = F.when(F.grouping("family") == 1, "overall").otherwise("family")
    return s.rollup("family").agg(level.alias("level"), F.count(F.lit(1)).alias("select_episodes"), F.sum(flag(F.col("exact"))).alias("exact_positive"), F.sum(flag(F.col("hard"))).alias("same_kind_negative"), F.sum(flag(F.col("several"))).alias("multiple_positive"))


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the values of several columns in one pass, long form."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *columns)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        name, value = F.when(F.grouping(c) == 0, c).otherwise(name), F.when(F.grouping(c) == 0, F.col(c).cast("string")).otherwise(value)
    return sets.agg(name.alias("dimension"), value.alias("value"), F.count(F.lit(1)).alias("n")).select("dimension", F.coalesce("value", F.lit("none")).alias("value"), "n")


def as_map(df: DataFrame, key: str, n: str = "n") -> Column:
    """A small table of counts as one map, for manifests."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, n))))


def cross_tab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of a fixed list of values side by side."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def pool_quality(df: DataFrame) -> DataFrame:
    """Selected, selected with a context, selected with every candidate acceptable, mean acceptable share."""
    sel = F.col("label.decision") == "select"
    share = F.size("label.acceptable_ids") / F.size("entries")
    return df.agg(F.count_if(sel).alias("selected"), F.count_if(sel & F.col("has_context")).alias("selected_with_context"), F.count_if(sel & (share == 1)).alias("all_acceptable"), F.avg(F.when(sel, share)).alias("mean_acceptable_share"))


def allocation_mismatch(df: DataFrame, quotas: DataFrame, keys: list[str]) -> DataFrame:
    """Strata whose count isn't the quota, either way (A27). quotas: keys, quota."""
    have = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"))
    both = have.join(quotas, keys, "full").select(*keys, F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("quota", F.lit(0)).alias("quota"))
    return both.where("have <> quota")


def composition_gate(df: DataFrame, shares: dict[str, float], slack: float = 0.025) -> DataFrame:
    """Each bucket's share against its target, and whether it's within the slack."""
    n = df.agg(F.count(F.lit(1)).alias("total"))
    out = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(n, F.lit(True))
    target = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("bucket"))
    return out.withColumns({"share": ratio(F.col("n"), F.col("total")), "target": target}).withColumn("within", F.abs(F.col("share") - F.col("target")) <= slack).drop("total")


def coverage_gate(df: DataFrame, families: int, sizes: int) -> DataFrame:
    """Whether all families and all candidate counts occur."""
    got = df.agg(F.count_distinct("family").alias("families"), F.count_distinct(F.size("entries")).alias("sizes"), F.max(F.size("entries")).alias("largest"))
    return got.withColumn("covered", (F.col("families") == families) & (F.col("sizes") >= sizes))
