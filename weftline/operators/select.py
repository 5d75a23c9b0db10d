"""Deterministic selection: stratified takes, round-robin turns, nested stages, splits and samples by hash.

All orders end in a unique key, so results don't depend on partitioning. Ranks within a stratum are windows partitioned by it; the
global turn order of round_robin() ranks only the rows that can still be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_hash(key: str, salt: str = "") -> Column:
    """The order of SHA-256 of a key."""
    return F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)


def first_rows(df: DataFrame, strata: list[str], order: list[Column], most: int, rank: str) -> DataFrame:
    """The first `most` rows of each stratum with their rank. The limit is a constant on the rank, so that each task keeps that many rows of a stratum before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col(rank) <= most)


def take_quota(df: DataFrame, quotas: DataFrame, strata: list[str], order: list[Column], quota: str = "quota") -> DataFrame:
    """The first `quota` rows of each stratum (W3). quotas has one row for each stratum. First the largest quota cuts every stratum on the map side, then each its own."""
    most = quotas.agg(F.max(quota)).first()[0] or 0
    first = first_rows(df, strata, order, int(most), "_rank")
    return first.join(small(quotas), strata).where(F.col("_rank") <= F.col(quota)).drop("_rank", quota)


def small(df: DataFrame, bound: int = 100_000) -> DataFrame:
    """A dimension, broadcast if its counted rows stay below the bound."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def shortages(df: DataFrame, quotas: DataFrame, strata: list[str], quota: str = "quota") -> DataFrame:
    """Strata that hold fewer rows than their quota; must be empty before a snapshot."""
    have = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("have"))
    return quotas.join(have, strata, "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < F.col(quota))


def round_robin(df: DataFrame, within: list[str], families: list[str], order: list[Column], n: int) -> DataFrame:
    """n rows of each group of `within`, one of each family in turns (W4, W5). Adds `turn`.

    Only rows whose turn is at most n can be taken; these are ranked. Without `within` the last step is a plain top-n.
    """
    turn = F.row_number().over(Window.partitionBy(*within, *families).orderBy(*order))
    first = df.withColumn("turn", turn).where(F.col("turn") <= n)
    last = [F.col("turn"), *map(F.col, families)]
    if not within:
        return first.orderBy(*last).limit(n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy(*last))).where(F.col("_r") <= n).drop("_r")


def sampled(key: Column, share: float) -> Column:
    """A fixed sample by the first 32 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0) < share


def half_of_families(families: DataFrame, salt: str, key: str = "family") -> DataFrame:
    """Families in salted hash order: the first half fits, the other sets the threshold (W9). `families` has one row for each."""
    h = F.sha2(F.concat(F.lit(salt), F.col(key)), 256)
    ranked = families.withColumn("_r", F.row_number().over(Window.orderBy(h)))
    return ranked.withColumn("half", F.when(F.col("_r") * 2 <= F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))), "fit").otherwise("threshold")).drop("_r")


def nested_stage(df: DataFrame, sizes: list[int], strata: list[str], order: list[Column]) -> DataFrame:
    """Rows that some of the nested snapshots (rows of each stratum) holds, with stage_min, the smallest that does."""
    out = F.lit(None).cast("int")
    for size in sorted(sizes, reverse=True):
        out = F.when(F.col("_r") <= size, size).otherwise(out)
    return first_rows(df, strata, order, max(sizes), "_r").withColumn("stage_min", out).drop("_r")
