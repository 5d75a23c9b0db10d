"""Positions in a global order without one task that sees all rows: range partitions, ranked each, with the sizes before them added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.shared import stored

_ROW = 33  # bits of a row number within a partition in monotonically_increasing_id()


def ranked(df: DataFrame, order: list[Column], name: str = "position", sums: dict[str, str] | None = None) -> DataFrame:
    """Adds the position (from 0) of each row in the order, and running sums of columns (name: column), the row included.

    The order must end in a unique key. Rows go to as many sorted ranges as the shuffle has partitions; only one row for each range is
    summed up, whatever the number of rows. The ranges are stored, so that positions hold if an executor is lost.
    """
    part = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = part.withColumn("_range", F.shiftright("_at", _ROW))
    sums = sums or {}
    size = part.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    size = size.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("_n", "_before"), *[(f"_sum_{n}", f"_before_{n}") for n in sums])])
    out = part.join(F.broadcast(size), "_range")
    own = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    added = {name: F.col("_before") + F.col("_at").bitwiseAND((1 << _ROW) - 1)} | {n: F.sum(c).over(own) + F.col(f"_before_{n}") for n, c in sums.items()}
    return out.withColumns(added).drop("_at", "_range", "_before", *[f"_before_{n}" for n in sums])
