"""What the operators of this subpackage share: tables, checkpoints in the shared folder, size-checked joins, Arrow maps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import ship
from weftline.sources.shared import Store, scratch, shared_dir

#: At most this many 8-byte keys are broadcast (32 MB); a larger table goes through a shuffled join.
BROADCAST_KEYS = 2_000_000
#: Rows of one key that a task of a join may hold; more are dealt over salts.
HOT_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_weftline_path", None)
        if path:
            Store(df.sparkSession, path).delete(path)


def by_ids(df: DataFrame, ids: DataFrame, how: str, on: str, bound: int = BROADCAST_KEYS) -> DataFrame:
    """Semi or anti join on a materialized key table: broadcast if its counted rows stay below the bound, else shuffled."""
    ids = ids.select(on)
    return df.join(F.broadcast(ids) if ids.count() <= bound else ids.hint("merge"), on, how)


def hot_join(many: DataFrame, few: DataFrame, on: list[str], spread: str, counts: DataFrame | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join of materialized `many` with `few`, which has one row for each key: the rows of a key that has more than `hot` of them are
    dealt over salts by the hash of `spread`, and the key's row of `few` goes to each salt. counts: the keys with c, their rows, if known."""
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("c")) if counts is None else counts.select(*on, "c")
    counts = materialize(counts.where(F.col("c") > hot).select(*on, F.ceil(F.col("c") / hot).cast("int").alias("_salts")), "hot")
    n = counts.count()
    if not n:
        release(counts)
        return many.join(few, on)
    if n <= BROADCAST_KEYS:
        left, right = (x.join(F.broadcast(counts), on, "left") for x in (many, few))
    else:  # too many hot keys for a broadcast: every key takes the same number of salts
        left, right = (x.withColumn("_salts", F.lit(64)) for x in (many, few))
    size = F.coalesce("_salts", F.lit(1))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), size).cast("int")).drop("_salts")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), size - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"]).drop("_salt")


def most_frequent(counted: DataFrame, count: str, bound: int) -> DataFrame:
    """The rows with the largest counts, `bound` at most: a histogram of counts (some hundred rows) gives the cut, so nothing is sorted. Equal counts stay or go together."""
    step = F.floor(F.log2(count) * 16).cast("int")
    left, cut = bound, 0
    for r in sorted(counted.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["s"]):
        left -= r["n"]
        if left < 0:
            cut = r["s"] + 1
            break
    return counted.where(step >= cut)


def whole_number_ids(df: DataFrame, id_col: str) -> None:
    """Refuse ids that aren't whole numbers, which a cast would turn into nulls."""
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be a whole number, not {df.schema[id_col].dataType.simpleString()}")


def give_back() -> None:
    """Return freed memory to the system at a task's end: workers live on, and their heaps would add up over the stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """What a worker process keeps for one kind of work (models, caches); arrow_map() drops the other kinds at a task's start, for workers live through all stages."""
    return _kept.setdefault(kind, {})


def keep_only(kind: str | None) -> None:
    others = [k for k in _kept if k != kind]
    for k in others:
        del _kept[k]
    if others:
        give_back()


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str, keep: str | None = None) -> DataFrame:
    """fn on every Arrow batch of df. keep: the kind of kept() that fn uses."""

    def run(batches):
        keep_only(keep)
        for b in batches:
            out = fn(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


__all__ = ["arrow_map", "by_ids", "give_back", "hot_join", "keep_only", "kept", "materialize", "most_frequent", "release", "shared_dir", "table", "whole_number_ids"]
