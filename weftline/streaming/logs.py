"""Structured Streaming over append-only logs and record folders: claims, rolling pools, sessions, alerts, streaks, leases.

Every stream reads what is there and stops (availableNow), so a scheduler can run it again. With a fixed `place`, its checkpoint and its
results stay there, and the next run takes up new files only; without one it starts anew in the shared folder. Results are deltas, one
folder for each batch, so a repeated batch writes the same and nothing is rewritten; a view puts the deltas together. Results that
depend on order take it from the rows (arrival, event time), not from the order within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.session import ship
from weftline.sources.shared import Store, scratch


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A folder's Parquet files, or a single one, as a stream."""
    store = Store(spark, path)
    if store.exists(path) and store.fs.getFileStatus(store.path(path)).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a pattern, since the source takes no plain file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run(stream: DataFrame, name: str, mode: str = "append", place: str | None = None) -> DataFrame:
    """Process all there is, batch by batch, and stop. Returns all deltas so far, with the number of their batch."""
    spark = stream.sparkSession
    place = place or scratch(spark, name)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/deltas/batch={number}")

    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    if not Store(spark, place).exists(f"{place}/deltas"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{place}/deltas").parquet(f"{place}/deltas")


def rolling_claims(stream: DataFrame, digest: str, owner: str, arrival: str | None = None, place: str | None = None) -> DataFrame:
    """First owner of each digest over all batches and runs (T1, T2). The first is the smallest (arrival, owner), where an arrival grows with the files; a crashed run's batch is repeated whole by the next.

    The claim of a digest is kept in the state store; what changes in a batch is its delta.
    """
    order = [*([arrival] if arrival else []), owner]
    first = stream.groupBy(digest).agg(F.min(F.struct(*order)).alias("first")).select(digest, *[F.col(f"first.{c}").alias(c) for c in order])
    deltas = run(first, "claims", "update", place)
    return deltas.groupBy(digest).agg(F.min(F.struct(*order)).alias("first")).select(digest, F.col(f"first.{owner}").alias(owner))


def pause_sessions(stream: DataFrame, key: str, time: str, gap: str, late: str = "1 day", place: str | None = None) -> DataFrame:
    """Session windows over event time (T9): finished ones, and at the end those still open. State is bounded by the watermark.

    A session goes out once the watermark has passed it; what is still open is taken from the rows that no finished session covers.
    """
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    s = s.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max(time).alias("last"))
    return run(s.select(key, F.col("w.start").alias("first"), "last", "events"), "sessions", "append", place).drop("batch")


def alerts(stream: DataFrame, keys: list[str], time: str, order: list[str], seconds: int = 300, place: str | None = None) -> DataFrame:
    """Which events of a key are tried as alerts (T5): those at least `seconds` after the last one tried. Keyed state of one time; events are taken in event order within a batch."""
    ship(stream.sparkSession)
    fields = [*keys, *order, time]
    schema = T.StructType([stream.schema[f] for f in dict.fromkeys(fields)])

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([time, *order], kind="stable")
        at, keep = rows[time].astype("int64") // 1000 if rows[time].dtype == "datetime64[ns]" else rows[time].astype("datetime64[us]").astype("int64"), []
        for x in at:
            hit = last is None or x - last >= seconds * 1_000_000
            last = x if hit else last
            keep.append(hit)
        if last is not None:
            state.update((int(last),))
        yield rows[keep][schema.fieldNames()]

    s = stream.select(*schema.fieldNames()).groupBy(*keys).applyInPandasWithState(step, schema, "last long", "update", GroupStateTimeout.NoTimeout)
    return run(s, "alerts", "update", place).drop("batch")


def windowed_counts(stream: DataFrame, time: str, window: str, keys: list[str], late: str = "7 days", place: str | None = None) -> DataFrame:
    """Counts by tumbling window and keys (A35). A window's last count stands; its state goes once the watermark has passed."""
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    deltas = run(s.select(F.col("w.start").alias("start"), *keys, "n"), "windows", "update", place)
    return deltas.groupBy("start", *keys).agg(F.max("n").alias("n"))


def failure_streaks(stream: DataFrame, key: str, failed: str, order: list[str], place: str | None = None) -> DataFrame:
    """Failures in a row at the end of each key's log, and the pause they call for (T4): keyed state of one number, updated in event order within a batch."""
    ship(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        for f in sorted((x for p in frames for x in p[[*order, failed]].itertuples(index=False, name=None))):
            streak = streak + 1 if f[-1] else 0
        state.update((streak,))
        yield pd.DataFrame({key: [k[0]], "streak": [streak], "pause": [min(900.0, 60.0 * 2.0 ** min(streak - 1, 4)) if streak else 0.0]})

    s = stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, streak long, pause double", "streak long", "update", GroupStateTimeout.NoTimeout)
    return run(s, "streaks", "update", place).groupBy(key).agg(F.max_by("streak", "batch").alias("streak"), F.max_by("pause", "batch").alias("pause"))


def admissions(stream: DataFrame, key: str, order: list[str], at: str, seconds: str, failed: str, cap: int = 2, interval: float = 0.5, longest: float = 120.0, cooldown: float = 300.0, place: str | None = None) -> DataFrame:
    """What an account's coordinator says to each request of a log (T3): admitted, or why it has to wait: cooldown, interval or cap.

    Times are seconds. An admitted request holds a lease until it ends, `longest` at most; the next one may start `interval` later; a failed one starts a cooldown at its end.
    Keyed state: the next start, the cooldown's end, at most `cap` leases. Requests are taken in order within a batch.
    """
    ship(stream.sparkSession)
    schema = T.StructType([stream.schema[key], *[stream.schema[o] for o in order], T.StructField("said", T.StringType()), T.StructField("in_flight", T.IntegerType())])

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, until, leases = (*state.get[:2], list(state.get[2])) if state.exists else (float("-inf"), float("-inf"), [])
        rows = pd.concat(list(frames)).sort_values([at, *order], kind="stable")
        said, flying = [], []
        for now, wanted, bad in zip(rows[at], rows[seconds], rows[failed], strict=True):
            leases = [x for x in leases if x > now]
            word = "cooldown" if now < until else "interval" if now < start else "cap" if len(leases) >= cap else "admitted"
            if word == "admitted":
                leases.append(now + min(wanted, longest))
                start = now + interval
                if bad:
                    until = max(until, now + wanted + cooldown)
            said.append(word)
            flying.append(len(leases))
        state.update((start, until, leases))
        yield rows[[key, *order]].assign(said=said, in_flight=flying)[schema.fieldNames()]

    s = stream.groupBy(key).applyInPandasWithState(step, schema, "start double, until double, leases array<double>", "update", GroupStateTimeout.NoTimeout)
    return run(s, "admissions", "update", place).drop("batch")
