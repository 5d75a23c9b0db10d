"""Rollups of request logs: tokens, provenance, throughput, streaks and restart budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.expr import ratio
from weftline.operators.ranks import ranked


#: Windows in a span of recent().
SPAN = 24


def rollup(log: DataFrame, phase: str = "phase", model: str = "model") -> DataFrame:
    """Tokens by total, phase and model in one pass (A20). A missing counter is counted as missing, never as 0."""
    sets = log.groupingSets([[], [F.col(phase)], [F.col(model)]], phase, model)
    level = F.when(F.grouping(phase) == 0, "phase").when(F.grouping(model) == 0, "model").otherwise("total")
    known = F.col("reasoning").isNotNull()
    return sets.agg(level.alias("level"), F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), F.coalesce(F.sum("reasoning"), F.lit(0)).alias("reasoning"), F.count_if(known).alias("reasoning_known"), F.count_if(~known).alias("reasoning_missing"), F.count_if(F.col("status") == "failed").alias("failed"))


def by_status(log: DataFrame, referenced: DataFrame, key: str = "audit_id") -> DataFrame:
    """Requests and tokens by phase and status, and how many are referenced by rows."""
    r = log.join(referenced.select(key, F.lit(1).alias("_r")).distinct(), key, "left")
    return r.groupBy("phase", "status").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), F.count("_r").alias("referenced"))


def throughput(log: DataFrame, accepted: Column, started: str = "started_at") -> DataFrame:
    """Accepted rows by hour of the window, tokens for each accepted row, and medians by phase."""
    n = F.count_if(accepted)
    hours = (F.unix_micros(F.max(started)) - F.unix_micros(F.min(started))) / F.lit(3.6e9)
    return log.groupBy("phase").agg(n.alias("accepted"), F.count(F.lit(1)).alias("requests"), ratio(n, hours).alias("accepted_per_hour"), ratio(F.sum("tokens"), n).alias("tokens_per_accepted"), F.median("tokens").alias("median_tokens"))


def histogram(rows: DataFrame, reason: str) -> DataFrame:
    """Rows by reason."""
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def sources_by_role(rows: DataFrame, log: DataFrame, roles: list[str]) -> DataFrame:
    """Teacher sources of each role column (J15, A24): roles become rows, then one join."""
    long = rows.unpivot([], roles, "role", "audit_id").where("audit_id IS NOT NULL")
    return long.join(log.select("audit_id", "model"), "audit_id").groupBy("role", "model").agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The row of the greatest order in each key, ties by the columns."""
    best = F.max(F.struct(order, *columns))
    return rows.groupBy(key).agg(best.alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in (order, *columns)])


def recent(log: DataFrame, key: str, seconds: int = 3600, started: str = "started_at") -> DataFrame:
    """Adds `recent`, the events of the key in the window that ends with each event.

    The log is cut into spans of SPAN windows, each with the events of one window before it, so that a key with very many events is several tasks' work.
    """
    reach, span = seconds * 1_000_000, seconds * 1_000_000 * SPAN
    at = F.unix_micros(started)
    own = F.floor(at / span).cast("long")
    both = log.withColumn("_own", own).withColumn("_span", F.explode(F.when(F.floor((at + reach) / span) > own, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(key, "_span").orderBy(F.unix_micros(started)).rangeBetween(-reach, 0)
    return both.withColumn("recent", F.count(F.lit(1)).over(w)).where("_span = _own").drop("_own", "_span")


def streaks(log: DataFrame, key: str, failed: Column, order: list[str], base: int = 60, cap: int = 900) -> DataFrame:
    """Adds streak (failures in a row up to here) and pause, base * 2 ** min(streak - 1, 4) up to a cap; success resets both (T4)."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum((~failed).cast("int")).over(w)
    g = log.withColumns({"_f": failed.cast("int"), "_island": island})
    streak = F.sum("_f").over(Window.partitionBy(key, "_island").orderBy(*order))
    g = g.withColumn("streak", F.when(failed, streak).otherwise(0))
    pause = F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.least(F.col("streak") - 1, F.lit(4))))
    return g.withColumn("pause", F.when(F.col("streak") > 0, pause).otherwise(0.0)).drop("_f", "_island")


def sessions(log: DataFrame, key: str, gap_seconds: int, started: str = "started_at") -> DataFrame:
    """Runs of events with gaps shorter than a bound: start, end, events (T9, in batch)."""
    s = log.groupBy(key, F.session_window(started, f"{gap_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max(started).alias("last"))
    return s.select(key, F.col("w.start").alias("first"), "last", "events")


def next_action(completion: Column, running: Column, locked: Column, paused: Column, restarts: Column, most: int = 3) -> Column:
    """What a supervisor does next, first rule first."""
    return (
        F.when(completion.isNotNull() & ~running, completion).when(completion.isNotNull(), F.concat(F.lit("finishing_"), completion)).when(running, "running_or_waiting_for_provider")
        .when(locked, "another_producer_holds_split_lock").when(paused, "waiting_for_shared_provider").when(restarts >= most, "restart_limit_requires_review").otherwise("launch")
    )


def effort(rows: DataFrame) -> DataFrame:
    """Matches, valid answers, format failures, tokens and median seconds by effort (A25). rows: effort, matched, valid, tokens, seconds."""
    return rows.groupBy("effort").agg(F.count_if("matched").alias("matched"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("format_failures"), F.sum("tokens").alias("tokens"), F.median("seconds").alias("median_seconds"))


def cheapest(rows: DataFrame, choice: str, cost: str) -> DataFrame:
    """The choice of the least cost, ties to the smallest choice."""
    return rows.agg(F.min_by(choice, F.struct(cost, choice)).alias(choice), F.min(cost).alias(cost))


def best_checkpoint(rows: DataFrame, group: str) -> DataFrame:
    """Of each group the epoch with the greatest (metric, accuracy, -loss), ties to the earliest."""
    return rows.groupBy(group).agg(F.max_by("epoch", F.struct("metric", "accuracy", -F.col("loss"), -F.col("epoch"))).alias("epoch"), F.max("metric").alias("metric"))


def updates(n_rows: Column, epochs: Column, effective_batch: Column, warmup: Column) -> dict[str, Column]:
    """Optimizer steps and episodes seen that a completed stage must show (A34). Warm-up steps cycle through the whole data, its short last batch included."""
    per_epoch = F.ceil(n_rows / effective_batch).cast("long")
    cycles, rest = F.floor(warmup / per_epoch), warmup % per_epoch
    return {"steps_per_epoch": per_epoch, "steps": (warmup + per_epoch * epochs).cast("long"), "seen": (cycles * n_rows + F.least(n_rows, rest * effective_batch) + n_rows * epochs).cast("long")}


def worker_budget(split: Column, ceiling: Column, most: int, initial: dict[str, int], borrowed: int, finished: Column, ready: Column) -> Column:
    """Workers that a split may use now (T8): its own, for training also those of finished splits, within the ceiling and the executor's; none while its gate isn't ready."""
    own = F.coalesce(*[F.when(split == k, v) for k, v in initial.items()], F.lit(0)) + F.when(split == "train", borrowed * finished).otherwise(0)
    return F.when(ready, F.least(ceiling, F.lit(most), own)).otherwise(0).cast("long")


def bucketed_order(rows: DataFrame, key: str, length: str, window: int) -> DataFrame:
    """Adds position: hash order in blocks of `window` rows, each block by length."""
    r = ranked(rows.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)), [F.col("_h")], "_rank")
    r = r.withColumn("block", F.floor(F.col("_rank") / window).cast("long"))
    inner = F.row_number().over(Window.partitionBy("block").orderBy(length, "_h")) - 1  # a block has a fixed size
    return r.withColumn("position", F.col("block") * window + inner).drop("_h", "_rank")


def quantile_rows(rows: DataFrame, order: str, key: str, n: int = 16) -> DataFrame:
    """n rows evenly spaced in the order, both ends included (W6); positions round half to even."""
    total = rows.count()
    if not total:
        return rows.limit(0)
    at = sorted({round(i * (total - 1) / (n - 1)) for i in range(n)})
    return ranked(rows, [F.col(order), F.col(key)]).where(F.col("position").isin(at))
