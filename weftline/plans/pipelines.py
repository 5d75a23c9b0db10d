"""Queries that go through sources, sinks, the scorer seam, replay and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from weftline.operators import replay as R
from weftline.plans.catalog import query
from weftline.plans.standins import LOG_SQL, POOL_SQL, pool, table
from weftline.sources import records, shared
from weftline.streaming import logs


@query("jsonl_round_trip", "SELECT doc_id::VARCHAR AS id, sha256(coalesce(text, '')) AS digest, lang FROM documents")
def jsonl_round_trip(spark, d):
    """Rows written as JSON lines and read back with a fixed schema and the key gate."""
    path = shared.scratch(spark, "jsonl")
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang").write.mode("errorifexists").json(path)
    back = records.read_jsonl(spark, path, "id string, text string, lang string")
    return back.select("id", F.sha2("text", 256).alias("digest"), "lang")


@query("guarded_scan", f"WITH {POOL_SQL} SELECT id, family FROM pool WHERE split = 'train'")
def guarded_scan(spark, d):
    """The training rows after the gates of their scan."""
    records.require_training_path("data/train/rows")
    p = pool(spark, d)
    families = p.select("split", F.col("family").alias("family_id")).distinct()
    rows = p.where("split = 'train'").select(F.col("id").cast("string").alias("id"), F.col("family").alias("family_id"), "split")
    return records.guarded(rows, families, "train", declared="split").select(F.col("id").cast("long").alias("id"), F.col("family_id").alias("family"))


@query("published_snapshot", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def published_snapshot(spark, d):
    """All rows as an immutable snapshot, read from its place."""
    path = f"{shared.scratch(spark, 'published')}/stage"
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "lang")
    records.publish(rows, path, "doc_id", ["lang"])
    return spark.read.parquet(f"{path}/rows").select("doc_id", "digest")


@query("resume_scan", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def resume_scan(spark, d):
    """Rows that a stopped run hasn't scored."""
    docs = table(spark, d, "documents").select("doc_id")
    return records.not_yet(docs, docs.where("doc_id % 3 = 0"), "doc_id")


@query("batch_records", "SELECT doc_id::VARCHAR AS id, 'batch-' || (doc_id // 100) AS batch_id FROM documents")
def batch_records(spark, d):
    """One JSON record for each batch, with its accepted rows taken out."""
    path = shared.scratch(spark, "batches")
    b = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("batch-"), F.floor(F.col("doc_id") / 100).cast("string")).alias("batch_id"))
    b.groupBy("batch_id").agg(F.collect_list(F.struct("id")).alias("accepted"), F.lit("run").alias("run_id")).write.json(path)  # a batch has a fixed size
    got = spark.read.schema("batch_id string, run_id string, accepted array<struct<id:string>>").json(path)
    return got.where("run_id = 'run'").select("batch_id", F.inline("accepted")).select("id", "batch_id")


@query("scorer_connector", "SELECT doc_id, CASE WHEN doc_id % 50 <> 7 THEN len(coalesce(text, ''))::DOUBLE END AS score, CASE WHEN doc_id % 50 = 7 THEN 'ValueError: refused' END AS error FROM documents")
def scorer_connector(spark, d):
    """A scorer that refuses some rows; its failures are rows."""
    def scorer(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["doc_id"] % 50 == 7).any():
            raise ValueError("refused")
        return pd.DataFrame({"doc_id": rows["doc_id"], "score": rows["text"].str.len().astype(float)})

    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return records.score_with(docs, scorer, "doc_id long, score double", "doc_id")


@query("final_event_check", "SELECT user_id, count(*) FILTER (event_type = 'purchase' AND event_id % 3 = 0)::BIGINT AS finals FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase' AND event_id % 3 = 0) <> 1")
def final_event_check(spark, d):
    """Attempts without exactly one final event."""
    e = table(spark, d, "events").withColumn("role", F.when(F.col("event_id") % 3 == 0, "assistant").otherwise("user"))
    return R.final_events(e, "user_id", "event_type", "role", "purchase")


@query("hardened_acceptance", """WITH g AS (SELECT event_type AS grp, count(*) AS n, avg(value) AS m0, avg(value) + CASE WHEN event_type = 'click' THEN -1 ELSE 1 END AS m1 FROM events GROUP BY 1 UNION ALL SELECT 'overall', count(*), avg(value), avg(value) + 0.5 FROM events)
SELECT bool_or(grp = 'overall' AND m1 > m0) AS improved, count(*) FILTER (grp <> 'overall' AND n >= 20 AND m0 - m1 > 0.05)::BIGINT AS dropped_groups, bool_or(grp = 'overall' AND m1 > m0) AND count(*) FILTER (grp <> 'overall' AND n >= 20 AND m0 - m1 > 0.05) = 0 AS accepted FROM g""")
def hardened_acceptance(spark, d):
    """R16, J17."""
    e = table(spark, d, "events")
    g = e.groupBy(F.col("event_type").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("metric")).unionByName(e.agg(F.lit("overall").alias("grp"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("metric")))
    after = g.withColumn("metric", F.col("metric") + F.when(F.col("grp") == "click", -1.0).when(F.col("grp") == "overall", 0.5).otherwise(1.0))
    return R.hardened_acceptance(g, after)


@query("decisions_by_content", """WITH r AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS c FROM documents), a AS (SELECT c, count(*) AS n FROM r WHERE id % 10 <> 3 GROUP BY 1)
SELECT id, CASE WHEN n IS NULL THEN 'undecided' ELSE 'decided_twice' END AS problem FROM r LEFT JOIN a USING (c) WHERE n IS NULL OR n > 1""")
def decisions_by_content(spark, d):
    """Content that isn't decided exactly once."""
    label = F.struct(F.lit(None).cast("string").alias("abstain_reason"), F.array(F.lit("a")).alias("acceptable_ids"), F.lit("select").alias("decision"))
    r = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"), label.alias("label"))
    return R.decisions_by_content(r, r.where("id % 10 <> 3").select("content_sha256", "label"))


def in_files(df, order, name, n=4):
    """A table as some files, written one after the other in an order, so that streams carry state from batch to batch. Returns the folder."""
    path, at = shared.scratch(df.sparkSession, name), F.col(order).cast("double")
    ends = df.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    step = ((ends["b"] or 0.0) - (ends["a"] or 0.0)) / n or 1.0
    part = F.least(F.floor((at - (ends["a"] or 0.0)) / step), F.lit(n - 1))
    for k in range(n):
        df.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return path


@query("stream_claims", "SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def stream_claims(spark, d):
    """Claims over a stream of files in id order, in two runs that share a place: the second finds nothing new and the claims stand."""
    docs = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "doc_id")
    path, place = in_files(docs, "doc_id", "claim-files"), shared.scratch(spark, "claims")
    for _ in range(2):
        out = logs.rolling_claims(logs.source(spark, path, docs.schema, 1), "digest", "doc_id", place=place)
    return out


@query("stream_pause_sessions", f"""WITH {LOG_SQL}, g AS (SELECT owner, started_at, CASE WHEN started_at - lag(started_at) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, max(started_at) OVER () AS top FROM log WINDOW w AS (PARTITION BY owner ORDER BY started_at)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY started_at RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT owner AS user_id, min(started_at) AS first, max(started_at) AS last, count(*)::BIGINT AS events FROM s GROUP BY owner, k, top HAVING max(started_at) + INTERVAL 6 HOUR <= top - INTERVAL 1 DAY""")
def stream_pause_sessions(spark, d):
    """Session windows that the watermark, a day behind the newest event, has passed."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = logs.source(spark, in_files(e, "ts", "session-files"), e.schema, 1)
    out = logs.pause_sessions(s, "user_id", "ts", "6 hours")
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "events")


@query("stream_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    """Counts by day and type; state goes once the watermark has passed a day."""
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    s = logs.source(spark, in_files(e, "ts", "window-files"), e.schema, 1)
    return logs.windowed_counts(s, "ts", "1 day", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_STEP = "row_number() OVER (PARTITION BY {k} ORDER BY ts, event_id) AS r"


@query("stream_first_alerts", f"""WITH RECURSIVE e AS (SELECT user_id % 7 AS k, event_type, event_id, epoch_us(ts) AS t, {_STEP.format(k='user_id % 7, event_type')} FROM events),
s AS (SELECT k, event_type, event_id, r, t AS last, TRUE AS hit FROM e WHERE r = 1 UNION ALL SELECT e.k, e.event_type, e.event_id, e.r, CASE WHEN e.t - s.last >= 36000000000 THEN e.t ELSE s.last END, e.t - s.last >= 36000000000 FROM s JOIN e ON e.k = s.k AND e.event_type = s.event_type AND e.r = s.r + 1)
SELECT k, event_type, event_id FROM s WHERE hit""")
def stream_first_alerts(spark, d):
    """T5: alerts of a key at least ten hours apart, with state carried over four batches."""
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("k"), "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    s = logs.source(spark, in_files(e, "ts", "alert-files"), e.schema, 1)
    return logs.alerts(s, ["k", "event_type"], "ts", ["event_id"], 36_000).select("k", "event_type", "event_id")


@query("stream_failure_streaks", """WITH f AS (SELECT user_id, ts, event_id, (event_id % 3 <> 0)::INT AS f, sum((event_id % 3 = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
h AS (SELECT user_id, island, sum(f) AS streak FROM f GROUP BY user_id, island), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY island DESC) AS r FROM h)
SELECT user_id, streak::BIGINT AS streak, CASE WHEN streak > 0 THEN least(900.0::DOUBLE, 60 * pow(2.0::DOUBLE, least(streak - 1, 4))) ELSE 0.0::DOUBLE END AS pause FROM g WHERE r = 1""")
def stream_failure_streaks(spark, d):
    """T4: keyed state over the log, carried over four batches."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_id") % 3 != 0).alias("failed"))
    s = logs.source(spark, in_files(e, "ts", "streak-files"), e.schema, 1)
    return logs.failure_streaks(s, "user_id", "failed", ["ts", "event_id"])


@query("lease_admissions", f"""WITH RECURSIVE e AS (SELECT user_id % 7 AS k, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, (value * 40)::DOUBLE AS need, event_id % 9 = 0 AS bad, {_STEP.format(k='user_id % 7')} FROM events),
z AS (SELECT k, 0::BIGINT AS r, 0::BIGINT AS event_id, -1e18::DOUBLE AS start, -1e18::DOUBLE AS until, []::DOUBLE[] AS leases, '' AS said FROM e WHERE r = 1
UNION ALL SELECT k, r, event_id, CASE WHEN word = 'admitted' THEN t + 900 ELSE start END, CASE WHEN word = 'admitted' AND bad THEN greatest(until, t + need + 3600) ELSE until END, CASE WHEN word = 'admitted' THEN list_append(live, t + least(need, 40000)) ELSE live END, word
FROM (SELECT *, CASE WHEN t < until THEN 'cooldown' WHEN t < start THEN 'interval' WHEN len(live) >= 2 THEN 'cap' ELSE 'admitted' END AS word FROM (SELECT e.k, e.r, e.event_id, e.t, e.need, e.bad, z.start, z.until, list_filter(z.leases, lambda x: x > e.t) AS live FROM z JOIN e ON e.k = z.k AND e.r = z.r + 1)))
SELECT k, event_id, said, len(leases)::INT AS in_flight FROM z WHERE r > 0""")
def lease_admissions(spark, d):
    """Requests of seven accounts against two leases each, an interval between starts, and a cooldown after failures."""
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("k"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"), (F.col("value") * 40).cast("double").alias("need"), (F.col("event_id") % 9 == 0).alias("bad"))
    s = logs.source(spark, in_files(e, "at", "lease-files"), e.schema, 1)
    return logs.admissions(s, "k", ["event_id"], "at", "need", "bad", cap=2, interval=900.0, longest=40_000.0, cooldown=3600.0)
