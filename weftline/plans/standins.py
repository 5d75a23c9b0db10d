"""Episodes, scores, labels and logs derived from the driver's tables, in Spark and in DuckDB SQL.

A conversation is an episode with its turns as entries; scores and labels are fixed functions of MD5 hashes, so both engines
compute the same. A document is a pool row: its source is the family, its labels the decision. Events are a request log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.expr import hash_unit

CALIBRATOR = {"mean": [0.2, 0.1, 5.0, 0.5], "scale": [0.3, 0.1, 2.0, 0.5], "coefficients": [1.2, 0.8, -0.1, -0.4], "intercept": 0.5, "threshold": 0.55}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str, salt: str = "ranker") -> DataFrame:
    """id, family, grp, entries, label, scores, abstain_score, error, latency_ms, has_context: one row per conversation."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    key = lambda *p: hash_unit(F.concat(F.col("id"), *[F.lit(f":{x}") if isinstance(x, str) else F.concat(F.lit(":"), x.cast("string")) for x in p]))
    c = c.withColumns({"score": key(F.col("turn"), salt), "acc": key(F.col("turn"), "acc")})
    e = c.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "score", "acc"))).alias("t"))  # an episode has 1 to 20 entries
    n = F.size("t")
    e = e.withColumns({"decide": key("label"), "abstain_score": key(f"{salt}:abstain"), "fail": key(f"{salt}:error"), "latency_ms": 5.0 + 100.0 * key(f"{salt}:latency")})
    picked = F.filter("t", lambda x, i: (x["acc"] < 0.3) | (i == F.col("id").cast("long") % n))
    decision = F.when(F.col("decide") < 0.7, "select").otherwise("abstain")
    reason = F.when(F.col("decide") < 0.7, F.lit(None)).when(F.col("decide") < 0.9, "no_match").when(F.col("decide") < 0.95, "ambiguous").otherwise("insufficient_context")
    name = lambda x: x["turn"].cast("string")
    return e.select(
        "id", F.concat(F.lit("fam"), (F.col("id").cast("long") % 12).cast("string")).alias("family"), F.when(F.col("id").cast("long") % 3 == 0, "zh").otherwise("en").alias("grp"),
        F.transform("t", lambda x: F.struct(name(x).alias("id"), x["role"].alias("kind"), x["text"].alias("text"))).alias("entries"),
        F.struct(reason.alias("abstain_reason"), F.when(decision == "select", F.transform(picked, name)).otherwise(F.array().cast("array<string>")).alias("acceptable_ids"), decision.alias("decision")).alias("label"),
        F.transform("t", lambda x, i: F.struct(name(x).alias("id"), i.alias("pos"), x["score"].alias("score"))).alias("scores"), "abstain_score",
        F.when(F.col("fail") < 0.03, "timeout").alias("error"), "latency_ms", F.exists("t", lambda x: x["role"] == "system").alias("has_context"),
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, family, ord, split, decision, reason, bucket, text, lang, labelled: one row per document."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    o = F.substring("source", 4, 9).cast("int")
    decision = F.when(F.col("toxic") == 1, "abstain").when(F.col("quality") == 1, "select").when(F.col("quality").isNotNull(), "abstain")
    reason = F.when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 0, "no_match")
    split = F.when(o < 12, "train").when(o < 14, "dev").when(o < 18, "calibration").otherwise("test")
    return d.join(y, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("family"), o.alias("ord"), split.alias("split"), decision.alias("decision"), reason.alias("reason"),
        F.when(decision == "select", "select").when(reason == "no_match", "no_match").when(decision.isNotNull(), "missing_intent").alias("bucket"), F.coalesce("text", F.lit("")).alias("text"), "lang",
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit_id, phase, owner, tokens, reasoning, started_at, status, model: one row per event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("audit_id"), F.col("event_type").alias("phase"), F.col("user_id").alias("owner"), F.floor(F.col("value") * 10).cast("long").alias("tokens"),
        F.when(k % 5 != 0, k).alias("reasoning"), F.col("ts").cast("timestamp").alias("started_at"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("completed").alias("status"),
        F.concat(F.lit("model"), (F.col("user_id") % 3).cast("string")).alias("model"),
    )


# --- the same in DuckDB ---

def unit(text: str) -> str:
    """hash_unit() of an SQL string expression."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)::DOUBLE"


def episode_sql(salt: str = "ranker", p: str = "") -> str:
    """CTEs {p}ent (one row per entry) and {p}ep (one row per episode)."""
    i = "conv_id::VARCHAR"
    return f"""
{p}ent AS (SELECT {i} AS id, turn::VARCHAR AS cand, role AS kind, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n, {unit(f"{i} || ':' || turn || ':{salt}'")} AS score, {unit(f"{i} || ':' || turn || ':acc'")} AS acc FROM conversations),
{p}ep AS (SELECT id, 'fam' || (id::BIGINT % 12) AS family, CASE WHEN id::BIGINT % 3 = 0 THEN 'zh' ELSE 'en' END AS grp, {unit("id || ':label'")} AS decide, {unit(f"id || ':{salt}:abstain'")} AS abstain,
    CASE WHEN {unit(f"id || ':{salt}:error'")} < 0.03 THEN 'timeout' END AS error, 5.0::DOUBLE + 100.0::DOUBLE * {unit(f"id || ':{salt}:latency'")} AS latency_ms, n, bool_or(kind = 'system') AS has_context
    FROM {p}ent GROUP BY id, n)"""


def decision_sql(salt: str = "ranker", p: str = "", calibrator: dict | None = None) -> str:
    """The CTEs of episode_sql() and {p}top, {p}dec, {p}out: features, decisions and outcome flags."""
    c = calibrator or CALIBRATOR
    x = [f"(coalesce({v}, 0) - ({m}::DOUBLE)) / ({s}::DOUBLE) * ({w}::DOUBLE)" for v, m, s, w in zip(("f0", "f1", "n::DOUBLE", "(NOT has_context)::INT::DOUBLE"), c["mean"], c["scale"], c["coefficients"], strict=True)]
    z = f"({c['intercept']}::DOUBLE + " + " + ".join(x) + ")"
    return f"""{episode_sql(salt, p)},
{p}rk AS (SELECT id, cand, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS r, acc, pos, n FROM {p}ent),
{p}top AS (SELECT e.*, CASE WHEN error IS NULL THEN a.cand END AS top_id, CASE WHEN error IS NULL THEN a.score - e.abstain END AS f0, CASE WHEN error IS NULL THEN a.score - coalesce(b.score, e.abstain) END AS f1,
    CASE WHEN decide < 0.7 THEN 'select' ELSE 'abstain' END AS label_decision, (a.acc < 0.3 OR a.pos = e.id::BIGINT % e.n) AND decide < 0.7 AS top_ok
    FROM {p}ep e JOIN {p}rk a ON a.id = e.id AND a.r = 1 LEFT JOIN {p}rk b ON b.id = e.id AND b.r = 2),
{p}dec AS (SELECT *, CASE WHEN error IS NULL THEN 1 / (1 + exp(-{z})) END AS probability, CASE WHEN error IS NULL THEN f0 > 0 END AS beats FROM {p}top),
{p}out AS (SELECT *, label_decision = 'select' AS answerable, error IS NOT NULL AS failure, coalesce(beats AND probability >= {c['threshold']}, FALSE) AS promoted,
    CASE WHEN error IS NOT NULL THEN 'inference_failure' WHEN beats AND probability >= {c['threshold']} THEN 'recommended' ELSE 'abstain' END AS decision FROM {p}dec),
{p}oc AS (SELECT *, promoted AND top_ok AS correct_promotion, NOT answerable AND promoted AS false_promotion, error IS NULL AND top_ok AS raw_top_correct,
    NOT failure AND ((promoted AND top_ok) OR (NOT answerable AND NOT promoted)) AS correct_decision FROM {p}out)"""


SUMMARY_SQL = """count(*)::BIGINT AS total, sum(answerable::INT)::BIGINT AS answerable, sum(failure::INT)::BIGINT AS failure, sum(promoted::INT)::BIGINT AS promoted, sum(correct_promotion::INT)::BIGINT AS correct_promotion,
sum(correct_decision::INT)::BIGINT AS correct_decision, sum(raw_top_correct::INT)::BIGINT AS raw_top_correct, sum(false_promotion::INT)::BIGINT AS false_promotion,
sum(correct_promotion::INT)::DOUBLE / nullif(sum(answerable::INT), 0) AS answerable_top1, sum(correct_decision::INT)::DOUBLE / count(*) AS decision_accuracy,
sum(correct_promotion::INT)::DOUBLE / nullif(sum(promoted::INT), 0) AS promotion_precision, sum(promoted::INT)::DOUBLE / count(*) AS coverage,
sum(false_promotion::INT)::DOUBLE / nullif(count(*) - sum(answerable::INT), 0) AS false_promotion_rate,
CASE WHEN count(top_id) > 0 THEN sum(raw_top_correct::INT)::DOUBLE / nullif(sum(answerable::INT), 0) END AS raw_top1,
quantile_cont(latency_ms, 0.5) AS latency_p50, quantile_cont(latency_ms, 0.95) AS latency_p95"""

POOL_SQL = """
pool AS (SELECT doc_id AS id, source AS family, substr(source, 4)::INT AS ord, CASE WHEN substr(source, 4)::INT < 12 THEN 'train' WHEN substr(source, 4)::INT < 14 THEN 'dev' WHEN substr(source, 4)::INT < 18 THEN 'calibration' ELSE 'test' END AS split,
    CASE WHEN toxic = 1 THEN 'abstain' WHEN quality = 1 THEN 'select' WHEN quality IS NOT NULL THEN 'abstain' END AS decision, CASE WHEN toxic = 1 THEN 'ambiguous' WHEN quality = 0 THEN 'no_match' END AS reason,
    CASE WHEN toxic = 1 THEN 'missing_intent' WHEN quality = 1 THEN 'select' WHEN quality = 0 THEN 'no_match' END AS bucket, coalesce(text, '') AS text, lang
    FROM documents LEFT JOIN labels USING (doc_id))"""

LOG_SQL = """
log AS (SELECT event_id AS audit_id, event_type AS phase, user_id AS owner, floor(value * 10)::BIGINT AS tokens, CASE WHEN (props ->> '$.k')::BIGINT % 5 <> 0 THEN (props ->> '$.k')::BIGINT END AS reasoning,
    ts AS started_at, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, 'model' || (user_id % 3) AS model FROM events)"""
