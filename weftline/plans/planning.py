"""Planning and pool queries: quotas, slots, batches, selections, claims, proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.expr import content_fingerprint
from weftline.operators import allocate as A
from weftline.operators import dedup as D
from weftline.operators import select as S
from weftline.plans.catalog import query
from weftline.plans.standins import POOL_SQL, pool, table

TOTAL = 1003
FAMILIES = "SELECT DISTINCT family, ord FROM pool WHERE split = 'train'"


def families(spark, d, split: str = "train") -> DataFrame:
    return pool(spark, d).where(F.col("split") == split).select("family", "ord").distinct()


def quotas(spark, d) -> DataFrame:
    return A.action_quotas(A.family_quotas(families(spark, d), TOTAL))


Q_SQL = f"""{POOL_SQL}, fam AS ({FAMILIES}),
q1 AS (SELECT family, ord, ({TOTAL} // (count(*) OVER ()) + (ord < {TOTAL} % (count(*) OVER ()))::INT)::BIGINT AS count FROM fam),
a1 AS (SELECT *, least(count * 7 // 10, count) AS s0 FROM q1),
a2 AS (SELECT *, (sum(count) OVER () * 7 + 5) // 10 - sum(s0) OVER () AS lft, row_number() OVER (PARTITION BY count - s0 > 0 ORDER BY count * 7 % 10 DESC, ord) AS r FROM a1),
a3 AS (SELECT family, ord, count, s0 + (count - s0 > 0 AND r <= lft)::INT AS sel FROM a2),
b1 AS (SELECT *, least(count * 2 // 10, count - sel) AS n0 FROM a3),
b2 AS (SELECT *, (sum(count) OVER () * 2 + 5) // 10 - sum(n0) OVER () AS lft, row_number() OVER (PARTITION BY count - sel - n0 > 0 ORDER BY count * 2 % 10 DESC, ord) AS r FROM b1),
q2 AS (SELECT family, ord, count, sel::BIGINT AS "select", (n0 + (count - sel - n0 > 0 AND r <= lft)::INT)::BIGINT AS no_match FROM b2),
q3 AS (SELECT *, (count - "select" - no_match)::BIGINT AS missing_intent FROM q2)"""

_HI = lambda t: f"('0x' || substr(sha256({t}), 1, 12))::BIGINT"
S_SQL = f"""{Q_SQL}, ac AS (SELECT family, ord, unnest(['select', 'no_match', 'missing_intent']) AS action, unnest(["select", no_match, missing_intent]) AS n FROM q3),
ai AS (SELECT family, ord, action, n, unnest(range(n)) AS action_index FROM ac WHERE n > 0),
sl AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY action_index::DOUBLE / n, action, action_index) - 1 AS slot FROM ai),
sk AS (SELECT *, 'run:train:' || family || ':' || slot AS k FROM sl),
so AS (SELECT *, count(*) OVER (PARTITION BY family, action) AS m, row_number() OVER (PARTITION BY family, action ORDER BY sha256(k || ':observation')) AS dr FROM sk),
slots AS (SELECT 'train-' || family || '-' || lpad(slot::VARCHAR, 5, '0') AS id, family, ord, slot, CASE WHEN action <> 'missing_intent' THEN action WHEN action_index % 2 = 1 THEN 'ambiguous' ELSE 'insufficient_context' END AS scenario_type,
    CASE WHEN action <> 'missing_intent' THEN 'standard' WHEN dr <= round_even(m * 0.4, 0) THEN 'no_accessibility' WHEN dr <= round_even(m * 0.4, 0) + round_even(m * 0.2, 0) THEN 'generic_field' ELSE 'standard' END AS observation_variant,
    1 + {_HI("k || ':size'")} % 20 AS candidate_count, ['English', '简体中文', 'English with Chinese UI text'][({_HI("k || ':language'")} % 3 + 1)::INT] AS context_language, {_HI('k')} AS seed FROM so)"""


@query("family_quotas", f"WITH {Q_SQL} SELECT family, ord, count FROM q1")
def family_quotas(spark, d):
    """Q1, J13."""
    return A.family_quotas(families(spark, d), TOTAL)


@query("action_quotas", f'WITH {Q_SQL} SELECT family, ord, count, "select", no_match, missing_intent FROM q3')
def action_quotas(spark, d):
    """Q2."""
    return quotas(spark, d).select("family", "ord", "count", "select", "no_match", "missing_intent")


@query("planned_slots", f"WITH {S_SQL} SELECT * FROM slots")
def planned_slots(spark, d):
    """Registered slots with independent factors."""
    return A.slots(quotas(spark, d), "run", "train")


@query("slot_batches", f"WITH {S_SQL}, b AS (SELECT family, ord, slot // 10 AS batch, min(id) AS first_id, count(*)::BIGINT AS n FROM slots GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY batch, ord) AS turn FROM b")
def slot_batches(spark, d):
    """O7, W8."""
    return A.batches(A.slots(quotas(spark, d), "run", "train"), 10)


@query("replacement_specs", f"WITH {S_SQL} SELECT s.id || '-replacement-02' AS id, s.id AS quota_slot_id, family, ord, slot, scenario_type, observation_variant, candidate_count, context_language, {_HI("s.id || '-replacement-02'")} AS seed FROM slots s WHERE ('0x' || substr(md5(s.id), 1, 2))::BIGINT >= 200")
def replacement_specs(spark, d):
    """Slots that nothing fills, planned again."""
    s = A.slots(quotas(spark, d), "run", "train")
    filled = s.where(F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") < 200).select(F.col("id").alias("quota_slot_id"))
    return A.replacements(s, filled, 2)


@query("missing_slots", f"WITH {S_SQL} SELECT id FROM slots s WHERE ('0x' || substr(md5(s.id), 1, 2))::BIGINT >= 200")
def missing_slots(spark, d):
    """J8, U6."""
    s = A.slots(quotas(spark, d), "run", "train")
    filled = s.where(F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") < 200).select(F.col("id").alias("quota_slot_id"))
    return A.missing_slots(s, filled).select("id")


@query("observation_assignments", f"""WITH {S_SQL}, o AS (SELECT family, slot, row_number() OVER (PARTITION BY family ORDER BY sha256('supplement:' || family || ':' || slot)) AS r FROM slots WHERE scenario_type IN ('ambiguous', 'insufficient_context') AND slot % 5 <> 0)
SELECT family, slot, ['no_accessibility', 'no_accessibility', 'generic_field'][r] AS variant FROM o WHERE r <= 3""")
def observation_assignments(spark, d):
    """Q6: every fifth slot counts as dispatched."""
    s = A.slots(quotas(spark, d), "run", "train")
    return A.observation_supplement(s, s.where("slot % 5 = 0").select("family", "slot"), "supplement")


@query("source_cover_order", f"""WITH RECURSIVE {POOL_SQL}, s AS (SELECT split, id // 50 AS position, family || '/' || bucket AS stratum, count(*) AS n FROM pool WHERE bucket IS NOT NULL GROUP BY ALL), u AS (SELECT DISTINCT split, stratum FROM s), b AS (SELECT DISTINCT split, position FROM s),
g AS (SELECT split, 0 AS turn, -1::BIGINT AS position, []::BIGINT[] AS taken, MAP_FROM_ENTRIES(list((stratum, 3::BIGINT))) AS missing FROM u GROUP BY split
UNION ALL SELECT split, turn + 1, best, list_append(taken, best), map_from_entries(list_transform(map_entries(missing), lambda e: {{'k': e.key, 'v': greatest(0, e.value - coalesce(gives[e.key], 0))}})) FROM (
  SELECT g.split, g.turn, g.taken, g.missing, arg_max(c.position, (c.gain, -c.position)) AS best, max(c.gain) AS gain, arg_max(c.gives, (c.gain, -c.position)) AS gives
  FROM g JOIN (SELECT split, position, map_from_entries(list((stratum, n))) AS gives FROM s GROUP BY ALL) x ON x.split = g.split AND NOT list_contains(g.taken, x.position),
  LATERAL (SELECT x.position AS position, x.gives AS gives, list_sum(list_transform(map_entries(x.gives), lambda e: least(e.value, g.missing[e.key]))) AS gain) c GROUP BY g.split, g.turn, g.taken, g.missing) WHERE gain > 0),
o AS (SELECT split, position, turn FROM g WHERE turn > 0)
SELECT split, position, turn::BIGINT AS turn FROM o UNION ALL SELECT split, position, (SELECT count(*) FROM o WHERE o.split = r.split) + row_number() OVER (PARTITION BY split ORDER BY position) FROM (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.split = b.split AND o.position = b.position)) r""")
def source_cover_order(spark, d):
    """Greedy cover of missing strata by batches of fifty documents."""
    p = pool(spark, d).where("bucket IS NOT NULL")
    stratum = F.concat_ws("/", "family", "bucket")
    supply = p.select("split", F.floor(F.col("id") / 50).cast("long").alias("position"), stratum.alias("stratum")).groupBy("split", "position", "stratum").agg(F.count(F.lit(1)).alias("n"))
    need = p.select("split", stratum.alias("stratum")).distinct().withColumn("n", F.lit(3).cast("long"))
    return A.cover_by_split(supply, need)


@query("source_priority", f"WITH {POOL_SQL}, b AS (SELECT id // 50 AS position, bool_or(bucket = 'no_match') AS hit FROM pool GROUP BY 1) SELECT position, coalesce(hit, FALSE) AS hit, row_number() OVER (ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, position) AS turn FROM b")
def source_priority(spark, d):
    """Batches that can fill a missing stratum first, in their order."""
    b = pool(spark, d).groupBy(F.floor(F.col("id") / 50).cast("long").alias("position")).agg(F.coalesce(F.bool_or(F.col("bucket") == "no_match"), F.lit(False)).alias("hit"))
    return A.by_priority(b, F.col("hit"))


@query("unused_multisets", """WITH v(x) AS (VALUES ('DELETE'), ('GET'), ('POST'), ('PUT')), m AS (SELECT [a.x, b.x, c.x] AS m FROM v a, v b, v c WHERE a.x <= b.x AND b.x <= c.x),
u AS (SELECT array_to_string(m, '|') AS members, len(list_distinct(m))::INT AS different FROM m WHERE len(list_distinct(m)) >= 2 AND m <> ['GET', 'GET', 'POST']) SELECT *, row_number() OVER (ORDER BY different DESC, sha256(members)) AS turn FROM u""")
def unused_multisets(spark, d):
    """U8: HTTP method choices of three that aren't used yet."""
    v = spark.createDataFrame([(x,) for x in ("DELETE", "GET", "POST", "PUT")], "value string")
    used = spark.createDataFrame([(["GET", "GET", "POST"],)], "members array<string>")
    return A.unused_multisets(v, used, 3).withColumn("members", F.array_join("members", "|"))


@query("unused_pairs", """WITH v(x) AS (VALUES ('application/json'), ('application/x-www-form-urlencoded'), ('text/plain'), ('application/json; charset=utf-8'), ('text/plain; charset=utf-8')),
p AS (SELECT a.x AS a, b.x AS b FROM v a, v b WHERE a.x < b.x AND NOT (a.x = 'application/json' AND b.x = 'text/plain'))
SELECT a || '|' || b AS members, row_number() OVER (ORDER BY contains(a, ';')::INT + contains(b, ';')::INT, a, b) AS turn FROM p""")
def unused_pairs(spark, d):
    """U8: content type pairs that aren't used yet."""
    v = spark.createDataFrame([(x,) for x in ("application/json", "application/x-www-form-urlencoded", "text/plain", "application/json; charset=utf-8", "text/plain; charset=utf-8")], "value string")
    used = spark.createDataFrame([(["application/json", "text/plain"],)], "members array<string>")
    return A.unused_pairs(v, used).withColumn("members", F.array_join("members", "|"))


@query("registered_selection", f"""WITH {POOL_SQL}, r AS (SELECT id, family, bucket, row_number() OVER (PARTITION BY family, bucket ORDER BY (id % 50 <> 0), sha256(id::VARCHAR)) AS r FROM pool WHERE bucket IS NOT NULL)
SELECT id, family, bucket FROM r WHERE r <= CASE bucket WHEN 'select' THEN 7 WHEN 'no_match' THEN 2 ELSE 1 END""")
def registered_selection(spark, d):
    """Required ids first, then hash order, up to each stratum's quota."""
    q = spark.createDataFrame([("select", 7), ("no_match", 2), ("missing_intent", 1)], "bucket string, quota long")
    p = pool(spark, d).where("bucket IS NOT NULL")
    both = p.select("family").distinct().join(q, F.lit(True))
    return S.take_quota(p, both, ["family", "bucket"], [F.col("id") % 50 != 0, S.by_hash("id")]).select("id", "family", "bucket")


@query("quota_shortages", f"""WITH {POOL_SQL}, q AS (SELECT family, bucket, CASE bucket WHEN 'select' THEN 25 WHEN 'no_match' THEN 5 ELSE 3 END::BIGINT AS quota FROM (SELECT DISTINCT family FROM pool), (VALUES ('select'), ('no_match'), ('missing_intent')) t(bucket)),
h AS (SELECT family, bucket, count(*)::BIGINT AS have FROM pool GROUP BY ALL) SELECT family, bucket, quota, coalesce(have, 0)::BIGINT AS have FROM q LEFT JOIN h USING (family, bucket) WHERE coalesce(have, 0) < quota""")
def quota_shortages(spark, d):
    """Strata that can't fill their quota."""
    q = spark.createDataFrame([("select", 25), ("no_match", 5), ("missing_intent", 3)], "bucket string, quota long")
    p = pool(spark, d)
    return S.shortages(p, p.select("family").distinct().join(q, F.lit(True)), ["family", "bucket"])


@query("round_robin_pilot", f"""WITH {POOL_SQL}, a AS (SELECT id, family, bucket, row_number() OVER (PARTITION BY bucket, family ORDER BY sha256(id::VARCHAR)) AS turn FROM pool WHERE bucket IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY turn, family) AS r FROM a) SELECT id, family, bucket, turn FROM b WHERE r <= 30""")
def round_robin_pilot(spark, d):
    """W4."""
    return S.round_robin(pool(spark, d).where("bucket IS NOT NULL"), ["bucket"], ["family"], [S.by_hash("id")], 30).select("id", "family", "bucket", F.col("turn").cast("long").alias("turn"))


@query("nested_snapshots", f"""WITH {POOL_SQL}, r AS (SELECT id, family, bucket, row_number() OVER (PARTITION BY family, bucket ORDER BY sha256(id::VARCHAR)) AS r FROM pool WHERE bucket IS NOT NULL)
SELECT id, family, bucket, CASE WHEN r <= 2 THEN 2 WHEN r <= 5 THEN 5 ELSE 10 END::INT AS stage_min FROM r WHERE r <= 10""")
def nested_snapshots(spark, d):
    """The smallest nested stage that holds a row."""
    return S.nested_stage(pool(spark, d).where("bucket IS NOT NULL"), [2, 5, 10], ["family", "bucket"], [S.by_hash("id")]).where("stage_min IS NOT NULL").select("id", "family", "bucket", "stage_min")


@query("fit_threshold_split", f"""WITH {POOL_SQL}, f AS (SELECT DISTINCT family FROM pool WHERE split = 'calibration'), r AS (SELECT family, row_number() OVER (ORDER BY sha256('calibration:' || family)) AS r, count(*) OVER () AS n FROM f)
SELECT family, CASE WHEN r * 2 <= n THEN 'fit' ELSE 'threshold' END AS half FROM r""")
def fit_threshold_split(spark, d):
    """W9; the salt is a parameter."""
    return S.half_of_families(families(spark, d, "calibration").select("family"), "calibration:")


@query("hash_audit_sample", "SELECT doc_id FROM documents WHERE ('0x' || substr(sha256(doc_id || ':audit'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1")
def hash_audit_sample(spark, d):
    """The audit sample is the feature."""
    return table(spark, d, "documents").select("doc_id").where(S.sampled(F.concat(F.col("doc_id").cast("string"), F.lit(":audit")), 0.1))


@query("content_claims", "WITH c AS (SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1) SELECT * FROM c")
def content_claims(spark, d):
    """The first owner of each content."""
    return D.claims(table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")), "digest", ["doc_id"])


@query("duplicate_quarantine", "SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def duplicate_quarantine(spark, d):
    """U3."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return D.split_duplicates(rows, "digest", ["doc_id"]).select("doc_id", "source", "is_duplicate")


@query("duplicate_gate", "SELECT sha256(coalesce(text, '')) AS digest, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_gate(spark, d):
    """U2, S1."""
    return D.duplicates(table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")), "digest")


@query("contamination_exclusion", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(coalesce(documents.text, ''), b.text))")
def contamination_exclusion(spark, d):
    """Documents that contain no benchmark text literally."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items = table(spark, d, "benchmark").select(F.col("text").alias("item"))
    return D.excluded(docs, D.contained(docs, items, "doc_id", "text", "item").select("doc_id"), "doc_id").select("doc_id")


@query("coverage_check", "SELECT doc_id, (d IS NOT NULL)::INT::BIGINT AS in_left, (l IS NOT NULL)::INT::BIGINT AS in_right FROM (SELECT doc_id, 1 AS d FROM documents) FULL JOIN (SELECT doc_id, 1 AS l FROM labels) USING (doc_id) WHERE d IS NULL OR l IS NULL")
def coverage_check(spark, d):
    """Ids that aren't exactly once in both tables."""
    return D.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("pool_overlap", """WITH n AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 2 = 0), o AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 2 = 1)
SELECT 'doc_id' AS key, (SELECT count(*) FROM n WHERE doc_id IN (SELECT doc_id FROM o))::BIGINT AS shared, (SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM n GROUP BY doc_id HAVING count(*) > 1))::BIGINT AS repeated
UNION ALL SELECT 'digest', (SELECT count(*) FROM n WHERE digest IN (SELECT digest FROM o))::BIGINT, (SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM n GROUP BY digest HAVING count(*) > 1))::BIGINT""")
def pool_overlap(spark, d):
    """Even ids as the new pool, odd ids as the old one."""
    p = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return D.overlap(p.where("doc_id % 2 = 0"), p.where("doc_id % 2 = 1"), ["doc_id", "digest"])


_CHANGED = "SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'x' ELSE '' END || coalesce(text, '') AS t FROM documents WHERE doc_id % 89 <> 1"


def _changed(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return p, p.where("doc_id % 89 <> 1").withColumn("t", F.concat(F.when(F.col("doc_id") % 97 == 0, "x").otherwise(""), F.col("t")))


@query("subset_proof", f"WITH s AS ({_CHANGED}) SELECT d.doc_id, CASE WHEN s.t IS NULL THEN 'absent' ELSE 'changed' END AS problem FROM documents d LEFT JOIN s USING (doc_id) WHERE s.t IS NULL OR s.t <> coalesce(d.text, '')")
def subset_proof(spark, d):
    """J11."""
    p, s = _changed(spark, d)
    return D.subset_proof(p, s, "doc_id", "t")


@query("mixture_check", f"WITH s AS ({_CHANGED}) SELECT CASE WHEN s.t IS NULL THEN 'new' WHEN s.t = coalesce(d.text, '') THEN 'retained' ELSE 'changed' END AS kind, count(*)::BIGINT AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1")
def mixture_check(spark, d):
    """J12."""
    p, s = _changed(spark, d)
    return D.mixture(p, s, "doc_id", "t")


@query("multiset_entry_match", """WITH a AS (SELECT conv_id, role, turn AS left_pos, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations), b AS (SELECT conv_id, role, 1000 - turn AS right_pos, row_number() OVER (PARTITION BY conv_id, role ORDER BY 1000 - turn) AS nth FROM conversations)
SELECT conv_id, role, nth, left_pos, right_pos FROM a JOIN b USING (conv_id, role, nth)""")
def multiset_entry_match(spark, d):
    """Turns against the reversed conversation, copies paired in order."""
    c = table(spark, d, "conversations")
    return D.matched_entries(c.select("conv_id", "role", "turn"), c.select("conv_id", "role", (1000 - F.col("turn")).alias("turn")), "conv_id", "role", "turn").withColumn("nth", F.col("nth").cast("long"))


@query("slot_fills", f"""WITH {S_SQL}, acc AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'train-none-' || doc_id ELSE 'train-src' || (doc_id % 12) || '-' || lpad((doc_id % 40)::VARCHAR, 5, '0') END AS quota_slot_id FROM documents), g AS (SELECT quota_slot_id, count(*)::BIGINT AS fills FROM acc GROUP BY 1)
SELECT quota_slot_id, fills, CASE WHEN s.id IS NULL THEN 'unknown_slot' WHEN fills > 1 THEN 'filled_twice' END AS problem FROM g LEFT JOIN slots s ON s.id = quota_slot_id""")
def slot_fills(spark, d):
    """J7."""
    x = F.col("doc_id")
    slot = F.when(x % 11 == 0, F.concat(F.lit("train-none-"), x.cast("string"))).otherwise(F.concat(F.lit("train-src"), (x % 12).cast("string"), F.lit("-"), F.lpad((x % 40).cast("string"), 5, "0")))
    return D.fills(table(spark, d, "documents").select(slot.alias("quota_slot_id")), A.slots(quotas(spark, d), "run", "train"))


@query("manifest_diff", """WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 13 <> 0), b AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 17 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE doc_id % 19 <> 0)
SELECT doc_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'unexpected' ELSE 'changed' END AS problem FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def manifest_diff(spark, d):
    """Two manifests of the same rows."""
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents")
    a = docs.where("doc_id % 13 <> 0").select("doc_id", F.sha2(t, 256).alias("sha256"))
    b = docs.where("doc_id % 19 <> 0").select("doc_id", F.sha2(F.concat(t, F.when(F.col("doc_id") % 17 == 0, "!").otherwise("")), 256).alias("sha256"))
    return D.manifest_difference(a, b, "doc_id")


@query("canonical_fingerprint", """WITH t AS (SELECT conv_id, '{"kind":' || to_json(role) || ',"text":' || to_json(coalesce(text, '')) || '}' AS j FROM conversations), g AS (SELECT conv_id, '{"context":{"applicationCategory":"unknown"},"entries":[' || array_to_string(list_sort(list(j)), ',') || ']}' AS body FROM t GROUP BY 1)
SELECT conv_id, sha256(body) AS fingerprint FROM g""")
def canonical_fingerprint(spark, d):
    """§1.5: content identity, whatever the entries' ids and order."""
    c = table(spark, d, "conversations").select("conv_id", F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("kind"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    g = c.groupBy("conv_id").agg(F.collect_list("e").alias("entries"))  # at most 20 entries each
    return g.select("conv_id", content_fingerprint(F.struct(F.lit("unknown").alias("applicationCategory")), F.col("entries")).alias("fingerprint"))
