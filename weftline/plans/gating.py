"""Gate, classifier, profile and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import envelope as E
from weftline.functions.expr import failure_pause, hash_unit, input_surface, request_failure, same_action, text_kind
from weftline.operators import gates as G
from weftline.operators import profile as P
from weftline.operators import usage as U
from weftline.plans.catalog import query
from weftline.plans.standins import LOG_SQL, POOL_SQL, episode_sql, episodes, log, pool, table, unit


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def cases(x, *values):
    """The value whose position is x modulo their number."""
    out = values[0] if not isinstance(values[0], str) else F.lit(values[0])
    for i, v in enumerate(values[1:], 1):
        out = F.when(x % len(values) == i, F.lit(v) if isinstance(v, str) else v).otherwise(out)
    return out


@query("label_contract_check", f"WITH {episode_sql()} SELECT id, CASE id::BIGINT % 6 WHEN 1 THEN CASE WHEN decide < 0.7 THEN 'select_without_ids' END WHEN 2 THEN 'unknown_ids' WHEN 3 THEN CASE WHEN decide < 0.7 THEN 'repeated_ids' END WHEN 4 THEN CASE WHEN decide < 0.7 THEN 'abstain_with_ids' END WHEN 5 THEN CASE WHEN decide < 0.7 THEN 'select_with_reason' END END AS problem FROM ep")
def label_contract_check(spark, d):
    """Labels broken in five ways."""
    e, k = episodes(spark, d), F.col("id").cast("long") % 6
    ids, reason, decision = F.col("label.acceptable_ids"), F.col("label.abstain_reason"), F.col("label.decision")
    ids = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.concat(ids, F.array(F.lit("zz")))).when(k == 3, F.concat(ids, ids)).otherwise(ids)
    label = F.struct(F.when((k == 4) | (k == 5), F.coalesce(reason, F.lit("no_match"))).otherwise(reason).alias("abstain_reason"), ids.alias("acceptable_ids"), F.when(k == 4, "abstain").otherwise(decision).alias("decision"))
    return e.withColumn("l", label).select("id", G.label_problem(F.col("l"), F.transform("entries", lambda x: x["id"])).alias("problem"))


# Clipboard texts made of documents: their first letters, their beginnings, their lines.
_WORD = "(regexp_extract(coalesce(text, ''), '[A-Za-z]+') || doc_id)"
_START = "substr(coalesce(text, ''), 1, 60)"
_KIND_TEXT = f"""CASE doc_id % 12 WHEN 0 THEN '#' || substr(md5({_START}), 1, 6) WHEN 1 THEN ' ' || {_WORD} || '@example.org' WHEN 2 THEN 'https://example.org/' || {_WORD} WHEN 3 THEN '+1 (555) 010-' || lpad((n_chars % 10000)::VARCHAR, 4, '0')
WHEN 4 THEN 'git ' || {_START} WHEN 5 THEN 'def ' || {_START} WHEN 6 THEN {_START} || chr(10) || 'b => {{' WHEN 7 THEN 'mailto:' || {_WORD} || ' x' WHEN 8 THEN 'ftp://' || {_START} WHEN 9 THEN '#' || {_WORD} ELSE coalesce(text, '') END"""


@query("kind_classifier", rf"""WITH t AS (SELECT doc_id, {_KIND_TEXT} AS x FROM documents), s AS (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM t)
SELECT doc_id, CASE WHEN regexp_matches(x, '^#[0-9a-fA-F]{{3,8}}$') THEN 'color' WHEN regexp_matches(x, '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 'email' WHEN regexp_matches(x, '(?i)^((https?|ftp)://|mailto:)\S+$') THEN 'url'
WHEN regexp_matches(x, '^[+()0-9 .-]{{7,25}}$') AND len(regexp_replace(x, '[^0-9]', '', 'g')) >= 7 THEN 'phone' WHEN regexp_matches(x, '^(\$|git|sudo|npm|npx|brew|python|python3|curl|swift|cd|ls|ssh|docker|make|xcodebuild) ') THEN 'command'
WHEN regexp_matches(x, '^((import|func|let|const|def|class|struct|SELECT) |#!/)') OR (contains(x, chr(10)) AND (contains(x, '{{') OR contains(x, '=>'))) THEN 'code' ELSE 'text' END AS kind FROM s""")
def kind_classifier(spark, d):
    """P20."""
    x, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    word, start = F.concat(F.regexp_extract(t, "[A-Za-z]+", 0), x.cast("string")), F.substring(t, 1, 60)
    c = cases(x, F.concat(F.lit("#"), F.substring(F.md5(start), 1, 6)), F.concat(F.lit(" "), word, F.lit("@example.org")), F.concat(F.lit("https://example.org/"), word), F.concat(F.lit("+1 (555) 010-"), F.lpad((F.col("n_chars") % 10000).cast("string"), 4, "0")),
              F.concat(F.lit("git "), start), F.concat(F.lit("def "), start), F.concat(start, F.lit("\nb => {")), F.concat(F.lit("mailto:"), word, F.lit(" x")), F.concat(F.lit("ftp://"), start), F.concat(F.lit("#"), word), t, t)
    return table(spark, d, "documents").select("doc_id", text_kind(c).alias("kind"))


_LABELS = ["To ", "cc: ", "Search ", "The {} Address Bar", "{} terminal prompt", "Source editor {}", "{} message composer", "hex color", "Folder path", "{}", "tool {}", "finder {}", "收件人"]
_LABEL_SQL = "replace([" + ", ".join(f"'{x}'" for x in _LABELS) + "][doc_id % 13 + 1], '{}', regexp_extract(coalesce(text, ''), '[A-Za-z]+')) || CASE WHEN doc_id % 13 < 3 THEN regexp_extract(coalesce(text, ''), '[A-Za-z]+') ELSE '' END"


@query("surface_classifier", rf"""WITH l AS (SELECT doc_id, {_LABEL_SQL} AS label, doc_id % 4 = 1 AS area FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(label, '(?i)^(to|cc|bcc|recipient|recipients|收件人|抄送|密送)(\b|$)') THEN 'recipient' WHEN regexp_matches(label, '(?i)address bar|location bar|地址栏|网址栏') THEN 'address_bar' WHEN regexp_matches(label, '(?i)^(search|find|搜索|查找)(\b|$)') THEN 'search'
WHEN regexp_matches(label, '(?i)shell prompt|terminal prompt|终端命令') THEN 'shell_prompt' WHEN regexp_matches(label, '(?i)code editor|source editor|代码编辑') THEN 'code_editor' WHEN regexp_matches(label, '(?i)message composer|chat input|聊天输入|消息输入') THEN 'chat_composer'
WHEN regexp_matches(label, '(?i)^(hex color|color value|颜色值|色值)$') THEN 'color' WHEN regexp_matches(label, '(?i)^(file path|folder path|文件路径|目录路径)$') THEN 'file_path' WHEN area THEN 'text' ELSE 'unknown' END AS surface FROM l""".replace("\\\\b", "\\b"))
def surface_classifier(spark, d):
    """Labels with words of the documents in them."""
    x, word = F.col("doc_id"), F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0)
    label = F.replace(F.element_at(F.array(*map(F.lit, _LABELS)), (x % 13 + 1).cast("int")), F.lit("{}"), word)
    label = F.concat(label, F.when(x % 13 < 3, word).otherwise(""))
    return table(spark, d, "documents").select("doc_id", input_surface(label, F.when(x % 4 == 1, "AXTextArea").otherwise("AXButton")).alias("surface"))


def _around(x):
    return cases(x, "", "  　 ", '{"format":"focus-text-v1","selectionKnown":true,"beforeSelection":" ","afterSelection":"","nearbyText":["  "]}', '{"format":"focus-text-v1","selectionKnown":true,"beforeSelection":"x","afterSelection":"","nearbyText":[]}',
                 '{"format":"focus-text-v1","selectionKnown":false,"textWindow":" ","nearbyText":["near"]}', '{"format":"focus-text-v1","selectionKnown":true,"beforeSelection":" ","afterSelection":"","nearbyText":[],"more":1}', "{broken",
                 '{"format":"other"}', '{"format":"focus-text-v1","selectionKnown":"true","beforeSelection":" ","afterSelection":"","nearbyText":[]}')


@query("semantic_context_flag", "SELECT doc_id, [FALSE, FALSE, FALSE, TRUE, TRUE, TRUE, TRUE, TRUE, TRUE][doc_id % 9 + 1] AS has_context, [FALSE, FALSE, TRUE, TRUE, TRUE, FALSE, FALSE, FALSE, FALSE][doc_id % 9 + 1] AS envelope FROM documents")
def semantic_context_flag(spark, d):
    """Nine surroundings; a malformed envelope is plain text."""
    around = _around(F.col("doc_id"))
    return docs(spark, d).select("doc_id", E.has_semantic_context(F.lit(""), F.lit(" "), around).alias("has_context"), E.is_valid(around).alias("envelope"))


@query("budget_clip", r"SELECT doc_id, regexp_extract(coalesce(text, ''), '^(?:\s*\S+){0,24}', 0) AS clipped, regexp_extract(coalesce(text, ''), '^(?:\s*\S+){0,24}', 0) <> coalesce(text, '') AS truncated FROM documents")
def budget_clip(spark, d):
    """P3 with the word counter; the clip is the feature."""
    c = G.clip_words(F.col("text"), 24)
    return docs(spark, d).select("doc_id", c.alias("clipped"), (c != F.col("text")).alias("truncated"))


@query("placement_gate", "SELECT doc_id, [NULL, 'fabricated_caret', 'duplicated_boundary', 'unselected_blank', 'unknown_caret', 'incomplete_caret', 'method_field', 'method_token'][doc_id % 8 + 1] AS problem FROM documents")
def placement_gate(spark, d):
    """One episode of each outcome, in the gate's order."""
    x = F.col("doc_id")
    env = lambda b, a: f'{{"format":"focus-text-v1","selectionKnown":true,"beforeSelection":"{b}","afterSelection":"{a}","nearbyText":[]}}'
    around = cases(x, env("a", "b"), "here <cursor> there", env("same", ""), env("def ____", ""), '{"format":"focus-text-v1","selectionKnown":false,"textWindow":"w","nearbyText":[]}', "plain text", env("", ""), env("", ""))
    context = F.struct(F.lit("unknown").alias("applicationCategory"), F.when(x % 8 == 7, "HTTP method").otherwise("f").alias("fieldLabel"), F.lit("AXTextField").alias("fieldRole"), F.lit(True).alias("hasAccessibility"), F.when(x % 8 == 3, "code_editor").otherwise("text").alias("inputSurface"),
                       F.lit(False).alias("isSecure"), cases(x, "", "", "same", "", "", "", "", "12 3").alias("selectedText"), around.alias("surroundingText"))
    label = F.struct(F.lit(None).cast("string").alias("abstain_reason"), F.array(F.lit("c0")).alias("acceptable_ids"), F.lit("select").alias("decision"))
    entries = F.array(F.struct(F.lit("c0").alias("id"), F.lit("GET").alias("text")))
    family = F.when(x % 8 >= 6, "http_method").otherwise("other")
    return docs(spark, d).select("doc_id", context.alias("c"), entries.alias("e"), label.alias("l"), family.alias("f")).select("doc_id", G.placement_problem(F.col("c"), F.col("e"), F.col("l"), F.col("f"), python=False).alias("problem"))


@query("prelabel_gate", "SELECT doc_id, [NULL, 'parameter_length', 'quote_length', 'quote_not_visible', 'candidate_count', 'possible_values', 'mapping', 'mapping_repeats', 'mapping_one_value', 'gate_missing'][doc_id % 10 + 1] AS problem FROM documents")
def prelabel_gate(spark, d):
    """One draft of each outcome."""
    x = F.col("doc_id") % 10
    pair = lambda c, v: F.struct(F.lit(c).alias("candidate"), F.lit(v).alias("value"))
    gate = F.struct(F.when(x == 1, "ab").otherwise("format").alias("parameter"), F.when(x == 2, "short").when(x == 3, "nowhere to be seen").otherwise("visible quote here").alias("quote"), F.when(x == 5, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("possible_values"),
                    F.when(x == 6, F.array(pair(0, 0), pair(9, 1))).when(x == 7, F.array(pair(0, 0), pair(0, 1))).when(x == 8, F.array(pair(0, 0), pair(1, 0))).otherwise(F.array(pair(0, 0), pair(1, 1))).alias("mapping"))
    rows = docs(spark, d).select("doc_id", F.when(x != 9, gate).alias("g"))
    return rows.select("doc_id", G.prelabel_problem(F.col("g"), F.lit('{"text":"a visible quote here"}'), F.when(F.col("doc_id") % 10 == 4, 3).otherwise(2), F.lit(2), F.lit(True)).alias("problem"))


_LAB = f"SELECT id, decision, reason, {unit('id || ' + repr(':r'))} AS r FROM pool WHERE decision IS NOT NULL"


def _labels(spark, d):
    lab = lambda dec, rea: F.struct(rea.alias("abstain_reason"), F.when(dec == "select", F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("acceptable_ids"), dec.alias("decision"))
    p = pool(spark, d).where("decision IS NOT NULL").withColumn("r", hash_unit(F.concat(F.col("id").cast("string"), F.lit(":r"))))
    other = F.when(F.col("r") < 0.2, "abstain").otherwise(F.col("decision"))
    why = F.when(other == "select", F.lit(None).cast("string")).when(F.col("r") < 0.1, "insufficient_context").when(F.col("r") < 0.2, "no_match").otherwise(F.col("reason"))
    return p.withColumns({"label": lab(F.col("decision"), F.col("reason")), "other": lab(other, why)})


_OTHER = f"o AS (SELECT *, CASE WHEN r < 0.2 THEN 'abstain' ELSE decision END AS d2 FROM ({_LAB})), lb AS (SELECT *, CASE WHEN d2 = 'select' THEN NULL WHEN r < 0.1 THEN 'insufficient_context' WHEN r < 0.2 THEN 'no_match' ELSE reason END AS r2 FROM o)"
_AGREE = "decision = d2 AND CASE WHEN reason IN ('ambiguous', 'insufficient_context') THEN 'm' ELSE coalesce(reason, '') END = CASE WHEN r2 IN ('ambiguous', 'insufficient_context') THEN 'm' ELSE coalesce(r2, '') END"


@query("label_agreement", f"WITH {POOL_SQL}, {_OTHER} SELECT id, {_AGREE} AS agreed FROM lb")
def label_agreement(spark, d):
    """P28."""
    return _labels(spark, d).select("id", same_action(F.col("label"), F.col("other")).alias("agreed"))


@query("label_consensus", f"WITH {POOL_SQL}, {_OTHER} SELECT id, CASE WHEN id % 5 = 0 THEN 'second_missing' WHEN {_AGREE} THEN 'agreed' ELSE 'disagreed' END AS status FROM lb")
def label_consensus(spark, d):
    """R12, J19."""
    x = _labels(spark, d)
    return G.consensus(x.select("id", "label"), x.where("id % 5 <> 0").select("id", F.col("other").alias("label")))


@query("label_repair", f"WITH {POOL_SQL} SELECT id, id % 4 <> 0 AS first_pass FROM pool WHERE decision IS NOT NULL AND (id % 4 <> 0 OR id % 8 <> 0)")
def label_repair(spark, d):
    """Every fourth answer is malformed, half of these after the repair as well."""
    x = _labels(spark, d)
    bad = lambda m: F.when(F.col("id") % m == 0, F.lit(None)).otherwise(F.col("label")).alias("label")
    first, retry = x.select("id", bad(4), F.lit(True).alias("first_pass")), x.select("id", bad(8), F.lit(False).alias("first_pass"))
    return G.one_repair(first, retry, F.col("label").isNotNull()).select("id", "first_pass")


@query("acceptance_precedence", f"""WITH {POOL_SQL}, {_OTHER}, x AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'program_issue' END AS issue, id % 11 = 0 AS terminal, id % 3 = 0 AS reviewed, CASE WHEN id % 13 = 0 THEN 'no_match' WHEN decision = 'select' THEN 'select' ELSE reason END AS planned FROM lb),
y AS (SELECT *, CASE WHEN reviewed AND NOT ({_AGREE}) THEN 'review_disagrees' WHEN CASE WHEN decision = 'select' THEN 'select' WHEN reason = 'no_match' THEN 'no_match' ELSE 'm' END <> CASE WHEN planned IN ('select', 'no_match') THEN planned ELSE 'm' END THEN 'bucket_mismatch'
    WHEN terminal THEN 'label_unavailable' ELSE coalesce(issue, CASE WHEN id % 17 = 0 THEN 'duplicate_content' END) END AS problem FROM x)
SELECT id, problem, CASE WHEN problem IS NULL THEN CASE WHEN id % 10 = 0 THEN 'sampled_reviewed' WHEN reviewed THEN 'risk_reviewed' ELSE 'single_pass' END END AS quality_path FROM y""")
def acceptance_precedence(spark, d):
    """Later findings overwrite earlier ones; a claim is made only without any."""
    x, i = _labels(spark, d), F.col("id")
    planned = F.when(i % 13 == 0, "no_match").when(F.col("decision") == "select", "select").otherwise(F.col("reason"))
    problem, path = G.acceptance(F.when(i % 7 == 0, "program_issue"), i % 11 == 0, planned, F.col("label"), F.when(i % 3 == 0, F.col("other")), i % 17 != 0, i % 10 == 0)
    return x.select("id", problem.alias("problem"), path.alias("quality_path"))


@query("derived_labels", f"WITH {episode_sql()} SELECT id, coalesce(string_agg(cand, ',' ORDER BY pos) FILTER (acc < 0.3), '') AS accepted, CASE WHEN min(acc) < 0.3 THEN 'select' ELSE 'abstain' END AS decision, CASE WHEN id::BIGINT % 9 = 0 THEN 'coverage' END AS problem FROM ent GROUP BY id")
def derived_labels(spark, d):
    """A verdict on every candidate; every ninth episode lacks the last one's, replaced by an unknown."""
    from weftline.plans.standins import table as t

    c = t(spark, d, "conversations")
    acc = hash_unit(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit("acc"))) < 0.3
    name = F.col("turn").cast("string")
    g = c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", name.alias("id"), F.coalesce("text", F.lit("")).alias("text"), acc.alias("acceptable")))).alias("x"))
    verdicts = F.transform("x", lambda v: F.struct(v["id"].alias("id"), v["acceptable"].alias("acceptable"), v["text"].alias("quoted_text")))
    odd = F.struct(F.lit("none").alias("id"), F.lit(False).alias("acceptable"), F.lit("").alias("quoted_text"))
    verdicts = F.when(F.col("id").cast("long") % 9 == 0, F.concat(verdicts, F.array(odd))).otherwise(verdicts)
    label, problem = G.derived_label(F.transform("x", lambda v: F.struct(v["id"].alias("id"), v["text"].alias("text"))), F.reverse(verdicts), F.lit("no_match"))
    return g.select("id", label.alias("l"), problem.alias("problem")).select("id", F.array_join("l.acceptable_ids", ",").alias("accepted"), "l.decision", "problem")


@query("secret_scan", f"SELECT doc_id, regexp_matches(coalesce(text, ''), '{G.SECRETS.replace(chr(39), chr(39) * 2)}') AS has_secret FROM documents")
def secret_scan(spark, d):
    """P33."""
    return docs(spark, d).select("doc_id", G.holds_secret(F.col("text")).alias("has_secret"))


@query("candidate_summaries", r"SELECT conv_id, turn, '[' || role || '] ' || CASE WHEN len(s) > 160 THEN substr(s, 1, 159) || '…' ELSE s END AS summary FROM (SELECT conv_id, turn, role, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM conversations)")
def candidate_summaries(spark, d):
    """P20, P1."""
    return table(spark, d, "conversations").select("conv_id", "turn", G.candidate_summary(F.col("role"), F.coalesce("text", F.lit(""))).alias("summary"))


@query("request_failures", """WITH x AS (SELECT event_id, [200, 401, 402, 403, 403, 403, 403, 403, 403, 429, 500][event_id % 11 + 1] AS status, ['', '', '', '5-hour limit', 'weekly cap', 'this month', 'concurrent use', 'usage limit', 'no', '', ''][event_id % 11 + 1] AS k, event_type || ' ' || k || ' ' || coalesce(props, '') AS m FROM events)
SELECT event_id, CASE WHEN status = 403 THEN CASE WHEN m LIKE '%5-hour%' THEN 'quota_5h' WHEN m LIKE '%weekly%' THEN 'quota_weekly' WHEN m LIKE '%month%' THEN 'quota_monthly' WHEN m LIKE '%concurrent%' THEN 'account_concurrent_restriction' WHEN m LIKE '%usage limit%' THEN 'quota_unknown_reset' ELSE 'permission_denied' END
WHEN status = 401 THEN 'authentication_or_model_entitlement' WHEN status = 402 THEN 'membership_status' WHEN status = 429 THEN 'short_term_rate_or_overload' ELSE 'transient_http_error' END AS reason,
CASE WHEN status = 403 THEN CASE WHEN m LIKE '%5-hour%' THEN 18000 WHEN m LIKE '%weekly%' THEN 604800 WHEN m LIKE '%month%' THEN 2678400 ELSE -1 END WHEN status IN (401, 402) THEN -1 ELSE 0 END::BIGINT AS pause FROM x""")
def request_failures(spark, d):
    """P31; no known pause is -1."""
    x = F.col("event_id")
    status = cases(x, *[F.lit(s) for s in (200, 401, 402, 403, 403, 403, 403, 403, 403, 429, 500)])
    body = cases(x, "", "", "", "5-hour limit", "weekly cap", "this month", "concurrent use", "usage limit", "no", "", "")
    said = F.concat(F.initcap("event_type"), F.lit(" "), body, F.lit(" "), F.coalesce("props", F.lit("")))  # the provider's words stand among others
    e = table(spark, d, "events").select("event_id", request_failure(status, said).alias("reason"))
    return e.withColumn("pause", F.coalesce(failure_pause(F.col("reason")), F.lit(-1)).cast("long"))


@query("difficulty_profile", f"""WITH {episode_sql()}, g AS (SELECT e.*, p.family, (e.acc < 0.3 OR e.pos = e.id::BIGINT % e.n) AS ok, f.text AS field FROM ent e JOIN ep p USING (id) JOIN ent f ON f.id = e.id AND f.pos = 0 WHERE p.decide < 0.7),
s AS (SELECT id, family, bool_or(ok AND text <> '' AND contains(field, text)) AS exact, bool_or(NOT ok AND EXISTS (SELECT 1 FROM g h WHERE h.id = g.id AND h.ok AND h.kind = g.kind)) AS hard, sum(ok::INT) > 1 AS several FROM g GROUP BY id, family)
SELECT family, CASE WHEN grouping(family) = 1 THEN 'overall' ELSE 'family' END AS level, count(*)::BIGINT AS select_episodes, sum(exact::INT)::BIGINT AS exact_positive, sum(hard::INT)::BIGINT AS same_kind_negative, sum(several::INT)::BIGINT AS multiple_positive FROM s GROUP BY ROLLUP (family)""")
def difficulty_profile(spark, d):
    """The first turn is the visible field."""
    return P.difficulty(episodes(spark, d), F.array(F.get("entries", F.lit(0))["text"]))


@query("distribution_maps", f"""WITH {POOL_SQL} SELECT 'split' AS dimension, split AS value, count(*)::BIGINT AS n FROM pool GROUP BY split UNION ALL SELECT 'family', family, count(*)::BIGINT FROM pool GROUP BY family
UNION ALL SELECT 'lang', lang, count(*)::BIGINT FROM pool GROUP BY lang UNION ALL SELECT 'bucket', coalesce(bucket, 'none'), count(*)::BIGINT FROM pool GROUP BY bucket""")
def distribution_maps(spark, d):
    """Four distributions in one pass."""
    return P.distributions(pool(spark, d), ["split", "family", "lang", "bucket"])


@query("action_cross_tab", f"WITH {POOL_SQL} SELECT family, count(*) FILTER (bucket = 'select')::BIGINT AS \"select\", count(*) FILTER (bucket = 'no_match')::BIGINT AS no_match, count(*) FILTER (bucket = 'missing_intent')::BIGINT AS missing_intent FROM pool GROUP BY 1")
def action_cross_tab(spark, d):
    """A18."""
    return P.cross_tab(pool(spark, d), "family", "bucket", ["select", "no_match", "missing_intent"])


@query("pool_quality", f"""WITH {episode_sql()}, g AS (SELECT e.id, p.decide, p.has_context, sum((e.acc < 0.3 OR e.pos = e.id::BIGINT % e.n)::INT)::DOUBLE / count(*) AS share FROM ent e JOIN ep p USING (id) GROUP BY ALL)
SELECT count(*) FILTER (decide < 0.7)::BIGINT AS selected, count(*) FILTER (decide < 0.7 AND has_context)::BIGINT AS selected_with_context, count(*) FILTER (decide < 0.7 AND share = 1)::BIGINT AS all_acceptable, avg(share) FILTER (decide < 0.7) AS mean_acceptable_share FROM g""")
def pool_quality(spark, d):
    """A19."""
    return P.pool_quality(episodes(spark, d))


@query("allocation_mismatch", f"WITH {POOL_SQL}, h AS (SELECT family, bucket, count(*)::BIGINT AS have FROM pool WHERE bucket IS NOT NULL GROUP BY ALL), q AS (SELECT DISTINCT family, b.bucket, b.quota FROM pool, (VALUES ('select', 15::BIGINT), ('no_match', 2), ('missing_intent', 3)) b(bucket, quota)) SELECT family, bucket, coalesce(have, 0) AS have, coalesce(quota, 0) AS quota FROM h FULL JOIN q USING (family, bucket) WHERE coalesce(have, 0) <> coalesce(quota, 0)")
def allocation_mismatch(spark, d):
    """A27."""
    p = pool(spark, d)
    q = p.select("family").distinct().join(spark.createDataFrame([("select", 15), ("no_match", 2), ("missing_intent", 3)], "bucket string, quota long"), F.lit(True))
    return P.allocation_mismatch(p.where("bucket IS NOT NULL"), q, ["family", "bucket"])


@query("composition_gate", f"WITH {POOL_SQL}, g AS (SELECT bucket, count(*)::BIGINT AS n, count(*)::DOUBLE / (SELECT count(*) FROM pool WHERE bucket IS NOT NULL) AS share, CASE bucket WHEN 'select' THEN 0.7::DOUBLE WHEN 'no_match' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS target FROM pool WHERE bucket IS NOT NULL GROUP BY 1) SELECT *, abs(share - target) <= 0.025 AS within FROM g")
def composition_gate(spark, d):
    """A28."""
    return P.composition_gate(pool(spark, d).where("bucket IS NOT NULL"), {"select": 0.7, "no_match": 0.2, "missing_intent": 0.1})


@query("coverage_gate", f"WITH {episode_sql()} SELECT count(DISTINCT family)::BIGINT AS families, count(DISTINCT n)::BIGINT AS sizes, max(n)::INT AS largest, count(DISTINCT family) = 12 AND count(DISTINCT n) >= 5 AS covered FROM ep")
def coverage_gate(spark, d):
    """A29."""
    return P.coverage_gate(episodes(spark, d), 12, 5)


# --- logs ---

@query("usage_rollup", f"WITH {LOG_SQL} SELECT phase, model, CASE WHEN grouping(phase) = 0 THEN 'phase' WHEN grouping(model) = 0 THEN 'model' ELSE 'total' END AS level, count(*)::BIGINT AS requests, sum(tokens)::BIGINT AS tokens, coalesce(sum(reasoning), 0)::BIGINT AS reasoning, count(reasoning)::BIGINT AS reasoning_known, (count(*) - count(reasoning))::BIGINT AS reasoning_missing, count(*) FILTER (status = 'failed')::BIGINT AS failed FROM log GROUP BY GROUPING SETS ((), (phase), (model))")
def usage_rollup(spark, d):
    """A20, P30."""
    return U.rollup(log(spark, d))


@query("usage_by_status", f"WITH {LOG_SQL} SELECT phase, status, count(*)::BIGINT AS requests, sum(tokens)::BIGINT AS tokens, count(*) FILTER (audit_id IN (SELECT doc_id FROM documents))::BIGINT AS referenced FROM log GROUP BY ALL")
def usage_by_status(spark, d):
    """A21."""
    return U.by_status(log(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("audit_id")))


@query("phase_throughput", f"WITH {LOG_SQL} SELECT phase, count(*) FILTER (status = 'completed')::BIGINT AS accepted, count(*)::BIGINT AS requests, count(*) FILTER (status = 'completed') / nullif((epoch_us(max(started_at)) - epoch_us(min(started_at))) / 3.6e9::DOUBLE, 0) AS accepted_per_hour, sum(tokens)::DOUBLE / nullif(count(*) FILTER (status = 'completed'), 0) AS tokens_per_accepted, median(tokens)::DOUBLE AS median_tokens FROM log GROUP BY 1")
def phase_throughput(spark, d):
    """A22."""
    return U.throughput(log(spark, d), F.col("status") == "completed")


@query("rejection_histogram", f"WITH {POOL_SQL} SELECT coalesce(reason, 'none') AS reason, count(*)::BIGINT AS n FROM pool GROUP BY 1")
def rejection_histogram(spark, d):
    """A23."""
    return U.histogram(pool(spark, d).select(F.coalesce("reason", F.lit("none")).alias("reason")), "reason")


@query("teacher_sources", f"WITH {LOG_SQL}, r AS (SELECT 'author' AS role, doc_id AS audit_id FROM documents UNION ALL SELECT 'primary_label', doc_id + 1 FROM documents UNION ALL SELECT 'review', doc_id + 2 FROM documents WHERE doc_id % 10 = 0) SELECT role, model, count(*)::BIGINT AS n FROM r JOIN log USING (audit_id) GROUP BY ALL")
def teacher_sources(spark, d):
    """J15, A24."""
    x = F.col("doc_id")
    return U.sources_by_role(table(spark, d, "documents").select(x.alias("author"), (x + 1).alias("primary_label"), F.when(x % 10 == 0, x + 2).alias("review")), log(spark, d), ["author", "primary_label", "review"])


@query("latest_attempt", f"WITH {LOG_SQL} SELECT owner, max(started_at) AS started_at, max_by(audit_id, {{'a': started_at, 'b': audit_id}}) AS audit_id FROM log GROUP BY owner")
def latest_attempt(spark, d):
    """W11."""
    return U.latest(log(spark, d), "owner", "started_at", ["audit_id"]).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("restart_budget_1h", f"WITH {LOG_SQL} SELECT audit_id, owner, count(*) OVER (PARTITION BY owner ORDER BY started_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM log")
def restart_budget_1h(spark, d):
    """W14, T6."""
    return U.recent(log(spark, d), "owner").select("audit_id", "owner", "recent")


_STREAK = f"""WITH {LOG_SQL}, f AS (SELECT *, (tokens % 3 <> 0)::INT AS f, sum((tokens % 3 = 0)::INT) OVER (PARTITION BY owner ORDER BY started_at, audit_id ROWS UNBOUNDED PRECEDING) AS island FROM log),
s AS (SELECT audit_id, owner, (CASE WHEN f = 1 THEN sum(f) OVER (PARTITION BY owner, island ORDER BY started_at, audit_id ROWS UNBOUNDED PRECEDING) ELSE 0 END)::BIGINT AS streak FROM f)"""


@query("backoff_streaks", f"{_STREAK} SELECT *, CASE WHEN streak > 0 THEN least(900.0::DOUBLE, 60 * pow(2.0::DOUBLE, least(streak - 1, 4))) ELSE 0.0::DOUBLE END AS pause FROM s")
def backoff_streaks(spark, d):
    """T4 in batch: gaps and islands."""
    return U.streaks(log(spark, d), "owner", F.col("tokens") % 3 != 0, ["started_at", "audit_id"]).select("audit_id", "owner", F.col("streak").cast("long").alias("streak"), "pause")


@query("pause_sessions", f"""WITH {LOG_SQL}, g AS (SELECT owner, started_at, CASE WHEN started_at - lag(started_at) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM log WINDOW w AS (PARTITION BY owner ORDER BY started_at)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY started_at RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT owner, min(started_at) AS first, max(started_at) AS last, count(*)::BIGINT AS events FROM s GROUP BY owner, k""")
def pause_sessions(spark, d):
    """T9 in batch."""
    s = U.sessions(log(spark, d), "owner", 6 * 3600)
    return s.select("owner", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "events")


@query("supervisor_actions", "SELECT event_id, CASE WHEN event_id % 13 = 0 AND event_id % 3 <> 0 THEN 'done' WHEN event_id % 13 = 0 THEN 'finishing_done' WHEN event_id % 3 = 0 THEN 'running_or_waiting_for_provider' WHEN event_id % 5 = 0 THEN 'another_producer_holds_split_lock' WHEN event_id % 7 = 0 THEN 'waiting_for_shared_provider' WHEN event_id % 4 >= 3 THEN 'restart_limit_requires_review' ELSE 'launch' END AS action FROM events")
def supervisor_actions(spark, d):
    """T7."""
    x = F.col("event_id")
    return table(spark, d, "events").select("event_id", U.next_action(F.when(x % 13 == 0, "done"), x % 3 == 0, x % 5 == 0, x % 7 == 0, x % 4).alias("action"))


@query("effort_report", f"WITH {LOG_SQL} SELECT model AS effort, count(*) FILTER (tokens % 2 = 0)::BIGINT AS matched, count(*) FILTER (status = 'completed')::BIGINT AS valid, count(*) FILTER (status <> 'completed')::BIGINT AS format_failures, sum(tokens)::BIGINT AS tokens, median(tokens / 10.0::DOUBLE) AS median_seconds FROM log GROUP BY 1")
def effort_report(spark, d):
    """A25."""
    return U.effort(log(spark, d).select(F.col("model").alias("effort"), (F.col("tokens") % 2 == 0).alias("matched"), (F.col("status") == "completed").alias("valid"), "tokens", (F.col("tokens") / 10.0).alias("seconds")))


@query("micro_batch_choice", f"WITH {LOG_SQL}, g AS (SELECT model, avg(tokens) AS seconds FROM log GROUP BY 1) SELECT model, seconds FROM g ORDER BY seconds, model LIMIT 1")
def micro_batch_choice(spark, d):
    """A33."""
    return U.cheapest(log(spark, d).groupBy("model").agg(F.avg("tokens").alias("seconds")), "model", "seconds")


@query("best_checkpoint", f"WITH {LOG_SQL}, e AS (SELECT model, audit_id % 50 AS epoch, count(*) FILTER (tokens % 3 = 0) AS metric, count(*) FILTER (status = 'completed') AS accuracy, sum(tokens) AS loss FROM log GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY metric DESC, accuracy DESC, loss, epoch) AS r FROM e) SELECT model, epoch, metric FROM r WHERE r = 1")
def best_checkpoint(spark, d):
    """W12, A31."""
    e = log(spark, d).groupBy("model", (F.col("audit_id") % 50).alias("epoch")).agg(F.count_if(F.col("tokens") % 3 == 0).alias("metric"), F.count_if(F.col("status") == "completed").alias("accuracy"), F.sum("tokens").alias("loss"))
    return U.best_checkpoint(e, "model")


@query("length_bucket_order", "WITH r AS (SELECT doc_id, n_chars, sha256(doc_id::VARCHAR) AS h, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR)) - 1 AS k FROM documents), b AS (SELECT *, k // 128 AS block FROM r) SELECT doc_id, block, block * 128 + row_number() OVER (PARTITION BY block ORDER BY n_chars, h) - 1 AS position FROM b")
def length_bucket_order(spark, d):
    """O6, O1."""
    return U.bucketed_order(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 128).select("doc_id", "block", "position")


@query("workload_quantiles", "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position, count(*) OVER () AS n FROM documents) SELECT doc_id, n_chars, position FROM r WHERE position IN (SELECT round_even(i * (n - 1) / 15.0::DOUBLE, 0)::BIGINT FROM range(16) t(i), (SELECT DISTINCT n FROM r))")
def workload_quantiles(spark, d):
    """W6; sixteen rows are the feature."""
    return U.quantile_rows(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "n_chars", "position")


@query("distinct_responses", "SELECT count(*)::BIGINT AS n, sum(user_id)::BIGINT AS s FROM (SELECT DISTINCT CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id // 2 END AS a, CASE WHEN event_id % 4 = 0 THEN user_id END AS u, CASE WHEN event_id % 4 = 0 THEN event_type END AS t, CASE WHEN event_id % 4 = 0 THEN user_id ELSE 0 END AS user_id FROM events)")
def distinct_responses(spark, d):
    """By attempt, else by owner and phase."""
    from weftline.operators.dedup import distinct_responses as distinct

    x = F.col("event_id")
    e = table(spark, d, "events").select(F.when(x % 4 != 0, F.floor(x / 2)).alias("attempt"), "user_id", "event_type")
    return distinct(e, "attempt", ["user_id", "event_type"]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("attempt").isNull(), F.col("user_id")).otherwise(0)).alias("s"))


@query("top_by_size", "SELECT conv_id, count(*)::BIGINT AS n FROM conversations GROUP BY 1 ORDER BY n DESC, conv_id LIMIT 10")
def top_by_size(spark, d):
    """O3, O4; ten rows are the feature."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "conv_id").limit(10)


@query("draft_checks", "SELECT doc_id::VARCHAR AS id, [NULL, 'candidate_count', 'secure', 'surface', 'raw_surrounding_text', 'duplicated_selection', 'nearby_too_many', 'nearby_too_long', 'duplicate_payload', 'missing', 'unplanned'][doc_id % 11 + 1] AS problem FROM documents")
def draft_checks(spark, d):
    """One draft of each outcome, against its plan."""
    from weftline.operators.drafts import drafts_against_plans

    k = F.col("doc_id") % 11
    text = lambda s: F.lit(s)
    entry = lambda s: F.struct(text("text").alias("kind"), s.alias("text"))
    near = F.when(k == 6, F.array(*[text(x) for x in "abcde"])).when(k == 7, F.array(F.repeat(text("x"), F.lit(241)))).otherwise(F.array(text("n")))
    draft = F.struct(
        F.struct((k == 2).alias("isSecure"), F.when(k == 3, "nowhere").otherwise("text").alias("inputSurface"), F.when(k == 4, "raw").otherwise("").alias("surroundingText"), F.when(k == 5, "sel").otherwise("").alias("selectedText")).alias("context"),
        F.struct(F.when(k == 5, "sel").otherwise("b").alias("beforeSelection"), text("").alias("afterSelection"), near.alias("nearbyText")).alias("capture"),
        F.when(k == 1, F.array(entry(text("a")))).when(k == 8, F.array(entry(text("a")), entry(text("a")))).otherwise(F.array(entry(text("a")), entry(text("b")))).alias("entries"),
    )
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), draft.alias("draft"))
    return drafts_against_plans(rows.where("doc_id % 11 <> 9").select("id", "draft"), rows.where("doc_id % 11 <> 10").select("id", F.lit(2).alias("candidate_count")))


@query("request_attempts", "SELECT event_id, 'b-a' || (event_id % 40) AS batch_id, (event_id % 3)::INT AS attempt FROM events WHERE event_id % 40 < 30 AND event_id % 7 <> 0")
def request_attempts(spark, d):
    """Requests on their batches by prefix; every seventh has no attempt mark."""
    from weftline.operators.drafts import request_attempts as attempts

    x = F.col("event_id")
    name = F.concat(F.lit("b-a"), (x % 40).cast("string"))
    r = table(spark, d, "events").select("event_id", F.concat(name, F.when(x % 7 == 0, "-x").otherwise(F.concat(F.lit("-a"), (x % 3).cast("string")))).alias("request_id"))
    b = spark.range(30).select(F.concat(F.lit("b-a"), F.col("id").cast("string")).alias("batch_id"))
    return attempts(r, b).select("event_id", "batch_id", "attempt")


@query("approved_mixture", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 1 ORDER BY n_chars DESC, doc_id LIMIT 50")
def approved_mixture(spark, d):
    """The first fifty approved nominations in their order; fifty is the planned quantity."""
    from weftline.operators.drafts import approved_in_order

    n = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (-F.col("n_chars")).alias("rank"))
    return approved_in_order(n, n.where("id % 3 <> 1"), "rank", 50).select("id")


@query("inference_views", "SELECT doc_id AS id, (doc_id % 4 = 0) AS secure, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS label, 'file|text' AS capabilities FROM documents")
def inference_views(spark, d):
    """What a model may see; secure fields show no text."""
    from weftline.operators.drafts import inference_view

    n = F.lit(None).cast("string")
    context = F.struct(n.alias("applicationCategory"), F.col("lang").alias("fieldLabel"), n.alias("fieldRole"), F.lit(None).cast("boolean").alias("hasAccessibility"), n.alias("inputSurface"), (F.col("doc_id") % 4 == 0).alias("isSecure"), n.alias("selectedText"), n.alias("surroundingText"))
    entries = F.array(F.struct(F.array(F.lit("text"), F.lit("file"), F.lit("text")).alias("capabilities"), F.lit("c").alias("id"), F.lit("text").alias("kind"), F.lit("unknown").alias("sourceCategory"), F.lit("t").alias("text")))
    v = inference_view(table(spark, d, "documents").select(F.col("doc_id").alias("id"), context.alias("context"), entries.alias("entries"), F.lit("hidden").alias("label")))
    return v.select("id", F.col("context.isSecure").alias("secure"), F.col("context.fieldLabel").alias("label"), F.array_join(F.get("entries", F.lit(0))["capabilities"], "|").alias("capabilities"))
