"""Queries of row contracts, authoring, replays and small files. Their stand-ins are built from the text, ids and counts of documents, conversations and events."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weftline.functions import envelope as E
from weftline.functions import expr as X
from weftline.operators import authoring as A
from weftline.operators import drafts as DR
from weftline.operators import gates as G
from weftline.operators import outcomes as O
from weftline.operators import replay as R
from weftline.operators import usage as U
from weftline.operators.ranks import ranked
from weftline.plans import run_plan
from weftline.plans.catalog import query
from weftline.plans.gating import cases, docs
from weftline.plans.standins import POOL_SQL, episode_sql, episodes, pool, table
from weftline.sources import records, shared

DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents)"


def pick(x, values):
    """SQL and Spark: the value at x modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (x % len(values) + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_pick(x: str, values) -> str:
    return f"{sql_list(values)}[({x} % {len(values)} + 1)::INT]"


# --- authoring -------------------------------------------------------------------------------------------------------

FAMILIES = ["file_listing", "http_method", "configuration_boolean", "python_", "sql_", "document_export_format", "design_image_dimensions", "design_color_syntax", "email_recipient_address", "chat_", "spreadsheet_", "url_", "contact_postal_address", "markdown_link", "calendar_rsvp_status", "other"]


def _family(x):
    f = pick(x, FAMILIES)
    return F.when(F.endswith(f, F.lit("_")), F.concat(f, F.col("lang"))).otherwise(f)


_FAMILY_SQL = f"(CASE WHEN ends_with({sql_pick('doc_id', FAMILIES)}, '_') THEN {sql_pick('doc_id', FAMILIES)} || lang ELSE {sql_pick('doc_id', FAMILIES)} END)"
_PROFILE_ROWS = ", ".join(f"({i}, '{n}', '{c}', '{r}', '{la}', '{s}', {sql_list(g) if g else '[]::VARCHAR[]'})" for i, (names, c, r, la, s, g) in enumerate(A.PROFILES) for n in names)
_PROFILE_SQL = f"""fam AS (SELECT *, {_FAMILY_SQL} AS family FROM d), profiles(ord, name, category, role, label, src, guidance) AS (VALUES {_PROFILE_ROWS}),
hit AS (SELECT doc_id, min(ord) AS ord FROM fam JOIN profiles ON family = name OR (ends_with(name, '*') AND starts_with(family, left(name, -1))) GROUP BY 1),
prof AS (SELECT fam.*, p.category, p.role, p.label, p.src, p.guidance FROM fam LEFT JOIN hit USING (doc_id) LEFT JOIN (SELECT DISTINCT ON (ord) * FROM profiles) p ON p.ord = hit.ord)"""


@query("field_profiles", f"""WITH {DOCS}, {_PROFILE_SQL} SELECT doc_id, family, CASE WHEN doc_id % 3 = 0 THEN coalesce({{'development': 'browser', 'spreadsheet': 'development', 'browser': 'writing', 'writing': 'browser', 'mail': 'writing', 'creative': 'writing'}}[category], category) ELSE category END AS category,
role, label, src AS source, array_to_string(guidance, '|') AS guidance, CASE WHEN family IN ('http_method', 'configuration_boolean', 'calendar_rsvp_status') THEN 4 ELSE 20 END::INT AS most FROM prof""".replace("{'development'", "MAP {'development'"))  # fmt: skip
def field_profiles(spark, d):
    """Each family's field, a third of them hosted by another application, and its candidate space."""
    x = table(spark, d, "documents").select("doc_id", _family(F.col("doc_id")).alias("family"))
    p = x.withColumn("p", A.field_profile(F.col("family"), F.col("doc_id") % 3 == 0))
    return p.select("doc_id", "family", F.col("p.applicationCategory").alias("category"), F.col("p.fieldRole").alias("role"), F.col("p.fieldLabel").alias("label"), F.col("p.sourceCategory").alias("source"),
                    F.array_join("p.staticGuidance", "|").alias("guidance"), A.candidate_space(F.col("family"))["most"].alias("most"))


def _items(spark, d):
    """doc_id, family, item, count: author items of one to five candidates, some with a fault."""
    x, w = F.col("doc_id"), F.split("text", " ")
    n = (x % 5 + 1).cast("int")
    kind = lambda j: (x + j) % 4
    texts = F.transform(F.sequence(F.lit(1), n), lambda j: F.struct(
        F.when(kind(j) < 2, F.coalesce(F.get(w, j), F.lit("-"))).alias("text"), F.when(kind(j) == 2, F.array(F.concat(F.lit("f"), j.cast("string")), F.lit("g"))).alias("file"),
        F.when(kind(j) == 3, F.when(x % 7 == 0, F.array(F.lit(3))).otherwise(F.array(F.lit(3), (x % 9).cast("int")))).alias("image")))
    item = F.struct(F.slice(F.concat(w, F.array(F.lit("a"), F.lit("b"), F.lit("c"))), F.lit(1), (x % 4).cast("int")).alias("guidance"), F.substring("text", 1, 20).alias("selected"), texts.alias("candidates"))
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").select("doc_id", _family(x).alias("family"), item.alias("item"), F.when(x % 11 == 0, n + 1).otherwise(n).alias("count"))


@query("compiled_drafts", f"""WITH {DOCS}, {_PROFILE_SQL}, w AS (SELECT *, (string_split(text, ' ') || ['a', 'b', 'c'])[1:doc_id % 4] AS g, (doc_id % 5 + 1)::INT AS n, list_transform(range(1, doc_id % 5 + 2), lambda j: CASE (doc_id + j) % 4 WHEN 2 THEN 'file' WHEN 3 THEN 'image' ELSE 'text' END) AS kinds FROM prof),
p AS (SELECT *, CASE WHEN category IS NULL THEN 'no_profile' WHEN len(g) > 2 OR len(list_filter(g, lambda x: len(x) > 240)) > 0 THEN 'guidance' WHEN doc_id % 11 = 0 THEN 'candidate_count' WHEN len(guidance) + len(g) > 4 THEN 'nearby' WHEN doc_id % 7 = 0 AND list_contains(kinds, 'image') THEN 'image_size' END AS problem FROM w)
SELECT doc_id, problem, CASE WHEN problem IS NULL THEN array_to_string(kinds, ',') END AS kinds, CASE WHEN problem IS NULL THEN array_to_string(list_transform(range(1, n + 1), lambda j: 'c' || j), ',') END AS ids, CASE WHEN problem IS NULL THEN array_to_string(guidance || g, '|') END AS nearby, CASE WHEN problem IS NULL THEN category END AS category FROM p""")  # fmt: skip
def compiled_drafts(spark, d):
    """Items compiled to raw fixtures, or the reason why not."""
    x = _items(spark, d).withColumn("p", A.field_profile(F.col("family")))
    x = x.withColumn("problem", A.draft_problem(F.col("item"), F.col("count"), F.col("p")))
    x = x.withColumn("raw", F.when(F.col("problem").isNull(), A.compiled(F.col("item"), F.col("p"))))
    return x.select("doc_id", "problem", F.array_join(F.transform("raw.entries", lambda e: e["payload"]["type"]), ",").alias("kinds"), F.array_join(F.transform("raw.entries", lambda e: e["id"]), ",").alias("ids"),
                    F.array_join("raw.capture.nearbyText", "|").alias("nearby"), F.col("raw.context.applicationCategory").alias("category"))


def _context(label, role, selected, around, secure=None):
    return F.struct(F.lit("mail").alias("applicationCategory"), label.alias("fieldLabel"), role.alias("fieldRole"), F.lit(True).alias("hasAccessibility"), F.lit("text").alias("inputSurface"), (F.lit(False) if secure is None else secure).alias("isSecure"), selected.alias("selectedText"), around.alias("surroundingText"))


VARIANTS = ["standard", "no_accessibility", "generic_field", "other"]


@query("observation_views", f"""WITH {DOCS}, v AS (SELECT *, {sql_pick('doc_id', VARIANTS)} AS variant FROM d),
p AS (SELECT *, CASE WHEN variant = 'other' THEN 'unregistered_variant' WHEN doc_id % 13 = 0 THEN 'already_labelled' WHEN variant <> 'standard' AND doc_id % 11 = 0 THEN 'secure_input' END AS problem, variant <> 'standard' AS hide, variant = 'no_accessibility' AS bare, doc_id % 11 = 0 AS secure FROM v)
SELECT doc_id, problem, CASE WHEN problem IS NULL THEN CASE WHEN bare OR secure THEN '' ELSE source END END AS label, CASE WHEN problem IS NULL THEN CASE WHEN bare THEN '' ELSE 'AXTextArea' END END AS role, CASE WHEN problem IS NULL THEN NOT bare END AS accessible,
CASE WHEN problem IS NULL THEN CASE WHEN hide OR secure THEN '' ELSE left(text, 10) END END AS selected, CASE WHEN problem IS NULL THEN CASE WHEN hide OR secure THEN '' ELSE left(text, 30) END END AS around, CASE WHEN problem IS NULL THEN CASE WHEN hide THEN 'unknown' ELSE 'text' END END AS surface FROM p""")  # fmt: skip
def observation_views(spark, d):
    """Registered views of a context, or why one isn't applied."""
    x = F.col("doc_id")
    e = table(spark, d, "documents").select("doc_id", pick(x, VARIANTS).alias("variant"), _context(F.col("source"), F.lit("AXTextArea"), F.substring(F.coalesce("text", F.lit("")), 1, 10), F.substring(F.coalesce("text", F.lit("")), 1, 30), x % 11 == 0).alias("c"))
    e = e.withColumn("problem", G.variant_problem(F.col("variant"), x % 13 == 0, F.col("c.isSecure")))
    e = e.withColumn("c", F.when(F.col("problem").isNull(), G.observation_variant(F.col("c"), F.col("variant"))))
    return e.select("doc_id", "problem", *[F.col(f"c.{f}").alias(n) for f, n in (("fieldLabel", "label"), ("fieldRole", "role"), ("hasAccessibility", "accessible"), ("selectedText", "selected"), ("surroundingText", "around"), ("inputSurface", "surface"))])


def _trim_step(a: str, b: str) -> str:
    return f"""{b} AS (SELECT doc_id, CASE WHEN x >= y AND x >= z THEN greatest(0, x - e) ELSE x END AS x, CASE WHEN y > x AND y >= z THEN greatest(0, y - e) ELSE y END AS y, CASE WHEN z > x AND z > y THEN greatest(0, z - e) ELSE z END AS z
FROM (SELECT *, greatest(0, 3 + x + y + z - 448) AS e FROM {a}))"""


@query("balanced_trim", f"WITH {DOCS}, s0 AS (SELECT doc_id, doc_id % 200 AS x, len(regexp_extract_all(text, '\\S+'))::BIGINT AS y, len(text)::BIGINT // 9 AS z FROM d), {_trim_step('s0', 's1')}, {_trim_step('s1', 's2')}, {_trim_step('s2', 's3')} SELECT doc_id, x AS label, y AS selected, z AS around FROM s3")
def balanced_trim(spark, d):
    """Token counts left of three fields."""
    x = docs(spark, d).select("doc_id", (F.col("doc_id") % 200).alias("x"), X.word_count(F.col("text")).cast("long").alias("y"), F.floor(F.length("text") / 9).cast("long").alias("z"))
    return x.select("doc_id", *[c.cast("long").alias(n) for c, n in zip(G.trim_longest([F.col("x"), F.col("y"), F.col("z")], 448, 3), ("label", "selected", "around"), strict=True)])


@query("pair_budget", rf"WITH {episode_sql()} SELECT e.id, max(3 + 9 + 4 + len(regexp_extract_all(f.text, '\S+')) + len(regexp_extract_all(e.text, '\S+')))::BIGINT AS max_pair_tokens, max(3 + 9 + 4 + len(regexp_extract_all(f.text, '\S+')) + len(regexp_extract_all(e.text, '\S+'))) <= 1024 AS fits FROM ent e JOIN ent f ON f.id = e.id AND f.pos = 0 GROUP BY e.id")
def pair_budget(spark, d):
    """P5: the largest pair of each episode, by words; the first turn is what surrounds the field."""
    e = episodes(spark, d)
    context = _context(F.col("family"), F.lit("AXTextArea"), F.lit(""), F.get("entries", F.lit(0))["text"])
    entry = lambda x: F.struct(x["kind"].alias("kind"), F.array(F.lit("text"), F.lit("file")).alias("capabilities"), F.lit("mail").alias("sourceCategory"))
    e = e.select("id", context.alias("context"), "entries")
    body = X.word_count(DR.context_body(F.col("context")))
    return DR.pair_sizes(e, body, lambda x: X.word_count(DR.metadata(F.col("context"), entry(x))) + X.word_count(x["text"])).select("id", F.col("max_pair_tokens").cast("long").alias("max_pair_tokens"), "fits")


@query("label_batches", f"""WITH {episode_sql()}, h AS (SELECT id, bool_or(ok) AS x FROM (SELECT e.id, e.kind, bool_or(acc < 0.3 OR pos = e.id::BIGINT % e.n) AND bool_or(NOT (acc < 0.3 OR pos = e.id::BIGINT % e.n)) AS ok FROM ent e GROUP BY e.id, e.kind) GROUP BY id)
SELECT id, CASE id::BIGINT % 10 WHEN 3 THEN 'missing' WHEN 5 THEN 'repeated' WHEN 6 THEN 'unknown_ids' ELSE CASE WHEN decide < 0.7 AND x THEN 'identical_text_omitted' END END AS problem FROM ep JOIN h USING (id) UNION ALL SELECT 'x' || id, 'unknown_id' FROM ep WHERE id::BIGINT % 10 = 4""")  # fmt: skip
def label_batches(spark, d):
    """Responses that miss, repeat, invent and break labels. Entries are told apart by role here, so some texts are equal."""
    e = episodes(spark, d).withColumn("entries", F.transform("entries", lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("text"), F.array(F.lit("text")).alias("capabilities")))).select("id", "entries", "label")
    e = shared.stored(e, "label-rows")
    k = F.col("id").cast("long") % 10
    bad = F.when(k == 6, F.col("label").withField("acceptable_ids", F.concat("label.acceptable_ids", F.array(F.lit("zz"))))).otherwise(F.col("label"))
    said = e.where(k != 3).select("id", bad.alias("label"))
    said = said.unionByName(e.where(k == 5).select("id", "label")).unionByName(e.where(k == 4).select(F.concat(F.lit("x"), "id").alias("id"), "label"))
    return G.label_batch_problems(said, e)


@query("program_gate", f"WITH {DOCS} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'no_semantic_context' WHEN doc_id % 3 <> 1 AND doc_id % 2 = 1 THEN 'python_syntax' END AS problem FROM d")
def program_gate(spark, d):
    """P10: selections without a context, and positives that aren't Python where they'd go."""
    x = F.col("doc_id")
    around = F.when(x % 5 == 0, "").otherwise(F.to_json(F.struct(F.lit(E.FORMAT).alias("format"), F.lit(True).alias("selectionKnown"), F.concat(F.lit("x_"), "lang", F.lit(" = ")).alias("beforeSelection"), F.lit("").alias("afterSelection"), F.array().cast("array<string>").alias("nearbyText"))))
    entries = F.array(F.struct(F.lit("a").alias("id"), F.when(x % 2 == 0, F.to_json(F.array(F.substring(F.coalesce("text", F.lit("")), 1, 40)))).otherwise(F.concat(F.lit("("), x.cast("string"))).alias("text")))
    label = F.struct(F.when(x % 7 == 0, "no_match").alias("abstain_reason"), F.when(x % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("acceptable_ids"), F.when(x % 7 == 0, "abstain").otherwise("select").alias("decision"))
    t = table(spark, d, "documents")
    return t.select("doc_id", DR.program_problem(_context(F.lit(""), F.lit(""), F.lit(""), around), entries, label, F.when(x % 3 == 1, "chat_y").otherwise("python_x")).alias("problem"))


@query("current_gates", f"""WITH {POOL_SQL} SELECT id FROM pool WHERE bucket IS NOT NULL AND id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0 AND id % 5 <> 0 AND CASE WHEN id % 17 = 0 THEN 'select' ELSE bucket END = bucket AND text NOT IN (SELECT text FROM pool WHERE id % 19 = 0)""")
def current_gates(spark, d):
    """Held-out rows that pass every gate of today."""
    x = F.col("id")
    entries = F.array(F.struct(F.lit("a").alias("id"), F.col("text")))
    p = pool(spark, d).where("bucket IS NOT NULL OR id % 19 = 0").select(
        "id", _context(F.lit("f"), F.lit(""), F.lit(""), F.lit("")).alias("context"), entries.alias("entries"), F.struct(F.col("reason").alias("abstain_reason"), F.col("decision")).alias("label"), F.when(x % 17 == 0, "select").otherwise(F.col("bucket")).alias("desired"), "bucket",
        F.col("family").alias("family_id"), F.when(x % 7 == 0, "other").otherwise(F.col("family")).alias("observed_family_id"), F.when(x % 13 == 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("secondary_family_ids"), (x % 11 != 0).alias("realistic"), F.when(x % 5 == 0, "p1").otherwise("p2").alias("protocol"))
    gone = p.where("id % 19 = 0").select(X.content_fingerprint(F.col("context"), F.col("entries")).alias("digest"))
    return DR.gates_passed(p.where("bucket IS NOT NULL"), {"protocol": "p2"}, gone).select("id")


@query("author_fixtures", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{"slot":"s' || doc_id || '","decision_gate":"g' || lang || '"}' ELSE '{"slot":"s' || doc_id || '"}' END AS fixture FROM documents""")
def author_fixtures(spark, d):
    """Drafts without their gate; versions that have none stay as they are."""
    x = F.col("doc_id")
    draft = F.struct(F.concat(F.lit("s"), x.cast("string")).alias("slot"), F.concat(F.lit("g"), "lang").alias("decision_gate"))
    return table(spark, d, "documents").select("doc_id", F.to_json(DR.author_view(draft, x % 3 != 0)).alias("fixture"))


_APPS = [(i, name) for i, names in enumerate(X.APPLICATIONS.values()) for name in names]


@query("application_categories", f"""WITH a(ord, name) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in _APPS)}), c(ord, category) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(X.APPLICATIONS))}),
b AS (SELECT event_id, lower({sql_pick('event_id', [n for _, n in _APPS])}) || CASE user_id % 4 WHEN 1 THEN '.helper' WHEN 2 THEN 'x' ELSE '' END AS bundle FROM events),
m AS (SELECT event_id, min(ord) AS ord FROM b JOIN a ON bundle = name AND NOT ends_with(name, '.') OR starts_with(bundle, CASE WHEN ends_with(name, '.') THEN name ELSE name || '.' END) GROUP BY 1)
SELECT event_id, coalesce(category, 'unknown') AS category FROM b LEFT JOIN m USING (event_id) LEFT JOIN c USING (ord)""")  # fmt: skip
def application_categories(spark, d):
    """Identifiers as they are, in capitals, with a part or a letter more."""
    u = F.col("user_id") % 4
    name = pick(F.col("event_id"), [n for _, n in _APPS])
    bundle = F.when(u == 0, F.upper(name)).when(u == 1, F.concat(name, F.lit(".helper"))).when(u == 2, F.concat(name, F.lit("x"))).otherwise(name)
    return table(spark, d, "events").select("event_id", X.application_category(bundle).alias("category"))


_WINDOW = "(CASE WHEN doc_id % 3 = 0 THEN '😀' ELSE '' END || left(text, 60))"


@query("focus_envelopes", f"""WITH {DOCS}, w AS (SELECT doc_id, {_WINDOW} AS w, doc_id % 3 = 0 AS wide, doc_id % 9 AS s, doc_id % 4 AS l, [' ' || source || ' ', source, lang, '', 'Mailer says ' || lang, 'fifth'] AS nearby FROM d),
u AS (SELECT *, len(w) + wide::INT AS units, CASE WHEN wide AND s >= 2 THEN s - 1 WHEN wide AND s = 1 THEN NULL ELSE s END AS a, CASE WHEN wide AND s + l >= 2 THEN s + l - 1 WHEN wide AND s + l = 1 THEN NULL ELSE s + l END AS b FROM w),
k AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND s + l <= units AND doc_id % 5 <> 0 AS known FROM u)
SELECT doc_id, CASE WHEN known THEN '{{"format":"focus-text-v1","selectionKnown":true,"beforeSelection":' || to_json(left(w, a))::VARCHAR || ',"afterSelection":' || to_json(substr(w, b + 1))::VARCHAR ELSE '{{"format":"focus-text-v1","selectionKnown":false,"textWindow":' || to_json(w)::VARCHAR END
|| ',"nearbyText":["' || source2 || '","' || lang2 || '"]}}' AS envelope FROM k JOIN (SELECT doc_id, source AS source2, lang AS lang2 FROM d) USING (doc_id)""")  # fmt: skip
def focus_envelopes(spark, d):
    """Selections in UTF-16 units, some through a surrogate pair, some with another text; texts nearby trimmed, told apart, without the host's name."""
    x = F.col("doc_id")
    t = table(spark, d, "documents").select("doc_id", "source", "lang", F.concat(F.when(x % 3 == 0, "😀").otherwise(""), F.substring(F.coalesce("text", F.lit("")), 1, 60)).alias("w"))
    start, length = (x % 9).cast("int"), (x % 4).cast("int")
    selected = F.when(x % 5 == 0, "another text").otherwise(X.utf16_substring(F.col("w"), start, length))
    nearby = F.array(F.concat(F.lit(" "), "source", F.lit(" ")), F.col("source"), F.col("lang"), F.lit(" Mailer\t"), F.lit("fifth"))
    return t.select("doc_id", E.render(F.col("w"), start, length, selected, nearby, "mailer").alias("envelope"))


@query("capture_checks", f"""WITH {DOCS}, w AS (SELECT doc_id, {_WINDOW} AS w, doc_id % 3 = 0 AS wide, doc_id % 80 AS s, doc_id % 7 AS l FROM d)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'half_range' WHEN s + l > len(w) + wide::INT THEN 'out_of_bounds' WHEN wide AND (s = 1 OR s + l = 1) THEN 'split_surrogate' WHEN doc_id % 4 = 0 THEN 'selection_mismatch' END AS problem FROM w""")  # fmt: skip
def capture_checks(spark, d):
    """Ranges that are half, outside, inside a pair or around another text."""
    x = F.col("doc_id")
    w = F.concat(F.when(x % 3 == 0, "😀").otherwise(""), F.substring(F.coalesce("text", F.lit("")), 1, 60))
    start, length = (x % 80).cast("int"), (x % 7).cast("int")
    selected = F.when(x % 4 == 0, "not this text").otherwise(X.utf16_substring(w, start, length))
    return table(spark, d, "documents").select("doc_id", G.capture_problem(w, F.when(x % 10 != 0, start), length, selected).alias("problem"))


PAYLOADS = ["text", "file", "image", "sound"]


@query("payload_checks", f"""WITH {DOCS}, k AS (SELECT *, {sql_pick('doc_id', PAYLOADS)} AS kind FROM d)
SELECT doc_id, CASE kind WHEN 'sound' THEN 'payload_type' WHEN 'text' THEN CASE WHEN NOT regexp_matches(text, '\\S') OR doc_id % 12 = 0 OR octet_length(encode(text)) > 128000 THEN 'text' END
WHEN 'file' THEN CASE WHEN doc_id % 8 = 5 THEN 'file_names' WHEN doc_id % 12 = 1 THEN 'repeated_files' END ELSE CASE WHEN doc_id % 9000 NOT BETWEEN 1 AND 8192 OR doc_id % 5000 < 1 OR (doc_id % 9000) * (doc_id % 5000) > 16777216 THEN 'image_size' END END AS problem FROM k""")  # fmt: skip
def payload_checks(spark, d):
    """P25: payload types, empty and long texts, file names with paths, repeated files, image sizes."""
    x, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    names = F.array(F.concat(F.lit("file-"), "lang"), F.when(x % 8 == 5, F.concat(F.lit("a/"), "lang")).when(x % 12 == 1, F.concat(F.lit("file-"), "lang")).otherwise(F.concat(F.lit("more-"), "lang")))
    return table(spark, d, "documents").select("doc_id", G.payload_problem(F.when(x % 12 == 0, "  ").otherwise(t), pick(x, PAYLOADS), (x % 9000).cast("int"), (x % 5000).cast("int"), names).alias("problem"))


@query("normalized_responses", """WITH e AS (SELECT event_id, event_id % 3 AS p, event_id % 5 AS k, event_id % 7 AS m, event_id % 11 = 0 AS own, event_id % 13 = 0 AS skip FROM events),
r AS (SELECT *, CASE WHEN own THEN 'timeout' WHEN p = 0 THEN CASE WHEN NOT skip AND k = 1 THEN 'invalid_score_response' END WHEN m = 1 THEN 'baseline_model_failure' WHEN p = 1 AND m = 2 THEN 'baseline_model_failure' WHEN p = 2 AND k = 2 THEN 'jev_remote_unavailable' WHEN k = 3 THEN 'baseline_invalid_request' END AS error FROM e)
SELECT event_id, error, CASE WHEN NOT own AND p = 0 AND NOT skip AND k = 1 THEN 'inference_failure' ELSE ['recommended', 'abstain', 'remote_unavailable', 'invalid_request', 'abstain'][k + 1] END AS decision,
CASE WHEN own THEN NULL WHEN p = 0 THEN CASE WHEN NOT skip AND k <> 1 THEN 'top' END ELSE 'r' || event_id END AS raw_top FROM r""")  # fmt: skip
def normalized_responses(spark, d):
    """Three protocols, failures of each kind."""
    x = F.col("event_id")
    k, m = x % 5, x % 7
    response = F.struct(
        F.when(x % 11 == 0, "timeout").alias("error"), pick(x, ["recommended", "abstain", "remote_unavailable", "invalid_request", "abstain"]).alias("decision"), F.when(m.isin(1, 2), "fallback").otherwise("model").alias("mode"),
        F.when(m == 1, "本次推荐未完成").otherwise("fine").alias("message"), F.when(m == 2, 1).otherwise(0).alias("inferenceCount"), F.array(F.concat(F.lit("r"), x.cast("string")), F.lit("s")).alias("rankings"))
    e = table(spark, d, "events").select("event_id", G.normalized_response(pick(x, ["ranker", "baseline", "jev"]), response, k != 1, F.lit("top"), x % 13 == 0).alias("r"))
    return e.select("event_id", "r.error", "r.decision", "r.raw_top")


@query("action_buckets", f"WITH {POOL_SQL} SELECT id, bucket, CASE id % 4 WHEN 0 THEN 'select' WHEN 1 THEN 'no_match' ELSE 'missing_intent' END = bucket AS matches FROM pool WHERE bucket IS NOT NULL")
def action_buckets(spark, d):
    """A label's bucket, and whether it's the planned one."""
    p = pool(spark, d).where("bucket IS NOT NULL").select("id", F.struct(F.col("reason").alias("abstain_reason"), F.col("decision")).alias("label"))
    planned = pick(F.col("id"), ["select", "no_match", "ambiguous", "insufficient_context"])
    return p.select("id", X.action_bucket(F.col("label.decision"), F.col("label.abstain_reason")).alias("bucket"), G.quota_matches(planned, F.col("label")).alias("matches"))


@query("rate_limit_evidence", """WITH e AS (SELECT event_id, event_id % 6 AS k, event_id % 90 + 1 AS n, user_id % 3 AS u FROM events),
s AS (SELECT *, k IN (0, 2) AS bare, k IN (0, 1) AS explicit FROM e)
SELECT event_id, CASE WHEN bare THEN 'provider_error_contains_429' WHEN explicit THEN 'explicit_provider_free_model_rate_limit' END AS signal, CASE WHEN bare OR explicit THEN CASE WHEN n * [1, 60, 3600][u + 1] <= 604800 THEN greatest(n * [1, 60, 3600][u + 1], CASE WHEN k = 2 THEN 45 ELSE 0 END) END END::BIGINT AS countdown FROM s""")  # fmt: skip
def rate_limit_evidence(spark, d):
    """Error events of a log, never the text that a model wrote."""
    x = F.col("event_id")
    k, n = x % 6, (x % 90 + 1).cast("string")
    reset = F.concat(F.lit("your limit will reset in "), n, F.lit(" "), pick(F.col("user_id"), ["seconds", "minutes", "hours"]))
    line = lambda *fields: F.to_json(F.struct(*fields))
    failed = lambda text: line(F.lit("message_end").alias("type"), F.struct(F.lit("assistant").alias("role"), F.lit("error").alias("stopReason"), text.alias("errorMessage")).alias("message"))
    written = line(F.lit("message_end").alias("type"), F.struct(F.lit("assistant").alias("role"), F.lit("stop").alias("stopReason"), F.lit("429, you reached free model rate limit").alias("errorMessage")).alias("message"))
    event = (
        F.when(k == 0, failed(F.concat(F.lit("HTTP 429: you Reached free model rate limit; "), reset)))
        .when(k == 1, line(F.lit("auto_retry_start").alias("type"), F.concat(F.lit("reached free model rate limit; "), reset).alias("error")))
        .when(k == 3, failed(F.concat(F.lit("cost 1429; "), reset))).otherwise(written)
    )
    stderr = F.when(k == 2, F.concat(F.lit("status 429 "), reset, F.lit(", then your limit will reset in 45 seconds")))
    e = table(spark, d, "events").select("event_id", X.limit_evidence(F.concat(F.lit("not json\n"), written, F.lit("\n"), event), stderr).alias("v"))
    return e.select("event_id", F.col("v.signal").alias("signal"), F.col("v.countdown").alias("countdown"))


@query("retry_delays", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 50)::DOUBLE WHEN 1 THEN (event_id % 300)::DOUBLE WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE END AS delay FROM events")
def retry_delays(spark, d):
    """Retry-After headers: seconds, an HTTP date, what lies behind, and neither."""
    x, now = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    date = lambda t: F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(x % 5 == 0, (x % 50).cast("string")).when(x % 5 == 1, date(F.timestamp_seconds(F.unix_timestamp(now) + x % 300))).when(x % 5 == 2, "-5").when(x % 5 == 3, date(F.timestamp_seconds(F.unix_timestamp(now) - 60))).otherwise("soon")
    return table(spark, d, "events").select("event_id", X.retry_after(header, now).alias("delay"))


@query("remapped_labels", f"WITH {episode_sql()} SELECT p.id, CASE WHEN decide < 0.7 THEN string_agg(cand, ',' ORDER BY cand) FILTER (acc < 0.3 OR pos = p.id::BIGINT % p.n) ELSE '' END AS acceptable FROM ep p JOIN ent e USING (id) GROUP BY p.id, decide")
def remapped_labels(spark, d):
    """Labels given on opaque ids in a hashed order, back on the episodes' own."""
    e = episodes(spark, d).select("id", "label", F.transform("entries", lambda x: F.struct(x["id"].alias("own"), x["id"].alias("id"))).alias("entries"))
    e = e.withColumn("seen", DR.reidentified(F.col("entries"), F.col("id")))
    opaque = F.transform(F.filter("seen", lambda x: F.array_contains("label.acceptable_ids", x["own"])), lambda x: x["id"])
    names = F.map_from_entries(F.transform("seen", lambda x: F.struct(x["id"].alias("key"), x["own"].alias("value"))))
    back = G.remapped(F.col("label").withField("acceptable_ids", opaque), names)
    return e.select("id", F.array_join(F.array_sort(back["acceptable_ids"]), ",").alias("acceptable"))


@query("reidentified_entries", "WITH h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY sha256(conv_id || ':' || i)) AS turns, string_agg('c' || (k - 1), ',' ORDER BY k) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sha256(conv_id || ':' || i)) AS k FROM h) GROUP BY conv_id")
def reidentified_entries(spark, d):
    """Entries in an order fixed by a seed's hash, with ids by position."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn"))).alias("t"))  # at most 20 turns
    c = c.select("conv_id", DR.reidentified(F.transform("t", lambda x: F.struct(x["turn"].alias("turn"), F.lit("").alias("id"))), F.col("conv_id")).alias("e"))
    return c.select("conv_id", F.array_join(F.transform("e", lambda x: x["turn"].cast("string")), ",").alias("turns"), F.array_join(F.transform("e", lambda x: x["id"]), ",").alias("ids"))


@query("acceptance_criteria", """WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN (event_id % 20 - 10) / 100.0::DOUBLE END AS g, user_id % 3 = 0 AS k, user_id % 2 = 0 AS c, event_id % 4 <> 3 AS f FROM events)
SELECT event_id, coalesce(g >= 0.05::DOUBLE, FALSE) AS top1_gain, k AS key_groups, c AS calibrated, f AS no_failures, coalesce(g >= 0.05::DOUBLE, FALSE) AND k AND c AND f AS accepted FROM e""")  # fmt: skip
def acceptance_criteria(spark, d):
    """A9."""
    x, u = F.col("event_id"), F.col("user_id")
    got = O.acceptance(F.when(x % 10 != 9, (x % 20 - 10) / F.lit(100.0)), pick(u, ["passed", "failed", "inconclusive"]), pick(u, ["observed_precision_target_met", "other"]), F.floor((x % 4) / 3))
    return table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in got.items()])


@query("stage_arithmetic", """WITH p AS (SELECT p_partkey, p_partkey % 977 + 1 AS n, p_size % 3 + 1 AS e, p_size AS w, ceil((p_partkey % 977 + 1) / 16.0)::BIGINT AS u FROM part)
SELECT p_partkey, u AS steps_per_epoch, (w + u * e)::BIGINT AS steps, ((w // u) * n + least(n, (w % u) * 16) + n * e)::BIGINT AS seen FROM p""")  # fmt: skip
def stage_arithmetic(spark, d):
    """A34."""
    got = U.updates(F.col("p_partkey") % 977 + 1, F.col("p_size") % 3 + 1, F.lit(16), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in got.items()])


@query("overfit_seeds", f"""WITH {POOL_SQL}, a AS (SELECT min(id) AS id FROM pool WHERE bucket = 'select'), b AS (SELECT min(id) AS id FROM pool WHERE bucket IS NOT NULL AND id NOT IN (SELECT id FROM a)), c AS (SELECT min(id) AS id FROM pool WHERE bucket = 'no_match' AND id NOT IN (SELECT id FROM a UNION SELECT id FROM b))
SELECT 'selects' AS predicate, id FROM a UNION ALL SELECT 'labelled', id FROM b UNION ALL SELECT 'no_match', id FROM c""")  # fmt: skip
def overfit_seeds(spark, d):
    """The first row of each predicate that none before took."""
    got = DR.first_by_predicate(pool(spark, d), [("selects", F.col("bucket") == "select"), ("labelled", F.col("bucket").isNotNull()), ("no_match", F.col("bucket") == "no_match")], [F.col("id")])
    return spark.createDataFrame(got, "predicate string, id long")


@query("ordered_pool", "SELECT doc_id, row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS position FROM documents")
def ordered_pool(spark, d):
    """O2: places of a pool's rows in the order of their ids as texts."""
    return ranked(table(spark, d, "documents").select("doc_id"), [F.col("doc_id").cast("string")]).select("doc_id", F.col("position").cast("long").alias("position"))


# --- plans, replays ----------------------------------------------------------------------------------------------------

def plan_document(**changes) -> dict:
    """A run plan that holds, with changes; None takes a field out."""
    d = {
        "version": "run-plan-v1", "run_id": "r1", "split_targets": {"train": 200, "dev": 20, "calibration": 20, "test": 30}, "pilot_episodes": 50, "hardening": {"pool_episodes": 40, "review_nominations": 20, "accepted_new": 10, "retained_original": 50},
        "training_seeds": run_plan.SEEDS, "epochs": run_plan.EPOCHS, "head_warmup_steps": 5, "effective_batch_episodes": 16, "family_partition_sha256": "a" * 64, "projection_provenance_sha256": "b" * 64, "teacher_contract_version": "t",
        "registration_reason": "x", "registered_at": "now", "cost_evidence": [{"path": "reports/x.json", "sha256": "c" * 64}], "quality_gates": dict(run_plan.GATES),
    }
    return {k: v for k, v in (d | changes).items() if v is not None}


PLANS = (
    ("holds", {}, None), ("no_run_id", {"run_id": None}, "fields"), ("more", {"extra": 1}, "fields"), ("name", {"run_id": "Bad Name"}, "run_id"), ("pilot", {"pilot_episodes": 201}, "pilot_episodes"), ("boolean", {"pilot_episodes": True}, "pilot_episodes"),
    ("diagnostic", {"diagnostic_episodes": 50}, "diagnostic_episodes"), ("seeds", {"training_seeds": [1]}, "training_seeds"), ("gates", {"quality_gates": dict(run_plan.GATES, top1_improvement=0.01)}, "quality_gates"), ("evidence", {"cost_evidence": []}, "cost_evidence"),
    ("path", {"cost_evidence": [{"path": "../x", "sha256": "c" * 64}]}, "cost_evidence"), ("hash", {"family_partition_sha256": "A" * 64}, "family_partition_sha256"), ("blank", {"registered_at": " "}, "registered_at"),
    ("order", {"hardening": {"pool_episodes": 5, "review_nominations": 20, "accepted_new": 10, "retained_original": 50}}, "hardening"), ("version", {"version": "other"}, "version"), ("too_few", {"split_targets": {"train": 200, "dev": 20, "calibration": 20, "test": 1}}, "quota test"),
)


@query("run_plan_checks", f"SELECT * FROM (VALUES {', '.join(chr(40) + chr(39) + n + chr(39) + ', ' + ('NULL' if p is None else chr(39) + p + chr(39)) + chr(41) for n, _, p in PLANS)}) t(plan, problem)")
def run_plan_checks(spark, d):
    """Q7: plans that break one rule each; the last has too few rows for its families."""
    families = {"train": 4, "dev": 2, "calibration": 2, "test": 3}
    rows = []
    for name, change, _ in PLANS:
        try:
            run_plan.parse(json.dumps(plan_document(**change)), families=families)
            rows.append((name, None))
        except run_plan.PlanError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "plan string, problem string")


def _label(ids, reason=None):
    none = F.lit(None).cast("string")
    return F.struct((none if reason is None else reason).alias("abstain_reason"), ids.alias("acceptable_ids"), F.when(F.size(ids) > 0, "select").otherwise("abstain").alias("decision"))


_STEPS = ["profile_changed", "variant_not_assigned", "input_not_replayed", "visible_changed", "first_label", "labels_disagree", "reason_provenance", "family_review"]


@query("training_replay", f"""WITH {DOCS}, {_PROFILE_SQL}, w AS (SELECT *, (string_split(text, ' ') || ['a', 'b', 'c'])[1:doc_id % 4] AS g, list_transform(range(1, doc_id % 5 + 2), lambda j: (doc_id + j) % 4 = 3) AS img FROM prof)
SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 AND category IS NOT NULL THEN 'profile_changed' WHEN category IS NULL OR len(g) > 2 OR len(list_filter(g, lambda x: len(x) > 240)) > 0 OR doc_id % 11 = 0 OR (doc_id % 7 = 0 AND list_contains(img, TRUE)) THEN 'not_compiled' ELSE {sql_pick('doc_id // 2', [None, *_STEPS[1:], None])} END AS problem FROM w""")  # fmt: skip
def training_replay(spark, d):
    """Accepted episodes built through every step, then changed at one."""
    x, k = F.col("id"), F.floor(F.col("id") / 2) % 9
    built = R.projected(_items(spark, d).select(F.col("doc_id").alias("id"), F.col("family").alias("family_id"), "item", "count", F.when(F.col("doc_id") % 3 == 0, "no_accessibility").alias("variant")))
    built = shared.stored(built, "replayed")
    label, other = _label(F.array(F.lit("c1"))), _label(F.array(F.lit("c9")))
    rows = built.select(
        "id", "family_id", "item", F.col("count").alias("n_candidates"), F.when(x % 17 != 0, F.col("_profile")).otherwise(F.col("_profile").withField("fieldLabel", F.lit("changed"))).alias("profile"), "variant", F.when(k == 1, "other").otherwise(F.col("variant")).alias("assigned_variant"),
        F.when(k == 2, F.col("_context").withField("fieldRole", F.lit("changed"))).otherwise(F.col("_context")).alias("context"), F.col("_entries").alias("entries"), F.when(k == 3, "0").otherwise(X.visible_sha256(F.col("_context"), F.col("_entries"))).alias("visible_sha256"), label.alias("label"),
        F.when(k == 4, other).otherwise(label).alias("first"), F.when(k == 5, other).otherwise(label).alias("second"), (k != 6).alias("reason_agreement"),
        F.struct(F.when(k == 7, "other").otherwise(F.col("family_id")).alias("observed_family_id"), F.array().cast("array<string>").alias("secondary_family_ids"), F.lit(True).alias("deployment_visible"), F.lit(True).alias("payload_consistent")).alias("review"))
    return R.training_replay(rows)


_AUDIT = ["family_outside_split", "partition_changed", "input_differs", "budget", None, "semantic_identifier", "label_differs", "blind_label_differs", "family_review"]


@query("heldout_audit", f"""WITH {POOL_SQL}, t AS (SELECT *, min(id) OVER (PARTITION BY text) AS first FROM pool WHERE split = 'test')
SELECT id, CASE WHEN id % 10 = 0 THEN 'family_outside_split' WHEN id % 10 IN (1, 2, 3) THEN {sql_pick('id % 10', _AUDIT)} WHEN id <> first THEN 'duplicate_content' WHEN id % 10 = 9 THEN NULL ELSE {sql_pick('id % 10', _AUDIT)} END AS problem FROM t""")  # fmt: skip
def heldout_audit(spark, d):
    """Held-out rows changed at one step each, and copies."""
    x, k = F.col("id"), F.col("id") % 10
    p = pool(spark, d)
    entries = F.array(F.struct(F.lit("a").alias("id"), F.col("text")))
    context = _context(F.lit("f"), F.lit(""), F.lit(""), F.lit(""))
    label, other = _label(F.array(F.lit("a"))), _label(F.array(F.lit("b")))
    family = F.when(k == 0, "elsewhere").otherwise(F.col("family"))
    rows = p.where("split = 'test'").select(
        "id", family.alias("family_id"), F.when(k == 1, "other").otherwise("sha").alias("partition_sha256"), context.alias("context"), entries.alias("entries"), F.when(k == 2, "0").otherwise(X.visible_sha256(context, entries)).alias("visible_sha256"),
        F.when(k == 3, 2000).otherwise(100).alias("max_pair_tokens"), F.when(k == 5, "mail-7").otherwise(F.concat(F.lit("e"), x.cast("string"))).alias("opaque_id"), label.alias("label"), F.when(k == 6, other).otherwise(label).alias("first"), F.when(k == 7, other).otherwise(label).alias("second"),
        F.when(k == 8, "other").otherwise(family).alias("reviewed_family"), F.array().cast("array<string>").alias("secondary"), F.lit(True).alias("realistic"))
    families = p.select("split", F.col("family").alias("family_id")).distinct()
    return R.heldout_audit(rows, families, "test", "sha")


@query("audit_identities", f"SELECT event_id, {sql_pick('event_id', ['identity', 'request_changed', 'roles', 'bound_input', 'effort', 'model', None, None])} AS problem FROM events")
def audit_identities(spark, d):
    """Audits changed in one part each; the last two are sound, one of them a failure."""
    x = F.col("event_id")
    k = x % 8
    request = F.concat(F.lit('{"messages":['), x.cast("string"), F.lit('],"model":"m"}'))
    endpoint = F.concat(F.lit('https://example.org/"'), F.col("event_type"))
    body = F.concat(F.lit('{"body":'), request, F.lit(',"endpoint":"https://example.org/\\"'), F.col("event_type"), F.lit('"}'))
    effort = F.when(k == 4, "none").otherwise("high")
    audit = F.struct(
        F.when(k == 0, "0").otherwise(F.sha2(body, 256)).alias("audit_id"), endpoint.alias("endpoint"), request.alias("request"), F.when(k == 1, "0").otherwise(F.sha2(request, 256)).alias("request_sha256"),
        F.when(k == 2, F.array(F.lit("user"))).otherwise(F.array(F.lit("system"), F.lit("user"))).alias("roles"), request.alias("bound"), F.when(k == 3, "0").otherwise(F.sha2(request, 256)).alias("bound_request_sha256"),
        F.when(k == 7, "failed").otherwise("success").alias("status"), F.lit("m").alias("model"), effort.alias("effort"), F.when(k.isin(5, 7), "m-low").otherwise(F.concat(F.lit("m-"), effort)).alias("actual_model"), F.concat(F.lit("m-"), effort).alias("response_model"))
    return table(spark, d, "events").select("event_id", R.audit_identity(audit).alias("problem"))


_RUNS = ["unknown_run", "other_plan", "other_data", "other_freeze", "scores_changed", "count", None]


@query("score_runs", f"SELECT o_orderkey AS run, CASE WHEN o_orderkey % 7 = 1 AND o_orderkey % 2 = 0 THEN NULL ELSE {sql_pick('o_orderkey', _RUNS)} END AS problem FROM orders")
def score_runs(spark, d):
    """Scoring runs changed in one field each; a plan counts for held-out splits only."""
    o, k = table(spark, d, "orders").select(F.col("o_orderkey").alias("run")), F.col("run") % 7
    split = F.when(F.col("run") % 2 == 0, "dev").otherwise("test")
    sound = o.select("run", split.alias("split"), F.lit("ranker").alias("protocol"), F.md5(F.col("run").cast("string")).alias("data_sha256"), F.lit("f").alias("freeze_sha256"), F.lit("p").alias("run_plan_sha256"))
    put = lambda n, value, c: F.when(k == n, value).otherwise(F.col(c)).alias(c)
    runs = sound.select("run", "split", "protocol", put(2, "x", "data_sha256"), put(3, "x", "freeze_sha256"), put(1, "x", "run_plan_sha256"), F.lit("s").alias("scores_sha256"), F.when(k == 4, "x").otherwise("s").alias("actual_scores_sha256"), F.lit(9).alias("manifest_episodes"), F.when(k == 5, 8).otherwise(9).alias("completed_episodes"))
    return R.score_runs(runs, sound.where(k != 0))


_GUARDS = ["unregistered", "other_run", "count", "split", "content_changed", "partition", None, "count"]


@query("snapshot_guards", f"SELECT o_orderkey AS name, {sql_pick('o_orderkey', _GUARDS)} AS problem FROM orders")
def snapshot_guards(spark, d):
    """Snapshots changed in one field each against what is registered."""
    o, k = table(spark, d, "orders").select(F.col("o_orderkey").alias("name")), F.col("name") % 8
    sound = o.select("name", F.lit("r").alias("run_id"), F.lit("p").alias("run_plan_sha256"), F.lit("train").alias("split"), (F.col("name") % 100).alias("episodes"), F.lit("fam").alias("family_partition_sha256"))
    put = lambda n, value, c: F.when(k == n, value).otherwise(F.col(c)).alias(c)
    has = sound.select("name", put(1, "x", "run_id"), "run_plan_sha256", put(3, "dev", "split"), put(2, -1, "episodes"), put(5, "x", "family_partition_sha256"), F.md5(F.col("name").cast("string")).alias("sha256"), F.when(k == 4, "x").otherwise(F.md5(F.col("name").cast("string"))).alias("actual_sha256"), (F.col("episodes") + F.when(k == 7, 1).otherwise(0)).alias("actual_episodes"))
    return R.snapshot_guards(has, sound.where(k != 0))


_GATE = ["specification", "task", "plan", "gate", "gate", "fixture", None]


@query("author_gate_replay", f"WITH {DOCS} SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN {sql_pick('doc_id', _GATE)} END AS problem FROM d")
def author_gate_replay(spark, d):
    """Gated rows changed in one part each; rows of other versions have no gate."""
    x = F.col("doc_id")
    k, spec = x % 7, F.concat(F.lit('{"mother_task":'), F.to_json(F.array("lang")), F.lit("}"))
    row = F.struct(
        (x % 5 != 0).alias("gated"), F.when(k == 0, "0").otherwise(F.sha2(spec, 256)).alias("source_spec_sha256"), spec.alias("spec_json"), F.col("lang").alias("mother_task"), F.when(k == 1, "x").otherwise(F.col("lang")).alias("requested_task"), F.col("source").alias("plan"),
        F.when(k == 2, F.lit(None)).otherwise(F.col("source")).alias("requested_plan"), F.when(k == 3, "quote_length").alias("recorded_problem"), F.when(k == 4, "mapping").alias("problem"), F.lit("v").alias("visible_sha256"), F.when(k == 5, "w").otherwise("v").alias("replayed_sha256"))
    return table(spark, d, "documents").select("doc_id", R.author_gate(row).alias("problem"))


_MINED = ["episode_changed", "audits", "phase", "permutation", "verdicts", "action", None]


@query("post_mining_review", f"WITH {episode_sql()} SELECT id, CASE WHEN id::BIGINT % 7 = 5 AND decide >= 0.7 THEN 'action' ELSE {sql_pick('id::BIGINT', _MINED)} END AS problem FROM ep")
def post_mining_review(spark, d):
    """Approvals changed in one part each."""
    k = F.col("id").cast("long") % 7
    e = episodes(spark, d).select("id", "label", F.transform("entries", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("entries"))
    good = F.transform("entries", lambda x: F.struct(x["id"].alias("id"), F.array_contains("label.acceptable_ids", x["id"]).alias("acceptable")))
    every = F.transform("entries", lambda x: F.struct(x["id"].alias("id"), (~F.array_contains("label.acceptable_ids", x["id"])).alias("acceptable")))
    ids = lambda v: F.transform(F.filter(v, lambda y: y["acceptable"]), lambda y: y["id"])
    other = F.struct(F.when(F.size(ids(every)) == 0, "no_match").alias("abstain_reason"), ids(every).alias("acceptable_ids"), F.when(F.size(ids(every)) > 0, "select").otherwise("abstain").alias("decision"))
    sound = F.struct(F.reverse("entries").alias("entries"), good.alias("verdicts"), F.col("label").alias("label"))
    wrong = F.struct(F.when(k == 3, F.slice("entries", 2, 100)).otherwise(F.col("entries")).alias("entries"), F.when(k.isin(4, 5), every).otherwise(good).alias("verdicts"), F.when(k == 5, other).otherwise(F.col("label")).alias("label"))
    row = F.struct(
        "label", F.when(k == 0, F.col("label").withField("decision", F.lit("x"))).otherwise(F.col("label")).alias("original_label"), F.lit("c").alias("content_sha256"), F.lit("c").alias("recorded_sha256"), F.array(F.lit("a"), F.when(k == 1, "a").otherwise("b")).alias("audit_ids"),
        F.array(F.lit("blind-0"), F.when(k == 2, "blind-0").otherwise("blind-1")).alias("phases"), "entries", F.array(sound, wrong).alias("passes"))
    return e.select("id", R.post_mining(row).alias("problem"))


_FILES = ["missing", "unexpected", "symlink", "size", "hash", "secret", None, None]


@query("bundle_check", f"WITH {DOCS}, x AS (SELECT doc_id, {sql_pick('doc_id', _FILES)} AS problem FROM d) SELECT 'f' || doc_id AS path, problem FROM x WHERE problem IS NOT NULL AND doc_id % 8 <> 6")
def bundle_check(spark, d):
    """A published folder against its manifest; files that the host adds don't count."""
    x = F.col("doc_id")
    k = x % 8
    f = docs(spark, d).select("doc_id", F.concat(F.lit("f"), x.cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    expected = f.where(~k.isin(1, 6))
    actual = f.where(k != 0).select(
        F.when(k == 6, ".gitattributes").otherwise(F.col("path")).alias("path"), F.when(k == 4, "0").otherwise(F.col("sha256")).alias("sha256"), F.when(k == 3, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (k == 2).alias("symlink"),
        F.when(k == 5, F.concat(F.lit("api_key = "), F.md5("path"))).otherwise("").alias("text"))
    return R.bundle(expected, actual)


# --- small files and workers ----------------------------------------------------------------------------------------------

@query("state_file", "SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def state_file(spark, d):
    """Counts by language as a JSON state file, replaced whole by a second write, and read back."""
    path = shared.scratch(spark, "state") + ".json"
    counts = {r["lang"]: r["n"] for r in table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # four languages
    shared.write_json(spark, path, {})
    shared.write_json(spark, path, counts, overwrite=True)
    got = json.loads(shared.Store(spark, path).read_text(path))
    return spark.createDataFrame(sorted(got.items()), "lang string, n long")


@query("republished_state", "SELECT lang, 'published' AS first, 'unchanged' AS again, 'refused' AS other, sha256(lang || ':' || count(*) || chr(10)) AS sha256 FROM documents GROUP BY lang")
def republished_state(spark, d):
    """A file for each language, published, published again, and refused with another content; hashes of the folder's files."""
    folder = shared.scratch(spark, "published")
    rows = []
    for r in table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect():  # four languages
        said, text = [], f"{r['lang']}:{r['n']}\n"
        for content in (text, text, text + "x"):
            try:
                said.append(shared.write_immutable(spark, f"{folder}/{r['lang']}.txt", content))
            except ValueError:
                said.append("refused")
        rows.append((f"{r['lang']}.txt", r["lang"], *said))
    files = records.file_hashes(spark, folder)
    return spark.createDataFrame(rows, "path string, lang string, first string, again string, other string").join(files, "path").select("lang", "first", "again", "other", "sha256")


@query("event_log", "SELECT event_type, count(*)::BIGINT AS n, 3::BIGINT AS appends FROM events GROUP BY 1")
def event_log(spark, d):
    """Events appended in three commits and read back."""
    path = shared.scratch(spark, "log")
    e = table(spark, d, "events").select("event_id", "event_type")
    for k in range(3):
        shared.append(e.where(F.col("event_id") % 3 == k).withColumn("commit", F.lit(k)), path)
    got = spark.read.parquet(path)
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("commit").alias("appends"))


@query("worker_budgets", "SELECT event_id, CASE WHEN event_id % 4 = 3 AND user_id % 2 = 1 THEN 0 ELSE least(event_id % 12, 9, [4, 2, 1, 3][event_id % 4 + 1] + CASE WHEN event_id % 4 = 0 THEN 2 * (user_id % 3) ELSE 0 END) END::BIGINT AS workers FROM events")
def worker_budgets(spark, d):
    """How many workers each split may use as others finish."""
    x, u = F.col("event_id"), F.col("user_id")
    split = pick(x, ["train", "dev", "calibration", "hardening"])
    n = U.worker_budget(split, x % 12, 9, {"train": 4, "dev": 2, "calibration": 1, "hardening": 3}, 2, u % 3, ~((split == "hardening") & (u % 2 == 1)))
    return table(spark, d, "events").select("event_id", n.alias("workers"))
