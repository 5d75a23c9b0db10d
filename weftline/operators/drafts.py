"""Author drafts and model inputs: allow-listed projections, draft checks, pair sizes, program gates, request matching, approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import envelope as E
from weftline.functions.expr import content_fingerprint
from weftline.operators.gates import PAIR_TOKENS, all_compile, first_problem, normalized_context, normalized_entries, quota_matches
from weftline.schemas import SURFACES


def inference_view(df: DataFrame) -> DataFrame:
    """What a model may see of an episode: id, context, entries; no label, family or metadata."""
    return df.select("id", normalized_context(F.col("context")).alias("context"), normalized_entries(F.col("entries")).alias("entries"))


def author_view(draft: Column, gated: Column | None = None) -> Column:
    """A draft without what only its author knows (P19). gated: whether the draft's version has a gate at all; others are left as they are."""
    bare = draft.dropFields("decision_gate")
    return bare if gated is None else F.when(gated, draft.withField("decision_gate", F.lit(None))).otherwise(draft)


def draft_problem(draft: Column, planned: Column) -> Column:
    """The first violation of a generated draft (P14). draft: context, capture (beforeSelection, afterSelection, nearbyText), entries."""
    c, cap = draft["context"], draft["capture"]
    selected, near = F.coalesce(c["selectedText"], F.lit("")), cap["nearbyText"]
    same = lambda a, b: (cap[a] == selected) & (cap[b] == "")
    texts = F.transform(draft["entries"], lambda e: F.struct(e["kind"].alias("kind"), e["text"].alias("text")))
    return first_problem(
        (draft.isNull(), "missing"), (F.size(draft["entries"]) != planned, "candidate_count"), (~F.coalesce(~c["isSecure"], F.lit(False)), "secure"), (~c["inputSurface"].isin(*SURFACES), "surface"),
        (F.coalesce(c["surroundingText"], F.lit("")) != "", "raw_surrounding_text"), ((selected != "") & (same("beforeSelection", "afterSelection") | same("afterSelection", "beforeSelection")), "duplicated_selection"),
        (near.isNull() | F.exists(near, lambda x: x.isNull()), "nearby_not_texts"), (F.size(near) > 4, "nearby_too_many"),
        (F.exists(near, lambda x: F.length(x) > 240) | (F.aggregate(near, F.lit(0), lambda a, x: a + F.length(x)) > 600), "nearby_too_long"), (F.size(F.array_distinct(texts)) != F.size(texts), "duplicate_payload"),
    )


def drafts_against_plans(drafts: DataFrame, plans: DataFrame) -> DataFrame:
    """Every planned id with its draft's first problem; missing and unplanned drafts are problems too (P14). drafts: id, draft; plans: id, candidate_count."""
    both = plans.join(drafts, "id", "full")
    return both.select("id", F.when(F.col("candidate_count").isNull(), "unplanned").otherwise(draft_problem(F.col("draft"), F.col("candidate_count"))).alias("problem"))


def reidentified(entries: Column, seed: Column) -> Column:
    """Entries in an order fixed by the seed's hash, with ids by position, so that neither order nor id tells the author's intent."""
    keyed = F.array_sort(F.transform(entries, lambda e, i: F.struct(F.sha2(F.concat_ws(":", seed.cast("string"), i.cast("string")), 256).alias("h"), e.alias("e"))))
    return F.transform(keyed, lambda x, i: x["e"].withField("id", F.concat(F.lit("c"), i.cast("string"))))


def program_problem(context: Column, entries: Column, label: Column, family: Column) -> Column:
    """Select without a semantic context, or a positive that isn't Python where it would be inserted (P10). Sources are parsed, never run."""
    around = F.coalesce(context["surroundingText"], F.lit(""))
    e = E.parsed(around)
    good = F.filter(entries, lambda x: F.array_contains(label["acceptable_ids"], x["id"]))
    sources = F.transform(good, lambda x: F.concat(F.coalesce(e["beforeSelection"], F.lit("")), x["text"], F.coalesce(e["afterSelection"], F.lit(""))))
    select, python = label["decision"] == "select", F.startswith(family, F.lit("python_"))
    seen = E.has_semantic_context(context["fieldLabel"], context["selectedText"], around)
    return first_problem((select & ~seen, "no_semantic_context"), (select & python & ~all_compile(sources), "python_syntax"))


def gates_passed(df: DataFrame, protocols: dict[str, str], exclusions: DataFrame) -> DataFrame:
    """Held-out rows that pass all current gates (P13): reviewed family and no other, realistic, protocol versions, not excluded, no duplicated boundary, in their bucket.

    Columns: context, entries, label, desired, family_id, observed_family_id, secondary_family_ids, realistic, and one for each protocol.
    """
    alone = F.size(F.coalesce("secondary_family_ids", F.array().cast("array<string>"))) == 0
    ok = (F.col("observed_family_id") == F.col("family_id")) & alone & F.coalesce("realistic", F.lit(False)) & ~E.duplicated_boundary(F.col("context.selectedText"), F.col("context.surroundingText")) & quota_matches(F.col("desired"), F.col("label"))
    for column, version in protocols.items():
        ok = ok & (F.col(column) == version)
    rows = df.where(F.coalesce(ok, F.lit(False))).withColumn("_digest", content_fingerprint(F.col("context"), F.col("entries")))
    return rows.join(exclusions.select(F.col("digest").alias("_digest")).distinct(), "_digest", "left_anti").drop("_digest")


def context_body(context: Column) -> Column:
    """The context as a model reads it (P5)."""
    return F.concat(F.lit("Field: "), context["fieldLabel"], F.lit("\nSelected: "), context["selectedText"], F.lit("\nSurrounding: "), context["surroundingText"])


def metadata(context: Column, entry: Column) -> Column:
    """What stands before the context in each pair (P5)."""
    return F.concat(
        F.lit("Context "), context["applicationCategory"], F.lit(" "), context["inputSurface"], F.lit(" "), context["fieldRole"], F.when(context["hasAccessibility"], " accessible").otherwise(" inaccessible"),
        F.lit("\nCandidate "), entry["kind"], F.lit(" "), F.array_join(entry["capabilities"], ","), F.lit(" "), entry["sourceCategory"], F.lit("\n"),
    )


def pair_sizes(df: DataFrame, context_tokens: Column, candidate_tokens, special: int = 3) -> DataFrame:
    """Largest pair of each episode in tokens, and whether all fit (P5). candidate_tokens: column function of an entry."""
    size = F.array_max(F.transform("entries", lambda e: context_tokens + candidate_tokens(e) + special))
    return df.select("id", size.alias("max_pair_tokens"), (size <= PAIR_TOKENS).alias("fits"))


def request_attempts(requests: DataFrame, batches: DataFrame, request: str = "request_id", batch: str = "batch_id") -> DataFrame:
    """Author requests on their batches by the part before the last attempt mark, with the attempt's number."""
    pattern = r"^(.*)-a(\d+)$"
    r = requests.withColumn(batch, F.regexp_extract(request, pattern, 1)).withColumn("attempt", F.regexp_extract(request, pattern, 2).try_cast("int"))
    return r.join(batches.select(batch), batch)


def approved_in_order(nominated: DataFrame, approved: DataFrame, rank: str, n: int, key: str = "id") -> DataFrame:
    """The first n approved nominations in their order (J18); n is a planned quantity."""
    return nominated.join(approved.select(key).distinct(), key, "left_semi").orderBy(rank, key).limit(n)


def first_by_predicate(df: DataFrame, predicates: list[tuple[str, Column]], order: list[Column], key: str = "id") -> list[tuple[str, object]]:
    """For each named predicate in turn the first row that isn't taken yet (W10): a handful of top-1 queries."""
    out: list[tuple[str, object]] = []
    for name, condition in predicates:
        taken = [k for _, k in out]
        rows = df.where(condition & (~F.col(key).isin(taken) if taken else F.lit(True))).orderBy(*order).limit(1).select(key).collect()
        if not rows:
            raise ValueError(f"no row for {name}")
        out.append((name, rows[0][0]))
    return out


def numbered_batches(df: DataFrame, order: list[Column], size: int, by: list[str]) -> DataFrame:
    """Rows of each group in fixed-size batches."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long"))
