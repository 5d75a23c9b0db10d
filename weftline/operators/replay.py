"""Replay: recompute what a row claims about itself and return what doesn't agree. An empty result is the proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import envelope as E
from weftline.functions.expr import content_fingerprint, same_action, text_kind, utf16_length, visible_sha256
from weftline.operators import authoring as A
from weftline.operators.gates import MAX_CANDIDATES, PAIR_TOKENS, first_problem, holds_secret, observation_variant


def episodes(df: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Episodes whose visible or content hash isn't the recorded one (R1, R8). fingerprints: id, content_sha256."""
    own = df.select("id", visible_sha256(F.col("context"), F.col("entries")).alias("v"), content_fingerprint(F.col("context"), F.col("entries")).alias("c"), F.col("preprocessing.visible_sha256").alias("said"))
    both = own.join(fingerprints.select("id", "content_sha256"), "id", "left")
    problem = first_problem((F.col("said").isNull() | (F.col("v") != F.col("said")), "visible_changed"), (F.col("content_sha256").isNull(), "not_registered"), (F.col("c") != F.col("content_sha256"), "content_changed"))
    return both.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def projected(rows: DataFrame) -> DataFrame:
    """Adds _profile, _context and _entries: what a model sees of an author's item under its observation variant (P15-P17, P20, P23). Columns: family_id, item, variant.

    Each step is a column of its own, so that plans stay small.
    """
    out = rows.withColumn("_profile", A.field_profile(F.col("family_id")))
    out = out.withColumn("_raw", A.compiled(F.col("item"), F.col("_profile"))).withColumn("_shown", observation_variant(F.col("_raw.context"), F.coalesce("variant", F.lit("standard"))))
    hide = F.coalesce(F.col("variant") != "standard", F.lit(False))
    out = out.withColumn("_near", F.when(hide, F.array().cast("array<string>")).otherwise(F.col("_raw.capture.nearbyText"))).withColumn("_selected", F.col("_shown.selectedText"))
    out = out.withColumn("_around", E.render(F.col("_selected"), F.lit(0), utf16_length(F.col("_selected")), F.col("_selected"), F.col("_near")))
    kind = lambda p: F.when(p["type"] == "text", text_kind(p["text"])).otherwise(p["type"])
    entries = F.transform("_raw.entries", lambda e: F.struct(e["id"].alias("id"), kind(e["payload"]).alias("kind"), A.entry_text(e["payload"]).alias("text")))
    return out.withColumn("_context", F.col("_shown").withField("surroundingText", F.col("_around"))).withColumn("_entries", entries).drop("_raw", "_shown", "_near", "_selected", "_around")


def training_replay(rows: DataFrame) -> DataFrame:
    """id and the first step at which an accepted training episode doesn't replay (R1), from the author's item to the family review; null if all do.

    Columns: id, family_id, item, n_candidates, profile, variant, assigned_variant, context, entries (id, kind, text), visible_sha256, label, first, second (labels; the second already on the episode's own ids),
    reason_agreement, review (observed_family_id, secondary_family_ids, deployment_visible, payload_consistent).
    """
    c = F.col
    draft = A.draft_problem(c("item"), c("n_candidates"), c("_profile"))
    same = c("first.abstain_reason").eqNullSafe(c("second.abstain_reason"))
    problem = first_problem(
        (~c("profile").eqNullSafe(c("_profile")), "profile_changed"), (c("_draft").isNotNull(), "not_compiled"), (~c("variant").eqNullSafe(c("assigned_variant")), "variant_not_assigned"),
        (~(c("context").eqNullSafe(c("_context")) & c("entries").eqNullSafe(c("_entries"))), "input_not_replayed"), (c("visible_sha256") != visible_sha256(c("context"), c("entries")), "visible_changed"), (c("first") != c("label"), "first_label"),
        (~same_action(c("first"), c("second")), "labels_disagree"), (c("reason_agreement") != same, "reason_provenance"),
        ((c("review.observed_family_id") != c("family_id")) | (F.size("review.secondary_family_ids") > 0) | ~c("review.deployment_visible") | ~c("review.payload_consistent"), "family_review"),
    )
    return projected(rows).withColumn("_draft", draft).select("id", problem.alias("problem"))


def heldout_audit(rows: DataFrame, families: DataFrame, split: str, partition_sha256: str) -> DataFrame:
    """id and first problem of every held-out episode (R3): one content once, the split's families, unchanged inputs, budgets, both label passes, the blind family review.

    Columns: id, family_id, partition_sha256, context, entries, visible_sha256, max_pair_tokens, opaque_id, label, first, second, reviewed_family, secondary, realistic. families: split, family_id.
    """
    r = rows.withColumn("_content", content_fingerprint(F.col("context"), F.col("entries")))
    once = r.groupBy("_content").agg(F.min("id").alias("_first"))
    own = families.where(F.col("split") == split).select("family_id").distinct().withColumn("_own", F.lit(True))
    r = r.join(once, "_content").join(own, "family_id", "left")
    problem = first_problem(
        (F.col("_own").isNull(), "family_outside_split"), (F.col("partition_sha256") != partition_sha256, "partition_changed"), (F.col("visible_sha256") != visible_sha256(F.col("context"), F.col("entries")), "input_differs"),
        (~F.size("entries").between(1, MAX_CANDIDATES) | (F.col("max_pair_tokens") > PAIR_TOKENS), "budget"), (F.col("id") != F.col("_first"), "duplicate_content"), (~F.col("opaque_id").rlike("^e[0-9]+$"), "semantic_identifier"),
        (~same_action(F.col("first"), F.col("label")), "label_differs"), (~same_action(F.col("second"), F.col("label")), "blind_label_differs"),
        ((F.col("reviewed_family") != F.col("family_id")) | (F.size("secondary") > 0) | ~F.coalesce("realistic", F.lit(False)), "family_review"),
    )
    return r.select("id", problem.alias("problem"))


def audit_identity(audit: Column) -> Column:
    """The first reason why an audit isn't what its id says (R5). audit: audit_id, endpoint, request (a JSON text as it was sent, keys sorted), request_sha256, roles array<string>, bound (JSON text), bound_request_sha256,
    status, model, effort, actual_model, response_model."""
    identity = F.sha2(F.concat(F.lit('{"body":'), audit["request"], F.lit(',"endpoint":'), F.to_json(F.array(audit["endpoint"])).substr(F.lit(2), F.length(F.to_json(F.array(audit["endpoint"]))) - 2), F.lit("}")), 256)
    expected = F.concat_ws("-", audit["model"], audit["effort"])
    return first_problem(
        (audit["audit_id"] != identity, "identity"), (audit["request_sha256"] != F.sha2(audit["request"], 256), "request_changed"), (audit["roles"] != F.array(F.lit("system"), F.lit("user")), "roles"),
        (audit["bound_request_sha256"] != F.sha2(audit["bound"], 256), "bound_input"), ((audit["status"] == "success") & ~audit["effort"].isin("medium", "high", "max"), "effort"),
        ((audit["status"] == "success") & (~audit["actual_model"].eqNullSafe(expected) | ~audit["response_model"].eqNullSafe(expected)), "model"),
    )


def author_gate(row: Column) -> Column:
    """The first reason why an accepted row fails its author gate's replay (R9). row: gated, source_spec_sha256, spec_json, mother_task, requested_task, plan, requested_plan, recorded_problem, problem, visible_sha256, replayed_sha256."""
    return F.when(row["gated"], first_problem(
        (row["source_spec_sha256"] != F.sha2(row["spec_json"], 256), "specification"), (row["requested_task"] != row["mother_task"], "task"), (~row["requested_plan"].eqNullSafe(row["plan"]), "plan"),
        (row["problem"].isNotNull() | ~row["recorded_problem"].eqNullSafe(row["problem"]), "gate"), (row["visible_sha256"] != row["replayed_sha256"], "fixture"),
    ))


def post_mining(row: Column) -> Column:
    """The first reason why an approval after mining doesn't replay (R10). row: label, original_label, content_sha256, recorded_sha256, audit_ids, phases, entries, passes array<struct<entries, verdicts, label>> of two blind passes on own ids.

    Each pass must have its own audit and phase, the same entries whatever their order, and verdicts that give the recorded label and the episode's action.
    """
    texts = lambda entries: F.array_sort(F.transform(entries, lambda e: F.concat_ws("|", e["id"], e["text"])))
    derived = lambda p: F.filter(F.transform(row["entries"], lambda e: e["id"]), lambda i: F.exists(p["verdicts"], lambda v: v["acceptable"] & (v["id"] == i)))
    return first_problem(
        ((row["original_label"] != row["label"]) | (row["content_sha256"] != row["recorded_sha256"]), "episode_changed"), (F.size(F.array_distinct(row["audit_ids"])) != 2, "audits"),
        (row["phases"] != F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.concat(F.lit("blind-"), i.cast("string"))), "phase"), (F.exists(row["passes"], lambda p: texts(p["entries"]) != texts(row["entries"])), "permutation"),
        (F.exists(row["passes"], lambda p: F.array_sort(derived(p)) != F.array_sort(p["label"]["acceptable_ids"])), "verdicts"), (F.exists(row["passes"], lambda p: ~same_action(p["label"], row["label"])), "action"),
    )


def bundle(expected: DataFrame, actual: DataFrame, ignored: tuple[str, ...] = (".gitattributes",)) -> DataFrame:
    """path and problem of a bundle's or a remote copy's files (R11): missing, unexpected, another size or hash, or a credential in it. Both: path, sha256, size; actual: also symlink, text (null where it isn't scanned)."""
    e = expected.select("path", F.col("sha256").alias("_e"), F.col("size").alias("_s"))
    a = actual.where(~F.col("path").isin(*ignored)).withColumn("_here", F.lit(True))
    problem = first_problem(
        (F.col("_here").isNull(), "missing"), (F.col("_e").isNull(), "unexpected"), (F.coalesce("symlink", F.lit(False)), "symlink"), (F.col("size") != F.col("_s"), "size"), (F.col("sha256") != F.col("_e"), "hash"), (holds_secret(F.col("text")), "secret"))
    return e.join(a, "path", "full").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def final_events(events: DataFrame, attempt: str, kind: str = "type", role: str = "role", final: str = "message_end") -> DataFrame:
    """Attempts without exactly one final assistant event; deltas never count."""
    last = (F.col(kind) == final) & (F.col(role) == "assistant")
    return events.groupBy(attempt).agg(F.count_if(last).alias("finals")).where("finals <> 1")


def score_runs(runs: DataFrame, data: DataFrame) -> DataFrame:
    """run and first problem of scoring runs (R6). runs: run, split, protocol, data_sha256, freeze_sha256, run_plan_sha256, scores_sha256, actual_scores_sha256, manifest_episodes, completed_episodes; data: what is
    required of each run: run, split, protocol, data_sha256, freeze_sha256, run_plan_sha256."""
    d = data.select("run", *[F.col(c).alias(f"_{c}") for c in ("split", "protocol", "data_sha256", "freeze_sha256", "run_plan_sha256")])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    problem = first_problem(
        (F.col("_split").isNull(), "unknown_run"), (F.col("_split").isin("calibration", "test") & differs("run_plan_sha256"), "other_plan"), (differs("split") | differs("protocol") | differs("data_sha256"), "other_data"),
        (differs("freeze_sha256"), "other_freeze"), (F.col("scores_sha256") != F.col("actual_scores_sha256"), "scores_changed"), (F.col("completed_episodes") != F.col("manifest_episodes"), "count"),
    )
    return runs.join(d, "run", "left").select("run", problem.alias("problem"))


def snapshot_guards(manifests: DataFrame, registered: DataFrame) -> DataFrame:
    """name and first problem of frozen snapshots against what is registered (R8). Both: name, run_id, run_plan_sha256, split, episodes, sha256, family_partition_sha256; manifests: actual_sha256, actual_episodes."""
    r = registered.select("name", *[F.col(c).alias(f"_{c}") for c in ("run_id", "run_plan_sha256", "split", "episodes", "family_partition_sha256")])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    problem = first_problem(
        (F.col("_split").isNull(), "unregistered"), (differs("run_id") | differs("run_plan_sha256"), "other_run"), (differs("episodes") | (F.col("episodes") != F.col("actual_episodes")), "count"), (differs("split"), "split"),
        (F.col("sha256") != F.col("actual_sha256"), "content_changed"), (differs("family_partition_sha256"), "partition"),
    )
    return manifests.join(r, "name", "left").select("name", problem.alias("problem"))


def decisions_by_content(rows: DataFrame, audits: DataFrame, digest: str = "content_sha256") -> DataFrame:
    """Rows whose content isn't decided by exactly one audit, or with another label."""
    n = audits.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.any_value("label").alias("decided"))
    both = rows.join(n, digest, "left")
    problem = first_problem((F.col("n").isNull(), "undecided"), (F.col("n") > 1, "decided_twice"), (~same_action(F.col("label"), F.col("decided")), "other_label"))
    return both.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def hardened_acceptance(before: DataFrame, after: DataFrame, least: int = 20, drop: float = 0.05) -> DataFrame:
    """Whether a hardened model improves and no large group drops (R16, J17). Both: grp, n, metric, with grp 'overall'."""
    j = before.select("grp", F.col("metric").alias("m0"), "n").join(after.select("grp", F.col("metric").alias("m1")), "grp")
    better = F.bool_or((F.col("grp") == "overall") & (F.col("m1") > F.col("m0")))
    worse = F.count_if((F.col("grp") != "overall") & (F.col("n") >= least) & (F.col("m0") - F.col("m1") > drop))
    return j.agg(F.coalesce(better, F.lit(False)).alias("improved"), worse.alias("dropped_groups")).withColumn("accepted", F.col("improved") & (F.col("dropped_groups") == 0))
