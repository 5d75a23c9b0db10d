"""Row-level normalization and gates: each returns columns with the first problem that holds, or null, instead of raising."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import envelope as E
from weftline.functions.expr import action_bucket, nonblank, same_action, strip
from weftline.schemas import ABSTAIN_REASONS, CAPABILITIES, CATEGORIES, KINDS, SURFACES

#: Fixed token budgets (§2.15).
PAIR_TOKENS, CONTEXT_TOKENS, CANDIDATE_TOKENS, NAME_TOKENS, MAX_CANDIDATES = 1024, 448, 512, 12, 20


def first_problem(*cases: tuple[Column, str]) -> Column:
    """The name of the first condition that holds, null if none does."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def label_problem(label: Column, entry_ids: Column, secure: Column | None = None) -> Column:
    """The label contract (P6, D3): select exactly with ids and without a reason; ids unique, at most 20, and entries'; secure never selects."""
    ids, select = F.coalesce(label["acceptable_ids"], F.array().cast("array<string>")), label["decision"] == "select"
    return first_problem(
        (label["decision"].isNull() | ~label["decision"].isin("select", "abstain"), "unknown_decision"), (F.size(F.array_distinct(ids)) != F.size(ids), "repeated_ids"), (F.size(ids) > MAX_CANDIDATES, "too_many_ids"),
        (F.size(F.array_except(ids, entry_ids)) > 0, "unknown_ids"), (select & (F.size(ids) == 0), "select_without_ids"), (select & label["abstain_reason"].isNotNull(), "select_with_reason"),
        (~select & (F.size(ids) > 0), "abstain_with_ids"), (~select & F.coalesce(~label["abstain_reason"].isin(*ABSTAIN_REASONS), F.lit(True)), "unknown_reason"), (select & (F.lit(False) if secure is None else secure), "secure_select"),
    )


def episode_issues(context: Column, entries: Column) -> Column:
    """All contract violations of an episode's visible part (P2), as an array."""
    ids = F.transform(entries, lambda e: e["id"])
    known = lambda c, allowed: c.isNull() | c.isin(*allowed)
    cases = (
        (~known(context["applicationCategory"], CATEGORIES), "application_category"), (~known(context["inputSurface"], SURFACES), "input_surface"), (F.size(entries) < 1, "no_entries"), (F.size(entries) > MAX_CANDIDATES, "too_many_entries"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "repeated_entry_id"), (F.exists(ids, lambda i: i.isNull() | (i == "")), "empty_entry_id"), (F.exists(entries, lambda e: ~e["kind"].isin(*KINDS)), "entry_kind"),
        (F.exists(entries, lambda e: (F.size(e["capabilities"]) < 1) | (F.size(F.array_except(e["capabilities"], F.array(*map(F.lit, CAPABILITIES)))) > 0)), "entry_capabilities"),
    )
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in cases]), lambda x: x.isNotNull())


def normalized_context(context: Column) -> Column:
    """Defaults, and no text of secure fields (P2). Fields stand in ASCII order."""
    secure = F.coalesce(context["isSecure"], F.lit(False))
    text = lambda f: F.when(secure, "").otherwise(F.coalesce(context[f], F.lit("")))
    return F.struct(
        F.coalesce(context["applicationCategory"], F.lit("unknown")).alias("applicationCategory"), text("fieldLabel").alias("fieldLabel"), F.coalesce(context["fieldRole"], F.lit("")).alias("fieldRole"), F.coalesce(context["hasAccessibility"], F.lit(True)).alias("hasAccessibility"),
        F.coalesce(context["inputSurface"], F.lit("unknown")).alias("inputSurface"), secure.alias("isSecure"), text("selectedText").alias("selectedText"), text("surroundingText").alias("surroundingText"),
    )


def normalized_entries(entries: Column) -> Column:
    """Capabilities sorted and distinct; order of entries kept."""
    return F.transform(entries, lambda e: F.struct(F.array_sort(F.array_distinct(e["capabilities"])).alias("capabilities"), e["id"].alias("id"), e["kind"].alias("kind"), e["sourceCategory"].alias("sourceCategory"), e["text"].alias("text")))


def clip_words(text: Column, budget: int) -> Column:
    """The longest prefix of at most `budget` tokens, a token being a word with the white space before it (P3 with the additive word counter)."""
    return F.regexp_extract(text, rf"^(?:\s*\S+){{0,{budget}}}", 0)


_models: dict = {}


def _pieces(path: str):
    """One model to a worker process and file."""
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def _clip(lib, text: str, budget: int) -> str:
    ids = lib.encode(text)
    if len(ids) <= budget:
        return text
    out = lib.decode(ids[:budget])
    if text.startswith(out) and len(lib.encode(out)) <= budget:
        return out
    fits = lambda n: text.startswith(out[:n]) and len(lib.encode(out[:n])) <= budget
    low, high = 0, len(out)
    while low < high:  # a shorter prefix of a prefix that fits needs no more tokens but for the last few; the step down from there ends the search
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    while low and not fits(low):
        low -= 1
    return out[:low]


@F.pandas_udf(T.StringType())
def clip_pieces(text: pd.Series, budget: pd.Series, path: pd.Series) -> pd.Series:
    """The longest decoded prefix of at most `budget` tokens of a SentencePiece file (P3): decoded ids, shortened until it encodes within the budget."""
    return pd.Series([None if t is None else _clip(_pieces(p), t, n) for t, n, p in zip(text, budget, path, strict=True)])


def trim_longest(fields: list[Column], total: int, fixed: int = 0) -> list[Column]:
    """Token counts left of fields (P4): while their sum and the fixed part exceed the total, the longest (ties: the first) loses the excess, or all it has. Each turn ends the trim or empties a field, so there are as many turns as fields."""
    now = list(fields)
    for _ in fields:
        excess = F.greatest(sum(now, F.lit(fixed)) - total, F.lit(0))
        top = F.greatest(*now)
        out, free = [], F.lit(True)
        for f in now:
            hit = free & (f == top)
            out.append(F.when(hit, F.greatest(F.lit(0), f - excess)).otherwise(f))
            free = free & ~hit
        now = out
    return now


def observation_variant(context: Column, variant: Column) -> Column:
    """A context as an observation variant shows it."""
    c = normalized_context(context)
    hide, bare = variant != "standard", variant == "no_accessibility"
    return F.struct(
        c["applicationCategory"].alias("applicationCategory"), F.when(bare, "").otherwise(c["fieldLabel"]).alias("fieldLabel"), F.when(bare, "").otherwise(c["fieldRole"]).alias("fieldRole"), F.when(bare, False).otherwise(c["hasAccessibility"]).alias("hasAccessibility"),
        F.when(hide, "unknown").otherwise(c["inputSurface"]).alias("inputSurface"), c["isSecure"].alias("isSecure"), F.when(hide, "").otherwise(c["selectedText"]).alias("selectedText"), F.when(hide, "").otherwise(c["surroundingText"]).alias("surroundingText"),
    )


def variant_problem(variant: Column, labelled: Column, secure: Column) -> Column:
    """Why a view can't be applied (P17): only registered ones, before any label or budget, and none but the standard one on secure input."""
    return first_problem((~variant.isin("standard", "no_accessibility", "generic_field") | variant.isNull(), "unregistered_variant"), (labelled, "already_labelled"), ((variant != "standard") & secure, "secure_input"))


@F.pandas_udf(T.BooleanType())
def compiles(source: pd.Series) -> pd.Series:
    """Whether Python source parses; nothing is run."""
    import ast

    def ok(s):
        try:
            ast.parse(s or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return source.map(ok)


def placement_problem(context: Column, entries: Column, label: Column, family: Column, rejected: Column | None = None, python: bool = True) -> Column:
    """Why an episode can't be used at its insertion point, first reason first (P11, §2.15). rejected: the reason of the rejection list, if any.

    With python=False the syntax check, the only one that needs a Python worker, is left out.
    """
    selected, around, editor = F.coalesce(context["selectedText"], F.lit("")), F.coalesce(context["surroundingText"], F.lit("")), context["inputSurface"] == "code_editor"
    e, focus, select = E.parsed(around), E.is_loose(around), label["decision"] == "select"
    before, after, window = (F.coalesce(e[f], F.lit("")) for f in ("beforeSelection", "afterSelection", "textWindow"))
    known = F.coalesce(e["selectionKnown"], F.lit(False))
    outside = F.when(known, F.concat(before, after)).otherwise(window)
    method = (family == "http_method") & context["hasAccessibility"]
    cases = [
        (around.rlike(r"(?i)<cursor>|\[cursor\]|\[caret\]|<caret>|\|CURSOR\|"), "fabricated_caret"),
        (focus & (selected != "") & (((before == selected) & (after == "")) | ((after == selected) & (before == ""))), "duplicated_boundary"),
        (focus & editor & outside.rlike("_{3,}"), "unselected_blank"),
        (focus & select & ~known & (window != ""), "unknown_caret"),
        (~focus & (around != "") & select, "incomplete_caret"),
    ]
    if python:
        code = select & editor & F.startswith(family, F.lit("python_"))
        positives = F.filter(entries, lambda x: F.array_contains(label["acceptable_ids"], x["id"]))
        sources = F.transform(positives, lambda x: F.concat(F.when(focus, before).otherwise(""), x["text"], F.when(focus, after).otherwise("")))
        cases += [(code & focus & ~known, "python_range_unknown"), (code & ~all_compile(sources), "python_syntax")]
    cases += [(method & ((context["fieldLabel"] != "HTTP method") | (context["fieldRole"] != "AXTextField")), "method_field"), (method & (selected != "") & ~strip(selected).rlike("^[A-Za-z-]+$"), "method_token")]
    problem = first_problem(*cases)
    return problem if rejected is None else F.coalesce(rejected, problem)


@F.pandas_udf(T.BooleanType())
def all_compile(sources: pd.Series) -> pd.Series:
    import ast

    def ok(xs):
        try:
            for s in () if xs is None else xs:
                ast.parse(s or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return sources.map(ok)


def prelabel_problem(gate: Column, context_json: Column, n_entries: Column, planned: Column, missing_intent: Column) -> Column:
    """The structural gate of missing-intent drafts before labelling (P18, §2.15). gate: parameter, quote, possible_values, mapping array<struct<candidate,value>>."""
    values, pairs = gate["possible_values"], gate["mapping"]
    blank = F.exists(values, lambda v: ~nonblank(v) | (F.length(v) > 80))
    index = F.transform(pairs, lambda m: m["candidate"])
    out = first_problem(
        (gate.isNull(), "gate_missing"), (gate["parameter"].isNull() | ~F.length(strip(gate["parameter"])).between(3, 80), "parameter_length"),
        (gate["quote"].isNull() | ~F.length(gate["quote"]).between(10, 180), "quote_length"), (~F.contains(context_json, gate["quote"]), "quote_not_visible"), (n_entries != planned, "candidate_count"),
        (values.isNull() | ~F.size(values).between(2, 8) | (F.size(F.array_distinct(values)) != F.size(values)) | blank, "possible_values"),
        (pairs.isNull() | F.exists(pairs, lambda m: m["candidate"].isNull() | m["value"].isNull() | (m["candidate"] < 0) | (m["candidate"] >= n_entries) | (m["value"] < 0) | (m["value"] >= F.size(values))), "mapping"),
        (F.size(F.array_distinct(index)) != F.size(index), "mapping_repeats"), ((n_entries >= 2) & (F.size(F.array_distinct(F.transform(pairs, lambda m: m["value"]))) < 2), "mapping_one_value"),
    )
    return F.when(missing_intent, out)


def quota_matches(desired: Column, label: Column) -> Column:
    """Whether the label falls into the planned bucket."""
    return action_bucket(label["decision"], label["abstain_reason"]) == F.when(desired.isin("ambiguous", "insufficient_context"), "missing_intent").otherwise(desired)


def acceptance(issue: Column, terminal: Column, planned: Column, label: Column, review: Column, claimed: Column, audit_sample: Column) -> tuple[Column, Column]:
    """(problem, quality path) of a labelled row (R14): later findings overwrite earlier ones, and content is claimed only without any."""
    problem = F.when(review.isNotNull() & ~same_action(label, review), "review_disagrees").when(~quota_matches(planned, label), "bucket_mismatch").when(terminal, "label_unavailable").otherwise(issue)
    problem = F.coalesce(problem, F.when(~claimed, F.lit("duplicate_content")))
    path = F.when(audit_sample, "sampled_reviewed").when(review.isNotNull(), "risk_reviewed").otherwise("single_pass")
    return problem, F.when(problem.isNull(), path)


def derived_label(entries: Column, verdicts: Column, reason: Column) -> tuple[Column, Column]:
    """(label, problem) from a verdict on every candidate (P8): acceptable ids in entry order; problems are uncovered candidates and quotes that don't match.

    verdicts: array<struct<id, acceptable boolean, quoted_text>>.
    """
    ids, judged = F.transform(entries, lambda e: e["id"]), F.transform(verdicts, lambda v: v["id"])
    good = F.transform(F.filter(verdicts, lambda v: v["acceptable"]), lambda v: v["id"])
    accepted = F.filter(ids, lambda i: F.array_contains(good, i))
    quotes = F.exists(verdicts, lambda v: v["acceptable"] & ~F.exists(entries, lambda e: (e["id"] == v["id"]) & (e["text"] == v["quoted_text"])))
    problem = first_problem((F.array_sort(ids) != F.array_sort(judged), "coverage"), (quotes, "quote"))
    select = F.size(accepted) > 0
    return F.struct(F.when(~select, reason).alias("abstain_reason"), accepted.alias("acceptable_ids"), F.when(select, "select").otherwise("abstain").alias("decision")), problem


def identical_text_problem(entries: Column, label: Column) -> Column:
    """Whether a text-only entry has the text of an accepted one but isn't accepted."""
    plain = F.filter(entries, lambda e: e["capabilities"] == F.array(F.lit("text")))
    good, bad = (F.transform(F.filter(plain, lambda e: F.array_contains(label["acceptable_ids"], e["id"]) == want), lambda e: e["text"]) for want in (F.lit(True), F.lit(False)))
    return F.coalesce(F.arrays_overlap(good, bad), F.lit(False))


def label_batch_problems(labels: DataFrame, visible: DataFrame, key: str = "id") -> DataFrame:
    """Every id of a request or its response with its first problem (P7): exactly one label each, the label contract, equal texts labelled alike. visible: key, entries; labels: key, label."""
    said = labels.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("label").alias("label"))
    both = visible.select(key, "entries").join(said, key, "full")
    problem = first_problem(
        (F.col("_n").isNull(), "missing"), (F.col("entries").isNull(), "unknown_id"), (F.col("_n") > 1, "repeated"),
    )
    contract = label_problem(F.col("label"), F.transform("entries", lambda e: e["id"]))
    return both.select(key, F.coalesce(problem, contract, F.when(identical_text_problem(F.col("entries"), F.col("label")), "identical_text_omitted")).alias("problem"))


def remapped(label: Column, names: Column) -> Column:
    """A label on opaque ids, back on the episode's own (J4). names: map of opaque to own id."""
    return F.struct(label["abstain_reason"].alias("abstain_reason"), F.transform(label["acceptable_ids"], lambda i: F.try_element_at(names, i)).alias("acceptable_ids"), label["decision"].alias("decision"))


def consensus(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Rows of two label passes with agreed, and the missing side named."""
    both = first.select(key, F.col("label").alias("a")).join(second.select(key, F.col("label").alias("b")), key, "full")
    status = F.when(F.col("a").isNull(), "first_missing").when(F.col("b").isNull(), "second_missing").when(same_action(F.col("a"), F.col("b")), "agreed").otherwise("disagreed")
    return both.select(key, status.alias("status"))


def one_repair(first: DataFrame, retry: DataFrame, valid: Column, key: str = "id") -> DataFrame:
    """Valid rows of the first pass, and of the retry only those that the first lacks (R13). `valid` is over the label column."""
    good = first.where(valid)
    return good.unionByName(retry.where(valid).join(good.select(key), key, "left_anti"))


def candidate_summary(kind: Column, text: Column, limit: int = 160) -> Column:
    """A one-line summary of a candidate: white space as single spaces, cut with an ellipsis (P20)."""
    one = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.concat(F.lit("["), kind, F.lit("] "), F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit - 1), F.lit("…"))).otherwise(one))


def payload_problem(text: Column, kind: Column, width: Column, height: Column, names: Column) -> Column:
    """The first limit that a candidate's payload breaks (P25): its type, text, file names, image dimensions."""
    bad = F.exists(names, lambda n: n.isNull() | (n == "") | n.isin(".", "..") | (F.octet_length(n) > 255) | n.rlike("[/\\\\\\x00\\n\\r]"))
    side = lambda x: x.isNull() | ~x.between(1, 8192)
    return first_problem(
        (kind.isNull() | ~kind.isin("text", "file", "image"), "payload_type"), ((kind == "text") & (~nonblank(text) | (F.octet_length(text) > 128_000)), "text"),
        ((kind == "file") & (names.isNull() | ~F.size(names).between(1, 20) | bad), "file_names"), ((kind == "file") & (F.size(F.array_distinct(names)) != F.size(names)), "repeated_files"),
        ((kind == "image") & (side(width) | side(height) | (width.cast("long") * height > 16_777_216)), "image_size"),
    )


def capture_problem(text: Column, start: Column, length: Column, selected: Column) -> Column:
    """Checks of a captured selection before rendering (P24): a whole UTF-16 range that equals the selected text."""
    from weftline.functions.expr import utf16_length, utf16_substring

    got = utf16_substring(text, start, length)
    return first_problem((start.isNull() != length.isNull(), "half_range"), ((start < 0) | (length < 0) | (start + length > utf16_length(text)), "out_of_bounds"), (start.isNotNull() & got.isNull(), "split_surrogate"), (start.isNotNull() & (got != selected), "selection_mismatch"))


# Parts of a worker's message that name a failed model call (P26), fixed values; the worker's own model name is a parameter beside them.
FAILED_CALLS = ("模型", "推理未完成", "本次推荐未完成")


def normalized_response(protocol: Column, response: Column, valid_scores: Column, top: Column, skipped: Column, words: tuple[str, ...] = FAILED_CALLS) -> Column:
    """error, decision and raw_top of a scorer's response (P26). response: error, decision, mode, message, inferenceCount, rankings array<string>.

    valid_scores, top: whether a ranker's scores can be read, and the best entry by them; skipped: secure or empty episodes, which a ranker doesn't score.
    An error that the response has stays. Of the other protocols, later rules overwrite earlier ones.
    """
    own = F.when(response["error"] != "", response["error"])
    ranker = (protocol == "ranker") & ~skipped
    fallback = response["mode"] == "fallback"
    failed = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(response["message"], w))
    other = (
        F.when(fallback & F.coalesce(failed, F.lit(False)), "baseline_model_failure").when((protocol == "baseline") & fallback & (response["inferenceCount"] > 0), "baseline_model_failure")
        .when((protocol == "jev") & (response["decision"] == "remote_unavailable"), "jev_remote_unavailable").when(response["decision"] == "invalid_request", "baseline_invalid_request")
    )
    error = F.when(own.isNotNull(), own).when(protocol == "ranker", F.when(ranker & ~valid_scores, "invalid_score_response")).otherwise(other)
    decision = F.when(own.isNull() & ranker & ~valid_scores, "inference_failure").otherwise(response["decision"])
    raw = F.when(own.isNotNull(), None).when(protocol == "ranker", F.when(ranker & valid_scores, top)).otherwise(F.get(response["rankings"], F.lit(0)))
    return F.struct(error.alias("error"), decision.alias("decision"), raw.alias("raw_top"))


SECRETS = r"(?i)\b(?:api[_-]?key|token|secret|password)\b\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{16,}|\bsk-[A-Za-z0-9]{20,}|\bAKIA[0-9A-Z]{16}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----"


def holds_secret(text: Column) -> Column:
    """Whether a text shows a credential."""
    return F.coalesce(text.rlike(SECRETS), F.lit(False))


