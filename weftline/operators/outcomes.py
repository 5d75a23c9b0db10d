"""Scores to decisions to outcomes to metrics: the evaluation half of the engine.

Frames are one row per episode, with nested entries and scores, so that features need no shuffle; grouping happens once, over flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.expr import flag, ratio, sigmoid, wilson
from weftline.operators import ranks
from weftline.schemas import FAILURES


def ranked(scores: Column) -> Column:
    """Candidate scores (id, pos, score) in descending order; the first in input order wins ties."""
    def before(a, b):
        return F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)

    return F.array_sort(scores, before)


def with_features(df: DataFrame, missing_context: Column, scores: str = "scores", abstain: str = "abstain_score") -> DataFrame:
    """Adds top_id, margins, candidate count, missing context, beats_abstain and valid.

    Margins are to abstention and to the runner-up, which is abstention for a single candidate. A tie with abstention abstains.
    Scores are invalid on an error, without entries, if they don't cover the entries exactly, or if one isn't finite.
    """
    ids = F.transform("entries", lambda e: e["id"])
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    scored = F.transform(scores, lambda s: s["id"])
    valid = (
        F.col("error").isNull() & (F.size("entries") > 0) & (F.array_sort(ids) == F.array_sort(scored)) & (F.size(F.array_distinct(scored)) == F.size(scored))
        & F.forall(scores, lambda s: finite(s["score"])) & finite(F.col(abstain))
    )
    r = df.withColumn("_r", F.when(F.coalesce(valid, F.lit(False)), ranked(F.col(scores)))).withColumn("valid", F.col("_r").isNotNull())
    top, second = F.get("_r", F.lit(0))["score"], F.coalesce(F.get("_r", F.lit(1))["score"], F.col(abstain))
    return r.withColumns({
        "top_id": F.get("_r", F.lit(0))["id"], "top_less_abstain": F.when(F.col("valid"), top - F.col(abstain)), "top_less_second": F.when(F.col("valid"), top - second),
        "n_candidates": F.size("entries"), "missing_context": missing_context, "beats_abstain": F.when(F.col("valid"), top > F.col(abstain)),
    }).drop("_r")


def with_decision(df: DataFrame, calibrator: dict, secure: Column | None = None) -> DataFrame:
    """Adds probability, recommended_id and decision by a frozen calibrator: bypass, inference_failure, recommended or abstain."""
    x = [F.col("top_less_abstain"), F.col("top_less_second"), F.col("n_candidates").cast("double"), F.col("missing_context").cast("double")]
    v = F.lit(float(calibrator["intercept"]))
    for value, mean, scale, weight in zip(x, calibrator["mean"], calibrator["scale"], calibrator["coefficients"], strict=True):
        v = v + (value - mean) / scale * weight
    bypass = (F.size("entries") == 0) | (F.lit(False) if secure is None else F.coalesce(secure, F.lit(False)))
    p = F.when(F.col("valid") & ~bypass, sigmoid(v))
    take = F.coalesce(F.col("beats_abstain") & (p >= calibrator["threshold"]), F.lit(False))
    return df.withColumns({
        "probability": p, "recommended_id": F.when(take & ~bypass, F.col("top_id")),
        "decision": F.when(bypass, "bypass").when(~F.col("valid"), "inference_failure").when(take, "recommended").otherwise("abstain"),
    })


def with_outcome(df: DataFrame) -> DataFrame:
    """Adds the outcome flags. Failures stay in every denominator; a recommended id that isn't an entry's is a failure."""
    ids = F.transform("entries", lambda e: e["id"])
    failed = F.coalesce(F.col("error").isNotNull() & (F.col("error") != ""), F.lit(False)) | F.coalesce(F.col("decision").isin(*FAILURES), F.lit(False)) | (
        F.col("recommended_id").isNotNull() & ~F.array_contains(ids, F.coalesce("recommended_id", F.lit(""))))
    answerable = F.col("label.decision") == "select"
    ok = lambda c: F.coalesce(F.array_contains("label.acceptable_ids", F.coalesce(c, F.lit(""))), F.lit(False))
    return df.withColumns({"answerable": answerable, "failure": failed}).withColumns({
        "promoted": F.col("recommended_id").isNotNull() & ~F.col("failure"), "raw_top": F.when(~F.col("failure") & F.col("valid"), F.col("top_id")),
    }).withColumns({
        "correct_promotion": F.col("promoted") & F.col("answerable") & ok(F.col("recommended_id")),
        "false_promotion": ~F.col("answerable") & F.col("promoted"),
        "raw_top_correct": F.col("answerable") & ~F.col("failure") & ok(F.col("raw_top")),
    }).withColumn("correct_decision", ~F.col("failure") & (F.col("correct_promotion") | (~F.col("answerable") & ~F.col("promoted"))))


FLAGS = ("answerable", "failure", "promoted", "correct_promotion", "correct_decision", "raw_top_correct", "false_promotion")


def summary_columns() -> list[Column]:
    """Flag sums, ratios and latency percentiles of a group (A1, A3)."""
    s = {f: F.sum(flag(F.col(f))) for f in FLAGS}
    total = F.count(F.lit(1))
    return [
        total.alias("total"), *[s[f].alias(f) for f in FLAGS],
        ratio(s["correct_promotion"], s["answerable"]).alias("answerable_top1"), ratio(s["correct_decision"], total).alias("decision_accuracy"),
        ratio(s["correct_promotion"], s["promoted"]).alias("promotion_precision"), ratio(s["promoted"], total).alias("coverage"),
        ratio(s["false_promotion"], total - s["answerable"]).alias("false_promotion_rate"),
        F.when(F.count("raw_top") > 0, ratio(s["raw_top_correct"], s["answerable"])).alias("raw_top1"),
        F.percentile("latency_ms", F.lit(0.5)).alias("latency_p50"), F.percentile("latency_ms", F.lit(0.95)).alias("latency_p95"),
    ]


def summarize(df: DataFrame) -> DataFrame:
    """One row of overall metrics (A1)."""
    return df.agg(*summary_columns())


def summarize_sets(df: DataFrame, *columns: str) -> DataFrame:
    """Overall, and by each column alone, in one pass over grouping sets (A2)."""
    sets = [[], *[[F.col(c)] for c in columns]]
    level = F.when(F.grouping_id() == 2 ** len(columns) - 1, "overall")
    for c in columns:
        level = F.when(F.grouping(c) == 0, c).otherwise(level)
    return df.groupingSets(sets, *columns).agg(level.alias("level"), *summary_columns())


def paired(base: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Rows of two outcome frames side by side (J2): b_* and r_* top-1 flags. Both must hold the same keys once; see require_coverage."""
    pick = lambda df, p: df.select(key, *([] if p == "r" else ["family", "answerable"]), F.col("correct_promotion").alias(f"{p}_top1"))
    return pick(base, "b").join(pick(other, "r"), key)


def paired_summary(pairs: DataFrame) -> DataFrame:
    """Top-1 of both arms, their difference, and how many episodes went each way (A10)."""
    a = F.col("answerable")
    n, b, r = F.sum(flag(a)), F.sum(flag(a & F.col("b_top1"))), F.sum(flag(a & F.col("r_top1")))
    return pairs.agg(
        n.alias("answerable"), ratio(b, n).alias("baseline_top1"), ratio(r, n).alias("replacement_top1"), ratio(r - b, n).alias("delta_top1"),
        F.sum(flag(a & ~F.col("b_top1") & F.col("r_top1"))).alias("gains"), F.sum(flag(a & F.col("b_top1") & ~F.col("r_top1"))).alias("regressions"),
    )


def family_bootstrap(pairs: DataFrame, draws: DataFrame) -> DataFrame:
    """Percentile interval of the top-1 difference, families drawn with replacement.

    draws: rep, nth (0-based family in sorted order). Families are summed first, so the join is draws by families, whatever the rows.
    Replicates without an answerable episode are dropped.
    """
    a = F.col("answerable")
    fam = pairs.groupBy("family").agg(F.sum(flag(a)).alias("n"), F.sum(flag(a & F.col("r_top1")) - flag(a & F.col("b_top1"))).alias("d"))
    fam = fam.withColumn("nth", F.row_number().over(Window.orderBy("family")) - 1)  # one row per family
    reps = draws.join(fam, "nth").groupBy("rep").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).where("n > 0").select((F.col("d") / F.col("n")).alias("delta"))
    return reps.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"))


def by_group(df: DataFrame, key: str) -> DataFrame:
    """Answerable top-1 of each group with its Wilson interval (A5)."""
    n, s = F.sum(flag(F.col("answerable"))), F.sum(flag(F.col("correct_promotion")))
    low, high = wilson(F.col("correct"), F.col("answerable"))
    return df.groupBy(key).agg(n.alias("answerable"), s.alias("correct")).withColumns({"top1": ratio(F.col("correct"), F.col("answerable")), "low": low, "high": high})


def key_group_gate(pairs: DataFrame, least: int = 30, drop: float = -0.05) -> DataFrame:
    """Families' differences, and the verdict over them: failed, inconclusive or passed."""
    a = F.col("answerable")
    fam = pairs.groupBy("family").agg(F.sum(flag(a)).alias("n"), ratio(F.sum(flag(a & F.col("r_top1")) - flag(a & F.col("b_top1"))), F.sum(flag(a))).alias("delta"))
    fam = fam.withColumns({"sufficient": F.col("n") >= least, "regression": F.coalesce((F.col("n") >= least) & (F.col("delta") < drop), F.lit(False))})
    return fam.agg(
        F.count(F.lit(1)).alias("families"), F.sum(flag(F.col("sufficient"))).alias("sufficient"), F.sum(flag(F.col("regression"))).alias("regressions"),
        F.when(F.coalesce(F.bool_or("regression"), F.lit(False)), "failed").when((F.count(F.lit(1)) == 0) | ~F.coalesce(F.bool_and("sufficient"), F.lit(True)), "inconclusive").otherwise("passed").alias("status"),
    )


def acceptance(delta_top1: Column, group_status: Column, calibrator_status: Column, failures: Column) -> dict[str, Column]:
    """The four criteria and whether all hold."""
    out = {"top1_gain": delta_top1 >= 0.05, "key_groups": group_status == "passed", "calibrated": calibrator_status == "observed_precision_target_met", "no_failures": failures == 0}
    out = {k: F.coalesce(c, F.lit(False)) for k, c in out.items()}
    return out | {"accepted": out["top1_gain"] & out["key_groups"] & out["calibrated"] & out["no_failures"]}


def precision_coverage(df: DataFrame, total: int | Column) -> DataFrame:
    """Every distinct probability as a threshold (p >= threshold), with what would be recommended, precision and coverage.

    Counts are cumulative over distinct thresholds only, in ranges of them; coverage is of all `total` episodes, scoreable or not.
    """
    d = df.where("beats_abstain AND probability IS NOT NULL").groupBy(F.col("probability").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(flag(F.col("target"))).alias("k"))
    c = ranks.ranked(d, [F.desc("threshold")], sums={"recommended": "n", "correct": "k"}).select("threshold", "recommended", "correct")
    n = F.lit(total) if isinstance(total, int) else total
    return c.withColumns({"precision": ratio(F.col("correct"), F.col("recommended")), "coverage": ratio(F.col("recommended"), n)})


def choose_threshold(curve: DataFrame, least: int, target: float = 0.95) -> DataFrame:
    """The threshold by three tiers and the tier's status (A13): enough recommendations and precision; enough recommendations; else the most."""
    enough, good = F.col("recommended") >= least, F.col("precision") >= target
    order = lambda *c: F.struct(*[F.col(x) for x in c])
    pick = lambda cond, key: F.max_by(F.when(cond, F.col("threshold")), F.when(cond, key))
    t1 = pick(enough & good, order("coverage", "precision", "threshold"))
    t2 = pick(enough, order("precision", "coverage", "threshold"))
    t3 = F.max_by("threshold", F.struct("recommended", "precision", "threshold"))
    status = F.when(F.col("a").isNotNull(), "observed_precision_target_met").when(F.col("b").isNotNull(), "precision_target_not_met_diagnostic_only").otherwise("insufficient_recommendation_coverage_diagnostic_only")
    return curve.agg(t1.alias("a"), t2.alias("b"), t3.alias("c")).select(F.coalesce("a", "b", "c").alias("threshold"), status.alias("status"))


def slice_keys(language: Column, variant: Column, teacher: Column, positive_kinds: Column, negative_kinds: Column, conflict: Column, truncated: Column) -> Column:
    """The slices an episode belongs to, as an array."""
    from weftline.functions.expr import count_bucket

    reason = F.when(F.col("label.decision") == "select", "select").when(F.col("label.abstain_reason").isin("ambiguous", "insufficient_context"), "ambiguous_or_insufficient_context").otherwise(F.col("label.abstain_reason"))
    other = lambda name, c: F.concat(F.lit(f"{name}/"), F.coalesce(c, F.lit("unspecified")))
    keys = F.array(
        F.concat(F.lit("label/"), reason), F.concat(F.lit("candidate_count/"), count_bucket(F.size("entries"))), other("language", language), other("observation_variant", variant), other("primary_teacher_model", teacher),
        F.when(F.size("label.acceptable_ids") > 1, "multiple_acceptable_candidates"), F.when(F.arrays_overlap(positive_kinds, negative_kinds), "same_kind_negative_present"),
        F.when(conflict, "generator_requested_field_category_conflict"), F.when(truncated, "truncated_before_teacher_label"),
    )
    return F.filter(keys, lambda k: k.isNotNull())


def dev_metrics(df: DataFrame) -> DataFrame:
    """Balanced development metrics, with empty denominators as 1."""
    n = lambda c: F.sum(flag(c))
    one = lambda c: F.greatest(c, F.lit(1)).cast("double")
    sel, right = F.col("answerable"), F.col("correct_decision")
    s, a = n(sel & right) / one(n(sel)), n(~sel & right) / one(n(~sel))
    return df.agg((n(right) / one(F.count(F.lit(1)))).alias("decision_accuracy"), s.alias("select_rate"), a.alias("abstain_rate"), ((s + a) / 2).alias("balanced"),
                  (n(F.col("promoted")) / one(F.count(F.lit(1)))).alias("coverage"), (n(F.col("correct_promotion")) / one(n(F.col("promoted")))).alias("precision"))


def hard_example(df: DataFrame, predicted: str = "predicted_id") -> DataFrame:
    """Adds agrees, category and margin for nomination."""
    kind = lambda i: F.get(F.filter("entries", lambda e: e["id"] == i), F.lit(0))["kind"]
    positive_kinds = F.transform(F.filter("entries", lambda e: F.array_contains("label.acceptable_ids", e["id"])), lambda e: e["kind"])
    sel = F.col("label.decision") == "select"
    agrees = F.when(sel, F.coalesce(F.array_contains("label.acceptable_ids", F.col(predicted)), F.lit(False))).otherwise(F.col(predicted).isNull())
    category = (
        F.when(F.col("agrees"), "correct_low_margin").when(~sel, "false_promotion_disagreement").when(F.col(predicted).isNull(), "missed_match_disagreement")
        .when(F.array_contains(positive_kinds, kind(F.col(predicted))), "same_kind_choice_disagreement").otherwise("different_kind_choice_disagreement")
    )
    margin = F.when(F.col("beats_abstain"), F.least("top_less_abstain", "top_less_second")).otherwise(-F.col("top_less_abstain"))
    return df.withColumn("agrees", agrees).withColumns({"category": category, "margin": margin})


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Score differences of two backends over (id, candidate), abstention included as a candidate."""
    long = lambda df, n: df.select("id", F.explode(F.concat(F.transform("scores", lambda s: F.struct(s["id"].alias("candidate"), s["score"].alias("score"))), F.array(F.struct(F.lit("__abstain__").alias("candidate"), F.col("abstain_score").alias("score"))))).alias("s")).select("id", "s.candidate", F.col("s.score").alias(n))
    both = long(a, "x").join(long(b, "y"), ["id", "candidate"], "full")
    d = F.abs(F.col("x") - F.col("y"))
    return both.agg(F.count(F.lit(1)).alias("scores"), F.sum(flag(F.col("x").isNull() | F.col("y").isNull())).alias("uncovered"), F.max(d).alias("max_difference"), F.avg(d).alias("mean_difference"))
