"""Evaluation queries: scores -> features -> decisions -> outcomes -> metrics, gates, curves and mining."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.expr import log_sum_exp
from weftline.operators import outcomes as O
from weftline.operators.select import round_robin
from weftline.plans.catalog import query
from weftline.plans.standins import CALIBRATOR, SUMMARY_SQL, decision_sql, episode_sql, episodes


def decided(spark: SparkSession, d: str, salt: str = "ranker") -> DataFrame:
    return O.with_outcome(O.with_decision(O.with_features(episodes(spark, d, salt), ~F.col("has_context")), CALIBRATOR))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return O.paired(decided(spark, d, "baseline"), decided(spark, d))


PAIR_SQL = f"{decision_sql('baseline', 'b_')}, {decision_sql('ranker', 'r_')}, pr AS (SELECT b.id, b.family, b.answerable, b.correct_promotion AS b1, r.correct_promotion AS r1 FROM b_oc b JOIN r_oc r ON r.id = b.id)"


@query("outcome_summary", f"WITH {decision_sql()} SELECT {SUMMARY_SQL} FROM oc")
def outcome_summary(spark, d):
    """A1, A3, J1."""
    return O.summarize(decided(spark, d))


@query(
    "outcome_grouping_sets",
    f"WITH {decision_sql()} SELECT grp, family, CASE WHEN grouping(grp) = 0 THEN 'grp' WHEN grouping(family) = 0 THEN 'family' ELSE 'overall' END AS level, {SUMMARY_SQL} FROM oc GROUP BY GROUPING SETS ((), (grp), (family))",
)
def outcome_grouping_sets(spark, d):
    """A2: overall, by group and by family in one pass."""
    return O.summarize_sets(decided(spark, d), "grp", "family")


@query("top_margin_features", f"WITH {decision_sql()} SELECT id, top_id, f0 AS top_less_abstain, f1 AS top_less_second, n::BIGINT AS n_candidates, NOT has_context AS missing_context, coalesce(beats, FALSE) AS beats_abstain, error IS NULL AS valid FROM dec")
def top_margin_features(spark, d):
    """Features of every episode."""
    f = O.with_features(episodes(spark, d), ~F.col("has_context"))
    return f.select("id", "top_id", "top_less_abstain", "top_less_second", F.col("n_candidates").cast("long").alias("n_candidates"), "missing_context", F.coalesce("beats_abstain", F.lit(False)).alias("beats_abstain"), "valid")


@query("decisions", f"WITH {decision_sql()} SELECT id, decision, probability, CASE WHEN promoted THEN top_id END AS recommended_id FROM oc")
def decisions(spark, d):
    """Calibrated probability and decision of every episode."""
    return decided(spark, d).select("id", "decision", "probability", "recommended_id")


@query("dev_metrics", f"""WITH {decision_sql()}, s AS (SELECT sum(correct_decision::INT)::DOUBLE / greatest(count(*), 1) AS decision_accuracy, sum((answerable AND correct_decision)::INT)::DOUBLE / greatest(sum(answerable::INT), 1) AS select_rate,
    sum((NOT answerable AND correct_decision)::INT)::DOUBLE / greatest(sum((NOT answerable)::INT), 1) AS abstain_rate, sum(promoted::INT)::DOUBLE / greatest(count(*), 1) AS coverage,
    sum(correct_promotion::INT)::DOUBLE / greatest(sum(promoted::INT), 1) AS precision FROM oc) SELECT *, (select_rate + abstain_rate) / 2 AS balanced FROM s""")
def dev_metrics(spark, d):
    """A14."""
    return O.dev_metrics(decided(spark, d))


@query("slices_long", f"""WITH {decision_sql()},
pk AS (SELECT e.id, sum((e.acc < 0.3 OR e.pos = e.id::BIGINT % e.n)::INT) AS m, bool_or(EXISTS (SELECT 1 FROM ent f WHERE f.id = e.id AND f.kind = e.kind AND NOT (f.acc < 0.3 OR f.pos = f.id::BIGINT % f.n))
    AND (e.acc < 0.3 OR e.pos = e.id::BIGINT % e.n)) AS hard FROM ent e GROUP BY e.id),
k AS (SELECT o.*, unnest(list_filter(['label/' || CASE WHEN decide < 0.7 THEN 'select' WHEN decide < 0.9 THEN 'no_match' ELSE 'ambiguous_or_insufficient_context' END,
    'candidate_count/' || CASE WHEN o.n <= 1 THEN '1' WHEN o.n <= 4 THEN '2-4' WHEN o.n <= 10 THEN '5-10' ELSE '11-20' END, 'language/' || grp, 'observation_variant/unspecified', 'primary_teacher_model/unspecified',
    CASE WHEN answerable AND m > 1 THEN 'multiple_acceptable_candidates' END, CASE WHEN answerable AND hard THEN 'same_kind_negative_present' END], lambda x: x IS NOT NULL)) AS slice FROM oc o JOIN pk USING (id))
SELECT slice, {SUMMARY_SQL} FROM k GROUP BY slice""")
def slices_long(spark, d):
    """Metrics of every slice an episode belongs to."""
    e, ok = decided(spark, d), lambda x: F.array_contains("label.acceptable_ids", x["id"])
    kinds = lambda c: F.transform(F.filter("entries", c), lambda x: x["kind"])
    none, no = F.lit(None).cast("string"), F.lit(False)
    keys = O.slice_keys(F.col("grp"), none, none, kinds(ok), kinds(lambda x: ~ok(x)), no, no)
    return e.withColumn("slice", F.explode(keys)).groupBy("slice").agg(*O.summary_columns())


@query("wilson_by_family", f"""WITH {decision_sql()}, g AS (SELECT family, sum(answerable::INT)::BIGINT AS answerable, sum(correct_promotion::INT)::BIGINT AS correct FROM oc GROUP BY 1),
p AS (SELECT *, correct::DOUBLE / nullif(answerable, 0) AS top1, 1.959963984540054::DOUBLE AS z, nullif(answerable, 0)::DOUBLE AS m FROM g)
SELECT family, answerable, correct, top1, CASE WHEN m > 0 THEN greatest(0.0::DOUBLE, (top1 + z*z/(2*m)) / (1 + z*z/m) - z * sqrt(top1*(1-top1)/m + z*z/(4*m*m)) / (1 + z*z/m)) END AS low,
CASE WHEN m > 0 THEN least(1.0::DOUBLE, (top1 + z*z/(2*m)) / (1 + z*z/m) + z * sqrt(top1*(1-top1)/m + z*z/(4*m*m)) / (1 + z*z/m)) END AS high FROM p""")
def wilson_by_family(spark, d):
    """A5."""
    return O.by_group(decided(spark, d), "family")


@query("paired_deltas", f"""WITH {PAIR_SQL} SELECT sum(answerable::INT)::BIGINT AS answerable, sum((answerable AND b1)::INT)::DOUBLE / nullif(sum(answerable::INT), 0) AS baseline_top1,
sum((answerable AND r1)::INT)::DOUBLE / nullif(sum(answerable::INT), 0) AS replacement_top1, (sum((answerable AND r1)::INT) - sum((answerable AND b1)::INT))::DOUBLE / nullif(sum(answerable::INT), 0) AS delta_top1,
sum((answerable AND NOT b1 AND r1)::INT)::BIGINT AS gains, sum((answerable AND b1 AND NOT r1)::INT)::BIGINT AS regressions FROM pr""")
def paired_deltas(spark, d):
    """J2, A10."""
    return O.paired_summary(pairs(spark, d))


@query("key_group_gate", f"""WITH {PAIR_SQL}, f AS (SELECT family, sum(answerable::INT) AS n, (sum((answerable AND r1)::INT) - sum((answerable AND b1)::INT))::DOUBLE / nullif(sum(answerable::INT), 0) AS delta FROM pr GROUP BY 1),
g AS (SELECT *, n >= 3 AS sufficient, coalesce(n >= 3 AND delta < -0.05, FALSE) AS regression FROM f)
SELECT count(*)::BIGINT AS families, sum(sufficient::INT)::BIGINT AS sufficient, sum(regression::INT)::BIGINT AS regressions, CASE WHEN bool_or(regression) THEN 'failed' WHEN count(*) = 0 OR NOT bool_and(sufficient) THEN 'inconclusive' ELSE 'passed' END AS status FROM g""")
def key_group_gate(spark, d):
    """A8, J17, with a smaller least size to suit the tables."""
    return O.key_group_gate(pairs(spark, d), least=3)


def bootstrap_draws(families: int, reps: int, seed: int) -> list[tuple[int, int]]:
    """(rep, nth family) of every draw."""
    rng = random.Random(seed)
    return [(r, rng.randrange(families)) for r in range(reps) for _ in range(families)]


@query("family_bootstrap", f"""WITH {PAIR_SQL}, f AS (SELECT family, row_number() OVER (ORDER BY family) - 1 AS nth, count(*) OVER () AS k, sum(answerable::INT) AS n, sum((answerable AND r1)::INT) - sum((answerable AND b1)::INT) AS d FROM pr GROUP BY 1),
dr AS (SELECT rep, i, floor(('0x' || substr(md5(rep || ':' || i || ':423190'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * k)::BIGINT AS nth FROM range(2000) t(rep), range(12) u(i), (SELECT max(k) AS k FROM f) WHERE i < k),
r AS (SELECT rep, sum(d)::DOUBLE / sum(n) AS delta FROM dr JOIN f USING (nth) GROUP BY rep HAVING sum(n) > 0)
SELECT count(*)::BIGINT AS replicates, quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high FROM r""")
def family_bootstrap(spark, d):
    """2,000 replicates over at most twelve families, with draws by hash so that both engines take the same."""
    from weftline.functions.expr import hash_unit

    p = pairs(spark, d)
    k = p.select("family").distinct().count()
    text = F.concat_ws(":", F.col("rep").cast("string"), F.col("i").cast("string"), F.lit("423190"))
    draws = spark.range(2000).withColumnRenamed("id", "rep").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("rep", F.floor(hash_unit(text) * k).cast("int").alias("nth"))
    return O.family_bootstrap(p, draws)


_CURVE = f"""WITH {decision_sql()}, d AS (SELECT probability AS threshold, count(*) AS n, sum(top_ok::INT) AS k FROM oc WHERE beats AND probability IS NOT NULL GROUP BY 1),
c AS (SELECT threshold, (sum(n) OVER w)::BIGINT AS recommended, (sum(k) OVER w)::BIGINT AS correct FROM d WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT *, correct::DOUBLE / recommended AS precision, recommended::DOUBLE / (SELECT count(*) FROM oc) AS coverage FROM c)"""


def curve(spark, d):
    e = decided(spark, d)
    return O.precision_coverage(e.withColumn("target", F.col("raw_top_correct")), episodes(spark, d).count())


@query("precision_coverage_curve", f"{_CURVE} SELECT * FROM curve")
def precision_coverage_curve(spark, d):
    """A12."""
    return curve(spark, d)


@query("threshold_choice", f"""{_CURVE}, t AS (SELECT 1 AS tier, threshold, coverage AS x, precision AS y FROM curve WHERE recommended >= 10 AND precision >= 0.95
UNION ALL SELECT 2, threshold, precision, coverage FROM curve WHERE recommended >= 10 UNION ALL SELECT 3, threshold, recommended, precision FROM curve)
SELECT threshold, CASE tier WHEN 1 THEN 'observed_precision_target_met' WHEN 2 THEN 'precision_target_not_met_diagnostic_only' ELSE 'insufficient_recommendation_coverage_diagnostic_only' END AS status
FROM t ORDER BY tier, x DESC, y DESC, threshold DESC LIMIT 1""")
def threshold_choice(spark, d):
    """A13."""
    return O.choose_threshold(curve(spark, d), least=10)


@query("calibration_fit", f"""WITH {decision_sql()}, m AS (SELECT * FROM oc WHERE error IS NULL), s AS (SELECT avg(f0) AS m0, stddev_pop(f0) AS s0, avg(f1) AS m1, stddev_pop(f1) AS s1, avg(n::DOUBLE) AS m2, stddev_pop(n::DOUBLE) AS s2, avg((NOT has_context)::INT::DOUBLE) AS m3, stddev_pop((NOT has_context)::INT::DOUBLE) AS s3, count(*) AS k FROM m)
SELECT f AS feature, [m0, m1, m2, m3][f + 1] AS mean, CASE WHEN [s0, s1, s2, s3][f + 1] = 0 THEN 1.0::DOUBLE ELSE [s0, s1, s2, s3][f + 1] END AS scale, k::BIGINT AS rows, 0.0::DOUBLE AS gradient FROM s, range(4) t(f)""")  # fmt: skip
def calibration_fit(spark, d):
    """Standardization by population moments and a penalized logistic fit, by Newton steps over distributed sums. The penalized likelihood's gradient at the fit, summed over all rows again, is 0 to eight digits."""
    from weftline.operators.calibrate import fit, gradient

    e = decided(spark, d).where("valid")
    features = [F.col("top_less_abstain"), F.col("top_less_second"), F.col("n_candidates").cast("double"), F.col("missing_context").cast("double")]
    got = fit(e, features, F.col("raw_top_correct"))
    g = gradient(e, features, F.col("raw_top_correct"), got.first())
    rows = [(i, float(v)) for i, v in enumerate(g[:4])]
    each = got.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("feature", "x"), "rows").select(F.col("feature").cast("long").alias("feature"), F.col("x.mean").alias("mean"), F.col("x.scale").alias("scale"), "rows")
    return each.join(spark.createDataFrame(rows, "feature long, g double"), "feature").select("feature", "mean", "scale", "rows", F.abs(F.round("g", 8)).alias("gradient"))


@query("group_logloss", f"""WITH {episode_sql()}, m AS (SELECT id, max(score) AS t FROM ent GROUP BY 1), l AS (SELECT e.id, greatest(m.t, p.abstain) AS t, p.abstain, p.decide FROM ep p JOIN m USING (id) JOIN ent e USING (id) GROUP BY ALL)
SELECT l.id, l.t + ln(exp(l.abstain - l.t) + sum(exp(e.score - l.t))) - (CASE WHEN l.decide < 0.7 THEN l.t + ln(sum(CASE WHEN e.acc < 0.3 OR e.pos = e.id::BIGINT % e.n THEN exp(e.score - l.t) ELSE 0 END)) ELSE l.abstain END) AS loss
FROM l JOIN ent e USING (id) GROUP BY l.id, l.t, l.abstain, l.decide""")
def group_logloss(spark, d):
    """Log-sum-exp of all less that of the acceptable; abstention is the target of unanswerable episodes."""
    e = episodes(spark, d)
    every = F.concat(F.transform("scores", lambda s: s["score"]), F.array("abstain_score"))
    good = F.transform(F.filter("scores", lambda s: F.array_contains("label.acceptable_ids", s["id"])), lambda s: s["score"])
    return e.select("id", (log_sum_exp(every) - F.when(F.col("label.decision") == "select", log_sum_exp(good)).otherwise(F.col("abstain_score"))).alias("loss"))


@query("pooling_features", f"WITH {episode_sql()} SELECT id, avg(score) AS mean_score, max(score) AS max_score, ln(1 + count(*)) AS log_count FROM ent GROUP BY id")
def pooling_features(spark, d):
    """A16, within the row: no explode and no shuffle beyond the episodes' own."""
    s = F.transform("scores", lambda x: x["score"])
    n = F.size("scores")
    return episodes(spark, d).select("id", (F.aggregate(s, F.lit(0.0), lambda a, b: a + b) / n).alias("mean_score"), F.array_max(s).alias("max_score"), F.log1p(n).alias("log_count"))


_MINE = f"""WITH {decision_sql()}, pr AS (SELECT o.*, CASE WHEN beats THEN top_id END AS pid FROM oc o WHERE error IS NULL),
tk AS (SELECT p.id, bool_or(e.cand = p.pid AND EXISTS (SELECT 1 FROM ent f WHERE f.id = e.id AND f.kind = e.kind AND (f.acc < 0.3 OR f.pos = f.id::BIGINT % f.n))) AS same_kind FROM pr p JOIN ent e USING (id) GROUP BY 1),
g AS (SELECT p.id, family, CASE WHEN answerable THEN coalesce(pid IS NOT NULL AND top_ok, FALSE) ELSE pid IS NULL END AS agrees, CASE WHEN beats THEN least(f0, f1) ELSE -f0 END AS margin, answerable, pid, same_kind FROM pr p JOIN tk USING (id)),
h AS (SELECT id, family, agrees, margin, CASE WHEN agrees THEN 'correct_low_margin' WHEN NOT answerable THEN 'false_promotion_disagreement' WHEN pid IS NULL THEN 'missed_match_disagreement' WHEN same_kind THEN 'same_kind_choice_disagreement'
    ELSE 'different_kind_choice_disagreement' END AS category FROM g)"""


def mined(spark, d):
    e = decided(spark, d).where("valid").withColumn("predicted_id", F.when(F.col("beats_abstain"), F.col("top_id")))
    return O.hard_example(e).select("id", "family", "agrees", "margin", "category")


@query("hard_example_categories", f"{_MINE} SELECT * FROM h")
def hard_example_categories(spark, d):
    """R15."""
    return mined(spark, d)


@query("hard_example_nominations", f"""{_MINE}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY agrees, CASE WHEN agrees THEN margin ELSE -margin END, sha256(id)) AS rn FROM h)
SELECT id, family, category, rn::BIGINT AS turn FROM r ORDER BY rn, family LIMIT 40""")
def hard_example_nominations(spark, d):
    """The hardest of each family in turns, until forty (the report's size) are named."""
    m = mined(spark, d)
    order = [F.col("agrees"), F.when(F.col("agrees"), F.col("margin")).otherwise(-F.col("margin")), F.sha2("id", 256)]
    return round_robin(m, [], ["family"], order, 40).select("id", "family", "category", F.col("turn").cast("long").alias("turn"))


@query("score_parity", f"""WITH {episode_sql('ranker', 'r_')}, {episode_sql('baseline', 'b_')}, x AS (SELECT id, cand, score FROM r_ent UNION ALL SELECT id, '__abstain__', abstain FROM r_ep), y AS (SELECT id, cand, score FROM b_ent UNION ALL SELECT id, '__abstain__', abstain FROM b_ep)
SELECT count(*)::BIGINT AS scores, sum((x.score IS NULL OR y.score IS NULL)::INT)::BIGINT AS uncovered, max(abs(x.score - y.score)) AS max_difference, avg(abs(x.score - y.score)) AS mean_difference FROM x FULL JOIN y USING (id, cand)""")
def score_parity(spark, d):
    """J16, A26."""
    return O.parity(episodes(spark, d), episodes(spark, d, "baseline"))


@query("latency_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, median(value) AS middle, max(value) AS most FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    """Exact interpolated percentiles."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"), F.median("value").alias("middle"), F.max("value").alias("most"))


@query("regression_grid", "SELECT c::BIGINT AS n_candidates, r::BIGINT AS repeats, 'case-' || c || '-' || r AS id FROM (VALUES (1), (5), (10), (20)) a(c), (VALUES (0), (6), (28), (90)) b(r)")
def regression_grid(spark, d):
    """The fixed grid of regression inputs, four candidate counts by four lengths."""
    c, r = spark.createDataFrame([(1,), (5,), (10,), (20,)], "n_candidates long"), spark.createDataFrame([(0,), (6,), (28,), (90,)], "repeats long")
    return c.join(r, F.lit(True)).withColumn("id", F.concat_ws("-", F.lit("case"), F.col("n_candidates").cast("string"), F.col("repeats").cast("string")))
