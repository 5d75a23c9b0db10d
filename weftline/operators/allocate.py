"""Quota allocation and planning of slots and batches, over small dimension tables (families, quotas) and their expansions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.expr import hash_int

#: Shares of the actions in tenths; what neither takes is missing intent.
SHARES = (("select", 7), ("no_match", 2))
LANGUAGES = ("English", "简体中文", "English with Chinese UI text")


def family_quotas(families: DataFrame, total: int | Column, by: list[str] | None = None) -> DataFrame:
    """Adds `count`: an even share, with the remainder to the first families in order (Q1). families: family, ord (0-based)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*(by or [F.lit(1)])))
    t = F.lit(total) if isinstance(total, int) else total
    return families.withColumn("count", (F.floor(t / n) + (F.col("ord") < t % n).cast("int")).cast("long"))


def action_quotas(counts: DataFrame) -> DataFrame:
    """Adds select, no_match, missing_intent: exact 70/20/10 of the whole by largest remainder (Q2). counts: family, ord, count.

    The target of an action is rounded half up; a family's base is its floored share, at most what is left of it; the rest goes, one
    each, to the largest remainders in family order, among families with something left.
    """
    out = counts.withColumn("missing_intent", F.col("count"))
    whole = Window.partitionBy(F.lit(1))
    for action, share in SHARES:
        base = F.least(F.floor(F.col("count") * share / 10), F.col("missing_intent")).cast("long")
        out = out.withColumn(action, base).withColumn("missing_intent", F.col("missing_intent") - F.col(action))
        target = F.floor((F.sum("count").over(whole) * share + 5) / 10)
        left = target - F.sum(action).over(whole)
        rank = F.row_number().over(Window.partitionBy(F.col("missing_intent") > 0).orderBy(F.desc(F.col("count") * share % 10), "ord"))
        out = out.withColumn("_left", left).withColumn("_one", ((F.col("missing_intent") > 0) & (rank <= F.col("_left"))).cast("long"))
        out = out.withColumn(action, F.col(action) + F.col("_one")).withColumn("missing_intent", F.col("missing_intent") - F.col("_one")).drop("_left", "_one")
    return out


def interleaved(quotas: DataFrame) -> DataFrame:
    """One row for each planned action, evenly interleaved: ordered by index / count, action, index within the family (W7). Adds slot."""
    actions = F.array(*[F.struct(F.lit(a).alias("action"), F.col(a).alias("n")) for a in ("select", "no_match", "missing_intent")])
    one = quotas.withColumn("_a", F.explode(actions)).where("_a.n > 0").select("family", "ord", F.col("_a.action").alias("action"), F.col("_a.n").alias("n"), F.explode(F.sequence(F.lit(0), F.col("_a.n").cast("int") - 1)).alias("action_index"))
    w = Window.partitionBy("family").orderBy(F.col("action_index") / F.col("n"), "action", "action_index")
    return one.withColumn("slot", F.row_number().over(w) - 1).drop("n")


def share_of(count: Column, tenths: int, floor: bool) -> Column:
    """A share in tenths: floored (held-out sets), or rounded half to even (training sets) (Q4)."""
    return F.floor(count * tenths / 10).cast("long") if floor else F.bround(count * (tenths / 10)).cast("long")


def slots(quotas: DataFrame, run_id: str, split: str, sizes: tuple[int, int] = (1, 20), floor: bool = False) -> DataFrame:
    """Registered slots with independent factors (Q3, Q4). Where the order must be random it is by hash, so plans need no shared generator state.

    Columns: id, family, slot, scenario_type, observation_variant, candidate_count, context_language, seed.
    """
    s = interleaved(quotas)
    key = F.concat_ws(":", F.lit(run_id), F.lit(split), "family", F.col("slot").cast("string"))
    seed = hash_int(key)
    missing = F.col("action") == "missing_intent"
    m = F.count(F.lit(1)).over(Window.partitionBy("family", "action"))
    draw = F.row_number().over(Window.partitionBy("family", "action").orderBy(F.sha2(F.concat_ws(":", key, F.lit("observation")), 256)))
    none, generic = share_of(m, 4, floor), share_of(m, 2, floor)
    variant = F.when(~missing, "standard").when(draw <= none, "no_accessibility").when(draw <= none + generic, "generic_field").otherwise("standard")
    lo, hi = sizes
    scenario = F.when(missing, F.when(F.col("action_index") % 2 == 1, "ambiguous").otherwise("insufficient_context")).otherwise(F.col("action"))
    return s.select(
        F.concat_ws("-", F.lit(split), "family", F.lpad(F.col("slot").cast("string"), 5, "0")).alias("id"), "family", F.col("ord"), F.col("slot").cast("long").alias("slot"), scenario.alias("scenario_type"), variant.alias("observation_variant"),
        (lo + hash_int(F.concat(key, F.lit(":size"))) % (hi - lo + 1)).alias("candidate_count"), F.element_at(F.array(*map(F.lit, LANGUAGES)), (hash_int(F.concat(key, F.lit(":language"))) % len(LANGUAGES) + 1).cast("int")).alias("context_language"), seed.alias("seed"),
    )


def batches(planned: DataFrame, size: int) -> DataFrame:
    """Slots in fixed-size batches of their family, in the order that covers all families before any gets its next."""
    b = planned.withColumn("batch", F.floor(F.col("slot") / size).cast("long")).groupBy("family", "ord", "batch").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return b.withColumn("turn", F.row_number().over(Window.orderBy("batch", "ord")))  # one row for each batch


def missing_slots(planned: DataFrame, fulfilled: DataFrame) -> DataFrame:
    """Planned slots that no accepted row fills (J8, U6). fulfilled: quota_slot_id."""
    return planned.join(fulfilled, planned["id"] == fulfilled["quota_slot_id"], "left_anti")


def replacements(planned: DataFrame, fulfilled: DataFrame, round_number: int) -> DataFrame:
    """Specifications for the missing slots of a round: factors kept, new id and seed (Q5)."""
    new = F.concat("id", F.lit(f"-replacement-{round_number:02d}"))
    return missing_slots(planned, fulfilled).withColumn("quota_slot_id", F.col("id")).withColumn("id", new).withColumn("seed", hash_int(F.col("id")))


def observation_supplement(planned: DataFrame, dispatched: DataFrame, salt: str, variants: tuple[str, ...] = ("no_accessibility", "no_accessibility", "generic_field")) -> DataFrame:
    """Variants for the first untouched missing-intent slots of each family in hash order (Q6). dispatched: family, slot."""
    open_slots = planned.where(F.col("scenario_type").isin("ambiguous", "insufficient_context")).join(dispatched, ["family", "slot"], "left_anti")
    h = F.sha2(F.concat_ws(":", F.lit(salt), "family", F.col("slot").cast("string")), 256)
    r = open_slots.withColumn("_r", F.row_number().over(Window.partitionBy("family").orderBy(h))).where(F.col("_r") <= len(variants))
    return r.select("family", "slot", F.element_at(F.array(*map(F.lit, variants)), F.col("_r")).alias("variant"))


def by_priority(pending: DataFrame, hit: Column, position: str = "position") -> DataFrame:
    """Stable two-class order: what hits a missing stratum first (O8). Adds turn; `pending` is a work list, one row for each batch."""
    return pending.withColumn("turn", F.row_number().over(Window.orderBy(F.when(hit, 0).otherwise(1), position)))


def cover_order(supplies: pd.DataFrame, missing: dict) -> list:
    """Greedy weighted set cover (O9): positions in order, batches of the largest remaining gain first (ties: earliest), then backups, then the rest.

    supplies: position, stratum, n. A work list has at most some hundred batches, and each choice depends on those before it.
    """
    missing = dict(missing)
    target = {k for k, v in missing.items() if v}
    groups = {p: dict(zip(g["stratum"], g["n"], strict=True)) for p, g in supplies.groupby("position")}
    order, left = [], sorted(groups)
    while left and any(missing.values()):
        gain = {p: sum(min(missing.get(k, 0), n) for k, n in groups[p].items()) for p in left}
        best = max(left, key=lambda p: (gain[p], -p))
        if not gain[best]:
            break
        order.append(best)
        left.remove(best)
        for k, n in groups[best].items():
            missing[k] = max(0, missing.get(k, 0) - n)
    return order + [p for p in left if target & set(groups[p])] + [p for p in left if not target & set(groups[p])]


def cover_by_split(supplies: DataFrame, missing: DataFrame) -> DataFrame:
    """cover_order() of each split. supplies: split, position, stratum, n; missing: split, stratum, n."""
    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = cover_order(left, dict(zip(right["for_stratum"], right["wanted"], strict=True)))
        return pd.DataFrame({"split": key[0], "position": order, "turn": range(1, len(order) + 1)})

    from weftline.session import ship

    ship(supplies.sparkSession)
    missing = missing.select(F.col("split").alias("for_split"), F.col("stratum").alias("for_stratum"), F.col("n").alias("wanted"))
    return supplies.groupBy("split").cogroup(missing.groupBy("for_split")).applyInPandas(one, "split string, position long, turn long")


def unused_multisets(values: DataFrame, used: DataFrame, size: int) -> DataFrame:
    """Multisets of `size` values with two or more different ones that aren't used, best first: most different values, then hash (U8).

    values: value (a handful); used: members array<string>, sorted.
    """
    out = values.select(F.array("value").alias("members"))
    for _ in range(size - 1):
        out = out.join(values, F.col("value") >= F.element_at("members", -1)).select(F.concat("members", F.array("value")).alias("members"))
    out = out.withColumn("different", F.size(F.array_distinct("members"))).where("different >= 2").join(used, "members", "left_anti")
    return out.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("different"), F.sha2(F.array_join("members", "|"), 256))))


def unused_pairs(values: DataFrame, used: DataFrame) -> DataFrame:
    """Pairs of different values that aren't used, fewest parameters (';') first, then in order (U8)."""
    a, b = values.select(F.col("value").alias("a")), values.select(F.col("value").alias("b"))
    p = a.join(b, F.col("a") < F.col("b")).select(F.array("a", "b").alias("members")).join(used, "members", "left_anti")
    marks = F.size(F.filter("members", lambda x: F.contains(x, F.lit(";"))))
    return p.withColumn("turn", F.row_number().over(Window.orderBy(marks, "members")))
