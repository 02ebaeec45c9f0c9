"""Findings, readiness, rule matching, rule audit, mistakes and report signals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import count_if, ratio, reasons, truth, union_all

# Pattern type -> (rule, threshold, direction).
RULES = {
    "site_preference": ("frequent_site", 0.60, "min"), "early_zone_occupation": ("frequent_early_control", 0.60, "min"),
    "first_contact_zone": ("frequent_early_control", 0.60, "min"), "ct_starting_position": ("frequent_early_control", 0.60, "min"),
    "recurring_opening_player": ("recurring_opening_player", 0.35, "min"), "recurring_opening_death": ("recurring_opening_death", 0.30, "min"),
    "opening_kill_conversion": ("low_opening_conversion", 0.55, "max"), "recovery_after_opening_death": ("opening_death_recovery", 0.35, "min"),
    "lost_man_advantage": ("lost_man_advantage", 0.25, "min"), "untraded_death": ("untraded_death", 0.25, "min"),
}


def findings(patterns: DataFrame, include_partial: bool = True, include_zero: bool = False) -> DataFrame:
    f = patterns if include_partial else patterns.where("availability = 'available'")
    f = f if include_zero else f.where("numerator > 0")
    w = Window.partitionBy("profile_id").orderBy(F.desc("frequency"), F.desc("denominator"), "pattern_id")
    return f.withColumn("rank", F.row_number().over(w))


def readiness(found: DataFrame, evidence: DataFrame, corpus: DataFrame, min_matches: int = 5, corpus_matches: int = 15) -> DataFrame:
    """ready / limited / blocked with the reasons; evidence(pattern_id, with_tick, total), corpus(profile_id, matches)."""
    q, c = found.join(evidence, "pattern_id", "left").join(corpus, "profile_id", "left").fillna(0, ["with_tick", "total", "matches"]), F.col
    lim = reasons((c("buy_type") == "none", "buy_type_unavailable"), (c("matches") < corpus_matches, "corpus_below_minimum"), (c("denominator_match_count") < min_matches, "finding_matches_below_minimum"),
                  (c("small_sample"), "finding_sample_below_minimum"), (c("availability") == "partial", "source_pattern_partial"))
    block = reasons((c("with_tick") != c("total"), "evidence_tick_partial"))
    status = F.when(F.size("blocking_reasons") > 0, "blocked").when(F.size("limitations") > 0, "limited").otherwise("ready")
    return q.withColumn("limitations", lim).withColumn("blocking_reasons", block).withColumn("status", status).withColumn("eligible", status != "blocked")


def rule_table(spark: SparkSession) -> DataFrame:
    """Ten fixed rows; small enough to broadcast by construction."""
    return spark.createDataFrame([(k, *v) for k, v in RULES.items()], "pattern_type string, rule_id string, threshold double, direction string")


def match_rules(ready: DataFrame, rules: DataFrame) -> DataFrame:
    """Recommendation or the reason a finding was skipped."""
    q, c = ready.join(F.broadcast(rules), "pattern_type", "left"), F.col
    met = F.when(c("direction") == "min", c("frequency") >= c("threshold")).when(c("direction") == "max", c("frequency") <= c("threshold"))
    skip = F.when(~c("eligible"), "not_ready").when(c("rule_id").isNull(), "no_supported_rule").when(~met, "rule_threshold_not_met")
    return q.withColumn("skip_reason", skip).withColumn("rule_id", F.when(skip.isNull(), c("rule_id"))).drop("threshold", "direction")


def audit(source: DataFrame, ready: DataFrame, outcome: DataFrame, evidence_rounds: DataFrame, selections: DataFrame, corpus_matches: int = 15) -> DataFrame:
    """Fourteen checks of a rule run per profile: code, passed, affected."""
    c, key = F.col, "profile_id"
    rec = outcome.where("rule_id IS NOT NULL")
    base = source.groupBy(key).agg(F.count("*").alias("n_source"), F.countDistinct("side").alias("sides"), count_if(c("buy_type") == "none").alias("no_buy"))
    a = ready.groupBy(key).agg(F.count("*").alias("n_ready"))
    o = outcome.groupBy(key).agg(F.count("*").alias("n_out"), count_if(c("rule_id").isNull() & c("skip_reason").isNull()).alias("open"), count_if(c("rule_id").isNotNull() & c("skip_reason").isNotNull()).alias("double"), F.countDistinct("pattern_id").alias("n_ids"),
                                   count_if(c("rule_id").isNotNull() & ~c("eligible")).alias("gate_broken"))
    s = selections.groupBy(key).agg(F.countDistinct("match_id").alias("corpus"))
    same = rec.select(key, "pattern_id", c("numerator").alias("n2"), c("denominator").alias("d2"), c("frequency").alias("f2")).join(source.select("pattern_id", "numerator", "denominator", "frequency"), "pattern_id", "left")
    moved = same.groupBy(key).agg(count_if(~(c("n2").eqNullSafe(c("numerator")) & c("d2").eqNullSafe(c("denominator")))).alias("changed"), count_if(F.abs(c("f2") - c("n2") / c("d2")) > 1e-9).alias("bad_share"), count_if(c("numerator").isNull()).alias("no_source"))
    ev = evidence_rounds.where("contributed").join(rec.select(key, "pattern_id", "numerator"), "pattern_id")
    lost = ev.groupBy(key, "pattern_id", "numerator").agg(F.count("*").alias("n_ev")).groupBy(key).agg(count_if(c("n_ev") != c("numerator")).alias("evidence_changed"))
    outside = ev.select(key, "match_id").distinct().join(selections.select(key, "match_id"), [key, "match_id"], "left_anti").groupBy(key).agg(F.count("*").alias("outside"))
    dup = rec.groupBy(key, "rule_id", "pattern_id").agg(F.count("*").alias("n")).groupBy(key).agg(count_if(c("n") > 1).alias("dups"))
    q = base
    for d in (a, o, s, moved, lost, outside, dup):
        q = q.join(d, key, "left")
    q = q.fillna(0)
    checks = [("source_lineage", c("no_source")), ("finding_count", F.abs(c("n_source") - c("n_out"))), ("readiness_count", F.abs(c("n_source") - c("n_ready"))), ("complete_classification", c("open")), ("exclusive_classification", c("double")),
              ("corpus_size", F.greatest(F.lit(0), F.lit(corpus_matches) - c("corpus"))), ("both_sides", F.lit(2) - c("sides")), ("buy_context", c("no_buy")), ("readiness_gate", c("gate_broken")), ("statistics_unchanged", c("changed")),
              ("share_consistent", c("bad_share")), ("evidence_unchanged", c("evidence_changed")), ("evidence_inside_corpus", c("outside")), ("duplicates", c("dups") + c("n_out") - c("n_ids"))]
    return q.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("code"), v.cast("long").alias("affected")) for n, v in checks]))).withColumn("passed", c("affected") == 0)


def mistakes(views: DataFrame, advantages: DataFrame, economy: DataFrame, deaths: DataFrame, trades: DataFrame, tick_rate: float, early_seconds: float = 15.0) -> DataFrame:
    """Lost rounds after +2 and against an eco, and early deaths nobody traded.

    views: one row per selected round with team_id, opponent_team_id, side, won, live_tick.
    advantages: team_id rounds that were ever two players ahead, with the first tick.
    """
    key = ["match_id", "round_id"]
    cols = ["profile_id", "match_id", "round_id", "round_number", "side", "map_name", "team_id"]
    known = views.where("won IS NOT NULL")
    plus = known.join(advantages.select(*key, "team_id", "tick"), key + ["team_id"]).select(*cols, F.lit("lost_plus_two").alias("mistake_type"), "tick", F.lit(None).cast("bigint").alias("event_id"), (~F.col("won")).alias("happened"))
    eco = economy.where("buy_type = 'eco' AND eligible").select(*key, F.col("team_id").alias("opponent_team_id"))
    vs = known.join(eco, key + ["opponent_team_id"]).select(*cols, F.lit("lost_vs_full_eco").alias("mistake_type"), F.lit(None).cast("int").alias("tick"), F.lit(None).cast("bigint").alias("event_id"), (~F.col("won")).alias("happened"))
    d = views.join(deaths.select(*key, F.col("victim_team_id").alias("team_id"), "tick", "event_id"), key + ["team_id"]).where((F.col("tick") >= F.col("live_tick")) & ((F.col("tick") - F.col("live_tick")) / tick_rate <= early_seconds))
    d = d.join(trades.select(F.col("original_event_id").alias("event_id"), F.lit(True).alias("traded")), "event_id", "left")
    early = d.select(*cols, F.lit("early_untraded_death").alias("mistake_type"), "tick", "event_id", F.col("traded").isNull().alias("happened"))
    rows = union_all(plus, vs, early)
    n = rows.groupBy("profile_id", "mistake_type").agg(count_if(F.col("happened")).alias("numerator"), F.count("*").alias("denominator"))
    return rows.where("happened").drop("happened").join(n, ["profile_id", "mistake_type"]).withColumn("frequency", ratio(F.col("numerator"), F.col("denominator")))


def frequency_word(v: Column) -> Column:
    return F.when(v >= 1.0, "every_time").when(v >= 0.75, "almost_always").when(v >= 0.5, "often").when(v >= 0.25, "sometimes").when(v > 0, "rarely").otherwise("not_seen")


def signals(found: DataFrame, limit: int = 5) -> DataFrame:
    """Best finding per pattern type, then the best few of a profile."""
    order = [F.col("small_sample"), F.desc("denominator_match_count"), F.desc("denominator"), F.desc("frequency"), F.col("pattern_type"), F.col("map_name"), F.col("pattern_id")]
    one = found.withColumn("rk", F.row_number().over(Window.partitionBy("profile_id", "pattern_type").orderBy(*order))).where("rk = 1")
    top = one.withColumn("position", F.row_number().over(Window.partitionBy("profile_id").orderBy(*order))).where(F.col("position") <= limit)
    return top.withColumn("word", frequency_word(F.col("frequency"))).drop("rk")


def export_reports(found: DataFrame, rules: DataFrame, path: str) -> None:
    """Write one JSON report per profile: findings with their rules by map, side, purchase, type and id, fields by name, no null fields.

    A report's lines lie in one file in their order, and carry it as ``position``; reports are dealt by profile, nothing is sorted over all of them.
    """
    q = found.join(rules.where("rule_id IS NOT NULL").select("pattern_id", "rule_id"), "pattern_id", "left")
    order = [F.col("map_name"), F.col("side"), F.coalesce("buy_type", F.lit("")), F.col("pattern_type"), F.col("pattern_id"), F.coalesce("rule_id", F.lit(""))]
    q = q.withColumn("position", F.row_number().over(Window.partitionBy("profile_id").orderBy(*order)))
    q.select("profile_id", *sorted(c for c in q.columns if c != "profile_id")).write.partitionBy("profile_id").json(path)
