"""Cross-match frequencies of round facts for selected match/team pairs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PatternConfig
from ..functions.common import any_of, count_if, ratio, truth
from ..operators.lineage import stable_id

SCOPE = ["profile_id", "pattern_type", "map_name", "side", "buy_type"]
ROUND = ["profile_id", "match_id", "round_id", "round_number", "team_id", "side", "map_name", "buy_type"]
BUCKETS = (0.0, 20.0, 40.0, 60.0)
BINARY = {"opening_kill_conversion": "converted_opening_kill", "recovery_after_opening_death": "recovered_after_opening_death",
          "lost_man_advantage": "round_contains_lost_man_advantage", "untraded_death": "round_contains_untraded_death"}


def bucket_labels() -> list[str]:
    ends = [*BUCKETS[1:], None]
    return [f"{int(a)}-{int(b)}s" if b is not None else f"{int(a)}s+" for a, b in zip(BUCKETS, ends)]


def match_inputs(selections: DataFrame, matches: DataFrame, feature_runs: DataFrame, version: str) -> DataFrame:
    """Selected matches with the reason a match cannot be used."""
    q = selections.join(matches.select("match_id", "map_name"), "match_id", "left").join(feature_runs, "match_id", "left")
    reason = (F.when(F.col("map_name").isNull(), "canonical_match_unavailable").when(F.col("rule_version").isNull(), "compatible_feature_run_unavailable")
              .when(F.col("rule_version") != version, "feature_rule_incompatible"))
    return q.select("profile_id", "match_id", "team_id", F.coalesce("map_name", F.lit("unknown")).alias("map_name"), F.when(reason.isNull(), "included").otherwise("excluded").alias("status"), reason.alias("exclusion_reason"))


def round_inputs(inputs: DataFrame, rounds: DataFrame, economy_teams: DataFrame) -> DataFrame:
    """Complete rounds of the included matches from the selected team's view."""
    r = rounds.where("is_complete AND NOT is_warmup").select("match_id", "round_id", "round_number", "t_team_id", "ct_team_id", "winner_side")
    q = inputs.where("status = 'included'").join(r, "match_id")
    side = F.when(F.col("team_id") == F.col("t_team_id"), "T").when(F.col("team_id") == F.col("ct_team_id"), "CT")
    q = q.withColumn("side", side).where("side IS NOT NULL").withColumn("won", F.when(F.col("winner_side").isin("T", "CT"), F.col("winner_side") == F.col("side")))
    return q.join(economy_teams.select("match_id", "round_id", "team_id", "buy_type"), ["match_id", "round_id", "team_id"], "left").select(*ROUND, "won")


def observations(inputs: DataFrame, facts: DataFrame, players: DataFrame, tick_rate: float | None) -> DataFrame:
    """One row per (round, pattern type): included or excluded, and its values.

    All facts of a round are folded by one aggregate; nothing is joined per pattern type.
    """
    f = facts.join(inputs.select("match_id", "round_id", "team_id").distinct(), ["match_id", "round_id", "team_id"], "left_semi")
    kind, av = F.col("feature_type"), F.col("availability")
    ok = av.isin("available", "partial")
    who = players.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("player_id", F.coalesce(F.concat(F.lit("steam:"), "steam_id"), F.concat_ws(":", F.lit("occurrence"), "match_id", "player_id"))))).alias("ids"))

    def some(t, extra=F.lit(True)):
        return any_of((kind == t) & ok & extra)

    def part(t, extra=F.lit(True)):
        return any_of((kind == t) & (av == "partial") & extra)

    def pick(t, c, extra=F.lit(True)):
        return F.max(F.when((kind == t) & ok & extra, c))

    role = F.col("value")
    g = f.groupBy("match_id", "round_id", "team_id").agg(
        pick("bombsite", F.col("value")).alias("site"), part("bombsite").alias("site_p"), pick("bomb_route", F.col("value")).alias("route"), part("bomb_route").alias("route_p"),
        pick("plant_timing", F.col("value")).alias("plant"), some("plant_timing").alias("plant_ok"), part("plant_timing").alias("plant_p"),
        F.max(F.when((kind == "starting_zone_distribution") & (av == "available"), F.col("value"))).alias("start"),
        F.sort_array(F.collect_set(F.when((kind == "early_zone_presence") & ok, F.concat(F.lit("zone:"), "zone_id")))).alias("early"),
        pick("opening_duel", F.col("details")[0], role == "winner").alias("killer"), pick("opening_duel", F.col("details")[1], role == "loser").alias("victim"), part("opening_duel").alias("open_p"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when((kind == "first_contact") & ok, F.transform("details", lambda z: F.concat("value", F.lit(":zone:"), z))))))).alias("contact"), part("first_contact").alias("contact_p"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when((kind == "first_utility") & ok, F.col("details")))))).alias("utility"), part("first_utility").alias("utility_p"),
        *[x for t, n in (("lost_man_advantage", "lost"), ("untraded_death", "untraded")) for x in (some(t).alias(f"{n}_yes"), part(t).alias(f"{n}_p"), any_of((kind == t) & (av == "not_applicable")).alias(f"{n}_no"))])
    q = inputs.join(g, ["match_id", "round_id", "team_id"], "left").join(who, "match_id", "left")
    c, none = F.col, F.expr("CAST(array() AS array<string>)")
    zones = F.transform(F.split("start", "\\|"), lambda p: F.element_at(F.split(p, "="), 2))
    setup = F.array_join(F.transform(F.sort_array(F.array_distinct(zones)), lambda z: F.concat(z, F.lit("*"), F.size(F.filter(zones, lambda y: y == z)))), " ")
    seconds = c("plant").cast("double") / F.lit(tick_rate) if tick_rate else F.lit(None).cast("double")
    labels = bucket_labels()
    bucket = F.when(seconds >= BUCKETS[3], labels[3]).when(seconds >= BUCKETS[2], labels[2]).when(seconds >= BUCKETS[1], labels[1]).when(seconds >= 0, labels[0])
    t, ct, always = c("side") == "T", c("side") == "CT", F.lit(True)
    false = F.lit(False)

    def row(applies, name, value, partial, reason, included=None):
        inc = F.coalesce((F.size(value) > 0) if included is None else included, false)
        return F.when(applies, F.struct(F.lit(name).alias("pattern_type"), inc.alias("included"), F.when(inc, value).otherwise(none).alias("values"),
                                        F.when(inc, truth(partial)).otherwise(false).alias("partial"), F.when(~inc, reason).alias("reason")))

    def one(v):
        return F.array_compact(F.array(v))

    def outcome(name, player, label):
        known = c(player).isNotNull() & c("won").isNotNull()
        return row(always, name, F.when(truth(c("won")), F.array(F.lit(label))).otherwise(none), c("open_p"), F.when(c(player).isNull(), f"opening_{'winner' if player == 'killer' else 'loser'}_opportunity_unavailable").otherwise("round_outcome_unavailable"), known)

    def has(name, n):
        return row(always, name, F.when(truth(c(f"{n}_yes")), F.array(F.lit(BINARY[name]))).otherwise(none), truth(c(f"{n}_yes")) & truth(c(f"{n}_p")), F.lit(f"{name}_availability_unproven"), truth(c(f"{n}_yes")) | truth(c(f"{n}_no")))

    items = F.array_compact(F.array(
        row(t, "site_preference", one(F.concat(F.lit("site:"), "site")), c("site_p"), F.lit("plant_site_unavailable")),
        row(t, "bomb_routing", one(c("route")), c("route_p"), F.lit("bomb_route_unavailable")),
        row(t, "plant_timing", one(bucket), c("plant_p"), F.when(truth(c("plant_ok")), "plant_seconds_unavailable").otherwise("plant_timing_unavailable")),
        row(ct, "ct_starting_position", one(F.when(c("start").isNotNull(), setup)), false, F.lit("complete_ct_starting_setup_unavailable")),
        row(always, "early_zone_occupation", F.coalesce("early", none), false, F.lit("early_zone_evidence_unavailable")),
        row(always, "recurring_opening_player", one(c("ids")[c("killer")]), c("open_p"), F.lit("opponent_opening_winner_not_observed")),
        row(always, "recurring_opening_death", one(c("ids")[c("victim")]), c("open_p"), F.lit("opponent_opening_loser_not_observed")),
        row(always, "first_contact_zone", F.coalesce("contact", none), c("contact_p"), F.lit("first_contact_zone_unresolved")),
        row(always, "first_utility", F.coalesce("utility", none), c("utility_p"), F.lit("first_utility_unavailable")),
        outcome("opening_kill_conversion", "killer", BINARY["opening_kill_conversion"]), outcome("recovery_after_opening_death", "victim", BINARY["recovery_after_opening_death"]),
        has("lost_man_advantage", "lost"), has("untraded_death", "untraded")))
    return q.select(*ROUND, F.inline(items))


def registered_values() -> list[tuple[str, str]]:
    """Values reported even when never seen."""
    return [("site_preference", "site:A"), ("site_preference", "site:B"), *[("plant_timing", b) for b in bucket_labels()], *BINARY.items()]


def wilson(n: Column, d: Column, z: float) -> tuple[Column, Column]:
    p, z2 = n / d, z * z
    div = F.lit(1.0) + F.lit(z2) / d
    center = (p + F.lit(z2) / (F.lit(2.0) * d)) / div
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / d + F.lit(z2) / (F.lit(4.0) * d * d)) / div
    return F.greatest(F.lit(0.0), center - margin), F.least(F.lit(1.0), center + margin)


def frequencies(obs: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """Numerator, denominator, share and interval per (pattern, map, side, buy, value)."""
    o = obs.withColumn("buy_type", F.coalesce("buy_type", F.lit("none")))
    inc = o.where("included")
    scope = inc.groupBy(*SCOPE).agg(F.count("*").alias("denominator"), F.countDistinct("match_id").alias("denominator_match_count"), F.bool_or("partial").alias("any_partial"))
    hits = inc.select(*SCOPE, "match_id", F.explode("values").alias("value")).groupBy(*SCOPE, "value").agg(F.count("*").alias("numerator"), F.countDistinct("match_id").alias("numerator_match_count"))
    fixed = F.create_map(*[x for t in dict.fromkeys(k for k, _ in registered_values()) for x in (F.lit(t), F.array(*[F.lit(v) for k, v in registered_values() if k == t]))])
    zero = scope.select(*SCOPE, F.explode(fixed[F.col("pattern_type")]).alias("value"))
    keys = hits.select(*SCOPE, "value").unionByName(zero).distinct()
    q = keys.join(hits, SCOPE + ["value"], "left").join(scope, SCOPE).fillna(0, ["numerator", "numerator_match_count"])
    n, d = F.col("numerator"), F.col("denominator")
    low, high = wilson(n, d, cfg.z)
    loose = F.col("pattern_type").isin("recurring_opening_player", "recurring_opening_death") & F.col("value").startswith("occurrence:")
    partial = F.col("any_partial") | (F.col("buy_type") == "none") | loose
    q = q.withColumn("pattern_id", stable_id(*SCOPE, "value"))
    return q.select("pattern_id", *SCOPE, "value", "numerator", "denominator", ratio(n, d).alias("frequency"), low.alias("lower_bound"), high.alias("upper_bound"), "numerator_match_count", "denominator_match_count",
                    F.when(partial, "partial").otherwise("available").alias("availability"), (d < cfg.min_sample).alias("small_sample"))


def contributions(obs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every included round of a pattern's scope with its contribution flag."""
    o = obs.where("included").withColumn("buy_type", F.coalesce("buy_type", F.lit("none")))
    q = patterns.select("pattern_id", *SCOPE, "value").join(o.select(*SCOPE, "match_id", "round_id", "round_number", "values"), SCOPE)
    return q.select("pattern_id", "match_id", "round_id", "round_number", F.array_contains("values", F.col("value")).alias("contributed"))


def exclusions(obs: DataFrame) -> DataFrame:
    return obs.where("NOT included").groupBy("profile_id", "pattern_type", "map_name", "side", F.coalesce("buy_type", F.lit("none")).alias("buy_type"), "reason").agg(F.count("*").alias("rounds"), F.countDistinct("match_id").alias("matches"))


def capability(obs: DataFrame, patterns: DataFrame) -> DataFrame:
    o = obs.groupBy("profile_id", "pattern_type").agg(count_if(F.col("included")).alias("eligible_rounds"), count_if(~F.col("included")).alias("excluded_rounds"))
    p = patterns.groupBy("profile_id", "pattern_type").agg(F.count("*").alias("pattern_count"), F.bool_or(F.col("availability") == "partial").alias("part"))
    q = o.join(p, ["profile_id", "pattern_type"], "left").fillna(0, ["pattern_count"])
    return q.withColumn("availability", F.when(F.col("eligible_rounds") == 0, "unavailable").when(truth(F.col("part")), "partial").otherwise("available")).drop("part")


def listing(patterns: DataFrame, profile_id=None, pattern_type=None, map_name=None, side=None) -> DataFrame:
    for n, v in (("profile_id", profile_id), ("pattern_type", pattern_type), ("map_name", map_name), ("side", side)):
        if v is not None:
            patterns = patterns.where(F.col(n) == v)
    return patterns.orderBy("profile_id", F.desc("frequency"), F.desc("denominator"), "pattern_id")


def latest_compatible(runs: DataFrame, run_inputs: DataFrame, selections: DataFrame, features: DataFrame) -> DataFrame:
    """Newest run per profile whose inputs are exactly the selection and still the newest features."""
    newest = features.groupBy("match_id").agg(F.max(F.struct("created_at", "feature_fingerprint")).alias("n")).select("match_id", F.col("n.feature_fingerprint").alias("now"))
    sel = selections.select("profile_id", "match_id", "team_id")
    i = run_inputs.join(runs.select("run_id", "profile_id"), "run_id").join(newest, "match_id", "left").join(sel.withColumn("hit", F.lit(1)), ["profile_id", "match_id", "team_id"], "left")
    bad = i.where("hit IS NULL OR NOT (feature_fingerprint <=> now)").select("run_id").distinct()
    sizes = run_inputs.groupBy("run_id").agg(F.count("*").alias("n_inputs"))
    want = sel.groupBy("profile_id").agg(F.count("*").alias("n_selected"))
    good = runs.join(sizes, "run_id").join(want, "profile_id").where("n_inputs = n_selected").join(bad, "run_id", "left_anti")
    w = Window.partitionBy("profile_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return good.withColumn("rk", F.row_number().over(w)).where("rk = 1").select("profile_id", "run_id", "created_at")


def movement_chapter(early: DataFrame, players: DataFrame, matches: DataFrame, spawn: tuple[str, ...] = ("T SPAWN", "CT SPAWN")) -> DataFrame:
    """Early zones of every player: share of that player's observed rounds per map and side."""
    e = early.select("match_id", "round_number", "side", "zone_id", F.explode("details").alias("player_id")).where("zone_id IS NOT NULL")
    e = e.join(players.where("steam_id IS NOT NULL").select("match_id", "player_id", "steam_id"), ["match_id", "player_id"]).join(matches.select("match_id", "map_name"), "match_id")
    key = F.struct("match_id", "round_number")
    seen = e.groupBy("steam_id", "map_name", "side").agg(F.countDistinct(key).alias("denominator"))
    z = e.groupBy("steam_id", "map_name", "side", "zone_id").agg(F.countDistinct(key).alias("numerator"), F.countDistinct("match_id").alias("match_count"))
    z = z.where(~F.upper(F.trim(F.replace("zone_id", F.lit("_"), F.lit(" ")))).isin(*spawn)).join(seen, ["steam_id", "map_name", "side"])
    w = Window.partitionBy("steam_id", "map_name").orderBy(F.desc("frequency"), F.desc("denominator"), "side", F.lower("zone_id"))
    return z.withColumn("frequency", ratio(F.col("numerator"), F.col("denominator"))).withColumn("rank", F.row_number().over(w))
