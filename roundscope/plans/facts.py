"""Per-round facts as one tall table with typed columns and evidence arrays.

``details`` holds players, or the zone / utility candidates of tied first contacts and throws.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FactConfig
from ..functions.common import count_if, reasons, shared, shared_union, truth, union_all
from ..operators.stats import classify_kills

KEY = ["match_id", "round_id"]
TEAM = ["match_id", "round_id", "round_number", "team_id", "side"]
STORY_GROUPS = (("opening_duel", "first_contact"), ("first_utility",), ("bombsite",), ("plant_timing",), ("retake_attempt", "save_exit"))


def fact(df: DataFrame, kind: str, availability: Column, tick_start=None, tick_end=None, zone=None, value=None, players=None, events=None, limits=None) -> DataFrame:
    def opt(c, t):
        return F.lit(None).cast(t) if c is None else c.cast(t)

    return df.select(*TEAM, F.lit(kind).alias("feature_type"), availability.alias("availability"), opt(tick_start, "int").alias("tick_start"),
                     opt(tick_end if tick_end is not None else tick_start, "int").alias("tick_end"), opt(zone, "string").alias("zone_id"), opt(value, "string").alias("value"),
                     opt(players, "array<string>").alias("details"), opt(events, "array<bigint>").alias("event_ids"),
                     (F.expr("CAST(array() AS array<string>)") if limits is None else limits.cast("array<string>")).alias("limitations"))


def absent(df: DataFrame, kind: str, status: str, reason: str, tick=None) -> DataFrame:
    return fact(df, kind, F.lit(status), tick_start=tick, limits=F.array(F.lit(reason)))


class RoundFacts:
    """``zoned`` and ``grenade_zones`` are callables, so facts without positions never build them.

    zoned(): match_id, round_id, tick, player_id, team_id, alive, has_bomb, zone_id.
    """

    def __init__(self, tables, stats, timeline, zoned, grenade_zones, cfg: FactConfig = FactConfig(), tolerance: int = 16, tick_rate: float | None = None):
        self.t, self.stats, self.tl, self.cfg, self.tolerance, self.rate = tables, stats, timeline, cfg, tolerance, tick_rate
        self._zoned, self._grenade_zones = zoned, grenade_zones
        self.rounds = timeline.rounds

    @cached_property
    def zoned(self) -> DataFrame:
        return self._zoned()

    @cached_property
    def grenade_zones(self) -> DataFrame:
        return self._grenade_zones()

    @cached_property
    def teams(self) -> DataFrame:
        sides = F.array(F.struct(F.col("t_team_id").alias("team_id"), F.lit("T").alias("side")), F.struct(F.col("ct_team_id").alias("team_id"), F.lit("CT").alias("side")))
        return shared(self.rounds.select(*KEY, "round_number", "start_tick", "freeze_end_tick", F.coalesce("official_end_tick", "end_tick").alias("last_tick"), F.inline(sides)).where("team_id IS NOT NULL"))

    @cached_property
    def people(self) -> DataFrame:
        p = self.tl.participants.where("participation_status <> 'not_participating' AND team_id IS NOT NULL")
        return shared(p.select(*KEY, "player_id", "team_id", "side"))

    @cached_property
    def roster(self) -> DataFrame:
        return self.people.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("player_id", F.struct("team_id", "side")))).alias("roster"))

    @cached_property
    def unclear(self) -> DataFrame:
        """Ticks whose inner order is not proven."""
        return self.tl.groups.where("intermediate_status <> 'deterministic'").select(*KEY, "tick", F.lit(True).alias("unclear"))

    @cached_property
    def kills(self) -> DataFrame:
        return classify_kills(self.t.kills, self.roster, live_only=False).where("kill_class = 'enemy'").join(self.rounds.select(*KEY), KEY, "left_semi")

    def zone_distributions(self) -> DataFrame:
        marks = F.array(*[F.lit(o) for o in (0, *self.cfg.checkpoints)])
        base = self.teams.select("*", F.explode(marks).alias("off")).withColumn("target", F.col("freeze_end_tick") + F.col("off"))
        z = self.zoned.join(self.rounds.select(*KEY, "freeze_end_tick"), KEY)
        near = F.filter(marks, lambda o: (F.col("tick") - F.col("freeze_end_tick") - o).between(0, self.tolerance))
        z = z.select(*KEY, "tick", "player_id", "zone_id", F.explode(near).alias("off"))
        first = z.groupBy(*KEY, "off").agg(F.min("tick").alias("tick"))
        at = z.join(first, KEY + ["off", "tick"]).where("zone_id IS NOT NULL").join(self.people, KEY + ["player_id"])
        got = at.groupBy(*KEY, "off", "team_id").agg(F.count("*").alias("resolved"), F.sort_array(F.collect_list(F.concat_ws("=", "player_id", "zone_id"))).alias("pairs"))
        size = self.people.groupBy(*KEY, "team_id").agg(F.count("*").alias("members"))
        q = base.join(first, KEY + ["off"], "left").join(got, KEY + ["off", "team_id"], "left").join(size, KEY + ["team_id"], "left")
        late = truth(F.col("target") > F.col("last_tick"))
        none = F.coalesce("resolved", F.lit(0)) == 0
        full = F.col("resolved") == F.col("members")
        why = F.when(F.col("freeze_end_tick").isNull(), "freeze_end_tick_unavailable").when(late, "checkpoint_after_round_end").when(F.col("tick").isNull(), "spatial_checkpoint_unavailable").when(
            none, "no_resolved_player_zones_at_checkpoint").when(~full, "partial_zone_coverage")
        av = F.when(F.col("freeze_end_tick").isNull(), "unavailable").when(late, "not_applicable").when(F.col("tick").isNull() | none, "unavailable").when(full, "available").otherwise("partial")
        seen = F.when(~late, F.col("tick"))
        out = []
        for kind, rule in (("starting_zone_distribution", "off = 0"), ("checkpoint_zone_distribution", "off > 0")):
            out.append(fact(q.where(rule), kind, av, seen, value=F.when(~late & ~none, F.array_join("pairs", "|")), limits=F.array_compact(F.array(why))))
        return union_all(*out)

    def first_contact(self) -> DataFrame:
        d = self.t.damages.where("phase = 'live' AND damage_health > 0").join(self.roster, KEY).join(self.rounds.select(*KEY), KEY, "left_semi")
        d = d.withColumn("att", F.col("roster")[F.col("attacker_player_id")]).withColumn("vic", F.col("roster")[F.col("victim_player_id")]).where("att.team_id <> vic.team_id")
        d = d.where("(attacker_team_id IS NULL OR attacker_team_id = att.team_id) AND (victim_team_id IS NULL OR victim_team_id = vic.team_id)")
        cols = [*KEY, "round_number", "tick", "event_id", "attacker_player_id", "victim_player_id", "att", "vic"]
        c = d.select(*cols).unionByName(self.kills.select(*cols))
        low = c.groupBy(*KEY).agg(F.min("tick").alias("tick"))
        c = c.join(low, KEY + ["tick"])
        n = c.groupBy(*KEY).agg(F.count("*").alias("n_first"))
        pair = F.array(F.struct(F.lit("initiator").alias("role"), F.col("attacker_player_id").alias("player_id"), F.col("att.team_id").alias("team_id"), F.col("att.side").alias("side")),
                       F.struct(F.lit("receiver").alias("role"), F.col("victim_player_id").alias("player_id"), F.col("vic.team_id").alias("team_id"), F.col("vic.side").alias("side")))
        r = c.select(*KEY, "round_number", "tick", "event_id", F.inline(pair)).join(self.zoned.select(*KEY, "tick", "player_id", "zone_id"), KEY + ["tick", "player_id"], "left").join(n, KEY)
        g = r.groupBy(*TEAM, "role", "tick").agg(F.sort_array(F.collect_list("event_id")).alias("ev"), F.min("zone_id").alias("z1"), F.max("zone_id").alias("z2"), F.bool_or(F.col("zone_id").isNull()).alias("gap"), F.max("n_first").alias("n"),
                                                  F.sort_array(F.collect_set("zone_id")).alias("zones"))
        lim = reasons((F.col("n") > 1, "same_tick_contact_order_not_proven"), (F.col("gap"), "contact_zone_partial"))
        out = fact(g, "first_contact", F.when((F.col("n") > 1) | F.col("gap"), "partial").otherwise("available"), F.col("tick"), zone=F.when(F.col("z1") == F.col("z2"), F.col("z1")), value=F.col("role"), players=F.col("zones"), events=F.col("ev"), limits=lim)
        return out.unionByName(absent(self.teams.join(low, KEY, "left_anti"), "first_contact", "unavailable", "no_proven_enemy_contact"))

    def opening_duel(self) -> DataFrame:
        o = self.stats.openings.select(*KEY, "tick", "event_id", "killer_team_id", "killer_player_id", "victim_player_id").join(self.unclear, KEY + ["tick"], "left")
        q = self.teams.join(o, KEY)
        amb = truth(F.col("unclear"))
        win = F.col("team_id") == F.col("killer_team_id")
        out = fact(q, "opening_duel", F.when(amb, "partial").otherwise("available"), F.col("tick"), value=F.when(win, "winner").otherwise("loser"), players=F.array("killer_player_id", "victim_player_id"),
                   events=F.array("event_id"), limits=reasons((amb, "analytics_tiebreak_is_not_physical_order")))
        return out.unionByName(absent(self.teams.join(o, KEY, "left_anti"), "opening_duel", "not_applicable", "no_valid_enemy_kill_observed"))

    def first_utility(self) -> DataFrame:
        g = self.grenade_zones.where("phase = 'live' AND player_id IS NOT NULL AND team_id IS NOT NULL AND lifecycle_event <> 'expired'")
        per = g.groupBy(*KEY, "team_id", "tick").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("event_id")).alias("ev"), F.min("zone_id").alias("z1"), F.max("zone_id").alias("z2"),
                                                     F.bool_and(F.col("lifecycle_event").isin("thrown", "throw")).alias("thrown"), F.min("grenade_type").alias("type"),
                                                     F.sort_array(F.collect_set(F.concat(F.lit("utility:"), "grenade_type", F.lit(":zone:"), F.coalesce("zone_id", F.lit("unresolved"))))).alias("kinds"))
        first = per.groupBy(*KEY, "team_id").agg(F.min_by(F.struct("tick", "n", "ev", "z1", "z2", "thrown", "type", "kinds"), "tick").alias("f"))
        q = self.teams.join(first, KEY + ["team_id"], "left").select(*TEAM, "f.*")
        zone = F.when(F.col("z1") == F.col("z2"), F.col("z1"))
        ok = F.col("thrown") & (F.col("n") == 1) & zone.isNotNull()
        lim = reasons((~F.col("thrown"), "source_observes_effect_not_throw_tick"), (F.col("n") > 1, "same_tick_utility_order_not_proven"), (zone.isNull(), "utility_zone_unresolved"))
        out = fact(q.where("n IS NOT NULL"), "first_utility", F.when(ok, "available").otherwise("partial"), F.col("tick"), zone=zone, value=F.col("type"), players=F.col("kinds"), events=F.col("ev"), limits=lim)
        return out.unionByName(absent(q.where("n IS NULL"), "first_utility", "unavailable", "no_canonical_utility_observation"))

    def early_zones(self) -> DataFrame:
        z = self.zoned.where("zone_id IS NOT NULL AND team_id IS NOT NULL").join(self.rounds.select(*KEY, "freeze_end_tick", F.coalesce("official_end_tick", "end_tick").alias("last_tick")), KEY)
        z = z.where((F.col("tick") >= F.col("freeze_end_tick")) & (F.col("tick") <= F.least(F.col("freeze_end_tick") + self.cfg.early_window, F.coalesce("last_tick", F.lit(2**31 - 1)))))
        per = z.groupBy(*KEY, "team_id", "zone_id", "tick").agg(F.sort_array(F.collect_set("player_id")).alias("players"))
        first = per.groupBy(*KEY, "team_id", "zone_id").agg(F.min("tick").alias("tick"), F.min_by("players", "tick").alias("players"))
        q = self.teams.join(first, KEY + ["team_id"])
        out = fact(q, "early_zone_presence", F.lit("available"), F.col("tick"), zone=F.col("zone_id"), value=F.array_join("players", "|"), players=F.col("players"), limits=F.array(F.lit("positive_presence_only_absence_not_proven")))
        return out.unionByName(absent(self.teams.join(first, KEY + ["team_id"], "left_anti"), "early_zone_presence", "unavailable", "no_resolved_early_zone_observation", F.col("freeze_end_tick")))

    def bomb_route(self) -> DataFrame:
        b = self.zoned.where("has_bomb")
        gaps = b.groupBy(*KEY).agg(count_if(F.col("zone_id").isNull()).alias("gaps"))
        w = Window.partitionBy(*KEY).orderBy("tick", "player_id")
        s = b.where("zone_id IS NOT NULL").withColumn("prev", F.lag("zone_id").over(w)).where("prev IS NULL OR prev <> zone_id")
        stops = s.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("tick", "player_id", "zone_id"))).alias("stops"))
        q = self.teams.where("side = 'T'").join(stops, KEY, "left").join(gaps, KEY, "left")
        have = q.where("stops IS NOT NULL")
        part = F.col("gaps") > 0
        out = fact(have, "bomb_route", F.when(part, "partial").otherwise("available"), F.col("stops")[0]["tick"], F.element_at("stops", -1)["tick"], zone=F.element_at("stops", -1)["zone_id"],
                   value=F.array_join("stops.zone_id", ">"), players=F.array_distinct("stops.player_id"), limits=reasons((part, "bomb_route_has_zone_gaps")))
        return out.unionByName(absent(q.where("stops IS NULL"), "bomb_route", "unavailable", "no_resolved_bomb_carrier_zone"))

    @cached_property
    def plants(self) -> DataFrame:
        """First plant of every round with the planter's zone."""
        p = self.t.bombs.where("phase = 'live' AND event_type = 'planted'").join(self.rounds.select(*KEY), KEY, "left_semi")
        per = p.groupBy(*KEY, "tick").agg(F.count("*").alias("n"), F.min(F.struct("event_id", "player_id", "site_normalized")).alias("f"))
        first = per.groupBy(*KEY).agg(F.min(F.struct("tick", "n", "f")).alias("b")).select(*KEY, F.col("b.tick").alias("tick"), F.col("b.n").alias("n"), "b.f.*")
        z = self.zoned.select(*KEY, "tick", "player_id", "zone_id")
        return shared(first.join(z, KEY + ["tick", "player_id"], "left"))

    def bombsite(self) -> DataFrame:
        q = self.teams.where("side = 'T'").join(self.plants, KEY, "left")
        have, none = q.where("n IS NOT NULL"), q.where("n IS NULL")
        site = F.when(F.upper("site_normalized").isin("A", "B"), F.upper("site_normalized"))
        in_zone = truth(F.col("zone_id").startswith("bombsite"))
        zone_site = F.when(in_zone, F.upper(F.nullif(F.regexp_extract("zone_id", "(?i)(?:^|[ _-])([ab])(?:[ _-]|$)", 1), F.lit(""))))
        solved = site.isNotNull() | in_zone
        lim = reasons((F.col("n") > 1, "multiple_same_tick_plant_events"), (~solved, "plant_site_unresolved"))
        out = fact(have, "bombsite", F.when((F.col("n") > 1) | ~solved, "partial").otherwise("available"), F.col("tick"), zone=F.col("zone_id"), value=F.coalesce(site, zone_site), players=F.array("player_id"), events=F.array("event_id"), limits=lim)
        return out.unionByName(absent(none, "bombsite", "not_applicable", "no_plant_observed"))

    def plant_timing(self) -> DataFrame:
        q = self.teams.where("side = 'T'").join(self.plants, KEY, "left")
        have, none = q.where("n IS NOT NULL"), q.where("n IS NULL")
        rel = F.when(F.col("tick") >= F.col("freeze_end_tick"), F.col("tick") - F.col("freeze_end_tick"))
        lim = reasons((rel.isNull(), "freeze_end_relative_tick_unavailable"), (F.lit(self.rate is None) | rel.isNull(), "seconds_unavailable_without_proven_tickrate"), (F.col("n") > 1, "multiple_same_tick_plant_events"))
        val = rel / F.lit(self.rate) if self.rate else rel
        out = fact(have, "plant_timing", F.when(rel.isNotNull() & (F.col("n") == 1), "available").otherwise("partial"), F.col("tick"), zone=F.col("zone_id"), value=val, players=F.array("player_id"), events=F.array("event_id"), limits=lim)
        return out.unionByName(absent(none, "plant_timing", "not_applicable", "no_plant_observed"))

    def post_plant_roster(self) -> DataFrame:
        f = self.tl.frame.select(*KEY, F.col("people"), "dead", "undecided")
        q = self.teams.join(self.plants, KEY, "left").join(f, KEY, "left")
        gone = "exists(dead, d -> d.victim = k AND d.tick <= tick)"
        mine = "v.team_id = team_id"
        for name, rule in (("alive", f"v.life = 'alive' AND NOT coalesce({gone}, false)"), ("lost", f"coalesce({gone}, false)"), ("unknown", f"v.life = 'unknown' AND NOT coalesce({gone}, false)")):
            q = q.withColumn(name, F.sort_array(F.map_keys(F.expr(f"map_filter(people, (k, v) -> {mine} AND {rule})"))))
        have, none = q.where("n IS NOT NULL"), q.where("n IS NULL")
        open_state = truth(F.col("undecided") <= F.col("tick"))
        unk = F.size("unknown") > 0
        av = F.when(open_state, "unavailable").when(unk, "partial").otherwise("available")
        lim = F.when(open_state, F.array(F.lit("post_plant_temporal_state_unavailable"))).otherwise(reasons((unk, "participant_life_state_partial")))
        val = F.concat_ws("/", F.size("alive"), F.size("lost"), F.size("unknown"))
        out = fact(have, "post_plant_roster", av, F.col("tick"), zone=F.when(~open_state, F.col("zone_id")), value=F.when(~open_state, val), players=F.when(~open_state, F.col("alive")), events=F.array("event_id"), limits=lim)
        return out.unionByName(absent(none, "post_plant_roster", "not_applicable", "no_plant_observed"))

    def retake_attempt(self) -> DataFrame:
        ct = self.teams.where("side = 'CT'")
        p = self.plants.select(*KEY, F.col("tick").alias("plant_tick"), "event_id", F.col("zone_id").alias("site_zone"))
        good = p.where("site_zone LIKE 'bombsite%'")
        mine = self.people.where("side = 'CT'").select(*KEY, "player_id")
        z = self.zoned.where("alive AND zone_id IS NOT NULL").join(good, KEY).join(mine, KEY + ["player_id"], "left_semi").where("tick >= plant_tick")
        flags = z.groupBy(*KEY, "player_id").agg(
            F.max((F.col("tick") == F.col("plant_tick")) & (F.col("zone_id") != F.col("site_zone"))).alias("outside"),
            F.min(F.when((F.col("tick") > F.col("plant_tick")) & (F.col("zone_id") == F.col("site_zone")), F.col("tick"))).alias("entry"))
        e = flags.where("outside AND entry IS NOT NULL").groupBy(*KEY).agg(F.min("entry").alias("entry"), F.sort_array(F.collect_set("player_id")).alias("who"))
        q = ct.join(p, KEY, "left").join(e, KEY, "left")
        done = q.where("entry IS NOT NULL")
        out = fact(done, "retake_attempt", F.lit("available"), F.col("plant_tick"), F.col("entry"), zone=F.col("site_zone"), value=F.array_join("who", "|"), players=F.col("who"), events=F.array("event_id"), limits=F.array(F.lit("positive_exact_site_entry_rule_v1")))
        left = q.where("entry IS NULL")
        why = F.when(F.col("plant_tick").isNull(), "no_plant_observed").when(truth(F.col("site_zone").startswith("bombsite")), "negative_retake_not_proven_with_partial_zone_coverage").otherwise("planted_bombsite_zone_unresolved")
        return out.unionByName(fact(left, "retake_attempt", F.when(F.col("plant_tick").isNull(), "not_applicable").otherwise("unavailable"), F.col("plant_tick"), limits=F.array(why)))

    def lost_advantage(self) -> DataFrame:
        t = self.stats.transitions.where("state_before <> 'even' AND state_before <> state_after")
        side = F.when(F.col("state_before") == "t_advantage", "T").otherwise("CT")
        q = self.teams.join(t.select(*KEY, "tick", "event_id", side.alias("side"), "death_class", "signed_before", "signed_after"), KEY + ["side"]).join(self.unclear, KEY + ["tick"], "left")
        amb = truth(F.col("unclear"))
        lim = reasons((amb, "same_tick_intermediate_advantage_ambiguous"), (F.col("death_class").isin("teamkill", "suicide", "world"), "advantage_includes_all_first_death_effects_by_analytics_rule"))
        out = fact(q, "lost_man_advantage", F.when(amb, "partial").otherwise("available"), F.col("tick"), value=F.concat_ws(">", "signed_before", "signed_after"), events=F.array("event_id"), limits=lim)
        seen = self.stats.roster.select(*KEY)
        rest = self.teams.join(out.select(*KEY, "team_id"), KEY + ["team_id"], "left_anti")
        return union_all(out, absent(rest.join(seen, KEY, "left_semi"), "lost_man_advantage", "not_applicable", "no_observed_advantage_loss"),
                         absent(rest.join(seen, KEY, "left_anti"), "lost_man_advantage", "unavailable", "pinned_analytics_round_unavailable"))

    def untraded_deaths(self) -> DataFrame:
        seen = self.stats.roster.select(*KEY)
        traded = self.stats.trades.select(F.col("original_event_id").alias("event_id"))
        k = self.kills.join(traded, "event_id", "left_anti").join(seen, KEY, "left_semi").join(self.unclear, KEY + ["tick"], "left")
        q = k.select(*KEY, "round_number", F.col("vic.team_id").alias("team_id"), F.col("vic.side").alias("side"), "tick", "event_id", "attacker_player_id", "victim_player_id", "unclear")
        amb = truth(F.col("unclear"))
        out = fact(q, "untraded_death", F.when(amb, "partial").otherwise("available"), F.col("tick"), F.col("tick") + self.stats.cfg.trade_window_ticks, value=F.col("victim_player_id"),
                   players=F.array("attacker_player_id", "victim_player_id"), events=F.array("event_id"), limits=reasons((amb, "same_tick_trade_order_not_proven")))
        rest = self.teams.join(q.select(*KEY, "team_id"), KEY + ["team_id"], "left_anti")
        return union_all(out, absent(rest.join(seen, KEY, "left_semi"), "untraded_death", "not_applicable", "no_untraded_enemy_death_under_pinned_trade_rule"),
                         absent(rest.join(seen, KEY, "left_anti"), "untraded_death", "unavailable", "pinned_trade_semantics_unavailable"))

    def never_observed(self) -> DataFrame:
        return absent(self.teams.where("side = 'CT'"), "first_ct_rotation", "unavailable", "map_adjacency_and_site_role_semantics_not_available_v1").unionByName(
            absent(self.teams, "save_exit", "unavailable", "survival_does_not_prove_save_or_exit_intent_v1"))

    @cached_property
    def all(self) -> DataFrame:
        return shared_union(self.zone_distributions(), self.first_contact(), self.opening_duel(), self.first_utility(), self.early_zones(), self.bomb_route(), self.bombsite(), self.plant_timing(),
                            self.post_plant_roster(), self.retake_attempt(), self.lost_advantage(), self.untraded_deaths(), self.never_observed())


def with_buy_type(facts: DataFrame, economy_teams: DataFrame) -> DataFrame:
    return facts.join(economy_teams.select("match_id", "round_id", "team_id", "buy_type"), ["match_id", "round_id", "team_id"], "left")


def type_counts(facts: DataFrame) -> DataFrame:
    p = facts.groupBy("match_id", "feature_type").pivot("availability", ["available", "partial", "unavailable", "not_applicable"]).count().fillna(0)
    return p.withColumn("population", F.col("available") + F.col("partial") + F.col("unavailable") + F.col("not_applicable"))


def list_facts(facts: DataFrame, match_id=None, round_number=None, team_id=None, side=None, feature_type=None, availability=None) -> DataFrame:
    """Filtered facts in stable order; every filter is optional."""
    for name, v in (("match_id", match_id), ("round_number", round_number), ("team_id", team_id), ("side", side), ("feature_type", feature_type), ("availability", availability)):
        if v is not None:
            facts = facts.where(F.col(name) == v)
    return facts.orderBy("match_id", "round_number", "side", "feature_type", "tick_start", "zone_id")


def consistent_inputs(*layers: DataFrame) -> DataFrame:
    """Layers(match_id, fingerprint) must share one data set fingerprint per match."""
    return union_all(*layers).groupBy("match_id").agg(F.countDistinct("fingerprint").alias("fingerprints")).withColumn("consistent", F.col("fingerprints") == 1)


def round_story(facts: DataFrame, limit: int = 5) -> DataFrame:
    """Best fact per type, first type of each group that has one, in tick order."""
    order = {t: (g, i) for g, types in enumerate(STORY_GROUPS) for i, t in enumerate(types)}
    kind = F.create_map(*[F.lit(x) for t, (g, i) in order.items() for x in (t, g * 10 + i)])
    usable = facts.where(F.col("feature_type").isin(*order) & F.col("availability").isin("available", "partial"))
    key = F.concat_ws("|", "team_id", "feature_type", "zone_id", "value")
    row = F.struct((kind[F.col("feature_type")] % 10).alias("pref"), F.when(F.col("availability") == "available", 0).otherwise(1).alias("weak"), F.coalesce("tick_start", F.lit(2**31 - 1)).alias("tick"),
                   key.alias("key"), "feature_type", "team_id", "side", "availability", "tick_start", "zone_id", "value")
    best = usable.groupBy("match_id", "round_id", "round_number", F.floor(kind[F.col("feature_type")] / 10).alias("grp")).agg(F.min(row).alias("b"))
    n = F.row_number().over(Window.partitionBy("match_id", "round_id").orderBy("b.tick", "b.key"))
    return best.withColumn("position", n).where(F.col("position") <= limit).select("match_id", "round_id", "round_number", "position", "b.feature_type", "b.team_id", "b.side", "b.availability", "b.tick_start", "b.zone_id", "b.value")
