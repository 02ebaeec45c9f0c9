"""Time-line state: event stream, phases, life and bomb state, same-tick groups, state at a tick.

State is kept in a *state frame*: one row per round with the initial life of every
participant, the ordered first deaths and the bomb transitions.  All three lists are
bounded (roster size, and three bomb steps), so state at any tick is an equi join on
the round plus array look-ups, never a replay.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_if, flag, shared, truth, union_all

KEY = ["match_id", "round_id"]
# Fixed value: order of families at one tick.
PRIORITY = {"phase_boundary": 10, "damage": 20, "shot": 30, "grenade": 40, "bomb_planted": 50, "death": 60, "bomb_defused": 70,
            "bomb_exploded": 70, "bomb_other": 75, "round_end": 90, "official_end": 100}


def boundary_events(rounds: DataFrame) -> DataFrame:
    official = truth((F.col("official_end_tick") == F.col("end_tick")) & (F.col("end_source") == "round_officially_ended")) if "end_source" in rounds.columns else F.lit(False)
    fallback = truth(F.col("end_source").startswith("fallback:")) if "end_source" in rounds.columns else F.lit(False)
    end_kind = F.when(fallback, "fallback_end").when(official, "official_end").otherwise("round_end")
    items = F.array(
        F.struct(F.col("start_tick").alias("tick"), F.lit("round_start").alias("label"), F.lit("phase_boundary").alias("kind"), F.lit(10).alias("priority")),
        F.struct(F.col("freeze_end_tick").alias("tick"), F.lit("freeze_end").alias("label"), F.lit("phase_boundary").alias("kind"), F.lit(10).alias("priority")),
        F.struct(F.col("end_tick").alias("tick"), end_kind.alias("label"), end_kind.alias("kind"), F.when(end_kind == "official_end", 100).otherwise(90).alias("priority")),
        F.struct(F.when(~F.coalesce(F.col("official_end_tick") == F.col("end_tick"), F.lit(False)), F.col("official_end_tick")).alias("tick"),
                 F.lit("official_end").alias("label"), F.lit("official_end").alias("kind"), F.lit(100).alias("priority")))
    b = rounds.select(*KEY, "round_number", F.inline(items)).where("tick IS NOT NULL")
    return b.select(*KEY, "round_number", "tick", "kind", F.col("label").alias("event_type"), "priority", F.lit(None).cast("bigint").alias("event_id"),
                    F.lit(None).cast("string").alias("actor_player_id"), F.lit(None).cast("string").alias("victim_player_id"), F.lit(True).alias("state_affecting"))


def timeline_events(t) -> DataFrame:
    """Union of all families and synthetic boundaries of the non-warm-up rounds."""
    rounds = t.rounds.where("NOT is_warmup")

    def family(df, kind, event_type, priority, actor, victim, state):
        return df.where("round_id IS NOT NULL").select(*KEY, "round_number", "tick", F.lit(kind).alias("kind"), event_type.alias("event_type"), priority.cast("int").alias("priority"),
                                                       "event_id", actor.alias("actor_player_id"), victim.alias("victim_player_id"), state.alias("state_affecting"))

    none, yes, no = F.lit(None).cast("string"), F.lit(True), F.lit(False)
    bomb = F.col("event_type")
    bp = F.when(bomb == "planted", 50).when(bomb.isin("defused", "exploded"), 70).otherwise(75)
    known = bomb.isin("planted", "defused", "exploded")
    ev = union_all(
        family(t.kills, "death", F.lit("death"), F.lit(60), F.col("attacker_player_id"), F.col("victim_player_id"), yes),
        family(t.damages, "damage", F.lit("damage"), F.lit(20), F.col("attacker_player_id"), F.col("victim_player_id"), no),
        family(t.shots, "shot", F.lit("shot"), F.lit(30), F.col("player_id"), none, no),
        family(t.grenades, "grenade", F.concat(F.lit("grenade:"), "lifecycle_event"), F.lit(40), F.col("player_id"), none, no),
        family(t.bombs, "bomb", F.concat(F.lit("bomb:"), bomb), bp, F.col("player_id"), none, known))
    bounds = rounds.select(*KEY, "start_tick", F.coalesce("official_end_tick", "end_tick").alias("_end"))
    out = union_all(ev, boundary_events(rounds)).join(bounds, KEY)
    late = truth(F.col("tick") < F.col("start_tick")) | truth(F.col("tick") > F.col("_end"))
    return out.withColumn("ordering_status", F.when(late, "out_of_range").otherwise("ordered")).drop("start_tick", "_end")


def phase_intervals(rounds: DataFrame) -> DataFrame:
    """Half-open phases of every round."""
    live_end, last = F.coalesce("end_tick", "official_end_tick"), F.coalesce("official_end_tick", "end_tick")
    frozen = F.col("freeze_end_tick").isNotNull()

    def item(when, phase, start, end, status):
        return F.when(when, F.struct(F.lit(phase).alias("phase"), start.alias("start_tick"), end.alias("end_tick"), status.alias("status")))

    ok, part, no_end = F.lit("available"), F.lit("partial"), F.lit(None).cast("int")
    inferred = F.when(truth(F.col("end_source").startswith("fallback:")), "inferred_authoritatively").otherwise("available") if "end_source" in rounds.columns else ok
    items = F.array_compact(F.array(
        item(~frozen, "unknown", F.col("start_tick"), last, part), item(frozen, "freeze_time", F.col("start_tick"), F.col("freeze_end_tick"), ok),
        item(frozen, "live", F.col("freeze_end_tick"), live_end, F.when(live_end.isNotNull(), ok).otherwise(part)),
        item(truth(F.col("official_end_tick") > F.col("end_tick")), "post_round", F.col("end_tick"), F.col("official_end_tick"), ok),
        item(last.isNotNull(), "ended", last, no_end, inferred)))
    r = rounds.where("start_tick IS NOT NULL")
    return r.select(*KEY, "round_number", F.inline(items))


def phase_at(requests: DataFrame, rounds: DataFrame) -> DataFrame:
    """Phase of every requested (round, tick)."""
    p = phase_intervals(rounds).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start_tick", "end_tick", "phase"))).alias("_p"))
    q = requests.join(p, KEY, "left")
    hit = F.expr("try_element_at(filter(_p, p -> tick >= p.start_tick AND (p.end_tick IS NULL OR tick < p.end_tick)), 1).phase")
    return q.withColumn("phase", F.when(F.col("tick") < F.col("_p")[0]["start_tick"], "prestart").otherwise(F.coalesce(hit, F.lit("unknown")))).drop("_p")


def tick_seconds(tick: Column, rate: float | None) -> Column:
    return (tick / F.lit(rate)) if rate else F.lit(None).cast("double")


class Timeline:
    """Time-line datasets of all rounds.  ``participants`` comes from participation_status."""

    def __init__(self, tables, participants: DataFrame, tick_rate: float | None = None):
        self.t, self.participants, self.rate = tables, shared(participants), tick_rate
        self.rounds = shared(tables.rounds.where("NOT is_warmup"))

    @cached_property
    def events(self) -> DataFrame:
        return timeline_events(self.t)

    @cached_property
    def roster(self) -> DataFrame:
        item = F.struct("player_id", F.struct("team_id", "side", F.col("initial_life").alias("life")))
        g = self.participants.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(item)).alias("people"))
        r = self.rounds.join(g, KEY, "left")
        return r.withColumn("last_tick", F.coalesce("official_end_tick", "end_tick"))

    @cached_property
    def deaths(self) -> DataFrame:
        """Every in-range death with victim, its first-death flag and state before."""
        e = self.events.where("kind = 'death' AND victim_player_id IS NOT NULL AND ordering_status <> 'out_of_range'")
        return e.join(self.roster.select(*KEY, "people", "freeze_end_tick"), KEY)

    @cached_property
    def first_deaths(self) -> DataFrame:
        return shared(self.deaths.groupBy(*KEY, "victim_player_id").agg(F.min(F.struct("tick", "event_id")).alias("first")))

    @cached_property
    def life(self) -> DataFrame:
        """Life transitions."""
        d = self.deaths.join(self.first_deaths, KEY + ["victim_player_id"])
        initial = F.coalesce(F.col("people")[F.col("victim_player_id")]["life"], F.lit("unknown"))
        repeated = F.col("event_id") != F.col("first.event_id")
        before = F.when(repeated, "dead").otherwise(initial)
        k = self.t.kills.select("event_id", "attacker_player_id", "attacker_team_id", "victim_team_id", "is_suicide", "is_teamkill", F.col("victim_player_id").alias("_v"))
        d = d.join(k, "event_id")
        cls = (F.when(truth(F.col("is_suicide")) | truth(F.col("attacker_player_id") == F.col("_v")), "suicide").when(F.col("attacker_player_id").isNull(), "world")
               .when(truth(F.col("is_teamkill")) | truth(F.col("attacker_team_id") == F.col("victim_team_id")), "teamkill")
               .when(truth(F.col("attacker_team_id") != F.col("victim_team_id")), "enemy").otherwise("unknown"))
        early = F.col("freeze_end_tick").isNull() | (F.col("tick") < F.col("freeze_end_tick"))
        status = F.when(repeated | (initial != "alive") | early, "partial").otherwise("available")
        return d.select(*KEY, "round_number", "tick", "event_id", F.col("victim_player_id").alias("player_id"), before.alias("life_before"), F.lit("dead").alias("life_after"),
                        F.when(repeated, "repeated").otherwise(cls).alias("death_class"), status.alias("status"))

    @cached_property
    def bomb_steps(self) -> DataFrame:
        """Bomb transitions from events.

        The machine only leaves ``unresolved`` never again, and a resolved state needs a plant
        followed by one terminal event, so the position in the round and the first two event
        types decide every state.
        """
        e = self.events.where("kind = 'bomb' AND state_affecting AND ordering_status <> 'out_of_range'").withColumn("type", F.regexp_replace("event_type", "^bomb:", ""))
        w = Window.partitionBy(*KEY).orderBy("tick", "priority", "event_id")
        e = e.withColumn("n", F.row_number().over(w)).withColumn("prev", F.lag("type").over(w)).withColumn("prev_n", F.lag("type", 2).over(w))
        s1 = F.when(F.col("type") == "planted", "planted").otherwise("unresolved")
        s2 = F.when((F.col("prev") == "planted") & (F.col("type") != "planted"), F.col("type")).otherwise("unresolved")
        after = F.when(F.col("n") == 1, s1).when(F.col("n") == 2, s2).otherwise("unresolved")
        b2 = F.when(F.col("prev") == "planted", "planted").otherwise("unresolved")
        b3 = F.when((F.col("prev_n") == "planted") & (F.col("prev") != "planted"), F.col("prev")).otherwise("unresolved")
        before = F.when(F.col("n") == 1, "unavailable").when(F.col("n") == 2, b2).when(F.col("n") == 3, b3).otherwise("unresolved")
        return shared(e.select(*KEY, "round_number", "tick", "event_id", "priority", before.alias("bomb_before"), after.alias("bomb_after"),
                               F.when(after == "unresolved", "unresolved").otherwise("available").alias("status"), F.col("n").alias("step")))

    @cached_property
    def bomb(self) -> DataFrame:
        """Event transitions plus the end of a round that closes over a planted bomb."""
        last = self.bomb_steps.groupBy(*KEY, "round_number").agg(F.max_by("bomb_after", "step").alias("final"), F.max("step").alias("step"))
        end = last.where("final = 'planted'").join(self.rounds.select(*KEY, F.coalesce("official_end_tick", "end_tick").alias("tick")), KEY).where("tick IS NOT NULL")
        end = end.select(*KEY, "round_number", "tick", F.lit(None).cast("bigint").alias("event_id"), F.lit("planted").alias("bomb_before"),
                         F.lit("round_ended_before_resolution").alias("bomb_after"), F.lit("partial").alias("status"), (F.col("step") + 1).alias("step"))
        return self.bomb_steps.drop("priority").unionByName(end)

    @cached_property
    def groups(self) -> DataFrame:
        """Ticks with two or more state events and what is known about their order."""
        e = self.events.where("state_affecting AND ordering_status <> 'out_of_range'")
        e = e.join(self.first_deaths.withColumnRenamed("victim_player_id", "victim"), (e.match_id == self.first_deaths.match_id) & (e.round_id == self.first_deaths.round_id) & (e.victim_player_id == F.col("victim")), "left").select(e["*"], "first")
        e = e.join(self.roster.select(*KEY, "people"), KEY)
        life = F.coalesce(F.col("people")[F.col("victim_player_id")]["life"], F.lit("unknown"))
        death, bomb = F.col("kind") == "death", F.col("kind") == "bomb"
        dead_before = F.col("victim_player_id").isNotNull() & (truth(F.col("first.tick") < F.col("tick")) | (life != "alive"))
        ends = F.col("kind").isin("round_end", "official_end", "fallback_end")
        g = e.groupBy(*KEY, "round_number", "tick").agg(
            F.count("*").alias("event_count"), count_if(death).alias("deaths"), count_if(bomb).alias("bombs"), count_if(ends).alias("ends"),
            count_if(ends | (F.col("kind") == "phase_boundary")).alias("bounds"), count_if(death & F.col("victim_player_id").isNull()).alias("no_victim"),
            count_if(death & F.col("victim_player_id").isNotNull()).alias("victims"), F.countDistinct(F.when(death, F.col("victim_player_id"))).alias("distinct_victims"),
            F.bool_or(death & dead_before).alias("bad_pre"), count_if(F.col("event_type") == "bomb:planted").alias("planted"),
            count_if(F.col("event_type") == "bomb:defused").alias("defused"), count_if(F.col("event_type") == "bomb:exploded").alias("exploded")).where("event_count >= 2")
        c = F.col
        clash = truth(c("bad_pre")) | (c("victims") != c("distinct_victims"))
        mixed = (c("deaths") + c("bombs") > 0) & (c("bounds") > 0)
        reason = (F.when(clash, "duplicate_or_previously_dead_victim").when((c("defused") > 0) & (c("exploded") > 0), "incompatible_terminal_bomb_events")
                  .when((c("planted") > 0) & (c("defused") > 0), "plant_defuse_order_not_proven").when(c("bombs") > 1, "multiple_non_commutative_bomb_events")
                  .when(c("no_victim") > 0, "death_effect_unavailable").when(c("deaths") > 1, "commutative_deaths_unknown_order")
                  .when((c("deaths") > 0) & (c("bombs") > 0), "independent_life_and_bomb_effects_unknown_order")
                  .when((c("bombs") > 0) & (c("ends") > 0), "bomb_resolution_and_round_boundary_same_tick").when(mixed, "state_effect_and_boundary_order_not_proven"))
        g = g.withColumn("reason", reason)
        conflict = c("reason").isin("duplicate_or_previously_dead_victim", "incompatible_terminal_bomb_events", "multiple_non_commutative_bomb_events")
        big = c("event_count") > 8
        g = g.withColumn("order_status", F.when(truth(conflict), "conflicting").when(c("reason").isNotNull(), "ambiguous_order").when(c("bounds") == c("event_count"), "definitively_ordered").otherwise("canonically_grouped"))
        g = g.withColumn("intermediate_status", F.when(c("reason").isNull(), "deterministic").when((c("reason") == "death_effect_unavailable") | big, "unavailable").otherwise("ambiguous"))
        g = g.withColumn("final_status", F.when(truth(conflict), "conflicting").when(c("reason") == "plant_defuse_order_not_proven", "ambiguous").otherwise("deterministic"))
        return shared(g.select(*KEY, "round_number", "tick", "event_count", "deaths", "bombs", "order_status", "intermediate_status", "final_status", "reason"))

    @cached_property
    def bomb_localized(self) -> DataFrame:
        """Final bomb state; an undecided same-tick bomb group makes it unresolved."""
        last = self.bomb.groupBy(*KEY).agg(F.max_by("bomb_after", "step").alias("state"))
        bad = self.groups.where("bombs > 0 AND final_status IN ('ambiguous', 'conflicting')").groupBy(*KEY).agg(F.min("tick").alias("conflict_tick"))
        r = self.rounds.select(*KEY, "round_number").join(last, KEY, "left").join(bad, KEY, "left")
        state = F.coalesce("state", F.lit("unavailable"))
        return r.select(*KEY, "round_number", F.when(F.col("conflict_tick").isNotNull(), "unresolved").otherwise(state).alias("final_bomb_state"),
                        F.when(state != "unresolved", F.col("conflict_tick")).alias("conflict_tick"))

    @cached_property
    def frame(self) -> DataFrame:
        d = self.first_deaths.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first.tick", "first.event_id", F.col("victim_player_id").alias("victim")))).alias("dead"))
        b = self.bomb.where("step <= 3 OR event_id IS NULL").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("tick", "step", "event_id", "bomb_after"))).alias("bomb_at"))
        bad = self.groups.where("final_status <> 'deterministic'").groupBy(*KEY).agg(F.min("tick").alias("undecided"))
        loc = self.bomb_localized.where("conflict_tick IS NOT NULL").select(*KEY, "conflict_tick")
        people = F.expr("map_filter(people, (k, v) -> v.life <> 'not_participating')")
        f = self.roster.select(*KEY, "round_number", "start_tick", "freeze_end_tick", "end_tick", "official_end_tick", "last_tick", people.alias("people"))
        return shared(f.join(d, KEY, "left").join(b, KEY, "left").join(bad, KEY, "left").join(loc, KEY, "left"))

    def state_at(self, requests: DataFrame, strict: bool = False) -> DataFrame:
        """State at the requested (round, tick); ``strict`` leaves out events of the tick itself."""
        op = "<" if strict else "<="
        q = requests.join(self.frame.drop("round_number"), KEY).where("tick >= start_tick AND (last_tick IS NULL OR tick <= last_tick)")
        q = q.withColumn("_dead", F.coalesce(F.expr(f"transform(filter(dead, d -> d.tick {op} tick), d -> d.victim)"), F.expr("CAST(array() AS array<string>)")))
        living = "map_filter(people, (k, v) -> v.life = 'alive' AND NOT array_contains(_dead, k))"
        q = q.withColumn("alive_players", F.sort_array(F.map_keys(F.expr(living))))
        for side, name in (("T", "t_alive"), ("CT", "ct_alive")):
            q = q.withColumn(name, F.size(F.expr(f"filter(alive_players, p -> people[p].side = '{side}')")).cast("long"))
        q = q.withColumn("dead_count", F.size(F.expr("map_filter(people, (k, v) -> array_contains(_dead, k))")).cast("long"))
        q = q.withColumn("unknown_count", F.size(F.expr("map_filter(people, (k, v) -> v.life = 'unknown' AND NOT array_contains(_dead, k))")).cast("long"))
        seen = F.expr(f"try_element_at(filter(bomb_at, b -> b.tick {op} tick AND b.event_id IS NOT NULL), -1).bomb_after")
        ended = F.expr("try_element_at(filter(bomb_at, b -> b.tick <= tick AND b.event_id IS NULL), -1).bomb_after")
        bomb = F.when(F.col("conflict_tick") <= F.col("tick"), "unresolved").otherwise(F.coalesce(ended, seen, F.lit("unavailable")))
        status = F.when(F.lit(not strict) & truth(F.col("undecided") <= F.col("tick")), "unavailable").otherwise("available")
        t = F.col("tick")
        phase = (F.when(t < F.coalesce("freeze_end_tick", "last_tick"), F.when(F.col("freeze_end_tick").isNull(), "unknown").otherwise("freeze_time"))
                 .when(t < F.coalesce("end_tick", "official_end_tick"), "live").when(t < F.col("official_end_tick"), "post_round").otherwise("ended"))
        return q.withColumn("bomb_state", bomb).withColumn("state_status", status).withColumn("phase", phase).select(
            *requests.columns, "alive_players", "t_alive", "ct_alive", "dead_count", "unknown_count", "bomb_state", "state_status", "phase")

    @cached_property
    def milestones(self) -> DataFrame:
        items = F.array(*[F.struct(F.lit(n).alias("label"), F.col(c).alias("tick")) for n, c in (("round_start", "start_tick"), ("freeze_end", "freeze_end_tick"), ("final", "last_tick"))])
        return self.state_at(self.roster.select(*KEY, "round_number", F.inline(items)).where("tick IS NOT NULL"))

    @cached_property
    def possible_states(self) -> DataFrame:
        """Distinct states an undecided tick may pass through, one event applied at a time."""
        g = self.groups.where("intermediate_status = 'ambiguous'").select(*KEY, "round_number", "tick")
        pre = self.state_at(g, strict=True)
        e = self.events.where("state_affecting AND ordering_status <> 'out_of_range'").select(*KEY, "tick", "kind", "event_id", "victim_player_id")
        b = self.bomb_steps.select("event_id", "bomb_after")
        x = pre.join(e, KEY + ["tick"]).join(b, "event_id", "left").join(self.roster.select(*KEY, "people"), KEY)
        hit = F.expr("kind = 'death' AND array_contains(alive_players, victim_player_id)")
        side = F.col("people")[F.col("victim_player_id")]["side"]
        return x.select(*KEY, "round_number", "tick", F.when(hit, F.col("victim_player_id")).alias("removed_player"), (F.col("t_alive") - flag(hit & (side == "T"))).alias("t_alive"),
                        (F.col("ct_alive") - flag(hit & (side == "CT"))).alias("ct_alive"), F.coalesce("bomb_after", "bomb_state").alias("bomb_state")).distinct()

    @cached_property
    def log(self) -> DataFrame:
        """All transitions as one stream."""
        none = F.lit(None).cast("string")

        def rows(df, kind, before, after, subject=none, event=F.lit(None).cast("bigint"), status=F.lit("available")):
            return df.select(*KEY, "round_number", "tick", kind.alias("transition_type"), before.alias("before_state"), after.alias("after_state"), subject.alias("player_id"), event.alias("event_id"), status.alias("status"))

        w = Window.partitionBy(*KEY).orderBy("start_tick")
        ph = phase_intervals(self.rounds).withColumn("prev", F.coalesce(F.lag("phase").over(w), F.lit("prestart"))).withColumnRenamed("start_tick", "tick").drop("status")
        seen = self.participants.where("participation_status = 'event_observed'").withColumnRenamed("first_seen_tick", "tick")
        kind = F.when(F.col("bomb_after").isin("planted", "defused", "exploded"), F.concat(F.lit("bomb_"), "bomb_after")).when(F.col("bomb_after") == "round_ended_before_resolution", "round_ended").otherwise("ambiguity_detected")
        ends = self.roster.where("last_tick IS NOT NULL").withColumnRenamed("last_tick", "tick")
        lit = F.lit
        return union_all(
            rows(ph, lit("phase_changed"), F.col("prev"), F.col("phase")),
            rows(seen, lit("participant_observed"), lit("not_participating"), F.col("participation_status"), F.col("player_id"), status=lit("partial")),
            rows(self.life, lit("player_died"), F.col("life_before"), F.col("life_after"), F.col("player_id"), F.col("event_id"), F.col("status")),
            rows(self.bomb, kind, F.col("bomb_before"), F.col("bomb_after"), none, F.col("event_id"), F.col("status")),
            rows(self.groups, lit("ambiguity_detected"), none, none, status=lit("unresolved")),
            rows(ends, lit("round_ended"), lit("active"), lit("ended")))

    @cached_property
    def capability(self) -> DataFrame:
        """Population, covered and status per round and metric."""
        p = self.participants.where("participation_status <> 'not_participating'").groupBy(*KEY).agg(
            F.count("*").alias("people_n"), count_if((F.col("participation_status") != "unresolved") & F.col("team_id").isNotNull() & F.col("side").isin("T", "CT")).alias("placed"),
            count_if(F.col("participation_status") == "unresolved").alias("unresolved_n"), count_if(F.col("initial_life") == "alive").alias("alive_n"))
        g = self.groups.groupBy(*KEY).agg(
            F.count("*").alias("groups_n"), count_if(F.col("final_status") == "deterministic").alias("groups_ok"), count_if(F.col("intermediate_status") == "deterministic").alias("mid_ok"),
            F.sum(F.when(F.col("intermediate_status") != "deterministic", F.col("event_count")).otherwise(0)).alias("mid_events"),
            F.bool_or((F.col("final_status") != "deterministic") & (F.col("deaths") > 0)).alias("life_undecided"))
        e = self.events.groupBy(*KEY).agg(F.count("*").alias("events_n"), F.bool_or(F.col("ordering_status") == "out_of_range").alias("out"),
                                          count_if((F.col("kind") == "death") & F.col("victim_player_id").isNull() & (F.col("ordering_status") != "out_of_range")).alias("no_victim"))
        lf = self.life.groupBy(*KEY).agg(F.bool_or(F.col("status") != "available").alias("life_partial"))
        b = self.bomb.groupBy(*KEY).agg(F.lit(True).alias("has_bomb"), F.bool_or(F.col("bomb_after") == "unresolved").alias("bomb_open"))
        loc = self.bomb_localized.select(*KEY, (F.col("conflict_tick").isNotNull()).alias("bomb_conflict"))
        r = self.roster
        for x in (p, g, e, lf, b, loc):
            r = r.join(x, KEY, "left")
        c = F.col
        z = lambda n: F.coalesce(n, F.lit(0)).cast("long")
        wrong = truth(c("start_tick") > c("freeze_end_tick")) | truth(c("freeze_end_tick") > c("last_tick")) | truth(c("end_tick") > c("official_end_tick"))
        bound = c("start_tick").isNotNull() & c("last_tick").isNotNull()
        people, groups_n = z("people_n"), z("groups_n")
        open_groups = groups_n > z("groups_ok")
        bomb_open = truth(c("bomb_open")) | truth(c("bomb_conflict"))
        one, many = F.lit(1).cast("long"), lambda n: F.greatest(F.lit(1).cast("long"), n)
        yes, no, none = F.lit(True), F.lit(False), F.lit(0).cast("long")
        rows = [  # metric, population, covered, unresolved, has reasons
            ("tick_timeline", one, flag(bound), wrong, ~bound | ~c("is_complete") | wrong | truth(c("out"))),
            ("seconds_timeline", one, one if self.rate else none, no, F.lit(self.rate is None)),
            ("phase_timeline", one, flag(bound & c("freeze_end_tick").isNotNull()), wrong, wrong | ~(bound & c("freeze_end_tick").isNotNull())),
            ("participant_state", many(people), z("placed"), z("unresolved_n") > 0, (z("placed") < people) | (people == 0)),
            ("alive_state", many(people), z("alive_n"), truth(c("life_undecided")), (z("alive_n") < people) | (people == 0) | truth(c("life_partial")) | truth(c("out")) | truth(c("life_undecided")) | (z("no_victim") > 0)),
            ("tick_group_state", many(groups_n), F.when(groups_n == 0, one).otherwise(z("groups_ok")), open_groups, open_groups),
            ("per_event_state", many(z("events_n")), F.greatest(none, z("events_n") - z("mid_events")), no, groups_n > z("mid_ok")),
            ("intermediate_ordering", many(groups_n), F.when(groups_n == 0, one).otherwise(z("mid_ok")), no, groups_n > z("mid_ok")),
            ("bomb_state", one, flag(truth(c("has_bomb")) | truth(c("bomb_conflict"))), bomb_open, yes),
            ("final_state", one, flag(bound & (people > 0)), (z("unresolved_n") > 0) | open_groups | bomb_open | wrong,
             ~bound | ~c("is_complete") | wrong | truth(c("out")) | (people == 0) | (z("unresolved_n") > 0) | open_groups | bomb_open)]
        tall = r.select(*KEY, "round_number", F.inline(F.array(*[
            F.struct(F.lit(n).alias("metric"), pop.cast("long").alias("population"), cov.cast("long").alias("covered"), un.alias("unresolved"), rs.alias("has_reason")) for n, pop, cov, un, rs in rows])))
        return tall.withColumn("status", capability_status(F.col("population"), F.col("covered"), F.col("unresolved"), F.col("has_reason")))

    @cached_property
    def match_capability(self) -> DataFrame:
        g = self.capability.groupBy("match_id", "metric").agg(F.sum("population").alias("population"), F.sum("covered").alias("covered"),
                                                              F.bool_or(F.col("status") == "unresolved").alias("u"), F.bool_or(F.col("has_reason") & (F.col("status") != "available")).alias("r"))
        return g.select("match_id", "metric", "population", "covered", capability_status(F.col("population"), F.col("covered"), F.col("u"), F.col("r")).alias("status"))

    def checks(self, openings: DataFrame, transitions: DataFrame) -> DataFrame:
        """Time-line warnings and the cross-check against the statistics stream."""
        from .checks import issues

        ev, out = self.events, []

        def add(df, code):
            out.append(issues(df.select("match_id", "round_id").distinct(), code, "round", F.col("round_id")))

        add(ev.where("event_id IS NOT NULL").groupBy(*KEY, "event_id", "kind").count().where("count > 1"), "duplicate_temporal_event_id")
        add(phase_intervals(self.rounds).where("end_tick < start_tick"), "invalid_phase_interval")
        add(self.roster.where("freeze_end_tick > last_tick"), "live_start_after_effective_end")
        add(ev.where("ordering_status = 'out_of_range'"), "out_of_range_temporal_events")
        add(ev.where("kind = 'death' AND victim_player_id IS NULL"), "death_without_victim")
        known = self.participants.select(*KEY, F.col("player_id").alias("victim_player_id"))
        add(ev.where("kind = 'death' AND victim_player_id IS NOT NULL").join(known, KEY + ["victim_player_id"], "left_anti"), "death_victim_missing_from_participants")
        add(self.life.join(self.rounds.select(*KEY, "freeze_end_tick"), KEY).where("tick < freeze_end_tick"), "death_before_live_start")
        add(self.life.where("death_class = 'repeated'"), "duplicate_death_without_respawn")
        add(self.participants.where("participation_status = 'unresolved'"), "participant_identity_conflict")
        add(self.bomb_localized.where("conflict_tick IS NOT NULL").select(*KEY).union(self.bomb.where("bomb_after = 'unresolved'").select(*KEY)), "bomb_state_conflict")
        live = self.t.kills.where("phase = 'live'").select("event_id")
        enemy = self.life.join(live, "event_id", "left_semi").where("death_class = 'enemy'").groupBy(*KEY).agg(F.min(F.struct("tick", "event_id")).alias("f"))
        pair = openings.select(*KEY, F.col("event_id").alias("o")).join(enemy, KEY, "full").where("NOT (o <=> f.event_id)")
        elig = self.rounds.where("is_complete").select(*KEY)
        add(pair.join(elig, KEY, "left_semi"), "opening_mismatch")
        ours = self.life.join(live, "event_id", "left_semi").join(elig, KEY, "left_semi").select(*KEY, "event_id", F.lit(1).alias("a"))
        theirs = transitions.select(*KEY, "event_id", F.lit(1).alias("b"))
        add(ours.join(theirs, KEY + ["event_id"], "full").where("a IS NULL OR b IS NULL"), "advantage_death_stream_mismatch")
        post = transitions.groupBy(*KEY, "tick").agg(F.min("t_alive_after").alias("ta"), F.min("ct_alive_after").alias("ca"))
        st = self.state_at(post)
        add(st.where("state_status = 'available' AND unknown_count = 0 AND (t_alive <> ta OR ct_alive <> ca)"), "advantage_post_tick_mismatch")
        return union_all(*out)


def capability_status(population: Column, covered: Column, unresolved: Column, has_reason: Column) -> Column:
    return (F.when(population == 0, "unavailable").when(unresolved, "unresolved").when((covered == population) & ~has_reason, "available")
            .when(covered > 0, "partial").otherwise("unavailable"))
