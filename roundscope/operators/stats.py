"""Per-round gameplay statistics.

Facts of a round are looked up in a *round frame*: one row per eligible round with
the roster map and the ordered first deaths.  A frame is bounded by the roster, so
event tables only take part in an equi join on the round (which adaptive execution
can split) and in aggregates with map-side combine.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import StatsConfig
from ..functions.common import ROUND, count_if, flag, percentage, ratio, shared, truth, union_all

KEY = ["match_id", "round_id"]
PLAYER_COUNTERS = [
    "kills", "headshots", "deaths", "enemy_deaths", "assists", "damage", "enemy_damage", "team_damage", "shots",
    "traded_kills", "traded_deaths", "trade_opportunities", "opening_kill", "opening_death", "teamkills",
    "suicides", "plants", "defuses",
]


def eligible_rounds(rounds: DataFrame) -> DataFrame:
    return rounds.where(truth(F.col("is_complete")) & ~truth(F.col("is_warmup")))


def participants(rounds: DataFrame, memberships: DataFrame) -> DataFrame:
    """Players whose membership overlaps the round; a player seen in two teams is dropped."""
    w = Window.partitionBy("match_id").orderBy("round_number", "round_id")
    end = F.coalesce("official_end_tick", "end_tick", "freeze_end_tick", "start_tick")
    r = (eligible_rounds(rounds).withColumn("next_start", F.lead("start_tick").over(w))
         .withColumn("last_tick", F.when(end > F.col("start_tick"), end).otherwise(F.coalesce(F.col("next_start") - 1, end)))
         .where("start_tick IS NOT NULL"))
    m = memberships.where("team_id IS NOT NULL").select("match_id", "player_id", "team_id", "valid_from_tick", "valid_to_tick")
    hit = r.join(m, "match_id").where(
        "team_id IN (t_team_id, ct_team_id) AND valid_from_tick <= last_tick "
        "AND (valid_to_tick IS NULL OR valid_to_tick >= start_tick)")
    hit = hit.withColumn("side", F.when(F.col("team_id") == F.col("t_team_id"), "T").otherwise("CT"))
    return (hit.groupBy(*ROUND, "player_id")
            .agg(F.min("team_id").alias("team_id"), F.max("team_id").alias("_other"), F.min("side").alias("side"))
            .where("team_id = _other").drop("_other"))


def roster_frame(rounds: DataFrame, members: DataFrame) -> DataFrame:
    """One row per eligible round with the roster as a map and lineup counts."""
    roster = members.groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("player_id", F.struct("team_id", "side")))).alias("roster"),
        count_if(F.col("side") == "T").alias("n_t"), count_if(F.col("side") == "CT").alias("n_ct"))
    base = eligible_rounds(rounds).join(roster, KEY, "left")
    zero = F.lit(0).cast("long")
    base = base.withColumn("n_t", F.coalesce("n_t", zero)).withColumn("n_ct", F.coalesce("n_ct", zero))
    winner = (F.when(F.col("outcome_status") == "available",
                     F.when(F.col("winner_side") == "T", F.col("t_team_id")).when(F.col("winner_side") == "CT", F.col("ct_team_id"))))
    return base.withColumn("winner_team_id", winner).withColumn(
        "lineup_valid", truth((F.col("t_team_id") != F.col("ct_team_id")) & (F.col("n_t") > 0) & (F.col("n_t") == F.col("n_ct"))))


def classify_kills(kills: DataFrame, frame: DataFrame, live_only: bool = True) -> DataFrame:
    """Kills of the framed rounds with their class; roster facts come from one join per round."""
    looked = frame.select(*KEY, "roster")
    k = (kills.where("phase = 'live'") if live_only else kills).join(looked, KEY)
    k = k.withColumn("att", F.col("roster")[F.col("attacker_player_id")]).withColumn("vic", F.col("roster")[F.col("victim_player_id")])
    k = k.withColumn("asi", F.col("roster")[F.col("assister_player_id")])
    a, v = F.col("attacker_team_id"), F.col("victim_team_id")
    cls = (F.when(F.col("vic").isNull(), "invalid")
           .when(truth(F.col("is_suicide")) | truth(F.col("attacker_player_id") == F.col("victim_player_id")), "suicide")
           .when(F.col("att").isNull(), "world")
           .when(truth(F.col("is_teamkill")) | (F.col("att.team_id") == F.col("vic.team_id")), "teamkill")
           .when(a.isNull() | v.isNull() | (a != F.col("att.team_id")) | (v != F.col("vic.team_id")) | (a == v), "invalid")
           .otherwise("enemy"))
    return k.withColumn("kill_class", cls).drop("roster")


def _deaths(classified: DataFrame) -> DataFrame:
    """Per round: ordered first deaths (bounded by the roster) and the opening kill."""
    death = F.struct(
        "tick", "event_id", F.col("victim_player_id").alias("victim"), F.col("vic.side").alias("victim_side"),
        F.col("vic.team_id").alias("victim_team"), F.col("attacker_player_id").alias("attacker"),
        F.col("att.team_id").alias("attacker_team"), F.col("att.side").alias("attacker_side"), F.col("kill_class"),
        "relative_tick", (F.col("kill_class") == "enemy").alias("valid"))
    per_victim = (classified.where("vic IS NOT NULL").groupBy(*KEY, "victim_player_id")
                  .agg(F.min(death).alias("death"), F.min(F.when(F.col("kill_class") == "enemy", death)).alias("enemy_kill")))
    return per_victim.groupBy(*KEY).agg(
        F.sort_array(F.collect_list("death")).alias("deaths"), F.min("enemy_kill").alias("opening"))


_BEFORE = "(a.tick < b.tick OR (a.tick = b.tick AND a.event_id < b.event_id))"


def _signed(frame: DataFrame) -> DataFrame:
    """Adds the running alive difference after every first death and what follows from it."""
    empty = F.expr("CAST(array() AS array<bigint>)")
    f = frame.withColumn("deaths", F.coalesce("deaths", F.expr("slice(array(opening), 1, 0)")))
    for side, n in (("T", "n_t"), ("CT", "n_ct")):
        f = f.withColumn(f"{n}_after", F.expr(
            f"transform(deaths, (d, i) -> {n} - size(filter(slice(deaths, 1, i + 1), x -> x.victim_side = '{side}')))"))
    f = f.withColumn("signed", F.when(F.size("deaths") > 0, F.expr("zip_with(n_t_after, n_ct_after, (x, y) -> x - y)")).otherwise(empty))
    f = f.withColumn("lead_at", F.expr("array_position(transform(signed, s -> s <> 0), true)"))
    f = f.withColumn("lead", F.when(F.col("lineup_valid") & (F.col("lead_at") > 0), F.expr("element_at(signed, int(nullif(lead_at, 0)))")))
    f = f.withColumn("lead_lost", truth(F.expr(
        "exists(slice(signed, int(lead_at) + 1, size(signed)), s -> signum(s) <> signum(lead))")))
    return (f.withColumn("lead_team", F.when(F.col("lead") > 0, F.col("t_team_id")).when(F.col("lead") < 0, F.col("ct_team_id")))
            .withColumn("max_t", F.when(F.col("lineup_valid"), F.coalesce(F.expr("greatest(array_max(signed), 0)"), F.lit(0))).otherwise(0).cast("long"))
            .withColumn("max_ct", F.when(F.col("lineup_valid"), F.coalesce(F.expr("greatest(-array_min(signed), 0)"), F.lit(0))).otherwise(0).cast("long"))
            .withColumn("final_t", F.coalesce(F.expr("try_element_at(n_t_after, -1)"), F.col("n_t")))
            .withColumn("final_ct", F.coalesce(F.expr("try_element_at(n_ct_after, -1)"), F.col("n_ct"))))


def match_trades(frame: DataFrame, window: int) -> DataFrame:
    """Adds the valid first deaths and the trades among them.

    A victim dies once, so an original kill has at most one possible trade kill; the
    greedy rule therefore reduces to keeping the latest original per trade kill.
    """
    f = frame.withColumn("valid_deaths", F.expr("filter(deaths, d -> d.valid)"))
    return f.withColumn("trades", F.expr(f"""
        filter(transform(valid_deaths, b -> named_struct('kill', b, 'orig', array_max(filter(valid_deaths, a ->
            {_BEFORE} AND b.tick - a.tick <= {int(window)} AND a.attacker = b.victim
            AND a.victim_team = b.attacker_team AND a.attacker_team = b.victim_team)))), t -> t.orig IS NOT NULL)"""))


_REPORTED = 1 << 32  # more than any health


def clamp_damage(damages: DataFrame, frame: DataFrame, width: int = 64) -> DataFrame:
    """Damage limited to the victim's remaining health.

    A row turns health h into max(b, h - a): a is its damage and b 0, or b the health that it reports and a more than any health.  Such steps compose,
    (a, b) and then (c, d) to (a + c, max(d, b - c)), so the rows of a victim are cut into stretches of ``width`` ticks: each is composed by itself, the few
    compositions of a victim are run through, and each row starts from the health that its stretch starts with.
    """
    d = damages.where("phase = 'live'").join(frame.select(*KEY, "roster"), KEY)
    d = d.withColumn("att", F.col("roster")[F.col("attacker_player_id")]).withColumn("vic", F.col("roster")[F.col("victim_player_id")])
    d = d.drop("roster").where("vic IS NOT NULL").withColumn("raw", F.coalesce("damage_health", F.lit(0)).cast("long"))
    victim, reported = [*KEY, "victim_player_id"], F.col("victim_health_after").isNotNull()
    d = d.withColumn("_a", F.when(reported, F.lit(_REPORTED)).otherwise(F.col("raw"))).withColumn("_b", F.coalesce(F.col("victim_health_after"), F.lit(0)).cast("long"))
    d = d.withColumn("_part", F.floor(F.col("tick") / width))

    def scanned(df: DataFrame, w) -> DataFrame:
        """_sum of the steps up to a row, and _best, the largest b that is left of the steps before it, plus their sum."""
        df = df.withColumn("_sum", F.sum("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return df.withColumn("_best", F.max(F.col("_b") + F.col("_sum")).over(w.rowsBetween(Window.unboundedPreceding, -1)))

    before = F.col("_sum") - F.col("_a")
    d = scanned(d, Window.partitionBy(*victim, "_part").orderBy("tick", "event_id"))
    parts = d.groupBy(*victim, "_part").agg(F.max(F.col("_b") + F.col("_sum")).alias("_top"), F.sum("_a").alias("_a")).withColumn("_b", F.col("_top") - F.col("_a"))
    parts = scanned(parts, Window.partitionBy(*victim).orderBy("_part"))
    parts = parts.select(*victim, "_part", F.greatest(F.lit(100) - before, F.col("_best") - before).alias("_health"))
    d = d.join(parts, [*victim, "_part"])
    d = d.withColumn("health_before", F.greatest(F.col("_health") - before, F.col("_best") - before).cast("long")).withColumn("effective", F.least("raw", "health_before"))
    kind = (F.when(F.col("att").isNull(), "none").when(F.col("att.team_id") != F.col("vic.team_id"), "enemy")
            .when(F.col("attacker_player_id") != F.col("victim_player_id"), "team").otherwise("self"))
    return d.withColumn("damage_kind", kind).drop("_a", "_b", "_sum", "_best", "_part", "_health")


def _entry(player: Column, **counters) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(player.alias("player_id"), *[counters.get(c, zero).alias(c) for c in PLAYER_COUNTERS])


def _contribute(df: DataFrame, *entries: Column) -> DataFrame:
    return df.select(*KEY, F.inline(F.array(*entries)))


class RoundStats:
    """Derived statistics of all matches; every attribute is a DataFrame."""

    def __init__(self, tables, cfg: StatsConfig = StatsConfig(), share: bool = False):
        """``share`` writes the frame and the classified kills once for callers that read them often."""
        self.t, self.cfg = tables, cfg
        self._keep = shared if share else (lambda df: df)

    @cached_property
    def members(self) -> DataFrame:
        return participants(self.t.rounds, self.t.memberships)

    @cached_property
    def roster(self) -> DataFrame:
        return self._keep(roster_frame(self.t.rounds, self.members))

    @cached_property
    def classified(self) -> DataFrame:
        return self._keep(classify_kills(self.t.kills, self.roster))

    @cached_property
    def frame(self) -> DataFrame:
        f = self.roster.join(_deaths(self.classified), KEY, "left")
        return self._keep(match_trades(_signed(f), self.cfg.trade_window_ticks))

    @cached_property
    def damage(self) -> DataFrame:
        return clamp_damage(self.t.damages, self.roster)

    @cached_property
    def openings(self) -> DataFrame:
        f = self.frame.where("opening IS NOT NULL")
        rate = F.lit(self.cfg.tick_rate).cast("double")
        return f.select(
            *ROUND, F.col("opening.event_id").alias("event_id"), F.col("opening.tick").alias("tick"),
            F.col("opening.relative_tick").alias("relative_tick"),
            F.col("opening.attacker").alias("killer_player_id"), F.col("opening.victim").alias("victim_player_id"),
            F.col("opening.attacker_team").alias("killer_team_id"), F.col("opening.victim_team").alias("victim_team_id"),
            F.col("opening.attacker_side").alias("killer_side"), F.col("opening.victim_side").alias("victim_side"),
            F.when(F.col("winner_team_id").isNotNull(), F.col("winner_side")).alias("round_winner"),
            (F.col("opening.attacker_team") == F.col("winner_team_id")).alias("opening_team_won"),
            F.greatest(F.lit(0.0), (F.col("opening.tick") - F.col("freeze_end_tick")) / rate).alias("seconds")
            if self.cfg.tick_rate else F.lit(None).cast("double").alias("seconds"))

    @cached_property
    def trades(self) -> DataFrame:
        t = self.frame.select(*ROUND, F.explode("trades").alias("x"))
        delta = F.col("x.kill.tick") - F.col("x.orig.tick")
        return t.select(
            *ROUND, F.col("x.kill.event_id").alias("trade_event_id"), F.col("x.orig.event_id").alias("original_event_id"),
            F.col("x.kill.attacker").alias("trader_player_id"), F.col("x.orig.victim").alias("traded_player_id"),
            F.col("x.orig.attacker").alias("traded_enemy_id"), F.col("x.kill.attacker_team").alias("team_id"),
            F.col("x.kill.attacker_side").alias("side"), delta.alias("tick_delta"),
            (delta / F.lit(self.cfg.tick_rate) if self.cfg.tick_rate else F.lit(None).cast("double")).alias("seconds_delta"))

    @cached_property
    def opportunities(self) -> DataFrame:
        """One row per valid first death and living teammate of its victim."""
        f = self.frame.select(*ROUND, "roster", "deaths", F.explode("valid_deaths").alias("b"))
        f = f.select("*", F.explode("roster").alias("player_id", "who")).where("player_id <> b.victim AND who.team_id = b.victim_team")
        f = f.where(F.expr("NOT exists(deaths, a -> a.victim = player_id AND (a.tick < b.tick OR (a.tick = b.tick AND a.event_id <= b.event_id)))"))
        return f.select(*ROUND, F.col("b.event_id").alias("event_id"), F.col("b.victim").alias("victim_player_id"),
                        "player_id", F.col("who.team_id").alias("team_id"))

    @cached_property
    def transitions(self) -> DataFrame:
        """Alive counts around every death of a participant; repeated deaths change nothing."""
        k = self.classified.where("vic IS NOT NULL").join(self.frame.select(*KEY, "n_t", "n_ct", "deaths"), KEY)
        k = k.withColumn("repeated", ~F.expr("exists(deaths, a -> a.event_id = event_id)"))
        for side, n in (("T", "n_t"), ("CT", "n_ct")):
            k = k.withColumn(f"{n}_before", F.expr(
                f"{n} - size(filter(deaths, a -> a.victim_side = '{side}' AND (a.tick < tick OR (a.tick = tick AND a.event_id < event_id))))"))
            k = k.withColumn(f"{n}_after", F.col(f"{n}_before") - flag((F.col("vic.side") == side) & ~F.col("repeated")))
        before, after = F.col("n_t_before") - F.col("n_ct_before"), F.col("n_t_after") - F.col("n_ct_after")

        def state(s: Column) -> Column:
            return F.when(s > 0, "t_advantage").when(s < 0, "ct_advantage").otherwise("even")

        return k.select(
            *ROUND, "tick", "event_id", F.col("n_t_before").alias("t_alive_before"), F.col("n_t_after").alias("t_alive_after"),
            F.col("n_ct_before").alias("ct_alive_before"), F.col("n_ct_after").alias("ct_alive_after"),
            before.alias("signed_before"), after.alias("signed_after"), state(before).alias("state_before"), state(after).alias("state_after"),
            "attacker_player_id", "victim_player_id",
            F.when(F.col("repeated"), "repeated").otherwise(F.col("kill_class")).alias("death_class"))

    @cached_property
    def advantage(self) -> DataFrame:
        return self.frame.select(
            *ROUND, "lineup_valid", F.col("lead_team").alias("first_advantage_team_id"),
            F.coalesce(F.abs("lead"), F.lit(0)).cast("long").alias("first_advantage_size"), F.col("lead_lost").alias("first_advantage_lost"),
            "max_t", "max_ct", (F.col("max_t") >= 2).alias("t_plus_two"), (F.col("max_ct") >= 2).alias("ct_plus_two"),
            "final_t", "final_ct")

    @cached_property
    def live_bombs(self) -> DataFrame:
        return self.t.bombs.where("phase = 'live'").join(self.roster.select(*KEY, "t_team_id", "ct_team_id"), KEY)

    @cached_property
    def player_rounds(self) -> DataFrame:
        one = F.lit(1).cast("long")
        enemy = F.col("kill_class") == "enemy"
        helped = enemy & F.col("asi").isNotNull() & (F.col("asi.team_id") == F.col("att.team_id")) \
            & (F.col("assister_player_id") != F.col("attacker_player_id")) & (F.col("assister_player_id") != F.col("victim_player_id"))
        from_kills = _contribute(
            self.classified,
            _entry(F.col("attacker_player_id"), kills=flag(enemy), headshots=flag(enemy & F.col("headshot")),
                   teamkills=flag(F.col("kill_class") == "teamkill")),
            _entry(F.col("victim_player_id"), enemy_deaths=flag(enemy), suicides=flag(F.col("kill_class") == "suicide")),
            _entry(F.col("assister_player_id"), assists=flag(helped)))
        z = {c: "0L" for c in PLAYER_COUNTERS}

        def row(player: str, **c) -> str:
            return "named_struct('player_id', " + player + "".join(f", '{n}', {({**z, **c})[n]}" for n in PLAYER_COUNTERS) + ")"

        facts = F.expr(f"""concat(
            transform(deaths, d -> {row('d.victim', deaths='1L')}),
            transform(coalesce(array_compact(array(opening)), array()), d -> {row('d.attacker', opening_kill='1L')}),
            transform(coalesce(array_compact(array(opening)), array()), d -> {row('d.victim', opening_death='1L')}),
            transform(trades, t -> {row('t.kill.attacker', traded_kills='1L')}),
            transform(trades, t -> {row('t.orig.victim', traded_deaths='1L')}))""")
        from_frame = self.frame.select(*KEY, F.inline(facts))
        from_opps = _contribute(self.opportunities, _entry(F.col("player_id"), trade_opportunities=one))
        eff, kind = F.col("effective"), F.col("damage_kind")
        zero = F.lit(0).cast("long")
        from_damage = _contribute(self.damage, _entry(
            F.col("attacker_player_id"), damage=eff, enemy_damage=F.when(kind == "enemy", eff).otherwise(zero),
            team_damage=F.when(kind == "team", eff).otherwise(zero)))
        from_shots = _contribute(self.t.shots.where("phase = 'live'"), _entry(F.col("player_id"), shots=one))
        from_bombs = _contribute(self.t.bombs.where("phase = 'live'"), _entry(
            F.col("player_id"), plants=flag(F.col("event_type") == "planted"), defuses=flag(F.col("event_type") == "defused")))
        counts = (union_all(from_kills, from_frame, from_opps, from_damage, from_shots, from_bombs).where("player_id IS NOT NULL")
                  .groupBy(*KEY, "player_id").agg(*[F.sum(c).alias(c) for c in PLAYER_COUNTERS]))
        p = self.members.join(counts, KEY + ["player_id"], "left").fillna(0, PLAYER_COUNTERS)
        k = F.col("kills")
        names = F.array(*[F.lit(n) for n in ("zero", "one", "two", "three", "four", "five")])
        return (p.withColumn("survived", F.col("deaths") == 0)
                .withColumn("multikill_category", F.when(k > 5, "five_plus").otherwise(F.get(names, k.cast("int"))))
                .withColumn("kast_k", k > 0).withColumn("kast_a", F.col("assists") > 0)
                .withColumn("kast_t", F.col("traded_deaths") > 0)
                .withColumn("kast", F.col("kast_k") | F.col("kast_a") | F.col("survived") | F.col("kast_t")))

    @cached_property
    def team_rounds(self) -> DataFrame:
        sums = self.player_rounds.groupBy(*KEY, "team_id").agg(
            F.count("*").alias("participant_count"), F.sum("kills").alias("kills"), F.sum("enemy_deaths").alias("lost"),
            F.sum("assists").alias("assists"), F.sum("enemy_damage").alias("enemy_damage"))
        bombs = self.live_bombs.groupBy(*KEY).agg(
            *[count_if(F.col("event_type") == e).alias(f"n_{e}") for e in ("planted", "defused", "exploded")])
        sides = F.array(
            F.struct(F.col("t_team_id").alias("team_id"), F.col("ct_team_id").alias("opponent_team_id"), F.lit("T").alias("side"),
                     F.col("max_t").alias("max_advantage"), F.col("final_t").alias("final_alive")),
            F.struct(F.col("ct_team_id").alias("team_id"), F.col("t_team_id").alias("opponent_team_id"), F.lit("CT").alias("side"),
                     F.col("max_ct").alias("max_advantage"), F.col("final_ct").alias("final_alive")))
        f = self.frame.where("t_team_id IS NOT NULL AND ct_team_id IS NOT NULL").join(bombs, KEY, "left")
        f = f.select("*", F.inline(sides))
        f = f.join(sums, KEY + ["team_id"], "left").fillna(0, ["participant_count", "kills", "lost", "assists", "enemy_damage", "n_planted", "n_defused", "n_exploded"])
        won = F.col("team_id") == F.col("winner_team_id")
        zero = F.lit(0).cast("long")
        ok = truth(F.col("opening.attacker_team") == F.col("team_id"))
        od = truth(F.col("opening.victim_team") == F.col("team_id"))
        gained = truth(F.col("lead_team") == F.col("team_id"))
        behind = F.col("lead_team").isNotNull() & ~gained
        successful = F.expr("size(filter(trades, t -> t.kill.attacker_team = team_id))").cast("long")
        plus = F.col("max_advantage") >= 2
        plants = F.when(F.col("side") == "T", F.col("n_planted")).otherwise(zero)
        return f.select(
            *ROUND, "team_id", "opponent_team_id", "side", "participant_count", "lineup_valid", won.alias("round_won"),
            "kills", F.col("lost").alias("deaths"), "assists", "enemy_damage", ok.alias("opening_kill"), od.alias("opening_death"),
            F.when(ok, won).alias("opening_kill_converted"), F.when(od, won).alias("recovered_after_opening_death"),
            F.expr("size(filter(valid_deaths, d -> d.victim_team = team_id))").cast("long").alias("trade_opportunities"),
            successful.alias("successful_trades"), successful.alias("traded_deaths"), (F.col("lost") - successful).alias("untraded_deaths"),
            gained.alias("gained_first_advantage"), F.when(gained, F.abs("lead")).otherwise(zero).cast("long").alias("first_advantage_size"),
            (gained & F.col("lead_lost")).alias("lost_first_advantage"), F.when(gained & F.col("lineup_valid"), won).alias("converted_first_advantage"),
            F.when(behind & F.col("lineup_valid"), won).alias("recovered_after_first_disadvantage"), behind.alias("first_disadvantage"),
            plus.alias("reached_plus_two"), F.when(plus & F.col("lineup_valid"), won).alias("converted_plus_two"), "max_advantage", "final_alive",
            plants.alias("plants"), F.when(F.col("side") == "CT", F.col("n_defused")).otherwise(zero).alias("defuses"),
            F.when(F.col("side") == "T", F.col("n_exploded")).otherwise(zero).alias("explosions"),
            (plants > 0).alias("planted_round"), F.when(plants > 0, won).alias("post_plant_won"),
            ((plants > 0) & (F.col("n_defused") + F.col("n_exploded") > 0)).alias("bomb_outcome_observed"),
            (F.col("n_planted") > 0).alias("round_has_plant"))

    @cached_property
    def availability(self) -> DataFrame:
        """Tall table of metric families: population, covered rounds, status and reason."""
        bombs = self.live_bombs.select(*KEY).distinct().withColumn("has_bomb", F.lit(True))
        r = self.roster.join(bombs, KEY, "left").groupBy("match_id").agg(
            F.count("*").alias("population"),
            count_if((F.col("n_t") > 0) & (F.col("n_ct") > 0)).alias("combat"),
            count_if(F.col("outcome_status") == "available").alias("win"),
            count_if(F.col("score_status") == "available").alias("score"),
            count_if(F.col("outcome_status") == "unresolved_conflict").alias("conflicts"),
            count_if(F.col("has_bomb")).alias("bomb"),
            count_if((F.col("n_t") + F.col("n_ct") > 0) & (F.col("n_t") == F.col("n_ct"))).alias("advantage"))
        win_reason = F.when(F.col("conflicts") > 0, "source_conflict").otherwise("missing_round_winner")
        fam = [("combat_metrics", "combat", F.lit("missing_participants")), ("opening_metrics", "combat", F.lit("missing_participants")),
               ("trade_metrics", "combat", F.lit("missing_participants")), ("kast_metrics", "combat", F.lit("missing_participants")),
               ("win_conversion_metrics", "win", win_reason), ("score_metrics", "score", F.lit("source_conflict")),
               ("bomb_metrics", "bomb", F.lit("unsupported_event_semantics")), ("advantage_metrics", "advantage", F.lit("missing_participants"))]
        tall = r.select("match_id", "population", F.inline(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(c).alias("covered"), reason.alias("reason")) for n, c, reason in fam])))
        full = (F.col("covered") == F.col("population")) & (F.col("metric") != "bomb_metrics")
        status = F.when(full, "available").when(F.col("covered") > 0, "partial").otherwise("unavailable")
        return tall.withColumn("status", status).withColumn("reason", F.when(~full, F.col("reason")))

    def _gates(self) -> DataFrame:
        r = self.roster.groupBy("match_id").agg(
            F.bool_and(F.col("outcome_status") == "available").alias("win_ok"),
            F.bool_and((F.col("n_t") > 0) & (F.col("n_ct") > 0)).alias("trade_ok"))
        return r

    @cached_property
    def player_matches(self) -> DataFrame:
        wins = self.openings.groupBy("match_id", F.col("killer_player_id").alias("player_id")).agg(count_if(F.col("opening_team_won")).alias("opening_wins"))
        s = {c: F.sum(c).alias(c) for c in PLAYER_COUNTERS}
        k = F.col("kills")
        g = self.player_rounds.groupBy("match_id", "player_id").agg(
            F.count("*").alias("rounds_played"), *s.values(),
            count_if(F.col("survived")).alias("survival_rounds"), count_if(k >= 2).alias("multikill_rounds"),
            *[count_if(k == n).alias(f"{w}_k_rounds") for n, w in ((2, "two"), (3, "three"), (4, "four"), (5, "five"))],
            count_if(k >= 5).alias("five_plus_rounds"), count_if(F.col("kast")).alias("kast_rounds"),
            *[count_if(F.col(f"kast_{x}")).alias(f"kast_{x}_rounds") for x in "kat"], )
        g = g.join(wins, ["match_id", "player_id"], "left").fillna(0, ["opening_wins"]).join(self._gates(), "match_id")
        n, d = F.col("rounds_played"), F.col("deaths")
        trade = lambda c: F.when(F.col("trade_ok"), c)
        attempts = F.col("opening_kill") + F.col("opening_death")
        return g.select(
            "match_id", "player_id", "rounds_played", "kills", "deaths", "assists", ratio(k, d).alias("kd_ratio"),
            (k - d).alias("kill_differential"), ratio(F.col("enemy_damage"), n).alias("adr"), ratio(k, n).alias("kpr"),
            ratio(d, n).alias("dpr"), ratio(F.col("assists"), n).alias("apr"), "headshots",
            percentage(F.col("headshots"), k).alias("headshot_percentage"), F.col("damage").alias("total_damage"), "enemy_damage",
            "team_damage", "shots", "survival_rounds", percentage(F.col("survival_rounds"), n).alias("survival_percentage"),
            F.col("opening_kill").alias("opening_kills"), F.col("opening_death").alias("opening_deaths"),
            percentage(F.col("opening_kill"), attempts).alias("opening_success_percentage"),
            F.when(F.col("win_ok"), F.col("opening_wins")).alias("opening_kill_round_wins"),
            F.when(F.col("win_ok"), percentage(F.col("opening_wins"), F.col("opening_kill"))).alias("opening_conversion_percentage"),
            trade(F.col("traded_kills")).alias("traded_kills"), trade(F.col("traded_deaths")).alias("traded_deaths"),
            trade(F.col("trade_opportunities")).alias("trade_opportunities"),
            trade(percentage(F.col("traded_kills"), F.col("trade_opportunities"))).alias("trade_success_percentage"),
            trade(percentage(F.col("traded_deaths"), F.col("enemy_deaths"))).alias("traded_death_percentage"),
            "multikill_rounds", "two_k_rounds", "three_k_rounds", "four_k_rounds", "five_k_rounds", "five_plus_rounds",
            trade(F.col("kast_rounds")).alias("kast_rounds"), trade(percentage(F.col("kast_rounds"), n)).alias("kast_percentage"),
            "kast_k_rounds", "kast_a_rounds", trade(F.col("kast_t_rounds")).alias("kast_t_rounds"),
            "teamkills", "suicides", "plants", "defuses")

    @cached_property
    def team_matches(self) -> DataFrame:
        c = {n: count_if(F.col(n)).alias(n) for n in (
            "opening_kill", "opening_death", "opening_kill_converted", "recovered_after_opening_death", "gained_first_advantage",
            "converted_first_advantage", "first_disadvantage", "recovered_after_first_disadvantage", "reached_plus_two",
            "converted_plus_two", "planted_round", "post_plant_won", "bomb_outcome_observed")}
        t, won = F.col("side") == "T", F.col("round_won")
        g = self.team_rounds.groupBy("match_id", "team_id").agg(
            F.count("*").alias("rounds_played"), count_if(won).alias("round_wins"), count_if(t).alias("t_rounds"), count_if(~t).alias("ct_rounds"),
            count_if(t & won).alias("t_round_wins"), count_if(~t & won).alias("ct_round_wins"), *c.values(),
            *[F.sum(x).alias(x) for x in ("kills", "deaths", "assists", "enemy_damage", "trade_opportunities", "successful_trades",
                                          "traded_deaths", "plants", "defuses", "explosions")],
            count_if(F.col("defuses") > 0).alias("rounds_with_defuse"), count_if(F.col("explosions") > 0).alias("rounds_with_explosion"),
            count_if(~t & F.col("round_has_plant")).alias("ct_plant_rounds"),
            count_if(~t & (F.col("defuses") > 0)).alias("ct_defuse_rounds")).join(self._gates(), "match_id")
        win = lambda x: F.when(F.col("win_ok"), x)
        tr = lambda x: F.when(F.col("trade_ok"), x)
        col = F.col
        return g.select(
            "match_id", "team_id", "rounds_played", win(col("round_wins")).alias("round_wins"), "t_rounds", "ct_rounds",
            win(col("t_round_wins")).alias("t_round_wins"), win(col("ct_round_wins")).alias("ct_round_wins"), "kills", "deaths", "assists",
            "enemy_damage", ratio(col("enemy_damage"), col("rounds_played")).alias("adr"), col("opening_kill").alias("opening_kills"),
            col("opening_death").alias("opening_deaths"), win(col("opening_kill_converted")).alias("opening_kill_conversions"),
            win(percentage(col("opening_kill_converted"), col("opening_kill"))).alias("opening_conversion_percentage"),
            win(percentage(col("recovered_after_opening_death"), col("opening_death"))).alias("opening_recovery_percentage"),
            tr(col("trade_opportunities")).alias("trade_opportunities"), tr(col("successful_trades")).alias("successful_trades"),
            tr(percentage(col("successful_trades"), col("trade_opportunities"))).alias("trade_percentage"),
            tr(col("deaths") - col("traded_deaths")).alias("untraded_deaths"), col("gained_first_advantage").alias("first_advantage_rounds"),
            win(percentage(col("converted_first_advantage"), col("gained_first_advantage"))).alias("first_advantage_conversion_percentage"),
            col("first_disadvantage").alias("first_disadvantage_rounds"),
            win(percentage(col("recovered_after_first_disadvantage"), col("first_disadvantage"))).alias("first_disadvantage_recovery_percentage"),
            col("reached_plus_two").alias("plus_two_rounds"),
            win(percentage(col("converted_plus_two"), col("reached_plus_two"))).alias("plus_two_conversion_percentage"),
            "plants", "defuses", "explosions", col("planted_round").alias("rounds_with_plant"), "rounds_with_defuse", "rounds_with_explosion",
            win(percentage(col("post_plant_won"), col("planted_round"))).alias("post_plant_conversion_percentage"),
            percentage(col("bomb_outcome_observed"), col("planted_round")).alias("bomb_outcome_coverage_percentage"),
            percentage(col("ct_defuse_rounds"), col("ct_plant_rounds")).alias("ct_defuse_success_percentage"))


def seconds_to_ticks(seconds: Column, rate: Column) -> Column:
    """Half-up rounding, at least one tick; NULL without a proven rate."""
    ok = (seconds > 0) & (rate > 0)
    return F.when(ok, F.greatest(F.lit(1).cast("long"), F.floor(seconds * rate + 0.5)))
