"""Tactical ratios of a selected team: occurrences per round, then shares per map and side.

Every builder returns occurrences (one row per observed unit); ``categorical`` and
``binary`` turn them into shares.  Time windows are equi joins on tick buckets.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_if, ratio, truth, union_all

KEY = ["match_id", "round_id"]
VIEW = ["profile_id", "match_id", "round_id", "round_number", "team_id", "side", "map_name"]
SCOPE = ["profile_id", "insight_type", "map_name", "side"]
#: Fewest seconds a tick of a fitted clock.
LEAST_SLOPE = 0.001
# Fixed value: price policy of carried utility.
PRICES = {"flashbang": 200, "smoke": 300, "he_grenade": 300, "molotov": 400, "incendiary": 500, "decoy": 50}


@dataclass(frozen=True)
class TacticalConfig:
    checkpoints: tuple[int, ...] = (640, 1280, 1920)
    max_age: int = 32
    min_players: int = 2
    execute_window: int = 640
    grace: int = 64
    smoke_bucket: int = 5
    rotation_window: int = 1280
    isolated: float = 1500.0
    cell: float = 512.0
    setup_window: int = 1280
    min_rotator_rounds: int = 2
    min_rotator_share: float = 0.2
    prices: dict = field(default_factory=lambda: dict(PRICES))


def occurrence(df: DataFrame, kind: str, key: Column, positive: Column, tick: Column, metrics: dict[str, Column] | None = None) -> DataFrame:
    m = metrics or {}
    items = [x for n, c in m.items() for x in (F.lit(n), c.cast("double"))]
    packed = F.map_filter(F.create_map(*items), lambda _, v: v.isNotNull()) if items else F.expr("CAST(map() AS map<string, double>)")
    return df.select(*VIEW, F.lit(kind).alias("insight_type"), key.alias("key"), truth(positive).alias("positive"), tick.cast("int").alias("tick"), packed.alias("metrics"))


def buckets(df: DataFrame, tick: str, size: int, back: int = 0, ahead: int = 0) -> DataFrame:
    b = F.floor(F.col(tick) / size)
    return df.withColumn("_b", F.explode(F.sequence(b - back, b + ahead))) if back or ahead else df.withColumn("_b", b)


def recent_sample(requests: DataFrame, samples: DataFrame, max_age: int, strict: bool = False) -> DataFrame:
    """Newest living sample of a player at most ``max_age`` ticks old; an ambiguous zone gives none.

    requests(match_id, round_id, player_id, tick, ...)
    """
    size = max(1, max_age)
    q = buckets(requests, "tick", size, back=1)
    s = samples.where("alive").select(*KEY, "player_id", F.col("tick").alias("sample_tick"), "x", "y", "z", "zone_id", "utility").withColumn("_b", F.floor(F.col("sample_tick") / size))
    age = F.col("tick") - F.col("sample_tick")
    hit = q.join(s, KEY + ["player_id", "_b"]).where((age >= (1 if strict else 0)) & (age <= max_age))
    keys = requests.columns
    per = hit.groupBy(*keys, "sample_tick").agg(F.min("zone_id").alias("z1"), F.max("zone_id").alias("z2"), F.first(F.struct("x", "y", "z", "utility")).alias("p"))
    new = per.groupBy(*keys).agg(F.max_by(F.struct("sample_tick", "z1", "z2", "p"), "sample_tick").alias("n"))
    return new.where("n.z1 IS NULL OR n.z1 = n.z2").select(*keys, F.col("n.sample_tick").alias("sample_tick"), F.col("n.z1").alias("zone_id"), "n.p.*")


def recent_zoned(requests: DataFrame, samples: DataFrame, seconds: float = 0.5) -> DataFrame:
    """Newest zoned living sample of a player on the requested side, at most ``seconds`` old by the round's fitted clock.

    Samples without zone or of another side don't count, so they hide no older one.  Two zones at the newest tick give none.
    requests(match_id, round_id, player_id, side, tick, seconds_per_tick, ...)
    """
    size = round(seconds / LEAST_SLOPE)  # no sample within ``seconds`` is more ticks away
    keys, same = requests.columns, KEY + ["player_id", "side", "_b"]
    s = samples.where("alive AND zone_id <> ''").select(*KEY, "player_id", "side", F.col("tick").alias("sample_tick"), "zone_id")
    hit = buckets(requests, "tick", size, back=1).join(s.withColumn("_b", F.floor(F.col("sample_tick") / size)), same)
    hit = hit.where(((F.col("tick") - F.col("sample_tick")) * F.col("seconds_per_tick")).between(0, seconds))
    per = hit.groupBy(*keys, "sample_tick").agg(F.min("zone_id").alias("z1"), F.max("zone_id").alias("z2"))
    new = per.groupBy(*keys).agg(F.max(F.struct("sample_tick", "z1", "z2")).alias("n"))
    return new.where("n.z1 = n.z2").select(*keys, F.col("n.sample_tick").alias("sample_tick"), F.col("n.z1").alias("zone_id"))


def clock_fit(events: DataFrame) -> DataFrame:
    """Seconds per tick of a round, when all source clocks agree with one line."""
    per = events.where("game_time IS NOT NULL").groupBy(*KEY, "tick").agg(F.min("game_time").alias("lo"), F.max("game_time").alias("hi"))
    ends = per.groupBy(*KEY).agg(F.min("tick").alias("t0"), F.max("tick").alias("t1"), F.min_by("lo", "tick").alias("g0"), F.max_by("lo", "tick").alias("g1"), F.count("*").alias("n"), F.bool_and(F.col("hi") - F.col("lo") <= 0.002).alias("tight"))
    ends = ends.where("n >= 2 AND tight AND g1 - g0 >= 1").withColumn("slope", (F.col("g1") - F.col("g0")) / (F.col("t1") - F.col("t0"))).where(F.col("slope").between(LEAST_SLOPE, 0.1))
    off = F.abs(F.col("lo") - (F.col("g0") + (F.col("tick") - F.col("t0")) * F.col("slope")))
    good = per.join(ends.select(*KEY, "t0", "g0", "slope"), KEY).groupBy(*KEY).agg(F.max(off).alias("worst"), F.first("slope").alias("seconds_per_tick"))
    return good.where("worst <= 0.02").select(*KEY, "seconds_per_tick")


class Tactical:
    """``view``: VIEW columns plus live_tick, last_tick, won; ``samples``: positioned, zone-labelled snapshots."""

    def __init__(self, view: DataFrame, samples: DataFrame, tables, trades: DataFrame, plants: DataFrame, members: DataFrame, cfg: TacticalConfig = TacticalConfig()):
        self.v, self.samples, self.t, self.trades, self.plants, self.members, self.cfg = view, samples, tables, trades, plants, members, cfg
        self.mine = samples.join(view.select(*KEY, "team_id"), KEY + ["team_id"], "left_semi")

    @property
    def kills(self) -> DataFrame:
        k = self.t.kills.where("attacker_player_id IS NOT NULL AND victim_player_id IS NOT NULL AND attacker_team_id <> victim_team_id AND NOT coalesce(is_teamkill, false) AND NOT coalesce(is_suicide, false)")
        return k.select(*KEY, "tick", "event_id", "attacker_player_id", "victim_player_id", "attacker_team_id", "victim_team_id", "weapon")

    @property
    def contacts(self) -> DataFrame:
        """Enemy damage and valid enemy kills."""
        d = self.t.damages.where("damage_health > 0 AND attacker_team_id <> victim_team_id")
        return d.select(*KEY, "tick", "event_id", "attacker_player_id", "victim_player_id", "attacker_team_id", "victim_team_id", "weapon").unionByName(self.kills)

    @property
    def live_contacts(self) -> DataFrame:
        """Damage and kills between players of the two rosters, from the live start to the end of a selected round."""
        cols = [*KEY, "tick", "event_id", "attacker_player_id", "victim_player_id", "weapon"]
        teams = self.members.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("player_id", "team_id"))).alias("team_of"))
        frame = self.v.where("live_tick IS NOT NULL").select(*KEY, "live_tick", "last_tick").distinct().join(teams, KEY)
        kills = self.t.kills.where("NOT coalesce(is_teamkill, false) AND NOT coalesce(is_suicide, false)").select(*cols)
        c = self.t.damages.where("damage_health > 0").select(*cols).unionByName(kills).join(frame, KEY)
        c = c.where("tick >= live_tick AND (last_tick IS NULL OR tick <= last_tick)")
        return c.where("try_element_at(team_of, attacker_player_id) <> try_element_at(team_of, victim_player_id)").select(*cols)

    @property
    def effects(self) -> DataFrame:
        e = self.t.effects.select(*KEY, "effect_id", "owner_player_id", F.col("owner_team_id").alias("team_id"), "effect_type", "start_tick", "end_tick")
        return self.v.join(e, KEY + ["team_id"])

    def at_checkpoints(self) -> DataFrame:
        """Last living sample of each team member before every checkpoint."""
        marks = F.array(*[F.lit(o) for o in self.cfg.checkpoints])
        s = self.mine.where("alive").join(self.v.select(*KEY, "live_tick").distinct(), KEY)
        s = s.select("*", F.explode(F.filter(marks, lambda o: (F.col("live_tick") + o - F.col("tick")).between(0, self.cfg.max_age))).alias("offset"))
        g = s.groupBy(*KEY, "team_id", "player_id", "offset").agg(F.max(F.struct("tick", "x", "y", "z", "zone_id")).alias("p"))
        return g.select(*KEY, "team_id", "player_id", "offset", "p.*")

    def formations(self) -> DataFrame:
        c = self.at_checkpoints()
        z = c.where("zone_id IS NOT NULL").groupBy(*KEY, "team_id", "offset", "zone_id").agg(F.count("*").alias("n"), F.max("tick").alias("tick"))
        part = F.when(F.col("n") > 1, F.concat(F.col("zone_id"), F.lit("*"), F.col("n"))).otherwise(F.col("zone_id"))
        per = z.groupBy(*KEY, "team_id", "offset").agg(F.sum("n").alias("known"), F.max("tick").alias("tick"), F.sort_array(F.collect_list(F.struct("zone_id", part.alias("p")))).alias("zs"))
        every = c.groupBy(*KEY, "team_id", "offset").agg(F.count("*").alias("players"))
        per = per.join(every, KEY + ["team_id", "offset"]).where(F.col("known") >= self.cfg.min_players)
        key = F.concat(F.col("offset"), F.lit(":"), F.array_join("zs.p", "+"))
        g = per.groupBy(*KEY, "team_id").agg(F.count("*").alias("n"), F.sum(F.col("players") - F.col("known")).alias("unknown"), F.max("tick").alias("tick"), F.sort_array(F.collect_list(F.struct("offset", key.alias("k")))).alias("ks"))
        q = self.v.join(g.where(F.col("n") == len(self.cfg.checkpoints)), KEY + ["team_id"])
        return occurrence(q, "path_cluster", F.array_join("ks.k", "|"), F.lit(True), F.col("tick"), {"unknown_player_zones": F.col("unknown")})

    def executes(self) -> DataFrame:
        p = self.plants.where("upper(site_normalized) IN ('A', 'B')").select(*KEY, F.col("tick").alias("plant_tick"), F.upper("site_normalized").alias("site"))
        base = self.v.where("side = 'T'").join(p, KEY)
        e = self.effects.select("profile_id", *KEY, "effect_type", "start_tick").join(base.select("profile_id", *KEY, "plant_tick"), ["profile_id", *KEY])
        e = e.where((F.col("start_tick") <= F.col("plant_tick")) & (F.col("start_tick") >= F.col("plant_tick") - self.cfg.execute_window))
        n = e.groupBy("profile_id", *KEY, "effect_type").agg(F.count("*").alias("n"))
        part = F.when(F.col("n") > 1, F.concat(F.col("effect_type"), F.lit("*"), F.col("n"))).otherwise(F.col("effect_type"))
        b = n.groupBy("profile_id", *KEY).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("effect_type", part.alias("p")))).alias("ps"))
        q = base.join(b, ["profile_id", *KEY], "left")
        key = F.concat(F.lit("site:"), "site", F.lit("|"), F.coalesce(F.array_join("ps.p", "+"), F.lit("no_observed_effect")))
        return occurrence(q, "execute_package", key, F.lit(True), F.col("plant_tick"), {"observed_utility_effects": F.coalesce("total", F.lit(0))})

    def effect_damage(self, unique: bool) -> DataFrame:
        """(profile, effect, damage) pairs by owner, weapon and time; ``unique`` drops damages fitting several effects."""
        e = self.effects.where("effect_type IN ('he', 'fire') AND owner_player_id IS NOT NULL").withColumn("until", F.coalesce("end_tick", "start_tick") + self.cfg.grace)
        size = 512
        e = e.select("profile_id", *KEY, "team_id", "effect_id", "owner_player_id", "effect_type", "start_tick", "until").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_tick") / size), F.floor(F.col("until") / size))))
        w = F.lower("weapon")
        fits = F.when(w.contains("hegrenade") | w.isin("he", "grenade"), "he").when(w.contains("inferno") | w.contains("molotov") | w.contains("incgrenade"), "fire")
        d = self.t.damages.withColumn("effect_type", fits).where("effect_type IS NOT NULL").select(*KEY, "effect_type", F.col("attacker_player_id").alias("owner_player_id"), "victim_team_id", F.col("tick").alias("hit_tick"), "event_id", "damage_health")
        d = d.withColumn("_b", F.floor(F.col("hit_tick") / size))
        h = e.join(d, KEY + ["effect_type", "owner_player_id", "_b"]).where("hit_tick BETWEEN start_tick AND until AND victim_team_id <> team_id")
        if not unique:
            return h
        many = h.groupBy("profile_id", "event_id").agg(F.count("*").alias("fits")).where("fits = 1")
        return h.join(many.select("profile_id", "event_id"), ["profile_id", "event_id"], "left_semi")

    def utility_outcomes(self) -> DataFrame:
        h = self.effect_damage(True).groupBy("profile_id", "effect_id").agg(F.sum(F.coalesce("damage_health", F.lit(0))).alias("damage"))
        q = self.effects.where("effect_type IN ('he', 'fire') AND owner_player_id IS NOT NULL").join(h, ["profile_id", "effect_id"], "left")
        return occurrence(q, "utility_outcome", F.col("effect_type"), F.col("damage") > 0, F.col("start_tick"), {"damage_health": F.coalesce("damage", F.lit(0))})

    def _blinds(self) -> DataFrame:
        b = self.t.blinds.select(*KEY, F.col("attacker_player_id").alias("owner_player_id"), F.col("tick").alias("start_tick"), "victim_player_id", "victim_team_id", "duration_seconds")
        return self.effects.where("effect_type = 'flash' AND owner_player_id IS NOT NULL").join(b, KEY + ["owner_player_id", "start_tick"], "left")

    def team_flashes(self) -> DataFrame:
        own = truth((F.col("victim_team_id") == F.col("team_id")) & (F.col("victim_player_id") != F.col("owner_player_id")))
        foe = truth(F.col("victim_team_id") != F.col("team_id"))
        sec = F.coalesce("duration_seconds", F.lit(0.0))
        g = self._blinds().groupBy(*VIEW, "effect_id", "owner_player_id", "start_tick").agg(F.bool_or(own).alias("hit"), F.sum(F.when(own, sec).otherwise(0.0)).alias("mates"), F.sum(F.when(foe, sec).otherwise(0.0)).alias("foes"))
        return occurrence(g, "team_flash", F.concat(F.lit("player:"), "owner_player_id"), F.col("hit"), F.col("start_tick"), {"team_blind_seconds": F.col("mates"), "enemy_blind_seconds": F.col("foes")})

    def utility_losses(self) -> DataFrame:
        """Utility carried at death: newest living sample strictly before it, of any age inside the round."""
        d = self.v.join(self.t.kills.where("victim_player_id IS NOT NULL").select(*KEY, F.col("victim_team_id").alias("team_id"), F.col("victim_player_id").alias("player_id"), "tick", "event_id"), KEY + ["team_id"])
        s = self.samples.where("alive").select(*KEY, "player_id", F.col("tick").alias("sample_tick"), "utility")
        last = d.select("profile_id", *KEY, "player_id", "tick", "event_id").join(s, KEY + ["player_id"]).where("sample_tick < tick").groupBy("profile_id", "event_id").agg(F.max_by("utility", "sample_tick").alias("utility"), F.max("sample_tick").alias("sample_tick"))
        q = d.join(last, ["profile_id", "event_id"])
        price = F.create_map(*[x for k, p in self.cfg.prices.items() for x in (F.lit(k), F.lit(p))])
        value = F.aggregate(F.transform("utility", lambda u: F.coalesce(F.try_element_at(price, u), F.lit(0))), F.lit(0), lambda a, b: a + b)
        return occurrence(q, "utility_loss", F.lit("carried_on_death"), F.size("utility") > 0, F.col("tick"), {"utility_items": F.size("utility"), "estimated_utility_value": value})

    def no_direct_effect(self) -> DataFrame:
        hit = self.effect_damage(False).select("profile_id", "effect_id").distinct()
        blind = self._blinds().where("victim_team_id <> team_id").select("profile_id", "effect_id").distinct()
        q = self.effects.where("owner_player_id IS NOT NULL AND effect_type IN ('he', 'fire', 'flash')").join(union_all(hit, blind).distinct().withColumn("hit", F.lit(True)), ["profile_id", "effect_id"], "left")
        return occurrence(q, "utility_loss", F.concat(F.lit("no_direct_effect:"), "effect_type"), F.col("hit").isNull(), F.col("start_tick"))

    def smoke_timing(self, clock: Column) -> DataFrame:
        """Seconds after the round start, and until the first contact of the team afterwards.

        ``clock`` turns a tick into source seconds.
        """
        s = self.effects.where("effect_type = 'smoke'")
        c = self.contacts_of_team().select("profile_id", *KEY, F.col("tick").alias("contact_tick"))
        nxt = s.select("profile_id", *KEY, "effect_id", "start_tick").join(c, ["profile_id", *KEY]).where("contact_tick >= start_tick").groupBy("profile_id", "effect_id").agg(F.min("contact_tick").alias("contact_tick"))
        q = s.join(nxt, ["profile_id", "effect_id"], "left")
        elapsed = (F.col("start_tick") - F.col("round_start")) * clock
        q = q.where(elapsed >= 0)
        b = F.floor(elapsed / self.cfg.smoke_bucket) * self.cfg.smoke_bucket
        return occurrence(q, "smoke_timing", F.concat(F.lit("start:"), b), F.lit(True), F.col("start_tick"), {"smoke_start_seconds": elapsed, "contact_window_seconds": (F.col("contact_tick") - F.col("start_tick")) * clock})

    def contacts_of_team(self) -> DataFrame:
        d = self.t.damages.where("attacker_team_id <> victim_team_id")
        return self.v.join(d.select(*KEY, "tick", "event_id", "attacker_team_id", "victim_team_id"), KEY).where("team_id IN (attacker_team_id, victim_team_id)")

    def spacing(self) -> DataFrame:
        """Distances inside the team at every checkpoint; a checkpoint holds one roster."""
        g = self.at_checkpoints().groupBy(*KEY, "team_id", "offset").agg(F.sort_array(F.collect_list(F.struct("player_id", "x", "y", "z"))).alias("ps"), F.max("tick").alias("tick")).where(F.size("ps") >= self.cfg.min_players)
        dist = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
        g = g.withColumn("near", F.expr(f"transform(ps, a -> array_min(transform(filter(ps, b -> b.player_id <> a.player_id), b -> {dist})))"))
        g = g.withColumn("pairs", F.sort_array(F.expr(f"flatten(transform(ps, a -> transform(filter(ps, b -> b.player_id > a.player_id), b -> {dist})))")))
        n = F.size("pairs")
        med = (F.element_at("pairs", F.floor((n + 1) / 2).cast("int")) + F.element_at("pairs", F.floor(n / 2).cast("int") + 1)) / 2
        q = self.v.join(g, KEY + ["team_id"])
        return occurrence(q, "spacing_profile", F.concat(F.lit("checkpoint:"), "offset"), F.array_max("near") > self.cfg.isolated, F.col("tick"), {"median_pairwise_distance": med, "maximum_nearest_teammate_distance": F.array_max("near")})

    def openings(self) -> DataFrame:
        per = self.kills.groupBy(*KEY, "tick").agg(F.count("*").alias("n"), F.min(F.struct("event_id", "attacker_team_id", "victim_team_id")).alias("k"))
        first = per.groupBy(*KEY).agg(F.min_by(F.struct("tick", "n", "k"), "tick").alias("f")).where("f.n = 1").select(*KEY, "f.tick", "f.k.*")
        return self.v.join(first, KEY)

    def entries(self) -> DataFrame:
        return occurrence(self.openings(), "entry_structure", F.lit("opening_duel_success"), F.col("attacker_team_id") == F.col("team_id"), F.col("tick"))

    def opening_deaths_traded(self) -> DataFrame:
        tr = self.trades.select(*KEY, "team_id", F.col("original_event_id").alias("event_id"), "tick_delta")
        q = self.openings().where("victim_team_id = team_id").join(tr, KEY + ["team_id", "event_id"], "left")
        return occurrence(q, "trade_structure", F.lit("opening_death_traded"), F.col("tick_delta").isNotNull(), F.col("tick"), {"trade_tick_delta": F.coalesce("tick_delta", F.lit(0))})

    def transitions(self) -> DataFrame:
        c = self.contacts.groupBy(*KEY).agg(F.min("tick").alias("contact"))
        s = self.v.where("side = 'CT'").join(c, KEY).join(self.mine.where("alive AND zone_id IS NOT NULL").select(*KEY, "team_id", "player_id", "tick", "zone_id"), KEY + ["team_id"])
        s = s.where((F.col("tick") >= F.col("contact")) & (F.col("tick") <= F.col("contact") + self.cfg.rotation_window))
        w = Window.partitionBy("profile_id", *KEY, "player_id").orderBy("tick")
        s = s.withColumn("prev", F.lag("zone_id").over(w)).where("prev <> zone_id")
        return occurrence(s, "rotation_transition", F.concat("prev", F.lit("->"), "zone_id"), F.lit(True), F.col("tick"), {"player_transition": F.lit(1)})

    def clutches(self) -> DataFrame:
        """First tick after which one player faces two or more; same-tick kills count together."""
        n = self.members.groupBy(*KEY, "team_id").agg(F.collect_set("player_id").alias("ids"))
        opp = n.select(*KEY, F.col("team_id").alias("other_team"), F.col("ids").alias("other_ids"))
        q = self.v.join(n, KEY + ["team_id"]).join(opp, KEY).where("other_team <> team_id AND size(ids) >= 2 AND size(other_ids) >= 2")
        first = self.kills.groupBy(*KEY, "victim_player_id").agg(F.min("tick").alias("tick"))
        d = first.groupBy(*KEY).agg(F.collect_list(F.struct("tick", F.col("victim_player_id").alias("victim"))).alias("ds"))
        q = q.join(d, KEY)
        alive = "size(filter({0}, p -> NOT exists(ds, d -> d.victim = p AND d.tick <= t)))"
        hit = F.expr(f"filter(sort_array(array_distinct(ds.tick)), t -> {alive.format('ids')} = 1 AND {alive.format('other_ids')} >= 2)")
        q = q.withColumn("at", F.try_element_at(hit, F.lit(1))).where("at IS NOT NULL AND won IS NOT NULL")
        left = F.expr("size(filter(other_ids, p -> NOT exists(ds, d -> d.victim = p AND d.tick <= at)))")
        return occurrence(q, "clutch_behavior", F.lit("one_vs_many_conversion"), F.col("won"), F.col("at"), {"opponents_alive_at_trigger": left})

    def saves(self, signals: DataFrame) -> DataFrame:
        """signals(match_id, round_id, team_id, saved, tick): rounds with an available save fact."""
        return occurrence(self.v.join(signals, KEY + ["team_id"]).where("saved IS NOT NULL"), "save_behavior", F.lit("save_observed"), F.col("saved"), F.col("tick"))

    @property
    def _living(self) -> DataFrame:
        s = self.v.join(self.mine.where("alive AND x IS NOT NULL"), KEY + ["team_id"]).drop(self.mine.side)
        return s.select("profile_id", "map_name", self.v.side, "match_id", F.floor(F.col("x") / self.cfg.cell).alias("cell_x"), F.floor(F.col("y") / self.cfg.cell).alias("cell_y"))

    def heat_cells(self) -> DataFrame:
        """Living samples per cell."""
        return self._living.groupBy("profile_id", "map_name", "side", "cell_x", "cell_y").agg(F.count("*").alias("numerator"))

    def heat_counts(self) -> DataFrame:
        """The same as counts of occurrences per match: samples are as many as all positions, so they are never listed one by one."""
        key = F.concat_ws(":", F.lit("cell"), F.col("cell_x").cast("string"), F.col("cell_y").cast("string"))
        return self._living.groupBy("profile_id", F.lit("heatmap_cell").alias("insight_type"), "map_name", "side", key.alias("key"), "match_id").agg(F.count("*").alias("n"))

    def pace(self, clocks: DataFrame, site_zone: Column) -> DataFrame:
        """Attack pace of T rounds from the first contact, an early plant and the zones held at contact."""
        c = self.live_contacts.groupBy(*KEY).agg(F.min("tick").alias("tick"))
        q = self.v.where("side = 'T'").join(c, KEY).join(clocks, KEY)
        who = q.select(*VIEW, "tick", "seconds_per_tick").join(self.members.select(*KEY, "team_id", "player_id"), KEY + ["team_id"])
        near = recent_zoned(who, self.samples).where("NOT lower(zone_id) RLIKE 'spawn|base|unknown|unavailable'")
        held = near.groupBy("profile_id", *KEY).agg(F.countDistinct("zone_id").alias("zones"), F.bool_or(site_zone).alias("entry"))
        p = self.plants.select(*KEY, F.col("tick").alias("plant_tick"))
        q = q.join(held, ["profile_id", *KEY], "left").join(p, KEY, "left")
        sec = (F.col("tick") - F.col("live_tick")) * F.col("seconds_per_tick")
        plant = (F.col("plant_tick") - F.col("live_tick")) * F.col("seconds_per_tick")
        early = truth((plant >= 0) & (plant < 25)) | truth(F.col("entry"))
        key = F.when((sec < 25) & early, "fast_hit").when(sec < 25, "early_contact").when((sec <= 60) & (F.coalesce("zones", F.lit(0)) >= 2), "default_to_split").when(sec > 60, "late_execute").otherwise("mid_contact")
        return occurrence(q, "attack_pace", key, F.lit(True), F.col("tick"))

    def corridors(self, clocks: DataFrame, lanes: dict[str, dict[str, str]], parallel: dict[str, tuple[str, str]]) -> DataFrame:
        """Approach lanes used in the 12 s before a plant; two players in both lanes within 3 s name the pair."""
        p = self.plants.where("upper(site_normalized) IN ('A', 'B')").select(*KEY, F.col("tick").alias("plant_tick"), F.upper("site_normalized").alias("site"))
        q = self.v.where("side = 'T'").join(p, KEY).join(clocks, KEY)
        lane = F.create_map(*[F.lit(x) for site, m in lanes.items() for z, l in m.items() for x in (f"{site}/{z}", l)])
        s = q.join(self.mine.where("alive AND zone_id IS NOT NULL").select(*KEY, "team_id", "player_id", F.col("tick").alias("sample_tick"), "zone_id"), KEY + ["team_id"])
        s = s.where(((F.col("plant_tick") - F.col("sample_tick")) * F.col("seconds_per_tick")).between(0, 12)).withColumn("lane", F.try_element_at(lane, F.concat("site", F.lit("/"), "zone_id"))).where("lane IS NOT NULL")
        base = s.groupBy(*VIEW, "plant_tick", "site", "seconds_per_tick").agg(F.sort_array(F.collect_set("lane")).alias("ls"), F.collect_set(F.struct("lane", "player_id", F.col("sample_tick").alias("t"))).alias("xs"))
        pair = F.create_map(*[F.lit(x) for site, (a, b) in parallel.items() for x in (site, f"{a}+{b}")])
        both = F.expr("exists(xs, a -> exists(xs, b -> a.lane = split(pr, '[+]')[0] AND b.lane = split(pr, '[+]')[1] AND a.player_id <> b.player_id AND abs(a.t - b.t) * seconds_per_tick <= 3))")
        base = base.withColumn("pr", pair[F.col("site")])
        key = F.concat(F.lower("site"), F.lit("_"), F.when(both, F.replace("pr", F.lit("+"), F.lit("_"))).otherwise(F.array_join("ls", "+")))
        return occurrence(base, "site_hit", key, F.lit(True), F.col("plant_tick"))

    def first_action_awp(self, clocks: DataFrame, players: DataFrame) -> DataFrame:
        """Players whose first action within 12 s is an AWP attack, with the zone they held."""
        non_gun = "knife|grenade|flash|smoke|molotov|inferno|decoy|c4"
        c = self.live_contacts
        acts = union_all(c.select(*KEY, "tick", F.col("attacker_player_id").alias("player_id"), F.lower("weapon").alias("w"), F.lit("hit").alias("how")),
                         c.select(*KEY, "tick", F.col("victim_player_id").alias("player_id"), F.lit(None).cast("string").alias("w"), F.lit("hurt").alias("how")),
                         self.t.shots.where(~F.lower("weapon").rlike(non_gun)).join(self.v.select(*KEY, "live_tick", "last_tick").distinct(), KEY).where("tick BETWEEN live_tick AND last_tick").select(*KEY, "tick", "player_id", F.lower("weapon").alias("w"), F.lit("shot").alias("how")))
        awp = F.regexp_replace("w", "^weapon_", "") == "awp"
        per = acts.groupBy(*KEY, "player_id", "tick").agg(F.bool_or(truth(awp) & F.col("how").isin("hit", "shot")).alias("awp"), F.bool_or((F.col("how") == "shot") & F.col("w").isNotNull() & ~truth(awp)).alias("other"))
        first = per.groupBy(*KEY, "player_id").agg(F.min_by(F.struct("tick", "awp", "other"), "tick").alias("f")).select(*KEY, "player_id", "f.*").where("awp AND NOT other")
        q = self.v.join(self.members.select(*KEY, "team_id", "player_id"), KEY + ["team_id"]).join(first, KEY + ["player_id"]).join(clocks, KEY)
        q = q.where((F.col("tick") - F.col("live_tick")) * F.col("seconds_per_tick") <= 12)
        near = recent_zoned(q.select(*VIEW, "player_id", "tick", "seconds_per_tick"), self.samples)
        near = near.join(players.select("match_id", "player_id", "steam_id"), ["match_id", "player_id"], "left")
        who = F.coalesce(F.concat(F.lit("steam:"), "steam_id"), F.concat_ws(":", F.lit("match"), "match_id", F.lit("player"), "player_id"))
        return occurrence(near, "awp_opening", F.concat(who, F.lit("|"), "zone_id"), F.lit(True), F.col("tick"))

    def ct_roles(self, area: Column, players: DataFrame) -> DataFrame:
        """Anchor, mid and rotator of every map: share of observed early rounds, with tie-breaks."""
        s = self.v.where("side = 'CT'").join(self.mine.where("alive AND zone_id IS NOT NULL").select(*KEY, "team_id", "player_id", "tick", "zone_id"), KEY + ["team_id"])
        s = s.where((F.col("tick") >= F.col("live_tick")) & (F.col("tick") <= F.col("live_tick") + self.cfg.setup_window)).withColumn("area", area)
        s = s.join(players.select("match_id", "player_id", "steam_id"), ["match_id", "player_id"], "left")
        who = F.coalesce(F.concat(F.lit("steam:"), "steam_id"), F.concat_ws(":", F.lit("occurrence"), "match_id", "player_id"))
        per = s.groupBy("profile_id", "map_name", who.alias("identity_key"), *KEY).agg(F.collect_set("area").alias("areas"))
        roles = F.array_compact(F.array(F.when(F.array_contains("areas", "a"), F.lit("a_anchor")), F.when(F.array_contains("areas", "b"), F.lit("b_anchor")), F.when(F.array_contains("areas", "mid"), F.lit("mid_sniper")), F.when(F.size("areas") >= 2, F.lit("rotator"))))
        seen = per.groupBy("profile_id", "map_name", "identity_key").agg(F.count("*").alias("denominator"))
        r = per.select("*", F.explode(roles).alias("role")).groupBy("profile_id", "map_name", "identity_key", "role").agg(F.count("*").alias("numerator"), F.countDistinct("match_id").alias("match_count"))
        r = r.join(seen, ["profile_id", "map_name", "identity_key"]).withColumn("frequency", F.col("numerator") / F.col("denominator"))
        r = r.where((F.col("role") != "rotator") | ((F.col("numerator") >= self.cfg.min_rotator_rounds) & (F.col("frequency") >= self.cfg.min_rotator_share)))
        best = F.min(F.struct((-F.col("frequency")).alias("f"), (-F.col("numerator")).alias("n"), (-F.col("denominator")).alias("d"), F.col("identity_key"), F.col("match_count"))).alias("b")
        return r.groupBy("profile_id", "map_name", "role").agg(best).select("profile_id", "map_name", "role", "b.identity_key", (-F.col("b.n")).alias("numerator"), (-F.col("b.d")).alias("denominator"), (-F.col("b.f")).alias("frequency"), "b.match_count")


def categorical(occ: DataFrame) -> DataFrame:
    """Share of each key among all occurrences of its map and side."""
    return categorical_counts(occ.groupBy(*SCOPE, "key", "match_id").agg(F.count("*").alias("n")))


def categorical_counts(counts: DataFrame) -> DataFrame:
    """The same from occurrences that are counted per match."""
    g = counts.groupBy(*SCOPE, "key").agg(F.sum("n").alias("numerator"), F.count("*").alias("match_count"))
    return g.withColumn("denominator", F.sum("numerator").over(Window.partitionBy(*SCOPE))).withColumn("frequency", ratio(F.col("numerator"), F.col("denominator")))


def binary(occ: DataFrame) -> DataFrame:
    """Positive share of each key."""
    g = occ.groupBy(*SCOPE, "key").agg(count_if(F.col("positive")).alias("numerator"), F.count("*").alias("denominator"), F.countDistinct("match_id").alias("match_count"))
    return g.withColumn("frequency", ratio(F.col("numerator"), F.col("denominator")))


def metrics(occ: DataFrame) -> DataFrame:
    """Total, mean and exact median of every metric of a key."""
    m = occ.select(*SCOPE, "key", F.explode("metrics").alias("metric", "v"))
    return m.groupBy(*SCOPE, "key", "metric").agg(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.expr("percentile(v, 0.5)").alias("median"))


def evidence(occ: DataFrame) -> DataFrame:
    """Merged evidence per round: tick span and number of units."""
    return occ.groupBy(*SCOPE, "key", "match_id", "round_number").agg(F.min("tick").alias("tick_start"), F.max("tick").alias("tick_end"), F.count("*").alias("units"))


def capability(eligible: DataFrame, covered: DataFrame, insights: DataFrame, keys: list[str], forced: tuple[str, ...] = ()) -> DataFrame:
    """Eligible, covered and insight counts with a status."""
    q = eligible.join(covered, keys, "left").join(insights.groupBy(*keys).agg(F.count("*").alias("insight_count")), keys, "left").fillna(0, ["covered", "insight_count"])
    c = F.col
    part = (c("covered") < c("eligible")) | c("insight_type").isin(*forced)
    return q.withColumn("status", F.when((c("eligible") == 0) | (c("covered") == 0), "unavailable").when(part, "partial").otherwise("available"))


def risk(score: Column) -> Column:
    return F.when(score >= 0.45, "high").when(score >= 0.25, "medium").otherwise("low")


def _flip(side: str = "side") -> Column:
    return F.when(F.col(side) == "T", "CT").otherwise("T")


def opening_vs_trade(opponent: DataFrame, ours: DataFrame, pairs: DataFrame) -> DataFrame:
    """Their opening success against our untraded first deaths, same map and opposite side."""
    o = opponent.where("insight_type = 'entry_structure' AND key = 'opening_duel_success'").select(F.col("profile_id").alias("opponent_id"), "map_name", F.col("side").alias("opponent_side"), F.col("frequency").alias("their_share"), _flip().alias("side"))
    m = ours.where("insight_type = 'trade_structure' AND key = 'opening_death_traded'").select(F.col("profile_id").alias("own_id"), "map_name", "side", F.col("frequency").alias("our_share"))
    q = pairs.join(o, "opponent_id").join(m, ["own_id", "map_name", "side"])
    score = F.col("their_share") * (1.0 - F.col("our_share"))
    return q.withColumn("score", score).withColumn("risk", risk(score))


def opening_vs_spacing(opponent: DataFrame, ours: DataFrame, pairs: DataFrame) -> DataFrame:
    """Their opening success against our isolation at the earliest checkpoint."""
    o = opponent.where("insight_type = 'entry_structure' AND key = 'opening_duel_success'").select(F.col("profile_id").alias("opponent_id"), "map_name", F.col("side").alias("opponent_side"), F.col("frequency").alias("their_share"), _flip().alias("side"))
    s = ours.where("insight_type = 'spacing_profile'").withColumn("at", F.split("key", ":")[1].try_cast("int"))
    s = s.groupBy(F.col("profile_id").alias("own_id"), "map_name", "side").agg(F.min_by("frequency", F.struct(F.coalesce("at", F.lit(2**31 - 1)), "key")).alias("our_share"))
    q = pairs.join(o, "opponent_id").join(s, ["own_id", "map_name", "side"])
    score = F.col("their_share") * F.col("our_share")
    return q.withColumn("score", score).withColumn("risk", risk(score))


def common_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("lobby", "map_name").intersect(b.select("lobby", "map_name"))


def representatives(insights: DataFrame, by_side: bool = True) -> DataFrame:
    """First insight per type and side, best first."""
    group = ["profile_id", "insight_type"] + (["side"] if by_side else [])
    w = Window.partitionBy(*group).orderBy(F.desc("denominator"), F.desc("frequency"), "map_name", "side", "key")
    return insights.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def highlights(insights: DataFrame, limit: int = 3) -> DataFrame:
    r = representatives(insights, by_side=False)
    w = Window.partitionBy("profile_id").orderBy(F.desc("denominator"), F.desc("frequency"), "insight_type")
    return r.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def round_robin(insights: DataFrame) -> DataFrame:
    """Order over types: best of each type, then second best of each, and so on."""
    w = Window.partitionBy("profile_id", "insight_type").orderBy(F.desc("denominator"), F.desc("frequency"), "map_name", "side", "key")
    r = insights.withColumn("turn", F.row_number().over(w))
    return r.withColumn("position", F.row_number().over(Window.partitionBy("profile_id").orderBy("turn", "insight_type")))
