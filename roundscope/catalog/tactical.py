"""Tactical, comparison and decision queries and oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import shared, shared_union, text, union_all
from ..operators import economy as K
from ..plans import decisions as P
from ..plans import patterns as M
from ..plans import tactical as O
from .facts import _zoned, facts, zone_points
from .patterns import frozen
from ..sources.store import shared_folder
from .registry import cte, query
from .space import AREAS, spatial
from .stats import stats

AGE = 32
CFG = O.TacticalConfig(max_age=AGE)
RATE = 64.0
LANES = {"A": {"mid1": "connector", "mid2": "ramp", "bombsite_a0": "palace"}, "B": {"mid2": "short", "mid10": "apps", "bombsite_b3": "market"}}
PARALLEL = {"A": ("connector", "ramp"), "B": ("short", "apps")}


def view(t):
    r = t.rounds.where("is_complete AND NOT is_warmup").select("match_id", "round_id", "round_number", "t_team_id", "ct_team_id", "winner_side", F.col("start_tick").alias("round_start"),
                                                             F.col("freeze_end_tick").alias("live_tick"), F.col("official_end_tick").alias("last_tick"))
    q = t.tactical_selections.join(t.matches.select("match_id", "map_name"), "match_id").join(r, "match_id")
    side = F.when(F.col("team_id") == F.col("t_team_id"), "T").when(F.col("team_id") == F.col("ct_team_id"), "CT")
    other = F.when(F.col("team_id") == F.col("t_team_id"), F.col("ct_team_id")).otherwise(F.col("t_team_id"))
    q = q.withColumn("side", side).where("side IS NOT NULL").withColumn("won", F.col("winner_side") == F.col("side")).withColumn("opponent_team_id", other)
    return q.select(*O.VIEW, "round_start", "live_tick", "last_tick", "won", "opponent_team_id")


def tactical(t) -> O.Tactical:
    def build():
        s = spatial(t).snapshots.where("x IS NOT NULL").select("match_id", "round_id", "tick", "player_id", "team_id", "side", "alive", "x", "y", "z", "utility")
        f = facts(t)
        return O.Tactical(shared(view(t)), shared(zone_points(t, s)), t, stats(t).trades, f.plants, f.people, CFG)

    return t.layer("tactical", build)


def clock_events(t):
    e = union_all(*[getattr(t, n).select("match_id", "round_id", "tick", "event_id") for n in ("kills", "damages", "shots")])
    return e.withColumn("game_time", F.col("tick") / 64.0 + F.when(F.col("event_id") % 97 == 5, 0.5).otherwise(0.0))


def clocks(t):
    return t.layer("clocks", lambda: shared(O.clock_fit(clock_events(t))))


cte("tv", """SELECT s.profile_id, r.match_id, r.round_id, r.round_number, s.team_id, CASE WHEN s.team_id = r.t_team_id THEN 'T' ELSE 'CT' END AS side, m.map_name, r.start_tick AS round_start, r.freeze_end_tick AS live_tick, r.official_end_tick AS last_tick,
  r.winner_side = CASE WHEN s.team_id = r.t_team_id THEN 'T' ELSE 'CT' END AS won, CASE WHEN s.team_id = r.t_team_id THEN r.ct_team_id ELSE r.t_team_id END AS opponent_team_id FROM tactical_selections s JOIN matches m ON m.match_id = s.match_id JOIN er r ON r.match_id = s.match_id""")
cte("tsm", _zoned("snp", "s.match_id, s.round_id, s.tick, s.player_id, s.team_id, s.side, s.alive, s.x, s.y, s.z, s.utility") + " WHERE s.x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.round_id, s.tick, s.player_id ORDER BY zz.priority DESC, zz.area, zz.zone_id) = 1")
cte("tk", "SELECT * FROM kills WHERE attacker_player_id IS NOT NULL AND victim_player_id IS NOT NULL AND attacker_team_id <> victim_team_id AND NOT coalesce(is_teamkill, FALSE) AND NOT coalesce(is_suicide, FALSE)")
cte("tco", "SELECT round_id, tick, event_id, attacker_player_id, victim_player_id, attacker_team_id, victim_team_id, weapon FROM damages WHERE damage_health > 0 AND attacker_team_id <> victim_team_id UNION ALL SELECT round_id, tick, event_id, attacker_player_id, victim_player_id, attacker_team_id, victim_team_id, weapon FROM tk")
VC = "profile_id, match_id, round_id, round_number, team_id, side, map_name"
VV = ", ".join("v." + c for c in VC.split(", "))
OC = f"{VC}, insight_type, key, positive, tick"


def occ(kind, key, positive, tick, body):
    return f"SELECT {VV}, '{kind}' AS insight_type, {key} AS key, coalesce({positive}, FALSE) AS positive, CAST({tick} AS INT) AS tick {body}"


cte("ccl", "SELECT match_id, round_id, tick, tick / 64.0::DOUBLE + CASE WHEN event_id % 97 = 5 THEN 0.5::DOUBLE ELSE 0 END AS g FROM kills UNION ALL SELECT match_id, round_id, tick, tick / 64.0::DOUBLE + CASE WHEN event_id % 97 = 5 THEN 0.5::DOUBLE ELSE 0 END FROM damages UNION ALL SELECT match_id, round_id, tick, tick / 64.0::DOUBLE + CASE WHEN event_id % 97 = 5 THEN 0.5::DOUBLE ELSE 0 END FROM shots")
cte("ccp", "SELECT match_id, round_id, tick, min(g) AS lo, max(g) AS hi FROM ccl GROUP BY 1, 2, 3")
cte("cce", "SELECT match_id, round_id, min(tick) AS t0, arg_min(lo, tick) AS g0, (arg_max(lo, tick) - arg_min(lo, tick)) / (max(tick) - min(tick)) AS slope FROM ccp GROUP BY 1, 2 HAVING count(*) >= 2 AND bool_and(hi - lo <= 0.002) AND arg_max(lo, tick) - arg_min(lo, tick) >= 1")
cte("clk", "SELECT p.match_id, p.round_id, any_value(e.slope) AS seconds_per_tick FROM ccp p JOIN cce e USING (round_id) WHERE e.slope BETWEEN 0.001 AND 0.1 GROUP BY 1, 2 HAVING max(abs(p.lo - (e.g0 + (p.tick - e.t0) * e.slope))) <= 0.02")


@query("o01_source_clock", "SELECT match_id, round_id, round(seconds_per_tick, 9) AS seconds_per_tick FROM clk")
def _(t):
    return clocks(t).withColumn("seconds_per_tick", F.round("seconds_per_tick", 9))


def _occ(name, sql, fn):
    cte(name, sql)

    @query(name, sql)
    def _(t):
        return fn(t).select(*OC.split(", "))


RECENT = "s.alive AND s.zone_id IS NOT NULL AND (q.tick - s.tick) * q.seconds_per_tick BETWEEN 0 AND 0.5"
cte("trs", f"""SELECT q.match_id, q.round_id, q.player_id, q.tick, q.event_id, s.tick AS sample_tick, s.zone_id
  FROM (SELECT k.match_id, k.round_id, p.player_id, p.side, k.tick, k.event_id, c.seconds_per_tick FROM kills k JOIN fpe p ON p.round_id = k.round_id AND p.player_id = k.victim_player_id JOIN clk c ON c.round_id = k.round_id) q
  JOIN tsm s ON s.round_id = q.round_id AND s.player_id = q.player_id AND s.side = q.side AND {RECENT} QUALIFY row_number() OVER (PARTITION BY q.event_id ORDER BY s.tick DESC) = 1""")


@query("o03_recent_sample", "SELECT * FROM trs")
def _(t):
    q = t.kills.select("match_id", "round_id", F.col("victim_player_id").alias("player_id"), "tick", "event_id")
    q = q.join(tactical(t).members.select("match_id", "round_id", "player_id", "side"), ["match_id", "round_id", "player_id"]).join(clocks(t), ["match_id", "round_id"])
    return O.recent_zoned(q, tactical(t).samples).drop("side", "seconds_per_tick")


cte("tcl", """SELECT e.* FROM (SELECT round_id, tick, event_id, attacker_player_id, victim_player_id, weapon FROM damages WHERE damage_health > 0
    UNION ALL SELECT round_id, tick, event_id, attacker_player_id, victim_player_id, weapon FROM kills WHERE NOT coalesce(is_teamkill, FALSE) AND NOT coalesce(is_suicide, FALSE)) e
  JOIN (SELECT DISTINCT round_id, live_tick, last_tick FROM tv WHERE live_tick IS NOT NULL) w ON w.round_id = e.round_id AND e.tick >= w.live_tick AND (w.last_tick IS NULL OR e.tick <= w.last_tick)
  JOIN fpe a ON a.round_id = e.round_id AND a.player_id = e.attacker_player_id JOIN fpe b ON b.round_id = e.round_id AND b.player_id = e.victim_player_id WHERE a.team_id <> b.team_id""")
cte("tfc", "SELECT round_id, min(tick) AS tick FROM tcl GROUP BY 1")
cte("tph", f"""SELECT profile_id, round_id, count(DISTINCT zone_id) AS zones, bool_or(zone_id LIKE 'bombsite%') AS entry FROM (SELECT q.profile_id, q.round_id, q.player_id, s.zone_id
  FROM (SELECT v.profile_id, v.round_id, v.side, p.player_id, c.tick, k.seconds_per_tick FROM tv v JOIN tfc c ON c.round_id = v.round_id JOIN clk k ON k.round_id = v.round_id JOIN fpe p ON p.round_id = v.round_id AND p.team_id = v.team_id WHERE v.side = 'T') q
  JOIN tsm s ON s.round_id = q.round_id AND s.player_id = q.player_id AND s.side = q.side AND {RECENT} QUALIFY row_number() OVER (PARTITION BY q.profile_id, q.round_id, q.player_id ORDER BY s.tick DESC) = 1)
  WHERE NOT regexp_matches(lower(zone_id), 'spawn|base|unknown|unavailable') GROUP BY 1, 2""")
_SEC = "(c.tick - v.live_tick) * k.seconds_per_tick"
_EAR = "(coalesce((p.tick - v.live_tick) * k.seconds_per_tick >= 0 AND (p.tick - v.live_tick) * k.seconds_per_tick < 25, FALSE) OR coalesce(h.entry, FALSE))"
_occ("o02_attack_pace", occ("attack_pace", f"CASE WHEN {_SEC} < 25 AND {_EAR} THEN 'fast_hit' WHEN {_SEC} < 25 THEN 'early_contact' WHEN {_SEC} <= 60 AND coalesce(h.zones, 0) >= 2 THEN 'default_to_split' WHEN {_SEC} > 60 THEN 'late_execute' ELSE 'mid_contact' END", "TRUE", "c.tick",
     "FROM tv v JOIN tfc c ON c.round_id = v.round_id JOIN clk k ON k.round_id = v.round_id LEFT JOIN tph h ON h.profile_id = v.profile_id AND h.round_id = v.round_id LEFT JOIN fpl p ON p.round_id = v.round_id WHERE v.side = 'T'"),
     lambda t: tactical(t).pace(clocks(t), F.col("zone_id").startswith("bombsite")))
_LANE = "CASE upper(p.site_normalized) || '/' || s.zone_id " + " ".join(f"WHEN '{a}/{z}' THEN '{l}'" for a, m in LANES.items() for z, l in m.items()) + " END"
cte("tln", f"SELECT {VV}, p.tick AS pt, upper(p.site_normalized) AS site, s.player_id, s.tick AS st, {_LANE} AS lane, k.seconds_per_tick AS spt FROM tv v JOIN fpl p ON p.round_id = v.round_id AND p.site_normalized IN ('A', 'B') JOIN clk k ON k.round_id = v.round_id JOIN tsm s ON s.round_id = v.round_id AND s.team_id = v.team_id AND s.alive AND s.zone_id IS NOT NULL AND (p.tick - s.tick) * k.seconds_per_tick BETWEEN 0 AND 12 WHERE v.side = 'T'")
cte("tlp", "SELECT DISTINCT a.profile_id, a.round_id FROM tln a JOIN tln b ON b.profile_id = a.profile_id AND b.round_id = a.round_id AND a.player_id <> b.player_id AND abs(a.st - b.st) * a.spt <= 3 WHERE (a.site = 'A' AND a.lane = 'connector' AND b.lane = 'ramp') OR (a.site = 'B' AND a.lane = 'short' AND b.lane = 'apps')")
_occ("o04_approach_corridors", f"SELECT {VC}, 'site_hit' AS insight_type, CASE WHEN EXISTS (SELECT 1 FROM tlp p WHERE p.profile_id = x.profile_id AND p.round_id = x.round_id) THEN CASE site WHEN 'A' THEN 'a_connector_ramp' ELSE 'b_short_apps' END ELSE lower(site) || '_' || string_agg(DISTINCT lane, '+' ORDER BY lane) END AS key, TRUE AS positive, pt AS tick FROM tln x WHERE lane IS NOT NULL GROUP BY {VC}, site, pt",
     lambda t: tactical(t).corridors(clocks(t), LANES, PARALLEL))
cte("taa", """SELECT round_id, tick, attacker_player_id AS pid, lower(weapon) = 'awp' AS awp, FALSE AS other FROM tcl UNION ALL SELECT round_id, tick, victim_player_id, FALSE, FALSE FROM tcl UNION ALL SELECT s.round_id, s.tick, s.player_id, lower(s.weapon) = 'awp', lower(s.weapon) <> 'awp' FROM shots s JOIN rounds r USING (round_id) WHERE s.tick BETWEEN r.freeze_end_tick AND r.official_end_tick AND s.round_id IN (SELECT round_id FROM tv)""")
cte("taf", "SELECT round_id, pid, tick FROM (SELECT round_id, pid, tick, bool_or(awp) AS awp, bool_or(other) AS other FROM taa GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY round_id, pid ORDER BY tick) = 1) WHERE awp AND NOT other")
_occ("o05_awp_opening", f"SELECT {VC}, insight_type, coalesce('steam:' || steam_id, 'match:' || match_id || ':player:' || pid) || '|' || zone_id AS key, TRUE AS positive, tick FROM (SELECT {VV}, 'awp_opening' AS insight_type, a.pid, a.tick, s.zone_id, pl.steam_id FROM tv v JOIN fpe p ON p.round_id = v.round_id AND p.team_id = v.team_id JOIN taf a ON a.round_id = v.round_id AND a.pid = p.player_id JOIN clk k ON k.round_id = v.round_id "
     f"JOIN tsm s ON s.round_id = v.round_id AND s.player_id = a.pid AND s.side = v.side AND {RECENT.replace('q.tick', 'a.tick').replace('q.seconds', 'k.seconds')} LEFT JOIN players pl ON pl.match_id = v.match_id AND pl.player_id = a.pid WHERE (a.tick - v.live_tick) * k.seconds_per_tick <= 12 QUALIFY row_number() OVER (PARTITION BY v.profile_id, v.round_id, a.pid ORDER BY s.tick DESC) = 1)",
     lambda t: tactical(t).first_action_awp(clocks(t), t.players))
_AREA = "CASE s.zone_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**AREAS, "bombsite_a8": "a", "bombsite_b11": "b"}.items()) + " END"
cte("tro", f"""SELECT v.profile_id, v.map_name, coalesce('steam:' || p.steam_id, 'occurrence:' || v.match_id || ':' || s.player_id) AS identity_key, v.match_id, v.round_id, list(DISTINCT {_AREA}) FILTER ({_AREA} IS NOT NULL) AS areas FROM tv v JOIN tsm s ON s.round_id = v.round_id AND s.team_id = v.team_id AND s.alive AND s.zone_id IS NOT NULL AND s.tick BETWEEN v.live_tick AND v.live_tick + 1280
  LEFT JOIN players p ON p.match_id = v.match_id AND p.player_id = s.player_id WHERE v.side = 'CT' GROUP BY 1, 2, 3, 4, 5""")
cte("trr", """SELECT r.profile_id, r.map_name, r.identity_key, r.role, count(*) AS numerator, count(DISTINCT r.match_id) AS match_count, any_value(d.n) AS denominator FROM (SELECT *, unnest(list_filter([CASE WHEN list_contains(areas, 'a') THEN 'a_anchor' END, CASE WHEN list_contains(areas, 'b') THEN 'b_anchor' END, CASE WHEN list_contains(areas, 'mid') THEN 'mid_sniper' END, CASE WHEN len(areas) >= 2 THEN 'rotator' END], lambda x: x IS NOT NULL)) AS role FROM tro) r
  JOIN (SELECT profile_id, map_name, identity_key, count(*) AS n FROM tro GROUP BY 1, 2, 3) d ON d.profile_id = r.profile_id AND d.map_name = r.map_name AND d.identity_key = r.identity_key GROUP BY 1, 2, 3, 4""")


@query("o06_ct_roles", """SELECT profile_id, map_name, role, identity_key, numerator, denominator, numerator / denominator AS frequency, match_count FROM trr WHERE role <> 'rotator' OR (numerator >= 2 AND numerator / denominator >= 0.2)
  QUALIFY row_number() OVER (PARTITION BY profile_id, map_name, role ORDER BY numerator / denominator DESC, numerator DESC, denominator DESC, identity_key) = 1""")
def _(t):
    lookup = {**AREAS, "bombsite_a8": "a", "bombsite_b11": "b"}
    area = F.try_element_at(F.create_map(*[F.lit(x) for kv in lookup.items() for x in kv]), F.col("zone_id"))
    return tactical(t).ct_roles(area, t.players)


cte("tcp", f"SELECT {VV}, o.off, s.player_id, s.tick, s.x, s.y, s.z, s.zone_id FROM tv v, LATERAL (SELECT unnest([640, 1280, 1920]) AS off) o, tsm s WHERE s.round_id = v.round_id AND s.team_id = v.team_id AND s.alive AND v.live_tick + o.off - s.tick BETWEEN 0 AND {AGE} QUALIFY row_number() OVER (PARTITION BY v.profile_id, v.round_id, o.off, s.player_id ORDER BY s.tick DESC) = 1")
cte("tfo", f"SELECT {VC}, off, string_agg(zone_id || CASE WHEN n > 1 THEN '*' || n ELSE '' END, '+' ORDER BY zone_id) AS k, max(tick) AS tick, sum(n) AS known FROM (SELECT {VC}, off, zone_id, count(*) AS n, max(tick) AS tick FROM tcp WHERE zone_id IS NOT NULL GROUP BY {VC}, off, zone_id) GROUP BY {VC}, off HAVING sum(n) >= 2")
cte("o_path", f"SELECT {VC}, 'path_cluster' AS insight_type, string_agg(off || ':' || k, '|' ORDER BY off) AS key, TRUE AS positive, max(tick) AS tick FROM tfo GROUP BY {VC} HAVING count(*) = 3")
_occ("o07_formations", "SELECT * FROM o_path", lambda t: tactical(t).formations())
cte("tef", f"SELECT {VV}, v.live_tick, v.round_start, e.effect_id, e.owner_player_id, e.effect_type, e.start_tick, e.end_tick FROM tv v JOIN effects e ON e.round_id = v.round_id AND e.owner_team_id = v.team_id")
cte("o_exec", f"SELECT {VC}, 'execute_package' AS insight_type, 'site:' || site || '|' || coalesce(string_agg(ty || CASE WHEN n > 1 THEN '*' || n ELSE '' END, '+' ORDER BY ty), 'no_observed_effect') AS key, TRUE AS positive, pt AS tick FROM (SELECT {VV}, p.site_normalized AS site, p.tick AS pt, e.effect_type AS ty, count(e.effect_id) AS n FROM tv v JOIN fpl p ON p.round_id = v.round_id AND p.site_normalized IN ('A', 'B') LEFT JOIN tef e ON e.profile_id = v.profile_id AND e.round_id = v.round_id AND p.tick - e.start_tick BETWEEN 0 AND 640 WHERE v.side = 'T' GROUP BY {VV}, p.site_normalized, p.tick, e.effect_type) GROUP BY {VC}, site, pt")
_occ("o08_execute_packages", "SELECT * FROM o_exec", lambda t: tactical(t).executes())
_WE = "CASE WHEN lower(d.weapon) LIKE '%hegrenade%' THEN 'he' WHEN lower(d.weapon) LIKE '%inferno%' THEN 'fire' END"
cte("ted", f"SELECT e.profile_id, e.effect_id, d.event_id, d.damage_health, count(*) OVER (PARTITION BY e.profile_id, d.event_id) AS fits FROM tef e JOIN damages d ON d.round_id = e.round_id AND d.attacker_player_id = e.owner_player_id AND {_WE} = e.effect_type AND d.tick BETWEEN e.start_tick AND coalesce(e.end_tick, e.start_tick) + 64 AND d.victim_team_id <> e.team_id")
cte("o_out", f"SELECT {VC}, 'utility_outcome' AS insight_type, effect_type AS key, coalesce(dmg > 0, FALSE) AS positive, start_tick AS tick, coalesce(dmg, 0)::DOUBLE AS damage_health FROM tef LEFT JOIN (SELECT profile_id, effect_id, sum(damage_health) AS dmg FROM ted WHERE fits = 1 GROUP BY 1, 2) USING (profile_id, effect_id) WHERE effect_type IN ('he', 'fire') AND owner_player_id IS NOT NULL")
_occ("o09_utility_outcomes", f"SELECT {OC} FROM o_out", lambda t: tactical(t).utility_outcomes())


cte("o10_team_flashes", f"""SELECT {VC}, 'player:' || owner_player_id AS key, coalesce(bool_or(b.victim_team_id = team_id AND b.victim_player_id <> owner_player_id), FALSE) AS positive, start_tick AS tick, round(coalesce(sum(b.duration_seconds) FILTER (b.victim_team_id = team_id AND b.victim_player_id <> owner_player_id), 0), 6) AS mates, round(coalesce(sum(b.duration_seconds) FILTER (b.victim_team_id <> team_id), 0), 6) AS foes
  FROM tef e LEFT JOIN (SELECT round_id AS rid, tick AS bt, attacker_player_id AS ap, victim_player_id, victim_team_id, duration_seconds FROM blinds) b ON b.rid = e.round_id AND b.ap = e.owner_player_id AND b.bt = e.start_tick WHERE effect_type = 'flash' AND owner_player_id IS NOT NULL GROUP BY {VC}, effect_id, owner_player_id, start_tick""")


@query("o10_team_flashes", "SELECT * FROM o10_team_flashes")
def _(t):
    o = tactical(t).team_flashes()
    return o.select(*VC.split(", "), "key", "positive", "tick", F.round(F.col("metrics")["team_blind_seconds"], 6).alias("mates"), F.round(F.col("metrics")["enemy_blind_seconds"], 6).alias("foes"))


_PR = "CASE u WHEN 'flashbang' THEN 200 WHEN 'smoke' THEN 300 WHEN 'he_grenade' THEN 300 WHEN 'molotov' THEN 400 ELSE 0 END"


cte("o11_carried_utility", f"""SELECT {VC}, event_tick AS tick, utility <> '' AS positive, CASE WHEN utility = '' THEN 0 ELSE len(string_split(utility, ',')) END::DOUBLE AS items, (SELECT coalesce(sum({_PR}), 0) FROM (SELECT unnest(string_split(utility, ',')) AS u))::DOUBLE AS worth FROM (
  SELECT {VV}, k.tick AS event_tick, s.utility FROM tv v JOIN kills k ON k.round_id = v.round_id AND k.victim_team_id = v.team_id AND k.victim_player_id IS NOT NULL JOIN tsm s ON s.round_id = v.round_id AND s.player_id = k.victim_player_id AND s.alive AND s.tick < k.tick QUALIFY row_number() OVER (PARTITION BY v.profile_id, k.event_id ORDER BY s.tick DESC) = 1)""")


@query("o11_carried_utility", "SELECT * FROM o11_carried_utility")
def _(t):
    o = tactical(t).utility_losses()
    return o.select(*VC.split(", "), "tick", "positive", F.col("metrics")["utility_items"].alias("items"), F.col("metrics")["estimated_utility_value"].alias("worth"))


_occ("o12_no_direct_effect", f"SELECT {VC}, 'utility_loss' AS insight_type, 'no_direct_effect:' || effect_type AS key, CASE WHEN effect_type = 'flash' THEN NOT EXISTS (SELECT 1 FROM blinds b WHERE b.round_id = e.round_id AND b.attacker_player_id = e.owner_player_id AND b.tick = e.start_tick AND b.victim_team_id <> e.team_id) ELSE NOT EXISTS (SELECT 1 FROM ted d WHERE d.profile_id = e.profile_id AND d.effect_id = e.effect_id) END AS positive, start_tick AS tick FROM tef e WHERE owner_player_id IS NOT NULL AND effect_type IN ('he', 'fire', 'flash')",
     lambda t: tactical(t).no_direct_effect())


cte("o13_smoke_timing", f"""SELECT {VC}, 'start:' || CAST(floor((start_tick - round_start) * (1 / {RATE}::DOUBLE) / 5) * 5 AS BIGINT) AS key, start_tick AS tick, round((start_tick - round_start) * (1 / {RATE}::DOUBLE), 6) AS start_seconds, round((ct - start_tick) * (1 / {RATE}::DOUBLE), 6) AS contact_seconds FROM (SELECT e.*, (SELECT min(d.tick) FROM damages d WHERE d.round_id = e.round_id AND d.attacker_team_id <> d.victim_team_id AND e.team_id IN (d.attacker_team_id, d.victim_team_id) AND d.tick >= e.start_tick) AS ct FROM tef e WHERE effect_type = 'smoke')""")


@query("o13_smoke_timing", "SELECT * FROM o13_smoke_timing")
def _(t):
    o = tactical(t).smoke_timing(F.lit(1 / RATE))
    return o.select(*VC.split(", "), "key", "tick", F.round(F.col("metrics")["smoke_start_seconds"], 6).alias("start_seconds"), F.round(F.try_element_at("metrics", F.lit("contact_window_seconds")), 6).alias("contact_seconds"))


_D3 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_VA = ", ".join("a." + c for c in VC.split(", "))
cte("tsn", f"SELECT {VC}, off, max(d) AS far, max(tick) AS tick FROM (SELECT {_VA}, a.off, a.player_id, a.tick, min({_D3}) AS d FROM tcp a JOIN tcp b ON b.profile_id = a.profile_id AND b.round_id = a.round_id AND b.off = a.off AND b.player_id <> a.player_id GROUP BY {_VA}, a.off, a.player_id, a.tick) GROUP BY {VC}, off")
cte("tsd", f"SELECT a.profile_id, a.round_id, a.off, median({_D3}) AS med FROM tcp a JOIN tcp b ON b.profile_id = a.profile_id AND b.round_id = a.round_id AND b.off = a.off AND b.player_id > a.player_id GROUP BY 1, 2, 3")
cte("o_space", f"SELECT {VC}, 'spacing_profile' AS insight_type, 'checkpoint:' || off AS key, far > 1500 AS positive, tick, med, far FROM tsn JOIN tsd USING (profile_id, round_id, off)")


@query("o14_spacing", f"SELECT {OC}, round(med, 6) AS med, round(far, 6) AS far FROM o_space")
def _(t):
    o = tactical(t).spacing()
    return o.select(*OC.split(", "), F.round(F.col("metrics")["median_pairwise_distance"], 6).alias("med"), F.round(F.col("metrics")["maximum_nearest_teammate_distance"], 6).alias("far"))


cte("top1", "SELECT round_id, tick, event_id, attacker_team_id AS ka, victim_team_id AS kv FROM (SELECT *, rank() OVER (PARTITION BY round_id ORDER BY tick) AS rk, count(*) OVER (PARTITION BY round_id, tick) AS n FROM tk) WHERE rk = 1 AND n = 1")
cte("o_entry", occ("entry_structure", "'opening_duel_success'", "o.ka = v.team_id", "o.tick", "FROM tv v JOIN top1 o ON o.round_id = v.round_id"))
cte("o_trade", occ("trade_structure", "'opening_death_traded'", "t.original_event_id IS NOT NULL", "o.tick", "FROM tv v JOIN top1 o ON o.round_id = v.round_id AND o.kv = v.team_id LEFT JOIN trd t ON t.original_event_id = o.event_id AND t.team_id = v.team_id"))
_occ("o15_entries_and_trades", f"SELECT {OC} FROM o_entry UNION ALL SELECT {OC} FROM o_trade", lambda t: union_all(tactical(t).entries(), tactical(t).opening_deaths_traded()))
cte("o_rot", f"SELECT {VC}, 'rotation_transition' AS insight_type, p || '->' || zone_id AS key, TRUE AS positive, tick FROM (SELECT {VV}, s.tick, s.zone_id, lag(s.zone_id) OVER (PARTITION BY v.profile_id, v.round_id, s.player_id ORDER BY s.tick) AS p FROM tv v JOIN (SELECT round_id, min(tick) AS tick FROM tco GROUP BY 1) c ON c.round_id = v.round_id JOIN tsm s ON s.round_id = v.round_id AND s.team_id = v.team_id AND s.alive AND s.zone_id IS NOT NULL AND s.tick BETWEEN c.tick AND c.tick + 1280 WHERE v.side = 'CT') WHERE p <> zone_id")
_occ("o16_zone_transitions", "SELECT * FROM o_rot", lambda t: tactical(t).transitions())
cte("tkf", "SELECT round_id, victim_player_id AS pid, min(tick) AS tick FROM tk GROUP BY 1, 2")
cte("tcs", f"SELECT {VV}, v.won, x.tick, (SELECT count(*) FROM fpe p WHERE p.round_id = v.round_id AND p.team_id = v.team_id) AS n1, (SELECT count(*) FROM fpe p WHERE p.round_id = v.round_id AND p.team_id <> v.team_id) AS n2, (SELECT count(*) FROM fpe p JOIN tkf d ON d.round_id = p.round_id AND d.pid = p.player_id WHERE p.round_id = v.round_id AND p.team_id = v.team_id AND d.tick <= x.tick) AS d1, (SELECT count(*) FROM fpe p JOIN tkf d ON d.round_id = p.round_id AND d.pid = p.player_id WHERE p.round_id = v.round_id AND p.team_id <> v.team_id AND d.tick <= x.tick) AS d2 FROM tv v JOIN (SELECT DISTINCT round_id, tick FROM tkf) x ON x.round_id = v.round_id")
cte("o_clutch", f"SELECT {VC}, 'clutch_behavior' AS insight_type, 'one_vs_many_conversion' AS key, won AS positive, tick FROM tcs WHERE n1 >= 2 AND n2 >= 2 AND n1 - d1 = 1 AND n2 - d2 >= 2 AND won IS NOT NULL QUALIFY row_number() OVER (PARTITION BY profile_id, round_id ORDER BY tick) = 1")
_occ("o17_one_against_many", "SELECT * FROM o_clutch", lambda t: tactical(t).clutches())
cte("o_save", occ("save_behavior", "'save_observed'", "s.saved", "s.tick", "FROM tv v JOIN save_signals s ON s.round_id = v.round_id AND s.team_id = v.team_id AND s.saved IS NOT NULL"))
_occ("o18_save_share", "SELECT * FROM o_save", lambda t: tactical(t).saves(t.save_signals))


@query("o19_heat_cells", "SELECT v.profile_id, v.map_name, v.side, CAST(floor(s.x / 512) AS BIGINT) AS cell_x, CAST(floor(s.y / 512) AS BIGINT) AS cell_y, count(*) AS numerator FROM tv v JOIN tsm s ON s.round_id = v.round_id AND s.team_id = v.team_id AND s.alive GROUP BY 1, 2, 3, 4, 5")
def _(t):
    return tactical(t).heat_cells()


SCP = "profile_id, insight_type, map_name, side"
cte("ocall", " UNION ALL ".join(f"SELECT {OC} FROM {x}" for x in ("o_path", "o_exec", "o_rot", "o02_attack_pace", "o04_approach_corridors", "o05_awp_opening")) + f" UNION ALL SELECT {VC}, 'smoke_timing', key, TRUE, tick FROM o13_smoke_timing"
    + f" UNION ALL SELECT {VV}, 'heatmap_cell', 'cell:' || CAST(floor(s.x / 512) AS BIGINT) || ':' || CAST(floor(s.y / 512) AS BIGINT), TRUE, s.tick FROM tv v JOIN tsm s ON s.round_id = v.round_id AND s.team_id = v.team_id AND s.alive")
cte("ocat", f"SELECT {SCP}, key, numerator, match_count, CAST(sum(numerator) OVER (PARTITION BY {SCP}) AS BIGINT) AS denominator, numerator / sum(numerator) OVER (PARTITION BY {SCP}) AS frequency FROM (SELECT {SCP}, key, count(*) AS numerator, count(DISTINCT match_id) AS match_count FROM (SELECT * FROM ocall) GROUP BY {SCP}, key)")
cte("oball", " UNION ALL ".join(f"SELECT {OC} FROM {x}" for x in ("o_out", "o_space", "o_entry", "o_trade", "o_clutch", "o_save", "o12_no_direct_effect"))
    + f" UNION ALL SELECT {VC}, 'team_flash', key, positive, tick FROM o10_team_flashes UNION ALL SELECT {VC}, 'utility_loss', 'carried_on_death', positive, tick FROM o11_carried_utility")
cte("obin", f"SELECT {SCP}, key, count(*) FILTER (positive) AS numerator, count(*) AS denominator, count(DISTINCT match_id) AS match_count, count(*) FILTER (positive) / count(*) AS frequency FROM oball GROUP BY {SCP}, key")


def cat_occ(t):
    """Every categorical family but the heat cells, which are counted before they become occurrences."""
    x, rate = tactical(t), F.lit(1 / RATE)

    def build():
        clocked = x.pace(clocks(t), F.col("zone_id").startswith("bombsite")), x.corridors(clocks(t), LANES, PARALLEL), x.first_action_awp(clocks(t), t.players)
        return shared_union(x.formations(), x.executes(), x.transitions(), *clocked, x.smoke_timing(rate))

    return t.layer("cat_occ", build)


def bin_occ(t):
    x = tactical(t)
    return t.layer("bin_occ", lambda: shared_union(x.utility_outcomes(), x.spacing(), x.entries(), x.opening_deaths_traded(), x.clutches(), x.saves(t.save_signals), x.team_flashes(), x.utility_losses(), x.no_direct_effect()))


def insights(t):
    return t.layer("insights", lambda: shared_union(O.binary(bin_occ(t)), *share_parts(t)))


def share_parts(t):
    return O.categorical(cat_occ(t)), O.categorical_counts(tactical(t).heat_counts())


def shares(t):
    """Of every categorical family."""
    return union_all(*share_parts(t))


@query("o20_categorical_share", "SELECT * FROM ocat")
def _(t):
    return shares(t)


@query("o21_binary_share", "SELECT * FROM obin")
def _(t):
    return O.binary(bin_occ(t))


@query("o22_metric_summary", f"""SELECT {SCP}, key, metric, round(sum(v), 6) AS total, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM (SELECT {SCP}, key, 'damage_health' AS metric, damage_health AS v FROM o_out UNION ALL SELECT {SCP}, key, 'median_pairwise_distance', med FROM o_space UNION ALL SELECT {SCP}, key, 'maximum_nearest_teammate_distance', far FROM o_space) GROUP BY {SCP}, key, metric""")
def _(t):
    m = O.metrics(bin_occ(t).where("insight_type IN ('utility_outcome', 'spacing_profile')"))
    return m.select(*SCP.split(", "), "key", "metric", *[F.round(c, 6).alias(c) for c in ("total", "mean", "median")])


@query("o23_evidence_by_round", f"SELECT {SCP}, key, match_id, round_number, min(tick) AS tick_start, max(tick) AS tick_end, count(*) AS units FROM oball GROUP BY {SCP}, key, match_id, round_number")
def _(t):
    return O.evidence(bin_occ(t))


@query("o24_tactical_capability", """SELECT e.profile_id, 'path_cluster' AS insight_type, e.n AS eligible, coalesce(c.n, 0) AS covered, coalesce(i.n, 0) AS insight_count, CASE WHEN e.n = 0 OR coalesce(c.n, 0) = 0 THEN 'unavailable' WHEN coalesce(c.n, 0) < e.n THEN 'partial' ELSE 'available' END AS status FROM (SELECT profile_id, count(*) AS n FROM tv GROUP BY 1) e
  LEFT JOIN (SELECT profile_id, count(*) AS n FROM o_path GROUP BY 1) c USING (profile_id) LEFT JOIN (SELECT profile_id, count(*) AS n FROM ocat WHERE insight_type = 'path_cluster' GROUP BY 1) i USING (profile_id)""")
def _(t):
    x = tactical(t)
    e = x.v.groupBy("profile_id").agg(F.count("*").alias("eligible")).withColumn("insight_type", F.lit("path_cluster"))
    p = x.formations()
    c = p.groupBy("profile_id", "insight_type").agg(F.count("*").alias("covered"))
    return O.capability(e, c, O.categorical(p), ["profile_id", "insight_type"])


@query("o25_tactical_inputs", "SELECT * FROM tv")
def _(t):
    return view(t)


_H2 = "SELECT p.own_id, m.map_name, m.side, p.opponent_id, o.side AS opponent_side, o.frequency AS their_share, m.frequency AS our_share, {0} AS score, CASE WHEN {0} >= 0.45 THEN 'high' WHEN {0} >= 0.25 THEN 'medium' ELSE 'low' END AS risk FROM profile_pairs p JOIN obin o ON o.profile_id = p.opponent_id AND o.insight_type = 'entry_structure' JOIN {1} m ON m.profile_id = p.own_id AND m.map_name = o.map_name AND m.side <> o.side"


@query("o26_opening_vs_trade", _H2.format("(o.frequency * (1.0 - m.frequency))", "(SELECT * FROM obin WHERE insight_type = 'trade_structure')"))
def _(t):
    return O.opening_vs_trade(insights(t), insights(t), t.profile_pairs)


@query("o27_opening_vs_spacing", _H2.format("(o.frequency * m.frequency)", "(SELECT profile_id, map_name, side, arg_min(frequency, CAST(string_split(key, ':')[2] AS INT)) AS frequency FROM obin WHERE insight_type = 'spacing_profile' GROUP BY 1, 2, 3)"))
def _(t):
    return O.opening_vs_spacing(insights(t), insights(t), t.profile_pairs)


@query("o28_common_maps", "SELECT DISTINCT lobby, map_name FROM tactical_selections s JOIN matches m USING (match_id) WHERE own = 0 INTERSECT SELECT lobby, map_name FROM tactical_selections s JOIN matches m USING (match_id) WHERE own = 1".replace("SELECT DISTINCT lobby", "SELECT DISTINCT s.lobby").replace("INTERSECT SELECT lobby", "INTERSECT SELECT s.lobby"))
def _(t):
    s = t.tactical_selections.join(t.matches.select("match_id", "map_name"), "match_id")
    return O.common_maps(s.where("own = 0"), s.where("own = 1"))


cte("madv", "SELECT n.round_id, x.team_id, min(n.tick) AS tick FROM trn n JOIN ro r USING (round_id), LATERAL (SELECT r.t_team_id AS team_id, n.ta - n.ca AS d UNION ALL SELECT r.ct_team_id, n.ca - n.ta) x WHERE r.lineup_valid AND x.d >= 2 GROUP BY 1, 2")
cte("mrow", """SELECT v.profile_id, v.match_id, v.round_id, v.round_number, v.side, v.map_name, v.team_id, 'lost_plus_two' AS mistake_type, a.tick, NULL::BIGINT AS event_id, NOT v.won AS happened FROM tv v JOIN madv a ON a.round_id = v.round_id AND a.team_id = v.team_id WHERE v.won IS NOT NULL
  UNION ALL SELECT v.profile_id, v.match_id, v.round_id, v.round_number, v.side, v.map_name, v.team_id, 'lost_vs_full_eco', NULL, NULL, NOT v.won FROM tv v JOIN ktm k ON k.round_id = v.round_id AND k.team_id = v.opponent_team_id AND k.buy_type = 'eco' AND k.eligible WHERE v.won IS NOT NULL
  UNION ALL SELECT v.profile_id, v.match_id, v.round_id, v.round_number, v.side, v.map_name, v.team_id, 'early_untraded_death', k.tick, k.event_id, k.event_id NOT IN (SELECT original_event_id FROM trd) FROM tv v JOIN tk k ON k.round_id = v.round_id AND k.victim_team_id = v.team_id AND k.tick >= v.live_tick AND (k.tick - v.live_tick) / 64.0 <= 15""")


@query("o29_critical_mistakes", "SELECT m.* EXCLUDE (happened), n.numerator, n.denominator, n.numerator / n.denominator AS frequency FROM mrow m JOIN (SELECT profile_id, mistake_type, count(*) FILTER (happened) AS numerator, count(*) AS denominator FROM mrow GROUP BY 1, 2) n ON n.profile_id = m.profile_id AND n.mistake_type = m.mistake_type WHERE happened")
def _(t):
    s = stats(t)
    side = F.array(F.struct(F.lit("T").alias("s"), (F.col("t_alive_after") - F.col("ct_alive_after")).alias("d")), F.struct(F.lit("CT").alias("s"), (F.col("ct_alive_after") - F.col("t_alive_after")).alias("d")))
    r = s.roster.where("lineup_valid").select("match_id", "round_id", "t_team_id", "ct_team_id")
    adv = s.transitions.select("match_id", "round_id", "tick", F.inline(side)).where("d >= 2").join(r, ["match_id", "round_id"])
    adv = adv.groupBy("match_id", "round_id", F.when(F.col("s") == "T", F.col("t_team_id")).otherwise(F.col("ct_team_id")).alias("team_id")).agg(F.min("tick").alias("tick"))
    return P.mistakes(tactical(t).v, adv, K.Economy(t).teams, tactical(t).kills, s.trades, RATE)


# -- decisions ---------------------------------------------------------------
PF = "pattern_id, profile_id, pattern_type, map_name, side, buy_type, value, numerator, denominator, frequency"
cte("dfn", "SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY frequency DESC, denominator DESC, pattern_id) AS INT) AS rank FROM pfr WHERE numerator > 0")


@query("o30_findings", f"SELECT {PF}, rank FROM dfn")
def _(t):
    return P.findings(frozen(t)[1]).select(*PF.split(", "), "rank")


def found(t):
    p, f, rounds = frozen(t)
    ev = rounds.where("contributed").groupBy("pattern_id").agg(F.count("*").alias("total"), F.count_if(F.col("round_number") % 11 != 3).alias("with_tick"))
    corpus = t.selections.groupBy("profile_id").agg(F.count("*").alias("matches"))
    return P.readiness(P.findings(f), ev, corpus)


cte("dre", """SELECT f.*, concat_ws(',', CASE WHEN f.buy_type = 'none' THEN 'buy_type_unavailable' END, CASE WHEN c.n < 15 THEN 'corpus_below_minimum' END, CASE WHEN f.denominator_match_count < 5 THEN 'finding_matches_below_minimum' END, CASE WHEN f.small_sample THEN 'finding_sample_below_minimum' END, CASE WHEN f.availability = 'partial' THEN 'source_pattern_partial' END) AS limitations,
  CASE WHEN e.w <> e.n THEN 'evidence_tick_partial' ELSE '' END AS blocking_reasons FROM dfn f JOIN (SELECT profile_id, count(*) AS n FROM selections GROUP BY 1) c USING (profile_id) LEFT JOIN (SELECT pattern_id, count(*) AS n, count(*) FILTER (round_number % 11 <> 3) AS w FROM pct WHERE contributed GROUP BY 1) e ON e.pattern_id = f.pattern_id""")
_ST = "CASE WHEN blocking_reasons <> '' THEN 'blocked' WHEN limitations <> '' THEN 'limited' ELSE 'ready' END"


@query("o31_readiness", f"SELECT pattern_id, profile_id, limitations, blocking_reasons, {_ST} AS status FROM dre")
def _(t):
    r = found(t)
    return r.select("pattern_id", "profile_id", text(F.col("limitations")).alias("limitations"), text(F.col("blocking_reasons")).alias("blocking_reasons"), "status")


_RU = " UNION ALL ".join(f"SELECT '{k}' AS pt, '{v[0]}' AS rid, {v[1]}::DOUBLE AS th, '{v[2]}' AS dir" for k, v in P.RULES.items())
cte("drm", f"""SELECT pattern_id, profile_id, pattern_type, frequency, CASE WHEN skip IS NULL THEN rid END AS rule_id, skip AS skip_reason FROM (SELECT *, CASE WHEN blocking_reasons <> '' THEN 'not_ready' WHEN rid IS NULL THEN 'no_supported_rule' WHEN NOT (CASE WHEN dir = 'min' THEN frequency >= th ELSE frequency <= th END) THEN 'rule_threshold_not_met' END AS skip FROM dre LEFT JOIN ({_RU}) ON pt = pattern_type)""")


def ruled(t):
    return P.match_rules(found(t), P.rule_table(t.spark))


@query("o32_rule_match", "SELECT * FROM drm")
def _(t):
    return ruled(t).select("pattern_id", "profile_id", "pattern_type", "frequency", "rule_id", "skip_reason")


@query("o33_rule_audit", """SELECT profile_id, x.code, x.affected, x.affected = 0 AS passed FROM (SELECT profile_id, count(DISTINCT side) AS sides, count(*) FILTER (buy_type = 'none') AS nb FROM dfn GROUP BY 1) JOIN (SELECT profile_id, count(*) AS corpus FROM selections GROUP BY 1) USING (profile_id), LATERAL (
  SELECT 'source_lineage' AS code, 0::BIGINT AS affected UNION ALL SELECT unnest(['finding_count', 'readiness_count', 'complete_classification', 'exclusive_classification', 'readiness_gate', 'statistics_unchanged', 'share_consistent', 'evidence_unchanged', 'evidence_inside_corpus', 'duplicates']), 0 UNION ALL SELECT 'corpus_size', greatest(0, 15 - corpus) UNION ALL SELECT 'both_sides', 2 - sides UNION ALL SELECT 'buy_context', nb) x""")
def _(t):
    src = P.findings(frozen(t)[1])
    return P.audit(src, found(t), ruled(t), frozen(t)[2], t.selections)


_SG = "small_sample, denominator_match_count DESC, denominator DESC, frequency DESC, pattern_type, map_name, pattern_id"


@query("o34_signal_pick", f"SELECT profile_id, pattern_type, pattern_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY {_SG}) AS INT) AS position FROM (SELECT * FROM dfn QUALIFY row_number() OVER (PARTITION BY profile_id, pattern_type ORDER BY {_SG}) = 1) QUALIFY position <= 5")
def _(t):
    return P.signals(P.findings(frozen(t)[1])).select("profile_id", "pattern_type", "pattern_id", "position")


@query("o35_frequency_word", "SELECT pattern_id, frequency, CASE WHEN frequency >= 1 THEN 'every_time' WHEN frequency >= 0.75 THEN 'almost_always' WHEN frequency >= 0.5 THEN 'often' WHEN frequency >= 0.25 THEN 'sometimes' WHEN frequency > 0 THEN 'rarely' ELSE 'not_seen' END AS word FROM pfr")
def _(t):
    return frozen(t)[1].select("pattern_id", "frequency", P.frequency_word(F.col("frequency")).alias("word"))


cte("oins", f"SELECT {SCP}, key, numerator, denominator, frequency FROM obin UNION ALL SELECT {SCP}, key, numerator, denominator, frequency FROM ocat")


@query("o36_representatives", f"""SELECT profile_id, insight_type, map_name, side, key, denominator, frequency, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY turn, insight_type) AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id, insight_type ORDER BY denominator DESC, frequency DESC, map_name, side, key) AS turn FROM oins QUALIFY row_number() OVER (PARTITION BY profile_id, insight_type, side ORDER BY denominator DESC, frequency DESC, map_name, side, key) = 1)""".replace("SELECT *, row_number() OVER (PARTITION BY profile_id, insight_type ORDER", "SELECT *, row_number() OVER (PARTITION BY profile_id, insight_type ORDER").replace("AS turn FROM oins QUALIFY", "AS turn FROM (SELECT * FROM oins QUALIFY").replace("side, key) = 1)", "side, key) = 1))"))
def _(t):
    r = O.round_robin(O.representatives(insights(t)))
    return r.select("profile_id", "insight_type", "map_name", "side", "key", "denominator", "frequency", "position")


@query("o36_highlights", """SELECT profile_id, insight_type, map_name, side, key, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY denominator DESC, frequency DESC, insight_type) AS INT) AS position FROM (SELECT * FROM oins QUALIFY row_number() OVER (PARTITION BY profile_id, insight_type ORDER BY denominator DESC, frequency DESC, map_name, side, key) = 1) QUALIFY position <= 3""")
def _(t):
    return O.highlights(insights(t)).select("profile_id", "insight_type", "map_name", "side", "key", "position")


@query("a07_report_export", """SELECT f.pattern_id, f.profile_id, f.pattern_type, f.map_name, f.side, f.frequency, r.rule_id,
  CAST(row_number() OVER (PARTITION BY f.profile_id ORDER BY f.map_name, f.side, coalesce(f.buy_type, ''), f.pattern_type, f.pattern_id, coalesce(r.rule_id, '')) AS INT) AS position
  FROM dfn f LEFT JOIN drm r ON r.pattern_id = f.pattern_id AND r.rule_id IS NOT NULL""")
def _(t):
    """The reports are written as JSON, one folder per profile, and read back."""
    path = shared_folder(t.spark, "reports")
    P.export_reports(P.findings(frozen(t)[1]), ruled(t), path)
    kinds = "pattern_id string, pattern_type string, map_name string, side string, frequency double, rule_id string, position int, profile_id string"
    return t.spark.read.schema(kinds).json(path)
