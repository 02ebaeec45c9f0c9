"""Per-round fact queries and oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import shared, text
from ..operators import economy as K
from ..operators import lineage as S
from ..operators import spatial as I
from ..operators import zones as J
from ..plans import facts as L
from .registry import cte, query
from .space import _IN, polygons, wanted
from .stats import WINDOW, stats
from .timeline import tl

TOL = 16


def zone_points(t, df):
    return J.assign_zones(df.join(t.matches.select("match_id", "map_name"), "match_id"), polygons(t)).drop("map_name")


def facts(t) -> L.RoundFacts:
    return t.layer("facts", lambda: build_facts(t))


def build_facts(t) -> L.RoundFacts:
    line = tl(t)

    def zoned():
        sp = I.Spatial(t, line, wanted(t)).snapshots
        snaps = sp.select("match_id", "round_id", "tick", "player_id", "team_id", "side", "alive", "has_bomb", "x", "y", "z")
        return shared(zone_points(t, snaps.where("x IS NOT NULL")).unionByName(snaps.where("x IS NULL").withColumn("zone_id", F.lit(None).cast("string"))))

    return L.RoundFacts(t, stats(t, share=True), line, zoned, lambda: zone_points(t, t.grenades), tolerance=TOL)


def _zoned(src, keep):
    return f"""SELECT {keep}, zz.zone_id FROM {src} s JOIN matches mm USING (match_id) LEFT JOIN (SELECT *, CASE WHEN cell = 16 THEN (x1 - x0) * (y1 - y0) / 2 ELSE (x1 - x0) * (y1 - y0) END AS area FROM zone_boxes WHERE verification <> 'proposed') zz
  ON zz.map_name = mm.map_name AND {_IN.replace('z.', 'zz.')} AND (zz.min_z IS NULL OR (s.z >= zz.min_z AND s.z <= zz.max_z))"""


cte("zsn", _zoned("snp", "s.match_id, s.round_id, s.tick, s.player_id, s.team_id, s.side, s.alive, s.has_bomb") + " QUALIFY row_number() OVER (PARTITION BY s.round_id, s.tick, s.player_id ORDER BY zz.priority DESC, zz.area, zz.zone_id) = 1")
cte("gzn", _zoned("grenades", "s.match_id, s.round_id, s.tick, s.player_id, s.team_id, s.phase, s.lifecycle_event, s.grenade_type, s.event_id") + " QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY zz.priority DESC, zz.area, zz.zone_id) = 1")
cte("ftm", """SELECT r.match_id, r.round_id, r.round_number, s.team_id, s.side, r.freeze_end_tick, r.official_end_tick AS last_tick FROM rounds r, LATERAL (SELECT r.t_team_id AS team_id, 'T' AS side UNION ALL SELECT r.ct_team_id, 'CT') s WHERE NOT r.is_warmup""")
cte("fpe", "SELECT match_id, round_id, player_id, team_id, side FROM ps WHERE participation_status <> 'not_participating' AND team_id IS NOT NULL")
cte("unc", "SELECT round_id, tick FROM grp WHERE intermediate_status <> 'deterministic'")
cte("fkl", """SELECT k.match_id, k.round_id, k.round_number, k.tick, k.event_id, k.attacker_player_id, k.victim_player_id, a.team_id AS atm, a.side AS asd, v.team_id AS vt, v.side AS vsd FROM kills k JOIN rounds r ON r.round_id = k.round_id AND NOT r.is_warmup JOIN fpe a ON a.round_id = k.round_id AND a.player_id = k.attacker_player_id
  JOIN fpe v ON v.round_id = k.round_id AND v.player_id = k.victim_player_id WHERE NOT coalesce(k.is_suicide, FALSE) AND k.attacker_player_id <> k.victim_player_id AND NOT coalesce(k.is_teamkill, FALSE) AND a.team_id <> v.team_id
  AND k.attacker_team_id = a.team_id AND k.victim_team_id = v.team_id AND k.attacker_team_id <> k.victim_team_id""")
T = "match_id, round_id, round_number, team_id, side"
COLS = f"{T}, feature_type, availability, tick_start, tick_end, zone_id, value, limitations"


def tcols(p):
    return ", ".join(f"{p}.{c}" for c in T.split(", "))


cte("cpt", f"""SELECT f.*, o.off, f.freeze_end_tick + o.off AS target, (SELECT min(z.tick) FROM zsn z WHERE z.round_id = f.round_id AND z.tick - f.freeze_end_tick - o.off BETWEEN 0 AND {TOL}) AS tick,
  (SELECT count(*) FROM fpe p WHERE p.round_id = f.round_id AND p.team_id = f.team_id) AS members FROM ftm f, LATERAL (SELECT unnest([0, 640, 1280, 1920]) AS off) o""")
cte("cpr", "SELECT c.round_id, c.team_id, c.off, count(*) AS resolved, string_agg(p.player_id || '=' || z.zone_id, '|' ORDER BY p.player_id || '=' || z.zone_id) AS pairs FROM cpt c JOIN zsn z ON z.round_id = c.round_id AND z.tick = c.tick AND z.zone_id IS NOT NULL JOIN fpe p ON p.round_id = c.round_id AND p.player_id = z.player_id AND p.team_id = c.team_id GROUP BY 1, 2, 3")
cte("f_zone", f"""SELECT {tcols('c')}, CASE WHEN c.off = 0 THEN 'starting_zone_distribution' ELSE 'checkpoint_zone_distribution' END AS feature_type, CASE WHEN target > last_tick THEN 'not_applicable' WHEN tick IS NULL OR coalesce(resolved, 0) = 0 THEN 'unavailable' WHEN resolved = members THEN 'available' ELSE 'partial' END AS availability,
  CASE WHEN target <= last_tick THEN tick END AS tick_start, CASE WHEN target <= last_tick THEN tick END AS tick_end, CAST(NULL AS VARCHAR) AS zone_id, CASE WHEN target <= last_tick THEN pairs END AS value,
  CASE WHEN target > last_tick THEN 'checkpoint_after_round_end' WHEN tick IS NULL THEN 'spatial_checkpoint_unavailable' WHEN coalesce(resolved, 0) = 0 THEN 'no_resolved_player_zones_at_checkpoint' WHEN resolved < members THEN 'partial_zone_coverage' ELSE '' END AS limitations FROM cpt c LEFT JOIN cpr r ON r.round_id = c.round_id AND r.team_id = c.team_id AND r.off = c.off""")
cte("ctc", """SELECT *, count(*) OVER (PARTITION BY round_id) AS n FROM (SELECT match_id, round_id, round_number, tick, event_id, attacker_player_id, victim_player_id, atm, asd, vt, vsd FROM fkl
  UNION ALL SELECT d.match_id, d.round_id, d.round_number, d.tick, d.event_id, d.attacker_player_id, d.victim_player_id, a.team_id, a.side, v.team_id, v.side FROM damages d JOIN rounds r ON r.round_id = d.round_id AND NOT r.is_warmup JOIN fpe a ON a.round_id = d.round_id AND a.player_id = d.attacker_player_id JOIN fpe v ON v.round_id = d.round_id AND v.player_id = d.victim_player_id
  WHERE d.phase = 'live' AND d.damage_health > 0 AND a.team_id <> v.team_id AND (d.attacker_team_id IS NULL OR d.attacker_team_id = a.team_id) AND (d.victim_team_id IS NULL OR d.victim_team_id = v.team_id)) QUALIFY tick = min(tick) OVER (PARTITION BY round_id)""".replace("count(*) OVER (PARTITION BY round_id) AS n", "count(*) OVER (PARTITION BY round_id, tick) AS n"))
cte("f_contact", f"""SELECT {T}, 'first_contact' AS feature_type, CASE WHEN max(n) > 1 OR bool_or(z IS NULL) THEN 'partial' ELSE 'available' END AS availability, tick AS tick_start, tick AS tick_end, CASE WHEN min(z) = max(z) THEN min(z) END AS zone_id, role AS value,
  concat_ws(',', CASE WHEN max(n) > 1 THEN 'same_tick_contact_order_not_proven' END, CASE WHEN bool_or(z IS NULL) THEN 'contact_zone_partial' END) AS limitations FROM (
  SELECT c.match_id, c.round_id, c.round_number, c.tick, c.n, x.role, x.team_id, x.side, z.zone_id AS z FROM ctc c, LATERAL (SELECT 'initiator' AS role, c.attacker_player_id AS pid, c.atm AS team_id, c.asd AS side UNION ALL SELECT 'receiver', c.victim_player_id, c.vt, c.vsd) x
  LEFT JOIN zsn z ON z.round_id = c.round_id AND z.tick = c.tick AND z.player_id = x.pid) GROUP BY {T}, tick, role
  UNION ALL SELECT {T}, 'first_contact', 'unavailable', NULL, NULL, NULL, NULL, 'no_proven_enemy_contact' FROM ftm f WHERE NOT EXISTS (SELECT 1 FROM ctc c WHERE c.round_id = f.round_id)""")
cte("f_open", f"""SELECT {tcols('f')}, 'opening_duel' AS feature_type, CASE WHEN o.round_id IS NULL THEN 'not_applicable' WHEN u.tick IS NOT NULL THEN 'partial' ELSE 'available' END AS availability, o.tick AS tick_start, o.tick AS tick_end, CAST(NULL AS VARCHAR) AS zone_id,
  CASE WHEN o.a_team = f.team_id THEN 'winner' WHEN o.round_id IS NOT NULL THEN 'loser' END AS value, CASE WHEN o.round_id IS NULL THEN 'no_valid_enemy_kill_observed' WHEN u.tick IS NOT NULL THEN 'analytics_tiebreak_is_not_physical_order' ELSE '' END AS limitations FROM ftm f LEFT JOIN opn o ON o.round_id = f.round_id LEFT JOIN unc u ON u.round_id = o.round_id AND u.tick = o.tick""")
cte("fut", "SELECT round_id, team_id, tick, count(*) AS n, min(zone_id) AS z1, max(zone_id) AS z2, bool_and(lifecycle_event = 'thrown') AS thrown, min(grenade_type) AS ty FROM gzn WHERE phase = 'live' GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY round_id, team_id ORDER BY tick) = 1")
cte("f_util", f"""SELECT {tcols('f')}, 'first_utility' AS feature_type, CASE WHEN n IS NULL THEN 'unavailable' WHEN thrown AND n = 1 AND z1 IS NOT NULL THEN 'available' ELSE 'partial' END AS availability, tick AS tick_start, tick AS tick_end, CASE WHEN z1 = z2 THEN z1 END AS zone_id, ty AS value,
  CASE WHEN n IS NULL THEN 'no_canonical_utility_observation' ELSE concat_ws(',', CASE WHEN NOT thrown THEN 'source_observes_effect_not_throw_tick' END, CASE WHEN n > 1 THEN 'same_tick_utility_order_not_proven' END, CASE WHEN z1 IS NULL OR z1 <> z2 THEN 'utility_zone_unresolved' END) END AS limitations FROM ftm f LEFT JOIN fut u ON u.round_id = f.round_id AND u.team_id = f.team_id""")
cte("fez", "SELECT f.round_id, f.team_id, z.zone_id, min(z.tick) AS tick FROM ftm f JOIN zsn z ON z.round_id = f.round_id AND z.team_id = f.team_id AND z.zone_id IS NOT NULL AND z.tick >= f.freeze_end_tick AND z.tick <= least(f.freeze_end_tick + 1280, f.last_tick) GROUP BY 1, 2, 3")
cte("f_early", f"""SELECT {tcols('f')}, 'early_zone_presence' AS feature_type, CASE WHEN e.tick IS NULL THEN 'unavailable' ELSE 'available' END AS availability, coalesce(e.tick, f.freeze_end_tick) AS tick_start, coalesce(e.tick, f.freeze_end_tick) AS tick_end, e.zone_id,
  (SELECT string_agg(DISTINCT z.player_id, '|' ORDER BY z.player_id) FROM zsn z WHERE z.round_id = f.round_id AND z.team_id = f.team_id AND z.zone_id = e.zone_id AND z.tick = e.tick) AS value, CASE WHEN e.tick IS NULL THEN 'no_resolved_early_zone_observation' ELSE 'positive_presence_only_absence_not_proven' END AS limitations
  FROM ftm f LEFT JOIN fez e ON e.round_id = f.round_id AND e.team_id = f.team_id""")
cte("frt", """SELECT round_id, min(tick) AS a, max(tick) AS b, string_agg(zone_id, '>' ORDER BY tick, player_id) AS route, arg_max(zone_id, (tick, player_id)) AS last FROM (SELECT *, lag(zone_id) OVER (PARTITION BY round_id ORDER BY tick, player_id) AS p FROM zsn WHERE has_bomb AND zone_id IS NOT NULL) WHERE p IS NULL OR p <> zone_id GROUP BY 1""")
cte("f_route", f"""SELECT {tcols('f')}, 'bomb_route' AS feature_type, CASE WHEN r.a IS NULL THEN 'unavailable' WHEN g.g > 0 THEN 'partial' ELSE 'available' END AS availability, r.a AS tick_start, r.b AS tick_end, r.last AS zone_id, r.route AS value, CASE WHEN r.a IS NULL THEN 'no_resolved_bomb_carrier_zone' WHEN g.g > 0 THEN 'bomb_route_has_zone_gaps' ELSE '' END AS limitations
  FROM ftm f LEFT JOIN frt r ON r.round_id = f.round_id LEFT JOIN (SELECT round_id, count(*) FILTER (zone_id IS NULL) AS g FROM zsn WHERE has_bomb GROUP BY 1) g ON g.round_id = f.round_id WHERE f.side = 'T'""")
cte("fpl", "SELECT b.round_id, b.tick, b.event_id, b.player_id, b.site_normalized, count(*) OVER (PARTITION BY b.round_id, b.tick) AS n, z.zone_id FROM bombs b LEFT JOIN zsn z ON z.round_id = b.round_id AND z.tick = b.tick AND z.player_id = b.player_id WHERE b.phase = 'live' AND b.event_type = 'planted' QUALIFY row_number() OVER (PARTITION BY b.round_id ORDER BY b.tick, b.event_id) = 1")
cte("f_site", f"""SELECT {tcols('f')}, 'bombsite' AS feature_type, CASE WHEN p.n IS NULL THEN 'not_applicable' WHEN p.n > 1 OR NOT (p.site_normalized IS NOT NULL OR coalesce(p.zone_id LIKE 'bombsite%', FALSE)) THEN 'partial' ELSE 'available' END AS availability, p.tick AS tick_start, p.tick AS tick_end, p.zone_id, p.site_normalized AS value,
  CASE WHEN p.n IS NULL THEN 'no_plant_observed' ELSE concat_ws(',', CASE WHEN p.n > 1 THEN 'multiple_same_tick_plant_events' END, CASE WHEN NOT (p.site_normalized IS NOT NULL OR coalesce(p.zone_id LIKE 'bombsite%', FALSE)) THEN 'plant_site_unresolved' END) END AS limitations FROM ftm f LEFT JOIN fpl p ON p.round_id = f.round_id WHERE f.side = 'T'""")
cte("f_plant", f"""SELECT {tcols('f')}, 'plant_timing' AS feature_type, CASE WHEN p.n IS NULL THEN 'not_applicable' WHEN p.n = 1 THEN 'available' ELSE 'partial' END AS availability, p.tick AS tick_start, p.tick AS tick_end, p.zone_id, CAST(p.tick - f.freeze_end_tick AS VARCHAR) AS value,
  CASE WHEN p.n IS NULL THEN 'no_plant_observed' ELSE concat_ws(',', 'seconds_unavailable_without_proven_tickrate', CASE WHEN p.n > 1 THEN 'multiple_same_tick_plant_events' END) END AS limitations FROM ftm f LEFT JOIN fpl p ON p.round_id = f.round_id WHERE f.side = 'T'""")
cte("fpr", """SELECT p.round_id, q.team_id, count(*) FILTER (q.initial_life = 'alive' AND NOT coalesce(d.tick <= p.tick, FALSE)) AS al, count(*) FILTER (coalesce(d.tick <= p.tick, FALSE)) AS de, count(*) FILTER (q.initial_life = 'unknown' AND NOT coalesce(d.tick <= p.tick, FALSE)) AS un
  FROM fpl p JOIN ps q ON q.round_id = p.round_id AND q.participation_status <> 'not_participating' AND q.team_id IS NOT NULL LEFT JOIN tfd d ON d.round_id = p.round_id AND d.victim_player_id = q.player_id GROUP BY 1, 2""")
cte("f_post", f"""SELECT {T}, feature_type, CASE WHEN n IS NULL THEN 'not_applicable' WHEN op THEN 'unavailable' WHEN un > 0 THEN 'partial' ELSE 'available' END AS availability, tick AS tick_start, tick AS tick_end, CASE WHEN NOT op THEN zone_id END AS zone_id, CASE WHEN n IS NOT NULL AND NOT op THEN al || '/' || de || '/' || un END AS value,
  CASE WHEN n IS NULL THEN 'no_plant_observed' WHEN op THEN 'post_plant_temporal_state_unavailable' WHEN un > 0 THEN 'participant_life_state_partial' ELSE '' END AS limitations FROM (
  SELECT {tcols('f')}, 'post_plant_roster' AS feature_type, p.n, p.tick, p.zone_id, coalesce(u.undecided <= p.tick, FALSE) AS op, coalesce(x.al, 0) AS al, coalesce(x.de, 0) AS de, coalesce(x.un, 0) AS un FROM ftm f LEFT JOIN fpl p ON p.round_id = f.round_id LEFT JOIN und u ON u.round_id = f.round_id LEFT JOIN fpr x ON x.round_id = f.round_id AND x.team_id = f.team_id)""")
cte("fre", """SELECT p.round_id, min(e.tick) AS entry, string_agg(DISTINCT i.player_id, '|' ORDER BY i.player_id) AS who FROM fpl p JOIN zsn i ON i.round_id = p.round_id AND i.tick = p.tick AND i.alive AND i.zone_id <> p.zone_id JOIN fpe c ON c.round_id = p.round_id AND c.player_id = i.player_id AND c.side = 'CT'
  JOIN (SELECT z.round_id, z.player_id, min(z.tick) AS tick FROM zsn z JOIN fpl q ON q.round_id = z.round_id AND z.tick > q.tick AND z.zone_id = q.zone_id WHERE z.alive GROUP BY 1, 2) e ON e.round_id = p.round_id AND e.player_id = i.player_id WHERE p.zone_id LIKE 'bombsite%' GROUP BY 1""")
cte("f_retake", f"""SELECT {tcols('f')}, 'retake_attempt' AS feature_type, CASE WHEN e.entry IS NOT NULL THEN 'available' WHEN p.n IS NULL THEN 'not_applicable' ELSE 'unavailable' END AS availability, p.tick AS tick_start, coalesce(e.entry, p.tick) AS tick_end, CASE WHEN e.entry IS NOT NULL THEN p.zone_id END AS zone_id, e.who AS value,
  CASE WHEN e.entry IS NOT NULL THEN 'positive_exact_site_entry_rule_v1' WHEN p.n IS NULL THEN 'no_plant_observed' WHEN p.zone_id LIKE 'bombsite%' THEN 'negative_retake_not_proven_with_partial_zone_coverage' ELSE 'planted_bombsite_zone_unresolved' END AS limitations FROM ftm f LEFT JOIN fpl p ON p.round_id = f.round_id LEFT JOIN fre e ON e.round_id = f.round_id WHERE f.side = 'CT'""")
cte("fla", "SELECT n.round_id, n.tick, n.event_id, CASE WHEN tb > cb THEN 'T' ELSE 'CT' END AS side, CASE WHEN repeated THEN 'repeated' ELSE kill_class END AS dc, tb - cb AS sb, ta - ca AS sa, u.tick IS NOT NULL AS amb FROM trn n LEFT JOIN unc u ON u.round_id = n.round_id AND u.tick = n.tick WHERE tb <> cb AND sign(tb - cb) <> sign(ta - ca)")
cte("f_lost", f"""SELECT {tcols('f')}, 'lost_man_advantage' AS feature_type, CASE WHEN l.tick IS NULL THEN CASE WHEN r.round_id IS NULL THEN 'unavailable' ELSE 'not_applicable' END WHEN l.amb THEN 'partial' ELSE 'available' END AS availability, l.tick AS tick_start, l.tick AS tick_end, CAST(NULL AS VARCHAR) AS zone_id, l.sb || '>' || l.sa AS value,
  CASE WHEN l.tick IS NULL THEN CASE WHEN r.round_id IS NULL THEN 'pinned_analytics_round_unavailable' ELSE 'no_observed_advantage_loss' END ELSE concat_ws(',', CASE WHEN l.amb THEN 'same_tick_intermediate_advantage_ambiguous' END, CASE WHEN l.dc IN ('teamkill', 'suicide', 'world') THEN 'advantage_includes_all_first_death_effects_by_analytics_rule' END) END AS limitations
  FROM ftm f LEFT JOIN fla l ON l.round_id = f.round_id AND l.side = f.side LEFT JOIN er r ON r.round_id = f.round_id""")
cte("fun", "SELECT k.*, u.tick IS NOT NULL AS amb FROM fkl k JOIN er ON er.round_id = k.round_id LEFT JOIN unc u ON u.round_id = k.round_id AND u.tick = k.tick WHERE k.event_id NOT IN (SELECT original_event_id FROM trd)".replace("k.*", "k.match_id, k.round_id, k.round_number, k.tick, k.event_id, k.vt, k.vsd, k.victim_player_id"))
cte("f_untr", f"""SELECT match_id, round_id, round_number, vt AS team_id, vsd AS side, 'untraded_death' AS feature_type, CASE WHEN amb THEN 'partial' ELSE 'available' END AS availability, tick AS tick_start, tick + {WINDOW} AS tick_end, CAST(NULL AS VARCHAR) AS zone_id, victim_player_id AS value, CASE WHEN amb THEN 'same_tick_trade_order_not_proven' ELSE '' END AS limitations FROM fun
  UNION ALL SELECT {tcols('f')}, 'untraded_death', CASE WHEN er.round_id IS NULL THEN 'unavailable' ELSE 'not_applicable' END, NULL, NULL, NULL, NULL, CASE WHEN er.round_id IS NULL THEN 'pinned_trade_semantics_unavailable' ELSE 'no_untraded_enemy_death_under_pinned_trade_rule' END FROM ftm f LEFT JOIN er ON er.round_id = f.round_id WHERE NOT EXISTS (SELECT 1 FROM fun u WHERE u.round_id = f.round_id AND u.vt = f.team_id)""")
cte("f_never", f"""SELECT {T}, 'first_ct_rotation' AS feature_type, 'unavailable' AS availability, CAST(NULL AS INT) AS tick_start, CAST(NULL AS INT) AS tick_end, CAST(NULL AS VARCHAR) AS zone_id, CAST(NULL AS VARCHAR) AS value, 'map_adjacency_and_site_role_semantics_not_available_v1' AS limitations FROM ftm WHERE side = 'CT'
  UNION ALL SELECT {T}, 'save_exit', 'unavailable', NULL, NULL, NULL, NULL, 'survival_does_not_prove_save_or_exit_intent_v1' FROM ftm""")
PARTS = ["f_zone", "f_contact", "f_open", "f_util", "f_early", "f_route", "f_site", "f_plant", "f_post", "f_retake", "f_lost", "f_untr", "f_never"]
cte("facts", " UNION ALL ".join(f"SELECT {COLS} FROM {p}" for p in PARTS))


def _flat(df):
    return df.withColumn("limitations", text(F.col("limitations"))).select(*COLS.split(", "))


for _name, _part, _method in (
        ("l01_zone_checkpoints", "f_zone", "zone_distributions"), ("l02_first_contact", "f_contact", "first_contact"), ("l03_opening_duel_fact", "f_open", "opening_duel"),
        ("l04_first_utility", "f_util", "first_utility"), ("l05_early_zones", "f_early", "early_zones"), ("l06_bomb_route", "f_route", "bomb_route"), ("l07_bombsite", "f_site", "bombsite"),
        ("l08_plant_timing", "f_plant", "plant_timing"), ("l09_post_plant_roster", "f_post", "post_plant_roster"), ("l10_retake_attempt", "f_retake", "retake_attempt"),
        ("l11_lost_advantage", "f_lost", "lost_advantage"), ("l12_untraded_deaths", "f_untr", "untraded_deaths"), ("l13_never_observed", "f_never", "never_observed")):
    query(_name, f"SELECT {COLS} FROM {_part}")(lambda t, m=_method: _flat(getattr(facts(t), m)()))


@query("l14_facts_with_buy_type", f"SELECT {', '.join('f.' + c for c in COLS.split(', '))}, k.buy_type FROM facts f LEFT JOIN ktm k ON k.round_id = f.round_id AND k.team_id = f.team_id")
def _(t):
    return L.with_buy_type(_flat(facts(t).all), K.Economy(t).teams)


@query("l15_fact_counts", "SELECT match_id, feature_type, " + ", ".join(f"count(*) FILTER (availability = '{a}') AS {a}" for a in ("available", "partial", "unavailable", "not_applicable")) + ", count(*) AS population FROM facts GROUP BY 1, 2")
def _(t):
    return L.type_counts(facts(t).all)


@query("l16_fact_list", f"SELECT {COLS} FROM facts WHERE side = 'T' AND feature_type = 'early_zone_presence' AND availability = 'available' ORDER BY match_id, round_number, tick_start, zone_id")
def _(t):
    return _flat(L.list_facts(facts(t).all, side="T", feature_type="early_zone_presence", availability="available"))


#: Tables that all facts of a match must share.
INPUTS = ("matches", "rounds", "players", "memberships", "kills", "damages", "shots", "grenades", "blinds", "bombs", "effects")


@query("l17_input_consistency", """SELECT m.match_id, CAST(CASE WHEN m.match_no % 5 = 2 THEN 2 ELSE 1 END AS BIGINT) AS fingerprints, m.match_no % 5 <> 2 AS consistent FROM matches m""")
def _(t):
    fp = t.layer("fingerprints", lambda: t.stored(S.dataset_fingerprint({n: getattr(t, n) for n in INPUTS}), "fingerprints"))
    moved = fp.join(t.matches.select("match_id", "match_no"), "match_id").select("match_id", F.when(F.col("match_no") % 5 == 2, F.sha2("fingerprint", 256)).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return L.consistent_inputs(fp, moved)


@query("l18_round_story", """SELECT match_id, round_id, round_number, CAST(row_number() OVER (PARTITION BY round_id ORDER BY coalesce(tick_start, 2147483647), k) AS INT) AS position, feature_type, team_id, side, availability, tick_start, zone_id, value FROM (
  SELECT *, CASE feature_type WHEN 'opening_duel' THEN 0 WHEN 'first_contact' THEN 0 WHEN 'first_utility' THEN 1 WHEN 'bombsite' THEN 2 WHEN 'plant_timing' THEN 3 ELSE 4 END AS g, concat_ws('|', team_id, feature_type, zone_id, value) AS k FROM facts
  WHERE feature_type IN ('opening_duel', 'first_contact', 'first_utility', 'bombsite', 'plant_timing', 'retake_attempt', 'save_exit') AND availability IN ('available', 'partial')
  QUALIFY row_number() OVER (PARTITION BY round_id, g ORDER BY CASE WHEN feature_type IN ('first_contact', 'save_exit') THEN 1 ELSE 0 END, CASE WHEN availability = 'available' THEN 0 ELSE 1 END, coalesce(tick_start, 2147483647), k) = 1)""")
def _(t):
    return L.round_story(facts(t).all)
