"""Time-line queries and oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import text
from ..operators import identity as D
from ..operators import timeline as H
from .raw import evidence
from .registry import cte, query
from .stats import stats


def tl(t, rate=None) -> H.Timeline:
    return t.layer(f"timeline:{rate}", lambda: H.Timeline(t, D.participation_status(t.rounds, t.players, t.memberships, evidence(t)), rate))


cte("tev0", """SELECT match_id, round_id, round_number, tick, 'death' AS kind, 'death' AS event_type, 60 AS priority, event_id, attacker_player_id AS actor_player_id, victim_player_id, TRUE AS state_affecting FROM kills
  UNION ALL SELECT match_id, round_id, round_number, tick, 'damage', 'damage', 20, event_id, attacker_player_id, victim_player_id, FALSE FROM damages
  UNION ALL SELECT match_id, round_id, round_number, tick, 'shot', 'shot', 30, event_id, player_id, NULL, FALSE FROM shots
  UNION ALL SELECT match_id, round_id, round_number, tick, 'grenade', 'grenade:' || lifecycle_event, 40, event_id, player_id, NULL, FALSE FROM grenades
  UNION ALL SELECT match_id, round_id, round_number, tick, 'bomb', 'bomb:' || event_type, CASE WHEN event_type = 'planted' THEN 50 ELSE 70 END, event_id, player_id, NULL, TRUE FROM bombs
  UNION ALL SELECT match_id, round_id, round_number, start_tick, 'phase_boundary', 'round_start', 10, NULL, NULL, NULL, TRUE FROM rounds UNION ALL SELECT match_id, round_id, round_number, freeze_end_tick, 'phase_boundary', 'freeze_end', 10, NULL, NULL, NULL, TRUE FROM rounds
  UNION ALL SELECT match_id, round_id, round_number, end_tick, 'round_end', 'round_end', 90, NULL, NULL, NULL, TRUE FROM rounds UNION ALL SELECT match_id, round_id, round_number, official_end_tick, 'official_end', 'official_end', 100, NULL, NULL, NULL, TRUE FROM rounds""")
cte("tev", "SELECT e.*, 'ordered' AS ordering_status FROM tev0 e JOIN rounds r USING (round_id) WHERE NOT r.is_warmup".replace("e.*", "e.match_id, e.round_id, e.round_number, e.tick, e.kind, e.event_type, e.priority, e.event_id, e.actor_player_id, e.victim_player_id, e.state_affecting"))
cte("phs", """SELECT match_id, round_id, round_number, p.phase, p.start_tick, p.end_tick, 'available' AS status FROM rounds r, LATERAL (SELECT 'freeze_time' AS phase, r.start_tick AS start_tick, r.freeze_end_tick AS end_tick
  UNION ALL SELECT 'live', r.freeze_end_tick, r.end_tick UNION ALL SELECT 'post_round', r.end_tick, r.official_end_tick UNION ALL SELECT 'ended', r.official_end_tick, NULL) p WHERE NOT r.is_warmup""")
cte("tfd", "SELECT match_id, round_id, victim_player_id, tick, event_id FROM tev WHERE kind = 'death' AND victim_player_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY round_id, victim_player_id ORDER BY tick, event_id) = 1")
cte("tlife", """SELECT k.match_id, k.round_id, k.round_number, k.tick, k.event_id, k.victim_player_id AS player_id, CASE WHEN f.event_id <> k.event_id THEN 'dead' ELSE coalesce(p.initial_life, 'unknown') END AS life_before, 'dead' AS life_after,
  CASE WHEN f.event_id <> k.event_id THEN 'repeated' WHEN k.is_suicide OR k.attacker_player_id = k.victim_player_id THEN 'suicide' WHEN k.attacker_player_id IS NULL THEN 'world' WHEN k.is_teamkill OR k.attacker_team_id = k.victim_team_id THEN 'teamkill'
    WHEN k.attacker_team_id <> k.victim_team_id THEN 'enemy' ELSE 'unknown' END AS death_class,
  CASE WHEN f.event_id <> k.event_id OR coalesce(p.initial_life, 'unknown') <> 'alive' OR k.tick < r.freeze_end_tick THEN 'partial' ELSE 'available' END AS status
  FROM kills k JOIN rounds r USING (round_id) JOIN tfd f ON f.round_id = k.round_id AND f.victim_player_id = k.victim_player_id LEFT JOIN ps p ON p.round_id = k.round_id AND p.player_id = k.victim_player_id WHERE NOT r.is_warmup""".replace("coalesce(p.initial_life", "coalesce(p.initial_life"))
cte("bseq", "SELECT match_id, round_id, round_number, tick, event_id, split_part(event_type, ':', 2) AS ty, row_number() OVER (PARTITION BY round_id ORDER BY tick, priority, event_id) AS n FROM tev WHERE kind = 'bomb'")
cte("bfold", """SELECT match_id, round_id, round_number, tick, event_id, n, 'unavailable' AS b, CASE WHEN ty = 'planted' THEN 'planted' ELSE 'unresolved' END AS a, CASE WHEN ty <> 'planted' THEN [ty] ELSE [] END AS seen FROM bseq WHERE n = 1
  UNION ALL SELECT s.match_id, s.round_id, s.round_number, s.tick, s.event_id, s.n, f.a, CASE WHEN s.ty = 'planted' THEN CASE WHEN f.a = 'unavailable' THEN 'planted' ELSE 'unresolved' END
    WHEN f.a = 'planted' AND len(list_distinct(list_append(f.seen, s.ty))) = 1 THEN s.ty ELSE 'unresolved' END, CASE WHEN s.ty <> 'planted' THEN list_distinct(list_append(f.seen, s.ty)) ELSE f.seen END
  FROM bfold f JOIN bseq s ON s.round_id = f.round_id AND s.n = f.n + 1""")
cte("blast", "SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY n DESC) AS back FROM bfold")
cte("btr", """SELECT match_id, round_id, round_number, tick, event_id, b AS bomb_before, a AS bomb_after, CASE WHEN a = 'unresolved' THEN 'unresolved' ELSE 'available' END AS status, CAST(n AS INT) AS step FROM bfold
  UNION ALL SELECT l.match_id, l.round_id, l.round_number, r.official_end_tick, NULL, 'planted', 'round_ended_before_resolution', 'partial', CAST(l.n + 1 AS INT) FROM blast l JOIN rounds r USING (round_id) WHERE l.back = 1 AND l.a = 'planted'""")
cte("grp0", """SELECT e.match_id, e.round_id, e.round_number, e.tick, count(*) AS event_count, count(*) FILTER (kind = 'death') AS deaths, count(*) FILTER (kind = 'bomb') AS bombs, count(*) FILTER (kind IN ('round_end', 'official_end')) AS ends,
  count(*) FILTER (kind IN ('round_end', 'official_end', 'phase_boundary')) AS bounds, count(*) FILTER (kind = 'death' AND e.victim_player_id IS NULL) AS nov, list(e.victim_player_id) FILTER (e.victim_player_id IS NOT NULL) AS vs,
  bool_or(kind = 'death' AND e.victim_player_id IS NOT NULL AND (f.tick < e.tick OR coalesce(p.initial_life, 'unknown') <> 'alive')) AS bad, list(DISTINCT e.event_type) AS tys
  FROM tev e LEFT JOIN tfd f ON f.round_id = e.round_id AND f.victim_player_id = e.victim_player_id LEFT JOIN ps p ON p.round_id = e.round_id AND p.player_id = e.victim_player_id WHERE e.state_affecting GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""")
cte("grp1", """SELECT *, CASE WHEN coalesce(bad, FALSE) OR coalesce(len(vs), 0) <> coalesce(len(list_distinct(vs)), 0) THEN 'duplicate_or_previously_dead_victim' WHEN list_contains(tys, 'bomb:defused') AND list_contains(tys, 'bomb:exploded') THEN 'incompatible_terminal_bomb_events'
  WHEN list_contains(tys, 'bomb:planted') AND list_contains(tys, 'bomb:defused') THEN 'plant_defuse_order_not_proven' WHEN bombs > 1 THEN 'multiple_non_commutative_bomb_events' WHEN nov > 0 THEN 'death_effect_unavailable' WHEN deaths > 1 THEN 'commutative_deaths_unknown_order'
  WHEN deaths > 0 AND bombs > 0 THEN 'independent_life_and_bomb_effects_unknown_order' WHEN bombs > 0 AND ends > 0 THEN 'bomb_resolution_and_round_boundary_same_tick' WHEN deaths + bombs > 0 AND bounds > 0 THEN 'state_effect_and_boundary_order_not_proven' END AS reason FROM grp0""")
cte("grp", """SELECT match_id, round_id, round_number, tick, event_count, deaths, bombs, CASE WHEN reason IN ('duplicate_or_previously_dead_victim', 'incompatible_terminal_bomb_events', 'multiple_non_commutative_bomb_events') THEN 'conflicting'
  WHEN reason IS NOT NULL THEN 'ambiguous_order' WHEN bounds = event_count THEN 'definitively_ordered' ELSE 'canonically_grouped' END AS order_status,
  CASE WHEN reason IS NULL THEN 'deterministic' WHEN reason = 'death_effect_unavailable' OR event_count > 8 THEN 'unavailable' ELSE 'ambiguous' END AS intermediate_status,
  CASE WHEN reason IN ('duplicate_or_previously_dead_victim', 'incompatible_terminal_bomb_events', 'multiple_non_commutative_bomb_events') THEN 'conflicting' WHEN reason = 'plant_defuse_order_not_proven' THEN 'ambiguous' ELSE 'deterministic' END AS final_status, reason FROM grp1""")
cte("bloc", """SELECT r.match_id, r.round_id, r.round_number, CASE WHEN c.tick IS NOT NULL THEN 'unresolved' ELSE coalesce(b.a, 'unavailable') END AS final_bomb_state, CASE WHEN coalesce(b.a, 'unavailable') <> 'unresolved' THEN c.tick END AS conflict_tick
  FROM rounds r LEFT JOIN (SELECT round_id, arg_max(bomb_after, step) AS a FROM btr GROUP BY 1) b USING (round_id) LEFT JOIN (SELECT round_id, min(tick) AS tick FROM grp WHERE bombs > 0 AND final_status <> 'deterministic' GROUP BY 1) c USING (round_id) WHERE NOT r.is_warmup""")


def state_sql(src: str, cols: str, strict: bool = False) -> str:
    op = "<" if strict else "<="
    return f"""SELECT {', '.join('q.' + c for c in cols.split(', '))}, string_agg(p.player_id, ',' ORDER BY p.player_id) FILTER (lf = 'alive') AS alive_players,
  count(*) FILTER (lf = 'alive' AND p.side = 'T') AS t_alive, count(*) FILTER (lf = 'alive' AND p.side = 'CT') AS ct_alive, count(*) FILTER (lf = 'dead') AS dead_count, count(*) FILTER (lf = 'unknown') AS unknown_count,
  any_value(CASE WHEN lo.conflict_tick <= q.tick THEN 'unresolved' ELSE coalesce((SELECT arg_max(bomb_after, step) FROM btr b WHERE b.round_id = q.round_id AND event_id IS NULL AND b.tick <= q.tick),
    (SELECT arg_max(bomb_after, step) FROM btr b WHERE b.round_id = q.round_id AND event_id IS NOT NULL AND b.tick {op} q.tick), 'unavailable') END) AS bomb_state,
  any_value(CASE WHEN {'FALSE' if strict else "EXISTS (SELECT 1 FROM grp g WHERE g.round_id = q.round_id AND g.final_status <> 'deterministic' AND g.tick <= q.tick)"} THEN 'unavailable' ELSE 'available' END) AS state_status,
  any_value(CASE WHEN q.tick < r.freeze_end_tick THEN 'freeze_time' WHEN q.tick < r.end_tick THEN 'live' WHEN q.tick < r.official_end_tick THEN 'post_round' ELSE 'ended' END) AS phase
  FROM {src} q JOIN rounds r USING (round_id) JOIN bloc lo USING (round_id) JOIN (SELECT ps.*, f.tick AS dtick FROM ps LEFT JOIN tfd f ON f.round_id = ps.round_id AND f.victim_player_id = ps.player_id WHERE participation_status <> 'not_participating') p USING (round_id),
  LATERAL (SELECT CASE WHEN p.dtick {op} q.tick THEN 'dead' ELSE p.initial_life END AS lf) GROUP BY {', '.join('q.' + c for c in cols.split(', '))}"""


RT = "match_id, round_id, round_number, tick"


@query("h01_event_union", "SELECT * FROM tev")
def _(t):
    return H.timeline_events(t)


@query("h02_phase_intervals", "SELECT * FROM phs")
def _(t):
    return H.phase_intervals(t.rounds.where("NOT is_warmup"))


@query("h03_phase_at_tick", "SELECT e.event_id, e.match_id, e.round_id, e.tick, p.phase FROM ev e JOIN phs p ON p.round_id = e.round_id AND e.tick >= p.start_tick AND (p.end_tick IS NULL OR e.tick < p.end_tick)")
def _(t):
    r = t.rounds.where("NOT is_warmup")
    return H.phase_at(t.ev.select("event_id", "match_id", "round_id", "tick").join(r.select("round_id"), "round_id", "left_semi"), r)


@query("h04_life_transitions", "SELECT * FROM tlife")
def _(t):
    return tl(t).life


@query("h05_bomb_states", "SELECT * FROM btr")
def _(t):
    return tl(t).bomb


@query("h06_same_tick_groups", "SELECT * FROM grp")
def _(t):
    return tl(t).groups


cte("gamb", "SELECT match_id, round_id, round_number, tick FROM grp WHERE intermediate_status = 'ambiguous'")
cte("gpre", state_sql("gamb", RT, True))


@query("h07_possible_states", """SELECT DISTINCT g.match_id, g.round_id, g.round_number, g.tick, CASE WHEN hit THEN e.victim_player_id END AS removed_player, t_alive - CAST(hit AND side = 'T' AS BIGINT) AS t_alive, ct_alive - CAST(hit AND side = 'CT' AS BIGINT) AS ct_alive, coalesce(b.bomb_after, g.bomb_state) AS bomb_state
  FROM gpre g JOIN tev e ON e.round_id = g.round_id AND e.tick = g.tick AND e.state_affecting LEFT JOIN btr b ON b.event_id = e.event_id LEFT JOIN ps p ON p.round_id = g.round_id AND p.player_id = e.victim_player_id,
  LATERAL (SELECT coalesce(e.kind = 'death' AND list_contains(string_split(g.alive_players, ','), e.victim_player_id), FALSE) AS hit)""")
def _(t):
    return tl(t).possible_states


cte("ereq", "SELECT DISTINCT match_id, round_id, rn AS round_number, tick FROM ev")


@query("h08_state_at_tick", state_sql("ereq", RT))
def _(t):
    q = t.ev.select("match_id", "round_id", F.col("rn").alias("round_number"), "tick").distinct()
    return tl(t).state_at(q).withColumn("alive_players", F.nullif(text(F.col("alive_players")), F.lit("")))


@query("h08_state_before_group", state_sql("grp", RT, True))
def _(t):
    x = tl(t)
    return x.state_at(x.groups.select("match_id", "round_id", "round_number", "tick"), strict=True).withColumn("alive_players", F.nullif(text(F.col("alive_players")), F.lit("")))


cte("freq", "SELECT match_id, round_id, round_number, official_end_tick AS tick FROM rounds WHERE NOT is_warmup")


@query("h09_final_state", state_sql("freq", RT))
def _(t):
    return tl(t).milestones.where("label = 'final'").drop("label").withColumn("alive_players", F.nullif(text(F.col("alive_players")), F.lit("")))


@query("h10_transition_log", """SELECT match_id, round_id, round_number, start_tick AS tick, 'phase_changed' AS transition_type, coalesce(lag(phase) OVER (PARTITION BY round_id ORDER BY start_tick), 'prestart') AS before_state, phase AS after_state, NULL::VARCHAR AS player_id, NULL::BIGINT AS event_id, 'available' AS status FROM phs
  UNION ALL SELECT match_id, round_id, round_number, first_seen_tick, 'participant_observed', 'not_participating', participation_status, player_id, NULL, 'partial' FROM ps WHERE participation_status = 'event_observed'
  UNION ALL SELECT match_id, round_id, round_number, tick, 'player_died', life_before, life_after, player_id, event_id, status FROM tlife
  UNION ALL SELECT match_id, round_id, round_number, tick, CASE WHEN bomb_after IN ('planted', 'defused', 'exploded') THEN 'bomb_' || bomb_after WHEN bomb_after = 'round_ended_before_resolution' THEN 'round_ended' ELSE 'ambiguity_detected' END, bomb_before, bomb_after, NULL, event_id, status FROM btr
  UNION ALL SELECT match_id, round_id, round_number, tick, 'ambiguity_detected', NULL, NULL, NULL, NULL, 'unresolved' FROM grp
  UNION ALL SELECT match_id, round_id, round_number, official_end_tick, 'round_ended', 'active', 'ended', NULL, NULL, 'available' FROM rounds WHERE NOT is_warmup""")
def _(t):
    return tl(t).log


_ST = "CASE WHEN u THEN 'unresolved' WHEN covered = population AND NOT r THEN 'available' WHEN covered > 0 THEN 'partial' ELSE 'unavailable' END"
cte("cap0", """SELECT r.match_id, r.round_id, r.round_number, r.is_complete, coalesce(p.n, 0) AS n, coalesce(p.placed, 0) AS placed, coalesce(p.unres, 0) AS unres, coalesce(p.alive, 0) AS alive, coalesce(g.n, 0) AS gn, coalesce(g.ok, 0) AS gok, coalesce(g.mid, 0) AS gmid,
  coalesce(g.mev, 0) AS mev, coalesce(g.lu, FALSE) AS lu, e.n AS en, e.nov, coalesce(l.lp, FALSE) AS lp, coalesce(b.bo, FALSE) OR bl.conflict_tick IS NOT NULL AS bo, b.round_id IS NOT NULL OR bl.conflict_tick IS NOT NULL AS hb
  FROM rounds r LEFT JOIN (SELECT round_id, count(*) AS n, count(*) FILTER (participation_status <> 'unresolved' AND team_id IS NOT NULL AND side IN ('T', 'CT')) AS placed, count(*) FILTER (participation_status = 'unresolved') AS unres, count(*) FILTER (initial_life = 'alive') AS alive
    FROM ps WHERE participation_status <> 'not_participating' GROUP BY 1) p USING (round_id)
  LEFT JOIN (SELECT round_id, count(*) AS n, count(*) FILTER (final_status = 'deterministic') AS ok, count(*) FILTER (intermediate_status = 'deterministic') AS mid, CAST(sum(event_count) FILTER (intermediate_status <> 'deterministic') AS BIGINT) AS mev, bool_or(final_status <> 'deterministic' AND deaths > 0) AS lu FROM grp GROUP BY 1) g USING (round_id)
  LEFT JOIN (SELECT round_id, count(*) AS n, count(*) FILTER (kind = 'death' AND victim_player_id IS NULL) AS nov FROM tev GROUP BY 1) e USING (round_id) LEFT JOIN (SELECT round_id, bool_or(status <> 'available') AS lp FROM tlife GROUP BY 1) l USING (round_id)
  LEFT JOIN (SELECT round_id, bool_or(bomb_after = 'unresolved') AS bo FROM btr GROUP BY 1) b USING (round_id) LEFT JOIN bloc bl USING (round_id) WHERE NOT r.is_warmup""")
_CAPS = [("tick_timeline", "1", "1", "FALSE", "NOT is_complete"), ("seconds_timeline", "1", "0", "FALSE", "TRUE"), ("phase_timeline", "1", "1", "FALSE", "FALSE"),
         ("participant_state", "greatest(1, n)", "placed", "unres > 0", "placed < n OR n = 0"), ("alive_state", "greatest(1, n)", "alive", "lu", "alive < n OR n = 0 OR lp OR lu OR nov > 0"),
         ("tick_group_state", "greatest(1, gn)", "CASE WHEN gn = 0 THEN 1 ELSE gok END", "gn > gok", "gn > gok"), ("per_event_state", "greatest(1, en)", "greatest(0, en - mev)", "FALSE", "gn > gmid"),
         ("intermediate_ordering", "greatest(1, gn)", "CASE WHEN gn = 0 THEN 1 ELSE gmid END", "FALSE", "gn > gmid"), ("bomb_state", "1", "CAST(hb AS INT)", "bo", "TRUE"),
         ("final_state", "1", "CAST(n > 0 AS INT)", "unres > 0 OR gn > gok OR bo", "NOT is_complete OR n = 0 OR unres > 0 OR gn > gok OR bo")]
cte("cap", " UNION ALL ".join(f"SELECT match_id, round_id, round_number, '{m}' AS metric, CAST({p} AS BIGINT) AS population, CAST({c} AS BIGINT) AS covered, {u} AS u, {r} AS r FROM cap0" for m, p, c, u, r in _CAPS))


@query("h11_round_capability", f"SELECT match_id, round_id, round_number, metric, population, covered, {_ST} AS status FROM cap")
def _(t):
    return tl(t).capability.drop("unresolved", "has_reason")


@query("h11_match_capability", f"SELECT match_id, metric, population, covered, {_ST} AS status FROM (SELECT match_id, metric, CAST(sum(population) AS BIGINT) AS population, CAST(sum(covered) AS BIGINT) AS covered, bool_or(u) AS u, bool_or(r) AS r FROM cap GROUP BY 1, 2)")
def _(t):
    return tl(t).match_capability


def _iss(sel, code):
    return f"SELECT DISTINCT match_id, '{code}' AS code, 'round' AS entity_type, round_id AS entity_id FROM {sel}"


cte("hpost", "SELECT match_id, round_id, round_number, tick, min(ta) AS ta, min(ca) AS ca FROM trn GROUP BY 1, 2, 3, 4")
cte("hst", state_sql("hpost", RT + ", ta, ca"))


@query("h12_timeline_checks", " UNION ALL ".join([
    _iss("tev WHERE kind = 'death' AND victim_player_id IS NULL", "death_without_victim"),
    _iss("(SELECT l.* FROM tlife l JOIN rounds r USING (round_id) WHERE l.tick < r.freeze_end_tick)", "death_before_live_start"), _iss("tlife WHERE death_class = 'repeated'", "duplicate_death_without_respawn"),
    _iss("ps WHERE participation_status = 'unresolved'", "participant_identity_conflict"),
    _iss("(SELECT match_id, round_id FROM bloc WHERE conflict_tick IS NOT NULL UNION SELECT match_id, round_id FROM btr WHERE bomb_after = 'unresolved')", "bomb_state_conflict"),
    _iss("""(SELECT r.match_id, r.round_id FROM rounds r LEFT JOIN opn o USING (round_id) LEFT JOIN (SELECT l.round_id, arg_min(l.event_id, (l.tick, l.event_id)) AS e FROM tlife l JOIN kills k USING (event_id) WHERE k.phase = 'live' AND l.death_class = 'enemy' GROUP BY 1) f USING (round_id)
      WHERE r.is_complete AND NOT r.is_warmup AND o.event_id IS DISTINCT FROM f.e)""", "opening_mismatch"),
    _iss("""(SELECT l.match_id, l.round_id FROM tlife l JOIN kills k USING (event_id) JOIN er r ON r.round_id = l.round_id WHERE k.phase = 'live' AND l.event_id NOT IN (SELECT event_id FROM trn))""", "advantage_death_stream_mismatch"),
    _iss("hst WHERE state_status = 'available' AND unknown_count = 0 AND (t_alive <> ta OR ct_alive <> ca)", "advantage_post_tick_mismatch")]))
def _(t):
    s = stats(t)
    return tl(t).checks(s.openings, s.transitions)


@query("h13_tick_seconds", "SELECT event_id, tick, tick / 64.0::DOUBLE AS seconds, NULL::DOUBLE AS seconds_without_rate FROM ev")
def _(t):
    return t.ev.select("event_id", "tick", H.tick_seconds(F.col("tick"), 64.0).alias("seconds"), H.tick_seconds(F.col("tick"), None).alias("seconds_without_rate"))


@query("h14_bomb_conflicts", "SELECT * FROM bloc")
def _(t):
    return tl(t).bomb_localized


cte("mreq", "SELECT match_id, round_id, round_number, 'round_start' AS label, start_tick AS tick FROM rounds WHERE NOT is_warmup UNION ALL SELECT match_id, round_id, round_number, 'freeze_end', freeze_end_tick FROM rounds WHERE NOT is_warmup UNION ALL SELECT match_id, round_id, round_number, 'final', official_end_tick FROM rounds WHERE NOT is_warmup")


@query("h15_milestones", state_sql("mreq", "match_id, round_id, round_number, label, tick"))
def _(t):
    return tl(t).milestones.withColumn("alive_players", F.nullif(text(F.col("alive_players")), F.lit("")))
