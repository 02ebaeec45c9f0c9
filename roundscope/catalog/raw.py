"""Raw normalization, round resolution, identity and integrity checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import text, union_all
from ..operators import checks as G
from ..operators import identity as D
from ..operators import normalize as B
from ..operators import rounds as C
from ..plans.canonical import CanonicalMatches
from ..sources.bridge import RAW_KEYS, SPARSE
from .registry import cte, query, scoped
from .stats import TEAM_MATCH, stats

INT = "CASE WHEN regexp_full_match({0}, '\\s*[+-]?[0-9]+\\s*') THEN TRY_CAST(trim({0}) AS BIGINT) END"


def _int(c):
    return INT.format(c)


def _nn(c):
    return f"CASE WHEN {_int(c)} >= 0 THEN {_int(c)} END"


def _flt(c):
    return f"CASE WHEN isfinite(TRY_CAST(trim({c}) AS DOUBLE)) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _bool(c):
    return f"CASE WHEN lower(trim({c})) IN ('1', 'true', 'yes', 'y') THEN TRUE WHEN lower(trim({c})) IN ('0', 'false', 'no', 'n') THEN FALSE END"


def _side(c):
    return (f"CASE WHEN lower(trim({c})) IN ('2', 't', 'terrorist', 'terrorists', 'team_t') THEN 'T' "
            f"WHEN lower(trim({c})) IN ('3', 'ct', 'counter-terrorist', 'counter-terrorists', 'team_ct') THEN 'CT' ELSE 'UNKNOWN' END")


def _txt(c):
    return f"nullif(trim({c}), '')"


def _sid(c):
    v = f"regexp_replace(trim({c}), '^([0-9]+)\\.0$', '\\1')"
    return f"CASE WHEN regexp_full_match({v}, '[0-9]{{1,32}}') AND NOT regexp_full_match({v}, '0+') THEN {v} END"


def _site(c):
    return (f"CASE WHEN lower({_txt(c)}) IN ('a', 'bombsite_a', 'site_a') THEN 'A' WHEN lower({_txt(c)}) IN ('b', 'bombsite_b', 'site_b') THEN 'B' END")


#: The first spelling of the tick's field that a row has, even if it holds nothing.
_TICK = "CASE WHEN k % 2 = 1 AND other_tick IS NOT NULL THEN other_tick ELSE tick_text END"
cte("nr0", f"""SELECT *, row_hash || ':' || ordinal AS row_key FROM (SELECT *, sha256(payload) AS row_hash, CAST({_nn(_TICK)} AS INT) AS tick,
  row_number() OVER (PARTITION BY match_id, source_event, payload) - 1 AS ordinal FROM raw_payload WHERE source_event = 'player_info' OR NOT coalesce({_bool('warm')}, FALSE))""")


def _role_sql(role, steam, name, team, bot, events, neg=False):
    sid, nm = _sid(steam), _txt(name) if name else "CAST(NULL AS VARCHAR)"
    side, bots = _side(team) if team else "'UNKNOWN'", f"coalesce({_bool(bot)}, FALSE)" if bot else "FALSE"
    if role == "user":
        plain = f"({sid}) IS NULL AND ({nm}) IS NULL"
        sid, nm = f"CASE WHEN {plain} THEN {_sid('p_steam')} ELSE {sid} END", f"CASE WHEN {plain} THEN {_txt('p_name')} ELSE {nm} END"
        side, bots = f"CASE WHEN {plain} THEN 'UNKNOWN' ELSE {side} END", f"CASE WHEN {plain} THEN coalesce({_bool('p_bot')}, FALSE) ELSE FALSE END"
    pid = (f"CASE WHEN sid IS NOT NULL THEN sha256(match_id || ':player:steam:' || sid) ELSE "
           f"sha256(match_id || ':player:unknown:' || source_event || ':' || row_key || ':{role}:' || coalesce(nm, '')) END")
    return (f"SELECT match_id, source_event, tick, row_key, '{role}' AS role, sid AS steam, nm AS name, sd AS side, bot AS is_bot, {pid} AS player_id FROM "
            f"(SELECT *, {sid} AS sid, {nm} AS nm, {side} AS sd, {bots} AS bot FROM nr0 WHERE source_event {'NOT ' if neg else ''}IN ({events})) "
            "WHERE CASE WHEN source_event = 'player_info' THEN TRUE WHEN source_event IN ('player_connect_full', 'player_disconnect') THEN sid IS NOT NULL ELSE sid IS NOT NULL OR nm IS NOT NULL END")


cte("nroles", " UNION ALL ".join([
    _role_sql("attacker", "a_steam", "a_name", "a_team", "a_bot", "'player_death', 'player_hurt', 'player_blind'"),
    _role_sql("victim", "u_steam", "u_name", "u_team", None, "'player_death', 'player_hurt'"),
    _role_sql("assister", "s_steam", None, None, None, "'player_death'"),
    _role_sql("user", "u_steam", "u_name", "u_team", None, "'player_death', 'player_hurt'", True)]))


def canonical(t) -> CanonicalMatches:
    """The canonical tables of the landing rows; steps that several others read are written once."""
    return t.layer("canonical", lambda: CanonicalMatches(t.raw_events, t.raw_marks, lambda df, name: t.stored(df, f"canonical_{name}")))


@query("b01_alias_projection", "SELECT event_id, user_id AS player, CAST(NULL AS VARCHAR) AS absent FROM events")
def _(t):
    df = t.read("events")
    return df.select("event_id", B.alias_column(df, ("player_id", "USER_ID", "event_id")).alias("player"), B.alias_column(df, ("nope", "missing")).alias("absent"))


@query("b02_safe_casts", f"SELECT seq, {_txt('weapon')} AS weapon, {_int('penetrated')} AS penetrated, {_nn('penetrated')} AS penetrated_nn, {_flt('distance')} AS distance, "
       f"{_bool('headshot')} AS headshot, {_nn('health_after')} AS health FROM raw_all")
def _(t):
    r = B.lowered(t.raw_events)
    f = B.field
    return r.select(B.optional_int(f("seq")).alias("seq"), B.optional_text(f("weapon")).alias("weapon"), B.optional_int(f("penetrated")).alias("penetrated"),
                    B.non_negative_int(f("penetrated")).alias("penetrated_nn"), B.optional_float(f("distance")).alias("distance"),
                    B.optional_bool(f("headshot")).alias("headshot"), B.non_negative_int(f("health")).alias("health"))


@query("b03_side_names", f"SELECT seq, {_side('a_team')} AS attacker_side, {_side('u_team')} AS user_side FROM raw_all")
def _(t):
    r = B.lowered(t.raw_events)
    return r.select(B.optional_int(B.field("seq")).alias("seq"), B.normalize_side(B.field("attacker_team_name", "attacker_team")).alias("attacker_side"),
                    B.normalize_side(B.field("user_team_name", "user_team")).alias("user_side"))


@query("b04_platform_ids", f"SELECT seq, {_sid('a_steam')} AS attacker, {_sid('u_steam')} AS victim FROM raw_all")
def _(t):
    r = B.lowered(t.raw_events)
    return r.select(B.optional_int(B.field("seq")).alias("seq"), B.steam_id(B.field("attacker_steamid", "attacker_steam_id")).alias("attacker"),
                    B.steam_id(B.field("user_steamid", "user_steam_id")).alias("victim"))


@query("b05_role_rows", "SELECT * FROM nroles")
def _(t):
    return canonical(t).roles


@query("b06_row_keys", "SELECT match_id, source_event, row_hash, ordinal, row_key, tick FROM nr0")
def _(t):
    return canonical(t).rows.select("match_id", "source_event", "row_hash", "ordinal", "row_key", "tick")


# -- rounds ------------------------------------------------------------------
_KIND = {"start": "'round_prestart', 'round_start', 'round_poststart', 'round_freeze_end'", "end": "'round_end', 'round_officially_ended'"}
_PREC = "CASE source_event WHEN 'round_prestart' THEN 1 WHEN 'round_start' THEN 2 WHEN 'round_poststart' THEN 3 WHEN 'round_freeze_end' THEN 4 WHEN 'round_end' THEN 5 ELSE 6 END"
cte("bnd", f"""SELECT match_id, source_event, CAST(rnum AS INT) AS round_number, max(tick) AS tick FROM (
  SELECT *, CASE WHEN source_event IN ({_KIND['start']}) THEN marker + 1 ELSE marker END AS rnum FROM raw_marks WHERE marker IS NOT NULL AND source_event IN ({_KIND['start']}, {_KIND['end']}))
  WHERE rnum > 0 GROUP BY 1, 2, 3
  UNION ALL SELECT match_id, source_event, CAST(dense_rank() OVER (PARTITION BY match_id, source_event ORDER BY tick) AS INT), tick FROM (
  SELECT DISTINCT match_id, source_event, tick FROM raw_marks m WHERE source_event IN ({_KIND['start']}, {_KIND['end']}) AND marker IS NULL
  AND NOT EXISTS (SELECT 1 FROM raw_marks o WHERE o.match_id = m.match_id AND o.source_event = m.source_event AND o.marker IS NOT NULL))""")
_CNT = "(SELECT CASE WHEN count(DISTINCT marker) > 0 THEN count(DISTINCT marker) ELSE count(DISTINCT tick) END FROM raw_marks x WHERE x.match_id = m.match_id AND x.source_event = {})"


def _fam(*names):
    return "coalesce(" + ", ".join(f"nullif({_CNT.format(repr(n))}, 0)" for n in names) + ")"


cte("rc", f"""SELECT match_id, counter_rounds, end_rounds, start_rounds, coalesce(counter_rounds, end_rounds, start_rounds) AS selected,
  CASE WHEN counter_rounds IS NOT NULL THEN 'max_total_rounds_played' WHEN end_rounds IS NOT NULL THEN 'canonical_round_end_count' WHEN start_rounds IS NOT NULL THEN 'canonical_round_start_count' END AS selected_source,
  coalesce(end_rounds <> coalesce(counter_rounds, end_rounds, start_rounds), FALSE) OR coalesce(start_rounds <> coalesce(counter_rounds, end_rounds, start_rounds), FALSE) AS disagreement
  FROM (SELECT match_id, CAST(nullif((SELECT max(marker) FROM raw_marks x WHERE x.match_id = m.match_id), 0) AS BIGINT) AS counter_rounds,
    {_fam('round_officially_ended', 'round_end')} AS end_rounds, {_fam('round_prestart', 'round_start', 'round_poststart')} AS start_rounds FROM (SELECT DISTINCT match_id FROM raw_marks) m)""")
cte("bfirst", f"""SELECT *, row_number() OVER (PARTITION BY match_id, round_number, source_event IN ({_KIND['end']}) ORDER BY {_PREC}) AS pick FROM bnd""")
cte("ots", "SELECT match_id, list_sort(list(DISTINCT marker))[2] + 1 AS overtime_from FROM raw_marks WHERE source_event = 'announce_phase_end' AND marker > 0 GROUP BY match_id")
cte("rr", f"""SELECT g.match_id, g.round_number, s.tick AS start_tick, fz.tick AS freeze_end_tick, coalesce(e.tick, p.tick) AS end_tick, o.tick AS official_end_tick, s.source_event AS start_source,
  coalesce(e.source_event, 'fallback:' || p.source_event) AS end_source, coalesce(g.round_number >= ots.overtime_from, FALSE) AS is_overtime,
  s.tick IS NOT NULL AND coalesce(e.tick, p.tick) IS NOT NULL AS is_complete,
  CASE WHEN coalesce(e.tick, p.tick) IS NULL THEN CASE WHEN g.round_number = g.selected THEN 'missing_final_round_end' ELSE 'missing_round_end' END WHEN s.tick IS NULL THEN 'missing_round_start' END AS exclusion_reason
  FROM (SELECT match_id, selected, CAST(unnest(generate_series(1, selected)) AS INT) AS round_number FROM rc) g
  LEFT JOIN bfirst s ON s.match_id = g.match_id AND s.round_number = g.round_number AND s.source_event IN ({_KIND['start']}) AND s.pick = 1
  LEFT JOIN bfirst e ON e.match_id = g.match_id AND e.round_number = g.round_number AND e.source_event IN ({_KIND['end']}) AND e.pick = 1
  LEFT JOIN bnd fz ON fz.match_id = g.match_id AND fz.round_number = g.round_number AND fz.source_event = 'round_freeze_end'
  LEFT JOIN bnd o ON o.match_id = g.match_id AND o.round_number = g.round_number AND o.source_event = 'round_officially_ended'
  LEFT JOIN raw_marks p ON p.match_id = g.match_id AND p.source_event = 'cs_win_panel_match' AND p.marker = g.selected AND g.round_number = g.selected
  LEFT JOIN ots ON ots.match_id = g.match_id""")


@query("c01_round_count", "SELECT * FROM rc")
def _(t):
    return C.round_count(t.raw_marks)


@query("c02_boundaries", "SELECT * FROM bnd")
def _(t):
    return C.boundaries(t.raw_marks)


def _cols(name, sql, fn, cols):
    @query(name, f"SELECT {', '.join(cols)} FROM {sql}")
    def _(t):
        return fn(t).select(*cols)


_RR = lambda t: C.resolve_rounds(t.raw_marks)
_cols("c03_source_precedence", "rr", _RR, ["match_id", "round_number", "start_tick", "start_source", "end_tick", "end_source"])
_cols("c04_terminal_boundary", "rr", _RR, ["match_id", "round_number", "end_source", "is_complete", "exclusion_reason"])
_cols("c05_overtime_rounds", "rr", _RR, ["match_id", "round_number", "is_overtime"])

cte("asg", """SELECT e.event_id, e.match_id, e.tick, r.round_id, r.round_number, e.tick - r.start_tick AS relative_tick,
  CASE WHEN r.round_id IS NULL THEN 'unknown' WHEN e.tick < r.freeze_end_tick THEN 'freeze_time' WHEN e.tick >= r.end_tick THEN 'post_round' WHEN e.tick >= r.freeze_end_tick THEN 'live' ELSE 'unknown' END AS phase
  FROM ev e LEFT JOIN (SELECT *, lead(start_tick) OVER (PARTITION BY match_id ORDER BY start_tick) AS nxt FROM rounds) r
  ON r.match_id = e.match_id AND e.tick >= r.start_tick AND (r.nxt IS NULL OR e.tick < r.nxt)""")


@query("c06_event_rounds", "SELECT * FROM asg")
def _(t):
    return C.assign_rounds(t.ev.select("event_id", "match_id", "tick"), t.rounds).select("event_id", "match_id", "tick", "round_id", "round_number", "relative_tick", "phase")


cte("ob", f"""SELECT match_id, CAST(marker AS INT) AS round_number, {_side('winner')} AS sd, winner, t_score, ct_score, {_txt('reason')} AS reason FROM raw_marks m
  WHERE source_event IN ('round_end', 'round_officially_ended', 'cs_win_panel_match') AND marker >= 1
  QUALIFY tick = max(tick) OVER (PARTITION BY match_id, marker, source_event)""")
cte("obr", """SELECT r.match_id, r.round_number, list_sort(coalesce(list(DISTINCT sd) FILTER (winner IS NOT NULL AND sd <> 'UNKNOWN'), [])) AS sides, coalesce(bool_or(winner IS NOT NULL), FALSE) AS anyw,
  list_sort(coalesce(list(DISTINCT {'t': CAST(t_score AS BIGINT), 'ct': CAST(ct_score AS BIGINT)}) FILTER (t_score IS NOT NULL AND ct_score IS NOT NULL), [])) AS scores,
  list_sort(coalesce(list(DISTINCT reason) FILTER (reason IS NOT NULL), [])) AS rs FROM rr r LEFT JOIN ob USING (match_id, round_number) GROUP BY r.match_id, r.round_number""")
cte("obw", """SELECT *, CASE WHEN len(sides) = 1 THEN sides[1] END AS winner, CASE WHEN len(sides) = 1 THEN 'source_event' WHEN anyw THEN 'unresolved_conflict' ELSE 'missing_from_source' END AS st FROM obr""")
_W = """CASE WHEN o.winner IS NOT NULL THEN o.winner WHEN o.st = 'missing_from_source' AND p.pt IS NOT NULL THEN
  CASE WHEN (list_contains(o.scores, {'t': p.pt + 1, 'ct': p.pc}) OR list_contains(o.scores, {'t': p.pc + 1, 'ct': p.pt})) AND NOT (list_contains(o.scores, {'t': p.pt, 'ct': p.pc + 1}) OR list_contains(o.scores, {'t': p.pc, 'ct': p.pt + 1})) THEN 'T'
       WHEN NOT (list_contains(o.scores, {'t': p.pt + 1, 'ct': p.pc}) OR list_contains(o.scores, {'t': p.pc + 1, 'ct': p.pt})) AND (list_contains(o.scores, {'t': p.pt, 'ct': p.pc + 1}) OR list_contains(o.scores, {'t': p.pc, 'ct': p.pt + 1})) THEN 'CT' END END"""
cte("scf", f"""SELECT match_id, round_number, w, ds, CAST(bt AS BIGINT) AS bt, CAST(bc AS BIGINT) AS bc, CAST(pt AS BIGINT) AS pt, CAST(pc AS BIGINT) AS pc FROM (
    SELECT match_id, 0 AS round_number, CAST(NULL AS VARCHAR) AS w, FALSE AS ds, CAST(NULL AS BIGINT) AS bt, CAST(NULL AS BIGINT) AS bc, CAST(NULL AS BIGINT) AS pt, CAST(NULL AS BIGINT) AS pc FROM rc)
  UNION ALL SELECT match_id, round_number, w, ds, h['bt'], h['bc'], h['at'], h['ac'] FROM (
    SELECT *, CASE WHEN len(m) = 1 AND m[1]['bt'] >= 0 AND m[1]['bc'] >= 0 THEN m[1] END AS h FROM (
      SELECT *, CASE WHEN w IS NULL THEN [] WHEN ppt IS NULL THEN list_transform(scores, lambda c: {{'bt': c.t - dt, 'bc': c.ct - dc, 'at': c.t, 'ac': c.ct}})
        ELSE list_distinct(list_concat(
          CASE WHEN list_contains(scores, {{'t': ppt + dt, 'ct': ppc + dc}}) THEN [{{'bt': ppt, 'bc': ppc, 'at': ppt + dt, 'ac': ppc + dc}}] ELSE [] END,
          CASE WHEN list_contains(scores, {{'t': ppc + dt, 'ct': ppt + dc}}) THEN [{{'bt': ppc, 'bc': ppt, 'at': ppc + dt, 'ac': ppt + dc}}] ELSE [] END)) END AS m FROM (
        SELECT *, CAST(w = 'T' AS BIGINT) AS dt, CAST(w = 'CT' AS BIGINT) AS dc FROM (
          SELECT o.match_id, o.round_number, {_W} AS w, o.winner IS NULL AND ({_W}) IS NOT NULL AS ds, o.scores, p.pt AS ppt, p.pc AS ppc
          FROM scf p JOIN obw o ON o.match_id = p.match_id AND o.round_number = p.round_number + 1))))""")
cte("oc", """SELECT o.match_id, o.round_number, f.w AS winner_side, CASE WHEN f.ds THEN 'derived_from_authoritative_score_delta' ELSE o.st END AS outcome_status,
  f.bt AS score_t_before, f.bc AS score_ct_before, f.pt AS score_t_after, f.pc AS score_ct_after,
  CASE WHEN len(o.scores) = 0 THEN 'missing_from_source' WHEN f.pt IS NULL THEN 'unresolved' ELSE 'available' END AS score_status,
  CASE WHEN len(o.rs) = 1 THEN o.rs[1] END AS end_reason, CASE WHEN len(o.rs) = 1 THEN 'available' WHEN len(o.rs) > 1 THEN 'unresolved' ELSE 'missing_from_source' END AS end_reason_status
  FROM obw o JOIN scf f USING (match_id, round_number)""")
_OC = lambda t: C.resolve_outcomes(C.resolve_rounds(t.raw_marks), t.raw_marks)
_cols("c07_winner_sources", "oc", _OC, ["match_id", "round_number", "winner_side", "outcome_status"])
_cols("c08_winner_from_score", "oc", lambda t: _OC(t).where("outcome_status LIKE 'derived%'"), ["match_id", "round_number", "winner_side"])
_cols("c09_round_scores", "oc", _OC, ["match_id", "round_number", "score_t_before", "score_ct_before", "score_t_after", "score_ct_after", "score_status"])
_cols("c10_end_reason", "oc", _OC, ["match_id", "round_number", "end_reason", "end_reason_status"])
from .registry import ORACLES  # noqa: E402

ORACLES["c08_winner_from_score"] += " WHERE outcome_status LIKE 'derived%'"


def _cap(name, ok, st):
    return (f"SELECT match_id, '{name}' AS capability, count(*) AS total, count(*) FILTER ({ok}) AS rounds_available, count(*) FILTER (NOT ({ok}) AND {st} = 'missing_from_source') AS rounds_missing, "
            f"count(*) FILTER (NOT ({ok}) AND {st} <> 'missing_from_source') AS rounds_unresolved FROM oc GROUP BY match_id")


@query("c11_coverage_policy", "SELECT *, CASE WHEN rounds_available = total THEN 'available' WHEN rounds_available > 0 THEN 'partial' WHEN rounds_unresolved > 0 THEN 'unresolved' ELSE 'missing_from_source' END AS status, "
       "rounds_available = total AS can_compute, rounds_available / total AS coverage FROM (" + " UNION ALL ".join([
           _cap("round_winner", "outcome_status IN ('source_event', 'derived_from_authoritative_score_delta')", "outcome_status"),
           _cap("round_score", "score_status = 'available'", "score_status"), _cap("round_end_reason", "end_reason_status = 'available'", "end_reason_status")]) + ")")
def _(t):
    return C.coverage_policy(_OC(t))


# -- identity ----------------------------------------------------------------
cte("rb", "SELECT *, match_id || '-r' || round_number AS round_id FROM rr")


cte("pid", """SELECT match_id, player_id, max(steam) AS steam_id, coalesce(arg_max(name, (CASE WHEN source_event = 'player_info' THEN -1 ELSE coalesce(tick, -1) END, name)), 'UnknownPlayer-' || substr(player_id, 1, 8)) AS current_name,
  coalesce(string_agg(DISTINCT name, ',' ORDER BY name), 'UnknownPlayer-' || substr(player_id, 1, 8)) AS known_names, bool_or(is_bot) AS is_bot, count(DISTINCT name) > 1 AS nickname_change_observed,
  coalesce(max(tick) FILTER (source_event = 'player_connect_full') > min(tick) FILTER (source_event = 'player_disconnect'), FALSE) AS reconnect_observed, max(steam) IS NULL AS steam_id_missing
  FROM nroles GROUP BY match_id, player_id""")


cte("obs", """SELECT o.match_id, o.player_id, o.tick, o.side, o.source_event || '.' || o.role AS source, r.round_number, r.start_tick FROM nroles o
  JOIN (SELECT *, lead(start_tick) OVER (PARTITION BY match_id ORDER BY start_tick) AS nxt FROM rb) r ON r.match_id = o.match_id AND o.tick >= r.start_tick AND (r.nxt IS NULL OR o.tick < r.nxt)
  WHERE o.tick IS NOT NULL AND o.side <> 'UNKNOWN'""")
cte("fsd", "SELECT match_id, player_id, round_number AS first_round, side AS first_side FROM obs QUALIFY row_number() OVER (PARTITION BY match_id, player_id ORDER BY tick, source, side) = 1")
cte("seed", """SELECT match_id, seed_round, sha256(match_id || ':physical-team:' || sig) AS team_id, CASE WHEN row_number() OVER (PARTITION BY match_id ORDER BY sig) = 1 THEN 'TeamAlpha' ELSE 'TeamBravo' END AS internal_name,
  sig AS starting_player_ids, CASE WHEN n >= 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS identity_confidence FROM (
  SELECT match_id, first_round AS seed_round, first_side, string_agg(player_id, ',' ORDER BY player_id) AS sig, count(*) AS n FROM fsd QUALIFY first_round = min(first_round) OVER (PARTITION BY match_id) GROUP BY 1, 2, 3)""".replace(
    " FROM fsd QUALIFY first_round = min(first_round) OVER (PARTITION BY match_id) GROUP BY 1, 2, 3", " FROM (SELECT *, min(first_round) OVER (PARTITION BY match_id) AS m FROM fsd) WHERE first_round = m GROUP BY 1, 2, 3"))
cte("ptm", """SELECT match_id, team_id, unnest(string_split(starting_player_ids, ',')) AS player_id FROM seed
  UNION ALL SELECT l.match_id, v.team_id, l.player_id FROM fsd l JOIN (
    SELECT f.match_id, f.player_id, s.team_id, row_number() OVER (PARTITION BY f.match_id, f.player_id ORDER BY count(*) DESC, min((o.tick, o.player_id, o.source))) AS pick
    FROM fsd f JOIN obs o ON o.match_id = f.match_id AND o.round_number = f.first_round AND o.side = f.first_side
    JOIN (SELECT match_id, team_id, unnest(string_split(starting_player_ids, ',')) AS pid FROM seed) s ON s.match_id = o.match_id AND s.pid = o.player_id
    GROUP BY f.match_id, f.player_id, s.team_id) v ON v.match_id = l.match_id AND v.player_id = l.player_id AND v.pick = 1
  WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.match_id = l.match_id AND contains(s.starting_player_ids, l.player_id))""")


@query("d01_player_identity", "SELECT p.*, t.team_id FROM pid p LEFT JOIN ptm t USING (match_id, player_id)")
def _(t):
    return canonical(t).players.withColumn("known_names", text(F.col("known_names")))


@query("d02_first_side", "SELECT * FROM fsd")
def _(t):
    return canonical(t).first_sides


@query("d03_seed_teams", "SELECT * FROM seed")
def _(t):
    return canonical(t).teams.withColumn("starting_player_ids", text(F.col("starting_player_ids")))


@query("d04_player_teams", "SELECT match_id, player_id, team_id FROM ptm")
def _(t):
    return canonical(t).player_teams.select("match_id", "player_id", "team_id")


cte("sv", """SELECT match_id, round_number, side, team_id FROM (SELECT o.match_id, o.round_number, o.side, p.team_id, row_number() OVER (PARTITION BY o.match_id, o.round_number, o.side
  ORDER BY count(*) DESC, min((o.tick, o.player_id, o.source))) AS pick FROM obs o JOIN ptm p USING (match_id, player_id) GROUP BY 1, 2, 3, 4) WHERE pick = 1""")
cte("sd1", """SELECT r.match_id, r.round_number, r.start_tick, r.end_tick, r.is_overtime AS marked_overtime, ids, coalesce(t.team_id, CASE WHEN c.team_id IS NOT NULL AND len(ids) = 2 THEN CASE WHEN c.team_id = ids[1] THEN ids[2] ELSE ids[1] END END) AS t1,
  coalesce(c.team_id, CASE WHEN t.team_id IS NOT NULL AND len(ids) = 2 THEN CASE WHEN t.team_id = ids[1] THEN ids[2] ELSE ids[1] END END) AS c1
  FROM rb r LEFT JOIN sv t ON t.match_id = r.match_id AND t.round_number = r.round_number AND t.side = 'T' LEFT JOIN sv c ON c.match_id = r.match_id AND c.round_number = r.round_number AND c.side = 'CT'
  LEFT JOIN (SELECT match_id, list_sort(list(DISTINCT team_id)) AS ids FROM seed GROUP BY match_id) i ON i.match_id = r.match_id""")
cte("sd2", """SELECT *, last_value(CASE WHEN t1 <> c1 THEN {'t': t1, 'c': c1} END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY round_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM sd1""")
cte("sides", """SELECT match_id, round_number, start_tick, end_tick, t_team_id, ct_team_id, sum(CASE WHEN t1 <> c1 AND t1 = prev['c'] AND c1 = prev['t'] THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY round_number) >= 2 OR marked_overtime AS is_overtime,
  coalesce(t_team_id <> ct_team_id, FALSE) AS side_certain FROM (SELECT *, CASE WHEN t1 IS NULL AND c1 IS NULL AND len(ids) = 2 THEN prev['t'] ELSE t1 END AS t_team_id,
  CASE WHEN t1 IS NULL AND c1 IS NULL AND len(ids) = 2 THEN prev['c'] ELSE c1 END AS ct_team_id FROM sd2)""")


@query("d05_round_sides", "SELECT * FROM sides")
def _(t):
    return canonical(t).sides


cte("legs", "SELECT match_id, round_number, start_tick, end_tick, t_team_id AS team_id, 'T' AS side FROM sides WHERE t_team_id IS NOT NULL AND start_tick IS NOT NULL UNION ALL SELECT match_id, round_number, start_tick, end_tick, ct_team_id, 'CT' FROM sides WHERE ct_team_id IS NOT NULL AND start_tick IS NOT NULL AND ct_team_id IS DISTINCT FROM t_team_id")
cte("spans", """SELECT match_id, team_id, side, island, min(start_tick) AS a, arg_max(end_tick, round_number) AS z FROM (SELECT *, sum(c) OVER (PARTITION BY match_id, team_id ORDER BY round_number) AS island FROM (
  SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY match_id, team_id ORDER BY round_number) THEN 0 ELSE 1 END AS c FROM legs)) GROUP BY 1, 2, 3, 4""")


cte("mem", """SELECT s.match_id, p.player_id, s.team_id, s.side, s.a AS valid_from_tick, coalesce(lead(s.a) OVER (PARTITION BY s.match_id, s.team_id, p.player_id ORDER BY s.island) - 1, s.z) AS valid_to_tick
  FROM spans s JOIN ptm p ON p.match_id = s.match_id AND p.team_id = s.team_id""")


@query("d06_membership_intervals", "SELECT * FROM mem")
def _(t):
    return canonical(t).memberships


_EV = [("kills", "attacker"), ("kills", "victim"), ("damages", "attacker"), ("damages", "victim"), ("shots", ""), ("grenades", ""), ("bombs", "")]


def _ecols(role):
    return [f"{role}_{c}" if role else c for c in ("player_id", "team_id", "side")]


cte("evid", " UNION ALL ".join(f"SELECT match_id, round_id, {', '.join(f'{c} AS {n}' for c, n in zip(_ecols(r), ('player_id', 'team_id', 'side')))}, tick FROM {s}" for s, r in _EV))


def evidence(t):
    return union_all(*[getattr(t, s).select("match_id", "round_id", *[F.col(c).alias(n) for c, n in zip(_ecols(r), ("player_id", "team_id", "side"))], "tick") for s, r in _EV])


cte("dm", """SELECT DISTINCT r.round_id, m.player_id, m.team_id || '/' || CASE WHEN m.team_id = r.t_team_id THEN 'T' ELSE 'CT' END AS v FROM rounds r JOIN memberships m ON m.match_id = r.match_id AND m.team_id IN (r.t_team_id, r.ct_team_id)
  AND m.valid_from_tick <= r.official_end_tick AND (m.valid_to_tick IS NULL OR m.valid_to_tick >= r.start_tick) WHERE NOT r.is_warmup""")
cte("dob", """SELECT e.round_id, e.player_id, e.tick, CASE WHEN e.team_id IS NOT NULL THEN CASE WHEN e.team_id = r.t_team_id AND e.side IN ('T', 'UNKNOWN') THEN e.team_id || '/T' WHEN e.team_id = r.ct_team_id AND e.side IN ('CT', 'UNKNOWN') THEN e.team_id || '/CT' END
  WHEN e.side = 'T' THEN r.t_team_id || '/T' WHEN e.side = 'CT' THEN r.ct_team_id || '/CT' END AS v FROM evid e JOIN rounds r USING (round_id) WHERE NOT r.is_warmup AND e.player_id IS NOT NULL""")
cte("d8", """SELECT g.match_id, g.round_id, g.round_number, g.player_id, m.ms, o.os, o.first_seen_tick, o.last_seen_tick FROM (
    SELECT r.match_id, r.round_id, r.round_number, p.player_id FROM rounds r JOIN (SELECT match_id, player_id FROM players UNION SELECT match_id, player_id FROM memberships) p USING (match_id) WHERE NOT r.is_warmup
    UNION SELECT r.match_id, r.round_id, r.round_number, d.player_id FROM dob d JOIN rounds r USING (round_id)) g
  LEFT JOIN (SELECT round_id, player_id, list_sort(list(DISTINCT v)) AS ms FROM dm GROUP BY 1, 2) m USING (round_id, player_id)
  LEFT JOIN (SELECT round_id, player_id, list_sort(list(DISTINCT v) FILTER (v IS NOT NULL)) AS os, min(tick) AS first_seen_tick, max(tick) AS last_seen_tick FROM dob GROUP BY 1, 2) o USING (round_id, player_id)""")
cte("ps", """SELECT match_id, round_id, round_number, player_id, string_split(who, '/')[1] AS team_id, coalesce(string_split(who, '/')[2], 'UNKNOWN') AS side, st AS participation_status,
  CASE st WHEN 'inferred_from_membership' THEN 'alive' WHEN 'not_participating' THEN 'not_participating' ELSE 'unknown' END AS initial_life, first_seen_tick, last_seen_tick FROM (
  SELECT *, CASE WHEN len(ms) = 1 AND len(os) > 0 AND os <> ms THEN 'unresolved' WHEN len(ms) = 1 THEN 'inferred_from_membership' WHEN len(ms) > 1 THEN 'unresolved' WHEN len(os) = 1 THEN 'event_observed'
    WHEN first_seen_tick IS NOT NULL THEN 'unresolved' ELSE 'not_participating' END AS st, CASE WHEN len(ms) = 1 THEN ms[1] WHEN coalesce(len(ms), 0) = 0 AND len(os) = 1 THEN os[1] END AS who FROM d8)""")


@query("d08_participation_status", "SELECT * FROM ps")
def _(t):
    return D.participation_status(t.rounds, t.players, t.memberships, evidence(t))


cte("nmv", """SELECT match_id, team_id, name, count(*) AS n FROM (SELECT match_id, team_id, round_number, min(name) AS name FROM (
    SELECT *, min(rk) OVER (PARTITION BY match_id, team_id, round_number) AS best FROM (
      SELECT m.match_id, r.round_number, x.team_id, nullif(trim(regexp_replace(x.raw, '\\s+', ' ', 'g')), '') AS name, CASE m.source_event WHEN 'round_freeze_end' THEN 1 WHEN 'round_start' THEN 2 WHEN 'round_poststart' THEN 3 WHEN 'round_prestart' THEN 4 ELSE 5 END AS rk
      FROM raw_marks m JOIN (SELECT *, lead(start_tick) OVER (PARTITION BY match_id ORDER BY start_tick) AS nxt FROM rounds) r ON r.match_id = m.match_id AND m.tick >= 0 AND m.tick >= r.start_tick AND (r.nxt IS NULL OR m.tick < r.nxt),
      LATERAL (SELECT r.t_team_id AS team_id, m.t_clan AS raw UNION ALL SELECT r.ct_team_id, m.ct_clan) x
      WHERE m.source_event IN ('round_freeze_end', 'round_start', 'round_poststart', 'round_prestart', 'round_end')) WHERE name IS NOT NULL)
  WHERE rk = best GROUP BY 1, 2, 3 HAVING count(DISTINCT name) = 1) GROUP BY 1, 2, 3""")
cte("nmt", """SELECT match_id, team_id, name, n, sum(n) OVER (PARTITION BY match_id, team_id) AS d, row_number() OVER w AS pick, lead(n) OVER w AS second FROM nmv WINDOW w AS (PARTITION BY match_id, team_id ORDER BY n DESC, lower(name), name)""")
cte("nmg", """SELECT match_id, team_id, tag, n, row_number() OVER (PARTITION BY match_id, team_id ORDER BY n DESC, lower(tag)) AS pick, lead(n) OVER (PARTITION BY match_id, team_id ORDER BY n DESC, lower(tag)) AS second FROM (
  SELECT match_id, team_id, nullif(regexp_extract(current_name, '^\\[([A-Za-z0-9_-]{2,12})\\]', 1), '') AS tag, count(*) AS n FROM players GROUP BY 1, 2, 3) WHERE tag IS NOT NULL""")


@query("d09_team_names", """SELECT match_id, team_id, CASE WHEN nok THEN name WHEN tok THEN tag END AS display_name, CASE WHEN nok THEN 'round_team_clan_name' WHEN tok THEN 'player_nickname_clan_tag' END AS source,
  CAST(CASE WHEN nok THEN nn WHEN tok THEN tn ELSE 0 END AS BIGINT) AS numerator, CAST(CASE WHEN nok THEN d WHEN tok THEN roster ELSE coalesce(d, 0) END AS BIGINT) AS denominator FROM (
  SELECT p.match_id, p.team_id, p.roster, n.name, n.n AS nn, n.d, g.tag, g.n AS tn,
    coalesce(n.n / n.d >= 0.6 AND (n.second IS NULL OR n.second <> n.n) AND NOT regexp_matches(lower(n.name), '^team[_ -]?[0-9]+$') AND lower(n.name) NOT LIKE 'team_%' AND length(n.name) >= 2, FALSE) AS nok,
    coalesce(p.roster >= 3 AND g.n >= 3 AND (g.second IS NULL OR g.second <> g.n) AND g.n / p.roster > 0.5, FALSE) AS tok
  FROM (SELECT match_id, team_id, count(*) AS roster FROM players GROUP BY 1, 2) p LEFT JOIN (SELECT * FROM nmt WHERE pick = 1) n USING (match_id, team_id) LEFT JOIN (SELECT * FROM nmg WHERE pick = 1) g USING (match_id, team_id))""")
def _(t):
    return D.team_names(t.raw_marks, t.rounds, t.players)


cte("rost", """SELECT profile_id, identity_key, steam_id, current_name, appearance_count, selected_match_count,
  CASE WHEN steam_id IS NULL THEN 'unresolved_identity' WHEN appearance_count = selected_match_count THEN 'core' ELSE 'partial' END AS role FROM (
  SELECT s.profile_id, coalesce('steam:' || p.steam_id, 'occurrence:' || p.match_id || ':' || p.player_id) AS identity_key, max(p.steam_id) AS steam_id, count(DISTINCT p.match_id) AS appearance_count,
    arg_max(p.current_name, (s.selection_order, p.current_name)) AS current_name FROM selections s JOIN players p USING (match_id, team_id) GROUP BY 1, 2) JOIN (SELECT profile_id, count(*) AS selected_match_count FROM selections GROUP BY 1) USING (profile_id)""")
cte("ovl", """SELECT c.profile_id, c.match_id, c.team_id, overlap_denominator, missing_ids, overlap_numerator, CASE WHEN overlap_denominator > 0 THEN overlap_numerator / overlap_denominator END AS overlap_frequency,
  CASE WHEN overlap_numerator >= 3 AND overlap_numerator / overlap_denominator >= 0.6 THEN 'strong' WHEN overlap_numerator >= 2 THEN 'possible' ELSE 'weak' END AS strength FROM (
  SELECT r.profile_id, p.match_id, p.team_id, count(DISTINCT p.steam_id) AS overlap_denominator, count(*) FILTER (p.steam_id IS NULL) AS missing_ids,
    count(DISTINCT p.steam_id) FILTER (p.steam_id IN (SELECT steam_id FROM rost x WHERE x.profile_id = r.profile_id)) AS overlap_numerator
  FROM players p CROSS JOIN (SELECT DISTINCT profile_id FROM rost) r GROUP BY 1, 2, 3) c WHERE NOT EXISTS (SELECT 1 FROM selections s WHERE s.profile_id = c.profile_id AND s.match_id = c.match_id)
  AND EXISTS (SELECT 1 FROM players p JOIN rost x ON x.steam_id = p.steam_id WHERE p.match_id = c.match_id AND x.profile_id = c.profile_id)""")


def roster(t):
    return D.selected_roster(t.selections, t.players)


@query("d10_opponent_roster", "SELECT * FROM rost")
def _(t):
    return roster(t)


@query("d11_candidate_overlap", "SELECT * FROM ovl")
def _(t):
    return D.candidate_overlap(t.selections, roster(t), t.players)


cte("sroster", "SELECT DISTINCT s.profile_id, p.steam_id FROM scout_selections s JOIN players p USING (match_id, team_id) WHERE p.steam_id IS NOT NULL")
cte("scand", """SELECT r.profile_id, t.match_id, t.team_id, t.overlap_denominator, t.missing_ids, coalesce(x.n, 0) AS overlap_numerator, CASE WHEN t.overlap_denominator > 0 THEN coalesce(x.n, 0) / t.overlap_denominator END AS overlap_frequency,
  CASE WHEN r.profile_id NOT IN (SELECT profile_id FROM sroster) THEN 'unscored' WHEN coalesce(x.n, 0) >= 3 AND x.n / t.overlap_denominator >= 0.6 THEN 'strong' WHEN coalesce(x.n, 0) >= 2 THEN 'possible' ELSE 'weak' END AS strength
  FROM (SELECT DISTINCT profile_id FROM scout_selections) r CROSS JOIN (SELECT match_id, team_id, count(DISTINCT steam_id) AS overlap_denominator, count(*) FILTER (steam_id IS NULL) AS missing_ids FROM players GROUP BY 1, 2) t
  LEFT JOIN (SELECT s.profile_id, p.match_id, p.team_id, count(DISTINCT p.steam_id) AS n FROM players p JOIN sroster s USING (steam_id) GROUP BY 1, 2, 3) x ON x.profile_id = r.profile_id AND x.match_id = t.match_id AND x.team_id = t.team_id
  WHERE NOT EXISTS (SELECT 1 FROM scout_selections s WHERE s.profile_id = r.profile_id AND s.match_id = t.match_id)""")


def scouted(t):
    return t.scout_selections, D.selected_roster(t.scout_selections, t.players), t.players


@query("d11_overlap_counts", """SELECT p.profile_id, count(*) FILTER (strength = 'strong') AS strong, count(*) FILTER (strength = 'possible') AS possible, count(*) FILTER (strength = 'weak') AS weak, count(*) FILTER (strength = 'unscored') AS unscored
  FROM (SELECT DISTINCT profile_id FROM scout_selections) p LEFT JOIN scand c USING (profile_id) GROUP BY 1""")
def _(t):
    return D.overlap_counts(*scouted(t))


for _p in ("opp0", "new0"):
    query(f"d11_candidates_of_{_p}", f"SELECT * FROM scand WHERE profile_id = '{_p}'")(lambda t, p=_p: D.profile_candidates(p, *scouted(t)))


@query("d12_clear_candidates", """SELECT profile_id, match_id, max(team_id) FILTER (strength = 'strong') AS team_id FROM ovl GROUP BY 1, 2 HAVING count(*) FILTER (strength = 'strong') = 1 AND count(*) FILTER (strength = 'possible') = 0""")
def _(t):
    return D.clear_candidates(D.candidate_overlap(t.selections, roster(t), t.players))


# -- normalized families -----------------------------------------------------
cte("nrs", """SELECT o.*, p.team_id, CASE WHEN o.side <> 'UNKNOWN' THEN o.side ELSE coalesce(m.side, 'UNKNOWN') END AS own_side FROM nroles o LEFT JOIN ptm p USING (match_id, player_id)
  LEFT JOIN mem m ON m.match_id = o.match_id AND m.player_id = o.player_id AND o.tick >= m.valid_from_tick AND (m.valid_to_tick IS NULL OR o.tick <= m.valid_to_tick) WHERE o.tick IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY o.match_id, o.source_event, o.row_key, o.role ORDER BY m.valid_from_tick) = 1""")
cte("nev", "SELECT n.*, " + ", ".join(f"{r}.player_id AS {r}_player_id, {r}.team_id AS {r}_team_id, coalesce({r}.own_side, 'UNKNOWN') AS {r}_side" for r in ("attacker", "victim", "assister", "victim_user"))
    .replace("victim_user_", "user_") + """, r.round_id, r.round_number, n.tick - r.start_tick AS relative_tick,
  CASE WHEN r.round_id IS NULL THEN 'unknown' WHEN n.tick < r.freeze_end_tick THEN 'freeze_time' WHEN n.tick >= r.end_tick THEN 'post_round' WHEN n.tick >= r.freeze_end_tick THEN 'live' ELSE 'unknown' END AS phase
  FROM nr0 n """ + " ".join(f"LEFT JOIN nrs {r} ON {r}.match_id = n.match_id AND {r}.source_event = n.source_event AND {r}.row_key = n.row_key AND {r}.role = '{r.removeprefix('victim_')}'"
                             for r in ("attacker", "victim", "assister", "victim_user")) + """
  LEFT JOIN (SELECT *, lead(start_tick) OVER (PARTITION BY match_id ORDER BY start_tick) AS nxt FROM rb) r
  ON r.match_id = n.match_id AND n.tick >= r.start_tick AND (r.nxt IS NULL OR n.tick < r.nxt) WHERE n.tick IS NOT NULL""")
_GT = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in B.GRENADE_EVENTS.items())
_GL = " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in B.GRENADE_EVENTS.items())
_PAIR = ", ".join(f"{r}_{c}" for r in ("attacker", "victim") for c in ("player_id", "team_id", "side"))
_ONE = "user_player_id AS player_id, user_team_id AS team_id, user_side AS side"


def _event_sql(kind, cols, rule):
    return (f"SELECT sha256(match_id || ':event:{kind}:' || source_event || ':' || tick || ':' || row_key) AS event_id, match_id, round_id, round_number, tick, relative_tick, phase, {cols} "
            f"FROM nev WHERE {rule}")


cte("c_kills", _event_sql("kill", f"""{_PAIR}, assister_player_id, {_txt('weapon')} AS weapon, {_bool('headshot')} AS headshot, {_nn('penetrated')} AS penetrated, CASE WHEN {_flt('distance')} >= 0 THEN {_flt('distance')} END AS distance,
  coalesce(attacker_player_id = victim_player_id, FALSE) AS is_suicide, coalesce(attacker_team_id = victim_team_id AND attacker_player_id <> victim_player_id, FALSE) AS is_teamkill""", "source_event = 'player_death'"))
cte("c_damages", _event_sql("damage", f"{_PAIR}, {_txt('weapon')} AS weapon, {_nn('dmg_health')} AS damage_health, {_nn('health_after')} AS victim_health_after", "source_event = 'player_hurt'"))
cte("c_shots", _event_sql("shot", f"{_ONE}, {_txt('weapon')} AS weapon", "source_event = 'weapon_fire'"))
cte("c_blinds", _event_sql("blind", "attacker_player_id, attacker_team_id, attacker_side, user_player_id AS victim_player_id, user_team_id AS victim_team_id, user_side AS victim_side, "
                           f"CASE WHEN {_flt('blind_duration')} >= 0 THEN {_flt('blind_duration')} END AS duration_seconds", "source_event = 'player_blind'"))
cte("c_grenades", _event_sql("grenade", f"{_ONE}, CASE source_event {_GT} END AS grenade_type, CASE source_event {_GL} END AS lifecycle_event", f"source_event IN ({', '.join(repr(k) for k in B.GRENADE_EVENTS)})"))
cte("c_bombs", _event_sql("bomb", f"{_ONE}, CASE source_event WHEN 'bomb_planted' THEN 'planted' WHEN 'bomb_defused' THEN 'defused' ELSE 'exploded' END AS event_type, site AS site_raw, {_site('site')} AS site_normalized", "source_event LIKE 'bomb_%'"))
cte("c_rounds", """SELECT b.match_id, b.round_id, b.round_number, b.start_tick, b.freeze_end_tick, b.end_tick, b.official_end_tick, s.t_team_id, s.ct_team_id, s.side_certain, s.is_overtime, b.is_complete, o.winner_side,
  CASE WHEN o.outcome_status IN ('source_event', 'derived_from_authoritative_score_delta') THEN 'available' WHEN o.outcome_status = 'unresolved_conflict' THEN 'unresolved_conflict' ELSE 'missing' END AS outcome_status,
  o.score_t_before, o.score_ct_before, o.score_t_after, o.score_ct_after, CASE WHEN o.score_status = 'available' THEN 'available' ELSE 'missing' END AS score_status, o.end_reason, FALSE AS is_warmup
  FROM rb b JOIN sides s USING (match_id, round_number) JOIN oc o USING (match_id, round_number)""")


@query("b07_kills", "SELECT * FROM c_kills")
def _(t):
    return canonical(t).kills


for _n, _s in (("b08_damages", "damages"), ("b08_shots", "shots"), ("b08_blinds", "blinds"), ("b09_grenades", "grenades"), ("b10_bombs", "bombs")):
    query(_n, f"SELECT * FROM c_{_s}")(lambda t, s=_s: getattr(canonical(t), s))


_MIXED = "match_id; event_id; '{0}' AS source_event; tick; round_id; phase; {1} AS actor_player_id; {2} AS target_player_id; {3} AS actor_side; {4} AS weapon; {5} AS damage_health; {6} AS victim_health_after; {7} AS duration_seconds"
_NO_INT, _NO_TEXT, _NO_FLOAT = "CAST(NULL AS BIGINT)", "nullif('', '')", "CAST(NULL AS DOUBLE)"
_FAMILY = {
    "damages": _MIXED.format("player_hurt", "attacker_player_id", "victim_player_id", "attacker_side", "weapon", "damage_health", "victim_health_after", _NO_FLOAT),
    "shots": _MIXED.format("weapon_fire", "player_id", _NO_TEXT, "side", "weapon", _NO_INT, _NO_INT, _NO_FLOAT),
    "blinds": _MIXED.format("player_blind", "attacker_player_id", "victim_player_id", "attacker_side", _NO_TEXT, _NO_INT, _NO_INT, "duration_seconds"),
}


@query("b08_damage_shots_blinds", " UNION ALL ".join(f"SELECT {c.replace('; ', ', ')} FROM c_{n}" for n, c in _FAMILY.items()))
def _(t):
    """The three families in one shape."""
    return union_all(*[getattr(canonical(t), n).selectExpr(*cols.split("; ")) for n, cols in _FAMILY.items()])


@query("b11_event_profile", f"""SELECT source_event, field, present, missing, row_count, missing_tick, coalesce(player_count, 0) AS player_count FROM (
  SELECT source_event, field, count(*) AS present, count(*) FILTER (value IS NULL OR trim(value) = '') AS missing FROM ({' UNION ALL '.join(
    f"SELECT source_event, lower(CASE WHEN k % 2 = 0 THEN '{even}' ELSE '{odd}' END) AS field, CAST({c} AS VARCHAR) AS value FROM raw_all" + (f" WHERE {c} IS NOT NULL" if c in SPARSE else "") for c, (even, odd) in RAW_KEYS.items())}) GROUP BY 1, 2)
  JOIN (SELECT source_event, count(*) AS row_count, count(*) FILTER (({_nn(_TICK)}) IS NULL) AS missing_tick FROM raw_all GROUP BY 1) USING (source_event)
  LEFT JOIN (SELECT source_event, count(DISTINCT steam) AS player_count FROM (SELECT source_event, unnest([{_sid('a_steam')}, {_sid('u_steam')}, {_sid('p_steam')}]) AS steam FROM raw_all) GROUP BY 1) USING (source_event)""")
def _(t):
    return B.event_profile(t.raw_events)


# -- the whole chain ---------------------------------------------------------
_OF_CHAIN = {n: f"SELECT * FROM c_{n}" for n in ("rounds", "kills", "damages", "shots", "grenades", "blinds", "bombs")} | {"memberships": "SELECT * FROM mem"}
_ROUND_COLS = ["match_id", "round_id", "round_number", "start_tick", "freeze_end_tick", "end_tick", "official_end_tick", "t_team_id", "ct_team_id", "side_certain", "is_overtime", "is_complete", "winner_side", "outcome_status",
               "score_t_before", "score_ct_before", "score_t_after", "score_ct_after", "score_status", "end_reason"]


@query("b12_canonical_rounds", f"SELECT {', '.join(_ROUND_COLS)} FROM c_rounds")
def _(t):
    return canonical(t).rounds.select(*_ROUND_COLS)


@query("b13_raw_to_player_match", f"SELECT * FROM ({scoped('SELECT * FROM pm', _OF_CHAIN)})")
def _(t):
    return stats(canonical(t)).player_matches


@query("b14_raw_to_team_match", f"SELECT * FROM ({scoped(TEAM_MATCH, _OF_CHAIN)})")
def _(t):
    return stats(canonical(t)).team_matches


# -- integrity ---------------------------------------------------------------
@query("g01_round_boundaries", """SELECT match_id, code, 'round' AS entity_type, round_id AS entity_id FROM (SELECT *, lead(start_tick) OVER (PARTITION BY match_id ORDER BY round_number) AS nxt FROM dirty_rounds),
  LATERAL (SELECT unnest(list_filter([CASE WHEN start_tick < 0 OR freeze_end_tick < 0 OR end_tick < 0 OR official_end_tick < 0 THEN 'negative_round_tick' END,
  CASE WHEN start_tick > freeze_end_tick OR freeze_end_tick > end_tick OR end_tick > official_end_tick THEN 'round_boundaries_not_monotonic' END, CASE WHEN end_tick > nxt THEN 'rounds_overlap' END], lambda x: x IS NOT NULL)) AS code)""")
def _(t):
    return G.round_issues(t.dirty_rounds)


cte("tms", "SELECT match_id, team_a AS team_id FROM matches UNION ALL SELECT match_id, team_b FROM matches")


def teams_of(t):
    return t.matches.select("match_id", F.explode(F.array("team_a", "team_b")).alias("team_id"))


@query("g02_event_integrity", """SELECT match_id, 'duplicate_event_id' AS code, 'event' AS entity_type, CAST(event_id AS VARCHAR) AS entity_id FROM dirty_events GROUP BY match_id, event_id HAVING count(*) > 1
  UNION ALL SELECT match_id, 'negative_event_tick', 'event', CAST(event_id AS VARCHAR) FROM dirty_events WHERE tick < 0
  UNION ALL SELECT e.match_id, 'assigned_event_outside_round_window', 'event', CAST(e.event_id AS VARCHAR) FROM dirty_events e
  JOIN (SELECT *, lead(start_tick) OVER (PARTITION BY match_id ORDER BY round_number) AS nxt FROM dirty_rounds) r USING (round_id) WHERE e.tick < r.start_tick OR e.tick >= r.nxt""")
def _(t):
    return G.event_issues(t.dirty_events, t.dirty_rounds)


@query("g03_references", """SELECT match_id, 'unknown_player_reference' AS code, 'event' AS entity_type, CAST(event_id AS VARCHAR) AS entity_id FROM dirty_events e WHERE player_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM players p WHERE p.match_id = e.match_id AND p.player_id = e.player_id)
  UNION ALL SELECT match_id, 'unknown_team_reference', 'event', CAST(event_id AS VARCHAR) FROM dirty_events e WHERE team_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tms p WHERE p.match_id = e.match_id AND p.team_id = e.team_id)
  UNION ALL SELECT match_id, 'unknown_round_reference', 'event', CAST(event_id AS VARCHAR) FROM dirty_events e WHERE round_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dirty_rounds p WHERE p.round_id = e.round_id)
  UNION ALL SELECT match_id, 'unknown_team_reference', 'round', round_id FROM dirty_rounds e WHERE t_team_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tms p WHERE p.match_id = e.match_id AND p.team_id = e.t_team_id)
  UNION ALL SELECT match_id, 'unknown_team_reference', 'round', round_id FROM dirty_rounds e WHERE ct_team_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tms p WHERE p.match_id = e.match_id AND p.team_id = e.ct_team_id)
  UNION ALL SELECT match_id, 'unknown_player_reference', 'membership', player_id FROM memberships e WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.match_id = e.match_id AND p.player_id = e.player_id)
  UNION ALL SELECT match_id, 'unknown_team_reference', 'membership', player_id FROM memberships e WHERE team_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tms p WHERE p.match_id = e.match_id AND p.team_id = e.team_id)""")
def _(t):
    return G.reference_issues(t.dirty_events, t.dirty_rounds, t.players, teams_of(t), t.memberships)


@query("g04_quality_counts", """SELECT * FROM (SELECT match_id, 'implausible_player_count' AS code, CASE WHEN count(*) < 2 OR count(*) > 64 THEN count(*) END AS count FROM players GROUP BY 1
  UNION ALL SELECT match_id, 'unknown_players', count(*) FILTER (steam_id IS NULL) FROM players GROUP BY 1 UNION ALL SELECT match_id, 'unassigned_events', count(*) FILTER (round_id IS NULL) FROM dirty_events GROUP BY 1
  UNION ALL SELECT match_id, 'incomplete_rounds', count(*) FILTER (NOT is_complete) FROM dirty_rounds GROUP BY 1 UNION ALL SELECT match_id, 'side_resolution_uncertainty', count(*) FILTER (t_team_id IS NULL OR ct_team_id IS NULL) FROM dirty_rounds GROUP BY 1
  UNION ALL SELECT match_id, 'missing_final_round_end', CAST(arg_max(CAST(official_end_tick IS NULL AS INT), round_number) AS BIGINT) FROM dirty_rounds GROUP BY 1) WHERE count > 0""")
def _(t):
    return G.quality_issues(t.dirty_events, t.dirty_rounds, t.players)


_CT = {"events": ("dirty_events", "event_id"), "rounds": ("dirty_rounds", "round_id"), "players": ("players", "steam_id"), "memberships": ("memberships", "player_id")}
_CT |= {n: (n, "event_id") for n in ("kills", "damages", "shots", "grenades", "blinds", "bombs")}


@query("g05_contract_counts", " UNION ALL ".join(f"""SELECT match_id, '{n}' AS table_name, CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_rows,
  CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS missing_keys FROM (SELECT match_id, CAST({k} AS VARCHAR) AS k, count(*) AS n FROM {s} GROUP BY 1, 2) GROUP BY match_id""" for n, (s, k) in _CT.items()))
def _(t):
    return G.contract_counts({n: getattr(t, s) for n, (s, _) in _CT.items()}, {n: k for n, (_, k) in _CT.items()})


@query("f04_stats_invariants", """SELECT t.match_id, 'team_conversion_without_winner' AS code, 'team_round' AS entity_type, t.team_id AS entity_id FROM tr t JOIN gates g USING (match_id)
  WHERE NOT g.win_ok AND coalesce(round_won, opening_kill_converted, recovered_after_opening_death, converted_first_advantage, recovered_after_first_disadvantage, converted_plus_two, post_plant_won) IS NOT NULL""")
def _(t):
    return G.stats_invariants(stats(t, share=True))
