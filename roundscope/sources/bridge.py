"""Match-shaped canonical tables derived from the supplied ``events`` table.

Every 720 consecutive events form one match of 24 rounds of 30 events, so the
number of matches grows with the data while a round keeps a bounded size.  Each
table is stated once as column expressions; Spark evaluates them with
``selectExpr`` and the oracle evaluates the same expressions in DuckDB.
"""
from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SESSION_DEFAULTS
from ..functions.common import once
from .layer import Layer
from .store import shared_folder


def _side(slot: str) -> str:
    return f"CASE WHEN ({slot} < 5) = (rn <= 12) THEN 'T' ELSE 'CT' END"


def _player(slot: str) -> str:
    return f"'p' || (lobby * 10 + {slot})"


def _team(slot: str) -> str:
    return f"'t' || (lobby * 2 + CASE WHEN {slot} < 5 THEN 0 ELSE 1 END)"


HEADER = [
    "event_id", "match_id", "round_id", "rn AS round_number", "tick", "rtick AS relative_tick", "phase",
]

# name -> (source, filter, expressions); a leading "*" keeps all source columns.
TABLES: dict[str, tuple[str, str, list[str]]] = {
    "ev0": ("events", "", [
        "event_id", "event_type", "value", "JSON_K AS k",
        "event_id // 720 AS match_no", "CAST((event_id % 720) // 30 + 1 AS INT) AS rn",
        "CAST(user_id % 10 AS INT) AS a",
    ]),
    "ev1": ("ev0", "", [
        "*", "match_no // 7 AS lobby", "k % 10 AS v",
        "CAST(((event_id * 7919 + k * 37) % 360) * 10 AS INT) AS rtick",
    ]),
    "ev": ("ev1", "", [
        "*", "'m' || match_no AS match_id", "'m' || match_no || '-r' || rn AS round_id",
        "(rn - 1) * 3600 + rtick AS tick",
        "CASE WHEN rtick < 100 THEN 'freeze_time' WHEN rtick >= 3500 THEN 'post_round' ELSE 'live' END AS phase",
    ]),
    "kills": ("ev", "event_type = 'error'", HEADER + [
        f"CASE WHEN k >= 97 THEN NULL ELSE {_player('a')} END AS attacker_player_id",
        f"CASE WHEN k = 96 THEN NULL ELSE {_player('v')} END AS victim_player_id",
        f"CASE WHEN k % 3 = 0 THEN {_player('((k // 10) % 10)')} END AS assister_player_id",
        f"CASE WHEN k >= 97 OR k = 50 THEN NULL ELSE {_team('a')} END AS attacker_team_id",
        f"CASE WHEN k = 96 THEN NULL ELSE {_team('v')} END AS victim_team_id",
        f"CASE WHEN k >= 97 THEN 'UNKNOWN' ELSE {_side('a')} END AS attacker_side",
        f"CASE WHEN k = 96 THEN 'UNKNOWN' ELSE {_side('v')} END AS victim_side",
        "CASE k % 5 WHEN 0 THEN 'ak47' WHEN 1 THEN 'awp' WHEN 2 THEN 'm4a1' WHEN 3 THEN 'deagle' ELSE 'glock' END AS weapon",
        "CASE WHEN k % 11 = 0 THEN NULL ELSE k % 4 = 0 END AS headshot",
        "CASE WHEN k % 13 = 0 THEN NULL ELSE a = v END AS is_suicide",
        "CASE WHEN k % 17 = 0 THEN TRUE END AS is_teamkill",
    ]),
    "damages": ("ev", "event_type = 'click'", HEADER + [
        f"CASE WHEN k >= 97 THEN NULL ELSE {_player('a')} END AS attacker_player_id",
        f"{_player('v')} AS victim_player_id",
        f"CASE WHEN k >= 97 THEN NULL ELSE {_team('a')} END AS attacker_team_id",
        f"{_team('v')} AS victim_team_id",
        f"CASE WHEN k >= 97 THEN 'UNKNOWN' ELSE {_side('a')} END AS attacker_side",
        f"{_side('v')} AS victim_side",
        "CASE k % 4 WHEN 0 THEN 'hegrenade' WHEN 1 THEN 'inferno' WHEN 2 THEN 'ak47' ELSE 'awp' END AS weapon",
        "CAST(floor(value) AS INT) AS damage_health",
        "CASE WHEN k % 4 <> 0 THEN CAST(greatest(0, 100 - CAST(floor(value) AS INT)) AS INT) END AS victim_health_after",
    ]),
    "shots": ("ev", "event_type = 'click' AND k % 2 = 1", HEADER + [
        f"{_player('a')} AS player_id", f"{_team('a')} AS team_id", f"{_side('a')} AS side",
        "CASE k % 4 WHEN 1 THEN 'awp' ELSE 'ak47' END AS weapon",
    ]),
    "grenades": ("ev", "event_type = 'purchase'", HEADER + [
        f"{_player('a')} AS player_id", f"{_team('a')} AS team_id", f"{_side('a')} AS side",
        "CASE k % 4 WHEN 0 THEN 'hegrenade' WHEN 1 THEN 'inferno' WHEN 2 THEN 'flashbang' ELSE 'smokegrenade' END AS grenade_type",
        "CASE WHEN k % 3 = 0 THEN 'detonated' ELSE 'thrown' END AS lifecycle_event",
        "CAST(event_id % 50 AS INT) AS entity_id",
        "CAST((event_id * 13 + CAST(floor(value * 100) AS BIGINT)) % 4096 AS DOUBLE) AS x",
        "CAST((k * 41 + CAST(floor(value * 10) AS BIGINT)) % 4096 AS DOUBLE) AS y",
        "CAST((k % 5) * 64 AS DOUBLE) AS z",
    ]),
    "effects": ("ev", "event_type = 'purchase'", [
        "event_id AS effect_id", "match_id", "round_id", "rn AS round_number",
        f"CASE WHEN k % 19 = 0 THEN NULL ELSE {_player('a')} END AS owner_player_id",
        f"CASE WHEN k % 19 = 0 THEN NULL ELSE {_team('a')} END AS owner_team_id",
        f"CASE WHEN k % 19 = 0 THEN NULL ELSE {_side('a')} END AS owner_side",
        "CASE k % 4 WHEN 0 THEN 'he' WHEN 1 THEN 'fire' WHEN 2 THEN 'flash' ELSE 'smoke' END AS effect_type",
        "tick AS start_tick", "CASE WHEN k % 10 <> 9 THEN tick + k * 4 END AS end_tick",
        "CAST((event_id * 13 + CAST(floor(value * 100) AS BIGINT)) % 4096 AS DOUBLE) AS x",
        "CAST((k * 41 + CAST(floor(value * 10) AS BIGINT)) % 4096 AS DOUBLE) AS y",
        "CAST((k % 5) * 64 AS DOUBLE) AS z",
    ]),
    "blinds": ("ev", "event_type = 'purchase' AND k % 4 = 2", HEADER + [
        f"{_player('a')} AS attacker_player_id", f"{_player('v')} AS victim_player_id",
        f"{_team('a')} AS attacker_team_id", f"{_team('v')} AS victim_team_id",
        f"{_side('a')} AS attacker_side", f"{_side('v')} AS victim_side",
        "CASE WHEN k % 10 = 8 THEN NULL ELSE value / 100 END AS duration_seconds",
    ]),
    "bombs": ("ev", "event_type = 'signup'", HEADER + [
        f"{_player('a')} AS player_id", f"{_team('a')} AS team_id", f"{_side('a')} AS side",
        "CASE WHEN k < 50 THEN 'planted' WHEN k < 75 THEN 'defused' ELSE 'exploded' END AS event_type",
        "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS site_normalized",
    ]),
    "sample_slots": ("ev", "", ["*", "EXPLODE[0, 1, 2, 3] AS j"]),
    "sample_players": ("sample_slots", "", ["*", "(a + 3 * j) % 10 AS slot"]),
    "event_samples": ("sample_players", "", [
        "event_id", "match_id", "round_id", "rn AS round_number", "tick", "rtick AS relative_tick", "phase", "j",
        "'7656' || (lobby * 10 + slot) AS steam_id", f"{_player('slot')} AS player_id", f"{_team('slot')} AS team_id", f"{_side('slot')} AS side",
        "CAST((event_id * 13 + CAST(floor(value * 100) AS BIGINT) + j * 137) % 4096 AS DOUBLE) AS x",
        "CASE WHEN k = 77 AND j = 2 THEN NULL ELSE CAST((k * 41 + CAST(floor(value * 10) AS BIGINT) + j * 211) % 4096 AS DOUBLE) END AS y",
        "CASE WHEN k % 31 = 3 THEN NULL ELSE CAST((k % 5) * 64 AS DOUBLE) END AS z",
        "CAST((k * 7 + j * 90) % 360 AS DOUBLE) AS yaw",
        "CAST(k % 90 AS DOUBLE) AS pitch",
        "(k + j) % 9 <> 0 AS source_alive",
        f"CASE WHEN (k + j) % 23 = 0 THEN NULL WHEN ({_side('slot')}) = 'T' THEN 2 ELSE 3 END AS source_team_number",
        "CASE WHEN k % 6 = 0 AND j = 0 THEN 49 ELSE 7 END AS carried_item_id",
        "CASE k % 4 WHEN 0 THEN 'hegrenade' WHEN 1 THEN 'molotov' WHEN 2 THEN 'flashbang' ELSE 'smokegrenade' END AS utility_a",
        "CASE WHEN k % 5 = 0 THEN 'flashbang' WHEN k % 5 = 1 THEN 'ak47' END AS utility_b",
    ]),
    "round_sums": ("ev", "GROUP match_no, match_id, lobby, round_id, rn", ["CAST(sum(k) AS BIGINT) AS sk"]),
    # all players at the checkpoints of every round, some of them a sampling step early or late, some missing
    "mark_slots": ("round_sums", "", ["*", "EXPLODE[0, 1, 2, 3, 4, 5, 6, 7, 8, 9] AS slot"]),
    "mark_points": ("mark_slots", "", ["*", "EXPLODE[0, 640, 1280, 1920] AS mark"]),
    "mark_rows": ("mark_points", "(slot + rn + mark // 640) % 11 <> 0", ["*", "100 + mark + CASE (slot + rn) % 5 WHEN 3 THEN 16 WHEN 4 THEN -16 ELSE 0 END AS rtick"]),
    "mark_samples": ("mark_rows", "", [
        "match_no * 720 + (rn - 1) * 30 AS event_id", "match_id", "round_id", "rn AS round_number", "(rn - 1) * 3600 + rtick AS tick", "rtick AS relative_tick", "CASE WHEN rtick < 100 THEN 'freeze_time' ELSE 'live' END AS phase",
        "CAST(10 + slot * 4 + mark // 640 AS INT) AS j", "'7656' || (lobby * 10 + slot) AS steam_id", f"{_player('slot')} AS player_id", f"{_team('slot')} AS team_id", f"{_side('slot')} AS side",
        "CAST((sk * 13 + slot * 409 + mark * 3) % 4096 AS DOUBLE) AS x", "CAST((sk * 41 + slot * 211 + mark) % 4096 AS DOUBLE) AS y", "CASE WHEN (sk + slot) % 31 = 3 THEN NULL ELSE CAST((sk % 5) * 64 AS DOUBLE) END AS z",
        "CAST((sk * 7 + slot * 30) % 360 AS DOUBLE) AS yaw", "CAST(sk % 90 AS DOUBLE) AS pitch", "(sk + slot) % 9 <> 0 AS source_alive",
        f"CASE WHEN (sk + slot) % 23 = 0 THEN NULL WHEN ({_side('slot')}) = 'T' THEN 2 ELSE 3 END AS source_team_number", "CASE WHEN (sk + slot) % 12 = 0 THEN 49 ELSE 7 END AS carried_item_id",
        "CASE (sk + slot) % 4 WHEN 0 THEN 'hegrenade' WHEN 1 THEN 'molotov' WHEN 2 THEN 'flashbang' ELSE 'smokegrenade' END AS utility_a", "CASE WHEN slot % 5 = 0 THEN 'flashbang' WHEN slot % 5 = 1 THEN 'ak47' END AS utility_b",
    ]),
    "samples": ("event_samples", "UNION mark_samples", []),
    "match_base": ("ev", "DISTINCT", ["match_no", "match_id", "lobby"]),
    "matches": ("match_base", "", [
        "match_id", "match_no", "lobby",
        "CASE match_no % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS map_name",
        "'t' || (lobby * 2) AS team_a", "'t' || (lobby * 2 + 1) AS team_b",
    ]),
    "slot_base": ("match_base", "", ["*", "EXPLODE[0, 1, 2, 3, 4, 5, 6, 7, 8, 9] AS slot"]),
    "players": ("slot_base", "", [
        "match_id", f"{_player('slot')} AS player_id", f"{_team('slot')} AS team_id",
        "CASE WHEN slot = 8 AND match_no % 7 = 6 THEN NULL ELSE '7656' || (lobby * 10 + slot) END AS steam_id",
        f"CASE WHEN slot < 4 THEN '[RED] ' WHEN slot = 6 THEN 'BLU ' ELSE '' END || 'n' || (lobby * 10 + slot) AS current_name",
        "FALSE AS is_bot",
    ]),
    "half_base": ("slot_base", "", ["*", "EXPLODE[0, 1, 2] AS half"]),
    # half 2 is the extra row of a player seen in both teams.
    "memberships": ("half_base",
        "(half < 2 OR (slot = 3 AND match_no % 5 = 2)) AND NOT (half = 1 AND slot = 4 AND match_no % 4 = 2)", [
        "match_id", f"{_player('slot')} AS player_id",
        "CASE WHEN half = 2 THEN 't' || (lobby * 2 + 1) ELSE " + _team("slot") + " END AS team_id",
        "CASE WHEN half = 2 THEN 'T' WHEN (slot < 5) = (half = 0) THEN 'T' ELSE 'CT' END AS side",
        "CASE WHEN half = 1 THEN 43200 WHEN half = 2 THEN 64800 WHEN slot = 9 AND match_no % 3 = 1 THEN 7200 ELSE 0 END AS valid_from_tick",
        "CASE WHEN half = 0 THEN 43199 END AS valid_to_tick",
    ]),
    "round_wins": ("round_sums", "", [
        "*", "CASE WHEN sk % 2 = 0 THEN 'T' ELSE 'CT' END AS true_side",
        "CASE WHEN (sk % 2 = 0) = (rn <= 12) THEN 1 ELSE 0 END AS a_won",
    ]),
    "round_score": ("round_wins", "", [
        "*", "CAST(sum(a_won) OVER (PARTITION BY match_id ORDER BY rn) AS INT) AS a_after",
        "CAST(sum(1 - a_won) OVER (PARTITION BY match_id ORDER BY rn) AS INT) AS b_after",
    ]),
    "rounds": ("round_score", "", [
        "match_id", "round_id", "rn AS round_number",
        "(rn - 1) * 3600 AS start_tick", "(rn - 1) * 3600 + 100 AS freeze_end_tick",
        "(rn - 1) * 3600 + 3500 AS end_tick", "(rn - 1) * 3600 + 3599 AS official_end_tick",
        "CASE WHEN rn <= 12 THEN 't' || (lobby * 2) ELSE 't' || (lobby * 2 + 1) END AS t_team_id",
        "CASE WHEN rn <= 12 THEN 't' || (lobby * 2 + 1) ELSE 't' || (lobby * 2) END AS ct_team_id",
        "CASE WHEN rn % 8 <> 0 OR match_no % 2 = 0 THEN true_side END AS winner_side",
        "CASE WHEN rn % 8 <> 0 OR match_no % 2 = 0 THEN 'available' WHEN rn = 16 THEN 'unresolved_conflict' ELSE 'missing' END AS outcome_status",
        "CASE WHEN rn <= 12 THEN a_after - a_won ELSE b_after - 1 + a_won END AS score_t_before",
        "CASE WHEN rn <= 12 THEN b_after - 1 + a_won ELSE a_after - a_won END AS score_ct_before",
        "CASE WHEN rn % 8 <> 0 OR match_no % 2 = 0 THEN CASE WHEN rn <= 12 THEN a_after ELSE b_after END END AS score_t_after",
        "CASE WHEN rn % 8 <> 0 OR match_no % 2 = 0 THEN CASE WHEN rn <= 12 THEN b_after ELSE a_after END END AS score_ct_after",
        "CASE WHEN rn % 8 <> 0 OR match_no % 2 = 0 THEN 'available' ELSE 'missing' END AS score_status",
        "rn = 1 AND match_no % 4 = 3 AS is_warmup", "FALSE AS is_overtime",
        "NOT (rn = 24 AND match_no % 5 = 4) AS is_complete",
    ]),
    "eco_rows": ("ev", "", [
        "match_id", "match_no", "lobby", "round_id", "rn", "a", "k", "CAST(floor(value * 20) AS BIGINT) AS cents",
    ]),
    "economy_sums": ("eco_rows", "GROUP match_id, match_no, lobby, round_id, rn, a", [
        "CAST(sum(cents) AS BIGINT) AS equipment_value", "min(k) AS k_min", "max(k) AS k_max",
    ]),
    "economy_samples": ("economy_sums", "", [
        "match_id", "round_id", "rn AS round_number", "(rn - 1) * 3600 + 100 AS tick",
        f"{_player('a')} AS player_id",
        "CASE WHEN k_max = 99 THEN NULL ELSE equipment_value END AS current_equip_value",
        "CAST(k_min * 60 AS BIGINT) AS cash_spent", "CAST(k_max * 50 AS BIGINT) AS balance",
        "CASE WHEN k_min % 3 = 0 THEN NULL ELSE k_min % 2 = 0 END AS has_helmet",
        "k_max % 2 = 0 AS has_defuser",
        "CASE WHEN k_max % 29 = 0 THEN 9 WHEN (" + _side("a") + ") = 'T' THEN 2 ELSE 3 END AS team_num",
        "CASE WHEN k_min % 4 = 0 THEN 'AK-47' WHEN k_min % 4 = 1 THEN ' weapon_AWP' ELSE 'Glock 18' END AS item_a",
        "CASE WHEN k_max % 3 = 0 THEN 'Smoke Grenade' WHEN k_max % 3 = 1 THEN 'weapon_flashbang' ELSE 'C4' END AS item_b",
    ]),
    # --- landing rows with dirty text values, and round markers -------------
    # some rows occur twice; the second copy is equal in every field
    "raw_copies": ("ev", "", ["*", "EXPLODE[0, 1] AS copy"]),
    "raw_cols": ("raw_copies", "copy = 0 OR k % 29 = 11", [
        "match_id", "k", "event_id AS seq",
        "CASE event_type WHEN 'error' THEN 'player_death' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'player_hurt' ELSE 'weapon_fire' END "
        "WHEN 'view' THEN 'player_blind' WHEN 'signup' THEN CASE WHEN k < 50 THEN 'bomb_planted' WHEN k < 75 THEN 'bomb_defused' ELSE 'bomb_exploded' END "
        "ELSE CASE k % 7 WHEN 0 THEN 'smokegrenade_detonate' WHEN 1 THEN 'smokegrenade_expired' WHEN 2 THEN 'inferno_startburn' WHEN 3 THEN 'inferno_expire' "
        "WHEN 4 THEN 'flashbang_detonate' WHEN 5 THEN 'hegrenade_detonate' ELSE 'decoy_detonate' END END AS source_event",
        "CASE WHEN k % 37 = 5 THEN 'True' WHEN k % 3 = 0 THEN '0' END AS warm",
        "CASE k WHEN 13 THEN 'bad' WHEN 14 THEN '-5' WHEN 15 THEN NULL WHEN 16 THEN NULL ELSE '' || tick END AS tick_text", "CASE WHEN k = 15 OR k = 16 THEN '77' END AS other_tick",
        "CASE WHEN k % 41 = 7 THEN 'abc' WHEN k % 43 = 9 THEN NULL WHEN k % 5 = 1 THEN '7656' || (lobby * 10 + a) || '.0' ELSE '7656' || (lobby * 10 + a) END AS a_steam",
        "CASE WHEN k % 47 = 3 THEN ' ' WHEN k % 9 = 0 THEN '  n' || (lobby * 10 + a) || ' ' WHEN rn > 20 THEN 'x' || (lobby * 10 + a) ELSE 'n' || (lobby * 10 + a) END AS a_name",
        f"CASE WHEN k % 29 = 0 THEN 'spectator' WHEN ({_side('a')}) = 'T' THEN CASE k % 4 WHEN 0 THEN '2' WHEN 1 THEN ' T' WHEN 2 THEN 'TERRORIST' ELSE 'team_t' END "
        "ELSE CASE k % 4 WHEN 0 THEN '3' WHEN 1 THEN 'ct ' WHEN 2 THEN 'Counter-Terrorists' ELSE 'TEAM_CT' END END AS a_team",
        "CASE WHEN k % 61 = 0 THEN 'Yes' END AS a_bot",
        "CASE WHEN k % 31 = 4 THEN NULL ELSE '7656' || (lobby * 10 + v) END AS u_steam",
        "CASE WHEN k % 31 = 4 AND k % 2 = 0 THEN NULL ELSE 'n' || (lobby * 10 + v) END AS u_name",
        f"CASE WHEN k % 23 = 0 THEN 'none' WHEN ({_side('v')}) = 'T' THEN 'T' ELSE 'CT' END AS u_team",
        "CASE WHEN k % 3 = 0 THEN '7656' || (lobby * 10 + (k // 10) % 10) END AS s_steam",
        "CASE k % 5 WHEN 0 THEN 'ak47' WHEN 1 THEN ' awp ' WHEN 2 THEN '' ELSE 'deagle' END AS weapon",
        "CASE k % 6 WHEN 0 THEN '1' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'no' WHEN 3 THEN 'maybe' WHEN 4 THEN ' y ' END AS headshot",
        "'' || (k - 3) AS penetrated",
        "CASE k WHEN 20 THEN 'nan' WHEN 21 THEN 'inf' WHEN 22 THEN 'far' ELSE '' || k || '.5' END AS distance",
        "'' || CAST(floor(value) AS INT) AS dmg_health", "CASE WHEN k % 8 = 0 THEN '1.5' ELSE '' || (k % 101) END AS health_after",
        "CASE WHEN k % 10 = 0 THEN '-1' ELSE '0.' || k END AS blind_duration",
        "CASE k % 6 WHEN 0 THEN 'bombsite_a' WHEN 1 THEN ' A' WHEN 2 THEN 'b' WHEN 3 THEN 'SITE_B' WHEN 4 THEN '422' END AS site",
    ]),
    # rows of players by themselves: a list of players without tick, connections, one reconnection, one connection without a platform id
    "people_slots": ("slot_base", "", ["*", "EXPLODE[0, 1, 2, 3, 4] AS q"]),
    "raw_people": ("people_slots", "q < 2 OR (q = 2 AND slot % 5 = 2) OR (q = 3 AND slot = 2) OR (q = 4 AND slot = 7)", [
        "match_id", "slot AS k", "CASE q WHEN 0 THEN 'player_info' WHEN 2 THEN 'player_disconnect' ELSE 'player_connect_full' END AS source_event", "CASE WHEN q = 0 THEN 'True' END AS warm",
        "CASE q WHEN 1 THEN '' || (10 + slot) WHEN 2 THEN '30000' WHEN 3 THEN '31000' WHEN 4 THEN '50' END AS tick_text",
        "CASE WHEN NOT (q = 4 OR (slot = 8 AND match_no % 7 = 6)) THEN '7656' || (lobby * 10 + slot) END AS p_steam",
        "CASE WHEN q = 0 AND slot = 1 THEN 'before' || (lobby * 10 + slot) WHEN NOT (slot = 8 AND match_no % 7 = 6) THEN 'n' || (lobby * 10 + slot) END AS p_name", "CASE WHEN slot = 9 THEN 'TRUE' END AS p_bot",
    ]),
    "mark_base": ("round_score", "", ["*", "EXPLODE[0, 1, 2, 3, 4, 5, 6, 7] AS q"]),
    "raw_marks": ("mark_base",
        "q = 0 OR (q = 1 AND rn % 5 = 0) OR (q = 2 AND rn <> 11) OR (q = 3 AND rn % 9 <> 0 AND NOT (rn = 24 AND match_no % 3 = 2)) OR (q = 4 AND rn < 24) "
        "OR (q = 5 AND rn = 24) OR (q = 6 AND (rn = 12 OR (rn = 20 AND match_no % 2 = 1))) OR (q = 7 AND match_no % 4 = 1 AND rn < 24)", [
        "match_id", "CASE q WHEN 0 THEN 'round_start' WHEN 1 THEN 'round_start' WHEN 2 THEN 'round_freeze_end' WHEN 3 THEN 'round_end' WHEN 4 THEN 'round_officially_ended' "
        "WHEN 5 THEN 'cs_win_panel_match' WHEN 6 THEN 'announce_phase_end' ELSE 'round_prestart' END AS source_event",
        "CAST((rn - 1) * 3600 + CASE q WHEN 1 THEN -40 WHEN 2 THEN 100 WHEN 3 THEN 3500 WHEN 4 THEN 3599 WHEN 5 THEN 3510 WHEN 6 THEN 3505 ELSE 0 END AS INT) AS tick",
        "CASE WHEN q < 3 THEN rn - 1 WHEN q < 7 THEN rn END AS marker",
        "CASE WHEN q IN (3, 4, 5) AND rn % 8 <> 0 THEN true_side WHEN q = 3 AND rn = 16 THEN 'T' WHEN q = 4 AND rn = 16 THEN '3' END AS winner",
        "CASE WHEN q = 3 AND rn = 7 THEN 'time' WHEN q IN (3, 4) AND rn % 4 <> 0 THEN 'elimination' END AS reason",
        "CASE WHEN q IN (3, 4, 5) AND rn % 10 <> 5 THEN CASE WHEN rn <= 12 THEN a_after ELSE b_after END + CASE WHEN q = 4 AND rn = 14 THEN 1 ELSE 0 END END AS t_score",
        "CASE WHEN q IN (3, 4, 5) AND rn % 10 <> 5 THEN CASE WHEN rn <= 12 THEN b_after ELSE a_after END END AS ct_score",
        "CASE WHEN q IN (0, 2) THEN CASE WHEN rn % 7 = 0 THEN 'mix' WHEN rn <= 12 THEN ' Red  Foxes' ELSE 'team_1' END END AS t_clan",
        "CASE WHEN q IN (0, 2) THEN CASE WHEN rn <= 12 THEN 'team_1' ELSE 'Red Foxes ' END END AS ct_clan",
    ]),
    # --- zone polygons: a 4 x 4 grid of squares per map, one open cell, a banded cell, an overlapping triangle
    "zone_maps": ("matches", "DISTINCT", ["map_name"]),
    "zone_cells": ("zone_maps", "", ["*", "EXPLODE[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16] AS cell"]),
    "zone_boxes": ("zone_cells", "cell <> 5", [
        "map_name", "cell", "CASE WHEN cell = 16 THEN 'a_ramp' WHEN cell % 4 = 0 THEN 'bombsite_a' || cell WHEN cell % 4 = 3 THEN 'bombsite_b' || cell ELSE 'mid' || cell END AS zone_id",
        "CASE WHEN cell = 16 THEN 10 WHEN cell = 7 THEN 3 ELSE 1 END AS priority",
        "CASE WHEN cell = 12 THEN 'proposed' ELSE 'verified' END AS verification",
        "CAST(CASE WHEN cell = 16 THEN 200 ELSE (cell % 4) * 1024 END AS DOUBLE) AS x0", "CAST(CASE WHEN cell = 16 THEN 200 ELSE (cell // 4) * 1024 END AS DOUBLE) AS y0",
        "CAST(CASE WHEN cell = 16 THEN 1500 ELSE (cell % 4) * 1024 + 1024 END AS DOUBLE) AS x1", "CAST(CASE WHEN cell = 16 THEN 1300 ELSE (cell // 4) * 1024 + 1024 END AS DOUBLE) AS y1",
        "CAST(CASE WHEN cell = 9 THEN 64 END AS DOUBLE) AS min_z", "CAST(CASE WHEN cell = 9 THEN 128 END AS DOUBLE) AS max_z",
    ]),
    "map_defs": ("zone_maps", "", [
        "map_name", "CAST(CASE WHEN map_name <> 'gamma' THEN -100 END AS DOUBLE) AS origin_x", "CAST(CASE WHEN map_name <> 'gamma' THEN 4000 END AS DOUBLE) AS origin_y",
        "CAST(4 AS DOUBLE) AS scale", "1024 AS image_width", "1024 AS image_height", "map_name = 'beta' AS two_levels", "CAST(128 AS DOUBLE) AS upper_min_z", "CAST(128 AS DOUBLE) AS lower_max_z",
    ]),
    "revision_cells": ("zone_maps", "", ["*", "EXPLODE[0, 1, 2] AS r"]),
    "map_revisions": ("revision_cells", "", [
        "map_name", "'rev' || r AS revision_id", "CASE WHEN r < 2 THEN 'p' || r ELSE 'p1' END AS patch_version", "'c' || r AS map_crc", "r = 2 AND map_name = 'alpha' AS is_current",
    ]),
    "map_evidence": ("matches", "", [
        "match_id", "CASE WHEN match_no % 7 = 6 THEN 'unknown_map' ELSE map_name END AS map_name", "CASE WHEN match_no % 7 = 3 THEN 'rev1' WHEN match_no % 11 = 10 THEN 'rev9' END AS manual_revision",
        "CASE match_no % 4 WHEN 0 THEN 'p0' WHEN 1 THEN 'p1' WHEN 2 THEN 'p9' END AS patch_version", "CASE match_no % 5 WHEN 0 THEN 'c0' WHEN 1 THEN 'c2' WHEN 2 THEN 'c9' END AS map_crc",
    ]),
    "point_slots": ("ev", "event_type = 'purchase'", ["*", "EXPLODE[0, 1, 2, 3, 4, 5] AS i"]),
    "projectile_points": ("point_slots", "", [
        "match_id", "CAST(event_id % 5 AS INT) AS entity_id", "CASE k % 4 WHEN 0 THEN 'he' WHEN 1 THEN 'fire' WHEN 2 THEN 'flash' ELSE 'smoke' END AS projectile_type",
        "CASE WHEN k % 17 = 0 THEN NULL ELSE '7656' || (lobby * 10 + a) END AS steam_id", "tick + 3 + i + CASE WHEN i >= 3 AND k % 4 = 0 THEN 5 ELSE 0 END AS tick",
        "CASE WHEN k % 5 = 0 AND i = 4 THEN 0 ELSE i // 2 END AS bounce", "CAST((event_id * 13 + i * 40) % 4096 AS DOUBLE) AS x", "CAST((k * 41 + i * 25) % 4096 AS DOUBLE) AS y", "CAST(i * 10 AS DOUBLE) AS z",
    ]),
    "throws": ("ev", "event_type = 'purchase' AND k % 6 <> 5", [
        "match_id", "event_id AS throw_id", "CASE WHEN k % 17 = 0 THEN NULL ELSE '7656' || (lobby * 10 + a) END AS steam_id", "CASE k % 4 WHEN 0 THEN 'he' WHEN 1 THEN 'fire' WHEN 2 THEN 'flash' ELSE 'smoke' END AS projectile_type", "tick",
    ]),
    "terminals": ("ev", "event_type = 'purchase' AND k % 7 <> 0", [
        "match_id", "event_id AS terminal_id", "CASE WHEN k % 3 = 0 THEN 99 ELSE CAST(event_id % 5 AS INT) END AS entity_id", "CASE k % 4 WHEN 0 THEN 'he' WHEN 1 THEN 'fire' WHEN 2 THEN 'flash' ELSE 'smoke' END AS projectile_type",
        "CASE WHEN k % 11 = 0 THEN NULL ELSE '7656' || (lobby * 10 + a) END AS steam_id", "tick + 9 + k % 20 AS tick", "CAST((event_id * 13 + 200 + k * 3) % 4096 AS DOUBLE) AS x", "CAST((k * 41 + 130) % 4096 AS DOUBLE) AS y",
    ]),
    "selections": ("match_base", "match_no % 7 < 5", [
        "'opp' || lobby AS profile_id", "match_id", "'t' || (lobby * 2) AS team_id", "match_no AS selection_order",
    ]),
    # the same profiles, and one per lobby that selected a team nobody plays for
    "scout_slots": ("match_base", "match_no % 7 < 5", ["*", "EXPLODE[0, 1] AS own"]),
    "scout_selections": ("scout_slots", "own = 0 OR match_no % 7 = 0", [
        "CASE WHEN own = 0 THEN 'opp' ELSE 'new' END || lobby AS profile_id", "match_id", "CASE WHEN own = 0 THEN 't' || (lobby * 2) ELSE 'nobody' END AS team_id", "match_no AS selection_order",
    ]),
    "view_slots": ("match_base", "match_no % 7 < 5", ["*", "EXPLODE[0, 1] AS own"]),
    "tactical_selections": ("view_slots", "", [
        "CASE WHEN own = 0 THEN 'opp' ELSE 'own' END || lobby AS profile_id", "match_id", "'t' || (lobby * 2 + own) AS team_id", "own", "lobby",
    ]),
    "profile_pairs": ("match_base", "DISTINCT", ["'opp' || lobby AS opponent_id", "'own' || lobby AS own_id"]),
    "save_signals": ("round_sums", "", ["match_id", "round_id", "'t' || (lobby * 2 + sk % 2) AS team_id", "CASE WHEN rn % 5 = 0 THEN NULL ELSE sk % 3 = 0 END AS saved", "(rn - 1) * 3600 + 3400 AS tick"]),
    "feature_runs": ("match_base", "match_no % 13 <> 12", ["match_id", "CASE WHEN match_no % 11 = 9 THEN 'v0' ELSE 'v1' END AS rule_version"]),
    "run_slots": ("selections", "", ["*", "EXPLODE[0, 1, 2] AS r"]),
    "pattern_runs": ("run_slots", "DISTINCT", ["profile_id || '-r' || r AS run_id", "profile_id", "r AS created_at"]),
    "run_inputs": ("run_slots", "NOT (r = 2 AND selection_order % 7 = 0)", [
        "profile_id || '-r' || r AS run_id", "match_id", "team_id", "CASE WHEN r = 0 OR (r = 1 AND selection_order % 21 = 14) THEN 'f0' ELSE 'f1' END AS feature_fingerprint",
    ]),
    "feature_slots": ("match_base", "", ["*", "EXPLODE[0, 1] AS r"]),
    "feature_history": ("feature_slots", "", ["match_id", "'f' || r AS feature_fingerprint", "r AS created_at"]),
    "corpus_cases": ("matches", "", [
        "'opp' || lobby AS target_id", "match_id AS case_id", "map_name", "CASE WHEN match_no % 5 = 4 THEN 'candidate' ELSE 'confirmed' END AS review_status",
        "CASE match_no % 3 WHEN 0 THEN 'league' WHEN 1 THEN 'ladder' ELSE 'scrim' END AS source", "CASE match_no % 4 WHEN 0 THEN 'overtime' WHEN 1 THEN 'reconnect' ELSE 'none' END AS edge_case",
    ]),
    "corpus_labels": ("round_score", "", ["'opp' || lobby AS target_id", "round_id AS label_id", "CASE WHEN rn % 7 = 0 THEN 'indeterminate' WHEN sk % 2 = 0 THEN 'present' ELSE 'absent' END AS value"]),
    "parser_slots": ("matches", "", ["*", "EXPLODE[1, 2] AS p"]),
    "parser_support": ("parser_slots", "", ["match_id AS case_id", "'parser' || p AS parser", "NOT (p = 2 AND match_no % 3 = 1) AS supported"]),
    "case_labels": ("labels", "", ["doc_id AS label_id", "CASE WHEN doc_id % 17 = 0 THEN 'indeterminate' WHEN quality = 1 THEN 'present' ELSE 'absent' END AS value"]),
    "case_predictions": ("documents", "doc_id % 19 <> 3", ["doc_id AS label_id", "CASE WHEN doc_id % 13 = 0 THEN 'unavailable' WHEN n_chars % 3 = 0 THEN 'absent' ELSE 'present' END AS value"]),
    # --- deliberately damaged copies for the integrity checks ----------------
    "dirty_rounds": ("round_score", "", [
        "match_id", "round_id", "rn AS round_number",
        "CAST(CASE WHEN rn = 1 AND match_no % 3 = 0 THEN -5 ELSE (rn - 1) * 3600 END AS INT) AS start_tick",
        "CAST((rn - 1) * 3600 + CASE WHEN rn = 6 THEN -1 ELSE 100 END AS INT) AS freeze_end_tick",
        "CAST((rn - 1) * 3600 + CASE WHEN rn = 5 AND match_no % 2 = 0 THEN 3700 ELSE 3500 END AS INT) AS end_tick",
        "CAST(CASE WHEN rn = 24 AND match_no % 2 = 1 THEN NULL ELSE (rn - 1) * 3600 + 3800 END AS INT) AS official_end_tick",
        "CASE WHEN rn = 9 AND match_no % 3 = 1 THEN 't_gone' WHEN rn = 10 THEN NULL ELSE 't' || (lobby * 2) END AS t_team_id",
        "'t' || (lobby * 2 + 1) AS ct_team_id", "rn <> 23 AS is_complete",
    ]),
    "dirty_slots": ("ev", "", ["*", "EXPLODE[0, 1] AS copy"]),
    "dirty_events": ("dirty_slots", "copy = 0 OR k = 42", [
        "event_id", "match_id", "CASE WHEN k = 45 THEN NULL WHEN k = 46 THEN 'r_gone' ELSE round_id END AS round_id",
        "CASE WHEN k = 43 THEN tick + 5000 WHEN k = 44 THEN -1 ELSE tick END AS tick",
        f"CASE WHEN k = 47 THEN 'p_gone' ELSE {_player('a')} END AS player_id", f"CASE WHEN k = 48 THEN 't_gone' ELSE {_team('a')} END AS team_id",
    ]),
}


def _column_names(name: str) -> list[str]:
    source, _, exprs = TABLES[name]
    out = []
    for e in exprs:
        out += _column_names(source) if e == "*" else [e.rpartition(" AS ")[2] if " AS " in e else e]
    return out


#: Columns of each table, and those that hold doubles.
TABLE_COLUMNS = {n: _column_names(n) for n, (source, rule, _) in TABLES.items() if not rule.startswith(("GROUP", "UNION")) and (source in TABLES or source == "events")}
DOUBLES = ("x", "y", "z", "duration_seconds", "yaw", "pitch")

# raw column -> landing key for even and odd k; several spellings of one field.
RAW_KEYS = {
    "seq": ("seq", "seq"), "warm": ("is_warmup_period", "warmup"), "tick_text": ("tick", "event_tick"),
    "a_steam": ("attacker_steamid", "Attacker_Steam_ID"), "a_name": ("attacker_name", "attacker_name"),
    "a_team": ("attacker_team_name", "attacker_team"), "u_steam": ("user_steamid", "user_steam_id"),
    "u_name": ("user_name", "USER_NAME"), "u_team": ("user_team_name", "user_team"), "s_steam": ("assister_steamid", "assister_steamid"),
    "weapon": ("weapon", "Weapon"), "headshot": ("headshot", "headshot"), "penetrated": ("penetrated", "penetrated"),
    "distance": ("distance", "distance"), "dmg_health": ("dmg_health", "dmg_health"), "health_after": ("health", "health"),
    "blind_duration": ("blind_duration", "duration"), "site": ("site", "bombsite"), "a_bot": ("attacker_isbot", "attacker_is_bot"),
    "p_steam": ("steamid", "steam_id"), "p_name": ("name", "player_name"), "p_bot": ("is_bot", "isbot"), "other_tick": ("event_tick", "tick"),
}
#: Written once to the columnar layer: typed events, so that ``events`` is scanned once, and the rounds, which most other tables are joined to.
STORED = ("ev", "rounds")
#: Columns that only some rows have; the others hold NULL where a value is missing.
SPARSE = ("other_tick",)


class MatchTables:
    """Lazily built canonical tables; ``tables.kills`` is a DataFrame.

    All of them go back to the events' columnar layer, which is written when one is asked for first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._built = spark, path, {}
        for key, value in SESSION_DEFAULTS.items():
            spark.conf.set(key, value)

    def layer(self, key: str, build):
        """Derived layer kept with these tables."""
        if key not in self._built:
            self._built[key] = build()
        return self._built[key]

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """A table of this session's columnar layer; write-once."""
        layer = self.layer("store", lambda: Layer(self.spark, shared_folder(self.spark, "layer")))
        return layer.write(name, df)

    def close(self) -> None:
        """Delete the layer's files; DataFrames that read them can't be used afterwards."""
        if "store" in self._built:
            self._built["store"].drop()
        self._built.clear()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def _events(self) -> DataFrame:
        return self.read("events")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    @property
    def raw_events(self) -> DataFrame:
        """Landing form: one map of text values per row, keys spelled in several ways."""
        key = {c: F.when(F.col("k") % 2 == 0, even).otherwise(odd) for c, (even, odd) in RAW_KEYS.items()}
        pairs = [F.struct(key[c].alias("key"), F.col(c).cast("string").alias("value")) for c in RAW_KEYS if c not in SPARSE]
        some = [F.when(F.col(c).isNotNull(), F.struct(key[c].alias("key"), F.col(c).cast("string").alias("value"))) for c in SPARSE]
        data = F.map_from_entries(F.concat(F.array(*pairs), F.array_compact(F.array(*some))))
        rows = self.raw_cols.unionByName(self.raw_people, allowMissingColumns=True)
        return once(rows, data=data).select("match_id", "source_event", "data")

    def _build(self, name: str) -> DataFrame:
        df = self._derived(name)
        return self.stored(df, name) if name in STORED else df

    def _derived(self, name: str) -> DataFrame:
        source, rule, exprs = TABLES[name]
        df = self._events() if source == "events" else getattr(self, source) if source in TABLES else self.read(source)
        exprs = [_spark_text(e) for e in exprs]
        if rule.startswith("UNION "):
            return df.unionByName(getattr(self, rule[6:]))
        if rule.startswith("GROUP "):
            keys = rule[6:].split(", ")
            return df.groupBy(*keys).agg(*[F.expr(e) for e in exprs])
        if rule == "DISTINCT":
            return df.selectExpr(*exprs).distinct()
        if rule:
            df = df.where(_spark_text(rule))
        return df.selectExpr(*exprs)


def _spark_text(text: str) -> str:
    text = text.replace(" // ", " div ").replace("JSON_K", "CAST(get_json_object(props, '$.k') AS INT)")
    if text.startswith("EXPLODE["):
        inner, _, alias = text[8:].partition("]")
        return f"explode(array({inner})){alias}"
    return text


def _duck_text(text: str) -> str:
    text = text.replace("JSON_K", "CAST(json_extract_string(props, '$.k') AS INT)")
    return text.replace("EXPLODE[", "unnest([").replace("] AS", "]) AS") if text.startswith("EXPLODE[") else text


def duck_ctes() -> dict[str, str]:
    """The same tables as DuckDB common table expressions."""
    out = {}
    for name, (source, rule, exprs) in TABLES.items():
        cols = [_duck_text(e) for e in exprs]
        if rule.startswith("UNION "):
            out[name] = f"SELECT * FROM {source} UNION ALL BY NAME SELECT * FROM {rule[6:]}"
        elif rule.startswith("GROUP "):
            keys = rule[6:]
            out[name] = f"SELECT {keys}, {', '.join(cols)} FROM {source} GROUP BY {keys}"
        elif rule == "DISTINCT":
            out[name] = f"SELECT DISTINCT {', '.join(cols)} FROM {source}"
        else:
            out[name] = f"SELECT {', '.join(cols)} FROM {source}" + (f" WHERE {_duck_text(rule)}" if rule else "")
    pair = """CASE WHEN VALUE IS NULL THEN '{"key":"' || KEY || '"}' ELSE '{"key":"' || KEY || '","value":"' || VALUE || '"}' END"""
    text = {c: pair.replace("KEY", f"CASE WHEN k % 2 = 0 THEN '{even}' ELSE '{odd}' END").replace("VALUE", c) for c, (even, odd) in RAW_KEYS.items()}
    parts = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {text[c]} END" if c in SPARSE else text[c] for c in RAW_KEYS)
    out["raw_all"] = "SELECT * FROM raw_cols UNION ALL BY NAME SELECT * FROM raw_people"
    out["raw_payload"] = f"SELECT *, '[' || array_to_string(list_sort(list_filter([{parts}], lambda x: x IS NOT NULL)), ',') || ']' AS payload FROM raw_all"
    return out
