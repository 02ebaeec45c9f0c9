"""Hand-written five-against-five rounds: ticks 100 / 110 / 900 / 1000, players a1-a5 (T) and b1-b5 (CT)."""
from types import SimpleNamespace

ROUND = ("match_id string, round_id string, round_number int, start_tick int, freeze_end_tick int, end_tick int, official_end_tick int, t_team_id string, ct_team_id string, winner_side string, "
         "outcome_status string, score_status string, is_complete boolean, is_warmup boolean")
MEMBER = "match_id string, player_id string, team_id string, side string, valid_from_tick int, valid_to_tick int"
KILL = ("match_id string, round_id string, round_number int, tick int, relative_tick int, event_id bigint, phase string, attacker_player_id string, victim_player_id string, assister_player_id string, "
        "attacker_team_id string, victim_team_id string, headshot boolean, is_suicide boolean, is_teamkill boolean")
DAMAGE = "match_id string, round_id string, round_number int, tick int, event_id bigint, phase string, attacker_player_id string, victim_player_id string, damage_health int, victim_health_after int"
BOMB = "match_id string, round_id string, round_number int, tick int, event_id bigint, phase string, player_id string, event_type string"
SHOT = "match_id string, round_id string, round_number int, tick int, event_id bigint, phase string, player_id string"


def team(p):
    return None if p is None else ("A" if p[0] == "a" else "B")


def tables(spark, kills=(), damages=(), bombs=(), winner="T", players=5, late=None):
    """kills: (attacker, victim, tick[, assister]); damages: (attacker, victim, tick, raw, health_after)."""
    status = "available" if winner else "missing"
    rounds = [("m", "m-r1", 1, 100, 110, 900, 1000, "A", "B", winner, status, status, True, False)]
    members = [("m", f"{s}{i}", s.upper(), "T" if s == "a" else "CT", (late or {}).get(f"{s}{i}", 0), None) for s in "ab" for i in range(1, players + 1)]
    k = []
    for i, row in enumerate(kills):
        a, v, t, s = (*row, None)[:4]
        k.append(("m", "m-r1", 1, t, t - 100, i + 1, "live", a, v, s, team(a), team(v), None, a == v, a is not None and a != v and team(a) == team(v)))
    d = [("m", "m-r1", 1, r[2], i + 1, "live", r[0], r[1], r[3], r[4]) for i, r in enumerate(damages)]
    b = [("m", "m-r1", 1, r[2], i + 1, "live", r[1], r[0]) for i, r in enumerate(bombs)]
    make = spark.createDataFrame
    return SimpleNamespace(rounds=make(rounds, ROUND), memberships=make(members, MEMBER), kills=make(k, KILL), damages=make(d, DAMAGE), bombs=make(b, BOMB), shots=make([], SHOT))
