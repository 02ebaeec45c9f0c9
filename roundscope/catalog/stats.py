"""Per-round and match statistics: queries and oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..config import StatsConfig
from ..functions.common import ROUND, count_if
from ..operators import stats as S
from .registry import cte, query

WINDOW = 900
CFG = StatsConfig(trade_window_ticks=WINDOW)


def stats(t, share: bool = False) -> S.RoundStats:
    return S.RoundStats(t, CFG, share)


cte("er", """SELECT *, CASE WHEN coalesce(official_end_tick, end_tick, freeze_end_tick, start_tick) > start_tick
  THEN coalesce(official_end_tick, end_tick, freeze_end_tick, start_tick) ELSE lead(start_tick) OVER (PARTITION BY match_id ORDER BY round_number) - 1 END AS last_tick
  FROM rounds WHERE is_complete AND NOT is_warmup""")
cte("part", """SELECT match_id, round_id, round_number, player_id, min(team_id) AS team_id, min(side) AS side FROM (
  SELECT r.match_id, r.round_id, r.round_number, m.player_id, m.team_id, CASE WHEN m.team_id = r.t_team_id THEN 'T' ELSE 'CT' END AS side
  FROM er r JOIN memberships m ON m.match_id = r.match_id AND m.team_id IN (r.t_team_id, r.ct_team_id)
  AND m.valid_from_tick <= r.last_tick AND (m.valid_to_tick IS NULL OR m.valid_to_tick >= r.start_tick))
  GROUP BY ALL HAVING count(DISTINCT team_id) = 1""".replace("GROUP BY ALL", "GROUP BY match_id, round_id, round_number, player_id"))
cte("ro", """SELECT r.*, coalesce(p.n_t, 0) AS n_t, coalesce(p.n_ct, 0) AS n_ct,
  CASE WHEN outcome_status = 'available' THEN CASE winner_side WHEN 'T' THEN t_team_id WHEN 'CT' THEN ct_team_id END END AS winner_team_id,
  coalesce(p.n_t, 0) > 0 AND coalesce(p.n_t, 0) = coalesce(p.n_ct, 0) AS lineup_valid
  FROM er r LEFT JOIN (SELECT round_id, count(*) FILTER (side = 'T') AS n_t, count(*) FILTER (side = 'CT') AS n_ct FROM part GROUP BY round_id) p USING (round_id)""")
cte("ck", """SELECT k.*, a.team_id AS a_team, a.side AS a_side, v.team_id AS v_team, v.side AS v_side, s.team_id AS s_team,
  CASE WHEN v.team_id IS NULL THEN 'invalid'
    WHEN coalesce(k.is_suicide, FALSE) OR k.attacker_player_id = k.victim_player_id THEN 'suicide'
    WHEN a.team_id IS NULL THEN 'world'
    WHEN coalesce(k.is_teamkill, FALSE) OR a.team_id = v.team_id THEN 'teamkill'
    WHEN k.attacker_team_id IS NULL OR k.victim_team_id IS NULL OR k.attacker_team_id <> a.team_id OR k.victim_team_id <> v.team_id
      OR k.attacker_team_id = k.victim_team_id THEN 'invalid' ELSE 'enemy' END AS kill_class
  FROM kills k JOIN er USING (round_id) LEFT JOIN part a ON a.round_id = k.round_id AND a.player_id = k.attacker_player_id
  LEFT JOIN part v ON v.round_id = k.round_id AND v.player_id = k.victim_player_id
  LEFT JOIN part s ON s.round_id = k.round_id AND s.player_id = k.assister_player_id WHERE k.phase = 'live'""".replace("SELECT k.*", "SELECT k.*"))
cte("fd", "SELECT * FROM ck WHERE v_team IS NOT NULL QUALIFY row_number() OVER (PARTITION BY round_id, victim_player_id ORDER BY tick, event_id) = 1")
cte("vd", "SELECT * FROM fd WHERE kill_class = 'enemy'")
cte("opn", "SELECT * FROM ck WHERE kill_class = 'enemy' QUALIFY row_number() OVER (PARTITION BY round_id ORDER BY tick, event_id) = 1")
cte("trd", f"""SELECT b.match_id, b.round_id, b.round_number, b.event_id AS trade_event_id, a.event_id AS original_event_id,
  b.attacker_player_id AS trader_player_id, a.victim_player_id AS traded_player_id, a.attacker_player_id AS traded_enemy_id,
  b.a_team AS team_id, b.a_side AS side, b.tick - a.tick AS tick_delta
  FROM vd b JOIN vd a ON a.round_id = b.round_id AND (a.tick, a.event_id) < (b.tick, b.event_id) AND b.tick - a.tick <= {WINDOW}
  AND a.attacker_player_id = b.victim_player_id AND a.v_team = b.a_team AND a.a_team = b.v_team
  QUALIFY row_number() OVER (PARTITION BY b.event_id ORDER BY a.tick DESC, a.event_id DESC) = 1""")
cte("opp", """SELECT b.match_id, b.round_id, b.round_number, b.event_id, b.victim_player_id, p.player_id, p.team_id
  FROM vd b JOIN part p ON p.round_id = b.round_id AND p.team_id = b.v_team AND p.player_id <> b.victim_player_id
  WHERE NOT EXISTS (SELECT 1 FROM fd d WHERE d.round_id = b.round_id AND d.victim_player_id = p.player_id AND (d.tick, d.event_id) <= (b.tick, b.event_id))""")
cte("dmg_seq", """SELECT d.*, coalesce(d.damage_health, 0) AS raw, v.team_id AS v_team, a.team_id AS a_team,
  row_number() OVER (PARTITION BY d.round_id, d.victim_player_id ORDER BY d.tick, d.event_id) AS n
  FROM damages d JOIN er USING (round_id) JOIN part v ON v.round_id = d.round_id AND v.player_id = d.victim_player_id
  LEFT JOIN part a ON a.round_id = d.round_id AND a.player_id = d.attacker_player_id WHERE d.phase = 'live'""")
cte("dmg_fold", """SELECT event_id, round_id, victim_player_id, n, 100 AS hb, least(raw, 100) AS eff,
    coalesce(victim_health_after, greatest(0, 100 - least(raw, 100))) AS h FROM dmg_seq WHERE n = 1
  UNION ALL SELECT s.event_id, s.round_id, s.victim_player_id, s.n, f.h, least(s.raw, f.h), coalesce(s.victim_health_after, greatest(0, f.h - least(s.raw, f.h)))
  FROM dmg_fold f JOIN dmg_seq s ON s.round_id = f.round_id AND s.victim_player_id = f.victim_player_id AND s.n = f.n + 1""")
cte("dmg", """SELECT s.match_id, s.round_id, s.round_number, s.event_id, s.attacker_player_id, s.victim_player_id,
  CAST(f.hb AS BIGINT) AS health_before, CAST(f.eff AS BIGINT) AS effective,
  CASE WHEN s.a_team IS NULL THEN 'none' WHEN s.a_team <> s.v_team THEN 'enemy' WHEN s.attacker_player_id <> s.victim_player_id THEN 'team' ELSE 'self' END AS damage_kind
  FROM dmg_seq s JOIN dmg_fold f USING (event_id)""")
cte("trn", """SELECT k.match_id, k.round_id, k.round_number, k.tick, k.event_id, k.attacker_player_id, k.victim_player_id,
  k.event_id NOT IN (SELECT event_id FROM fd) AS repeated, k.kill_class, k.v_side, r.lineup_valid, r.t_team_id, r.ct_team_id,
  r.n_t - (SELECT count(*) FROM fd d WHERE d.round_id = k.round_id AND d.v_side = 'T' AND (d.tick, d.event_id) < (k.tick, k.event_id)) AS tb,
  r.n_t - (SELECT count(*) FROM fd d WHERE d.round_id = k.round_id AND d.v_side = 'T' AND (d.tick, d.event_id) <= (k.tick, k.event_id)) AS ta,
  r.n_ct - (SELECT count(*) FROM fd d WHERE d.round_id = k.round_id AND d.v_side = 'CT' AND (d.tick, d.event_id) < (k.tick, k.event_id)) AS cb,
  r.n_ct - (SELECT count(*) FROM fd d WHERE d.round_id = k.round_id AND d.v_side = 'CT' AND (d.tick, d.event_id) <= (k.tick, k.event_id)) AS ca
  FROM ck k JOIN ro r USING (round_id) WHERE k.v_team IS NOT NULL""")
cte("lead1", """SELECT * FROM trn WHERE lineup_valid AND ta <> ca QUALIFY row_number() OVER (PARTITION BY round_id ORDER BY tick, event_id) = 1""")
cte("adv", """SELECT r.match_id, r.round_id, r.round_number, r.lineup_valid, r.t_team_id, r.ct_team_id, r.winner_team_id,
  CASE WHEN l.ta > l.ca THEN r.t_team_id WHEN l.ta < l.ca THEN r.ct_team_id END AS lead_team, CAST(coalesce(abs(l.ta - l.ca), 0) AS BIGINT) AS lead_size,
  EXISTS (SELECT 1 FROM trn x WHERE x.round_id = r.round_id AND (x.tick, x.event_id) > (l.tick, l.event_id) AND sign(x.ta - x.ca) <> sign(l.ta - l.ca)) AS lead_lost,
  CAST(CASE WHEN r.lineup_valid THEN greatest(0, coalesce((SELECT max(ta - ca) FROM trn x WHERE x.round_id = r.round_id), 0)) ELSE 0 END AS BIGINT) AS max_t,
  CAST(CASE WHEN r.lineup_valid THEN greatest(0, coalesce((SELECT max(ca - ta) FROM trn x WHERE x.round_id = r.round_id), 0)) ELSE 0 END AS BIGINT) AS max_ct,
  r.n_t - (SELECT count(*) FROM fd d WHERE d.round_id = r.round_id AND d.v_side = 'T') AS final_t,
  r.n_ct - (SELECT count(*) FROM fd d WHERE d.round_id = r.round_id AND d.v_side = 'CT') AS final_ct
  FROM ro r LEFT JOIN lead1 l USING (round_id)""")


def _sub(expr: str, src: str, who: str) -> str:
    return f"coalesce((SELECT {expr} FROM {src} x WHERE x.round_id = p.round_id AND x.{who} = p.player_id), 0)"


cte("pr0", f"""SELECT p.*,
  CAST({_sub("count(*) FILTER (kill_class = 'enemy')", "ck", "attacker_player_id")} AS BIGINT) AS kills,
  CAST({_sub("count(*) FILTER (kill_class = 'enemy' AND headshot)", "ck", "attacker_player_id")} AS BIGINT) AS headshots,
  CAST({_sub("count(*)", "fd", "victim_player_id")} AS BIGINT) AS deaths,
  CAST({_sub("count(*) FILTER (kill_class = 'enemy')", "ck", "victim_player_id")} AS BIGINT) AS enemy_deaths,
  CAST({_sub("count(*) FILTER (kill_class = 'enemy' AND s_team = a_team AND assister_player_id <> attacker_player_id AND assister_player_id <> victim_player_id)", "ck", "assister_player_id")} AS BIGINT) AS assists,
  CAST({_sub("sum(effective)", "dmg", "attacker_player_id")} AS BIGINT) AS damage,
  CAST({_sub("sum(effective) FILTER (damage_kind = 'enemy')", "dmg", "attacker_player_id")} AS BIGINT) AS enemy_damage,
  CAST({_sub("sum(effective) FILTER (damage_kind = 'team')", "dmg", "attacker_player_id")} AS BIGINT) AS team_damage,
  CAST({_sub("count(*) FILTER (phase = 'live')", "shots", "player_id")} AS BIGINT) AS shots,
  CAST({_sub("count(*)", "trd", "trader_player_id")} AS BIGINT) AS traded_kills,
  CAST({_sub("count(*)", "trd", "traded_player_id")} AS BIGINT) AS traded_deaths,
  CAST({_sub("count(*)", "opp", "player_id")} AS BIGINT) AS trade_opportunities,
  CAST({_sub("count(*)", "opn", "attacker_player_id")} AS BIGINT) AS opening_kill,
  CAST({_sub("count(*)", "opn", "victim_player_id")} AS BIGINT) AS opening_death,
  CAST({_sub("count(*) FILTER (kill_class = 'teamkill')", "ck", "attacker_player_id")} AS BIGINT) AS teamkills,
  CAST({_sub("count(*) FILTER (kill_class = 'suicide')", "ck", "victim_player_id")} AS BIGINT) AS suicides,
  CAST({_sub("count(*) FILTER (phase = 'live' AND event_type = 'planted')", "bombs", "player_id")} AS BIGINT) AS plants,
  CAST({_sub("count(*) FILTER (phase = 'live' AND event_type = 'defused')", "bombs", "player_id")} AS BIGINT) AS defuses
  FROM part p""")
cte("pr", """SELECT *, deaths = 0 AS survived,
  CASE WHEN kills <= 0 THEN 'zero' WHEN kills = 1 THEN 'one' WHEN kills = 2 THEN 'two' WHEN kills = 3 THEN 'three' WHEN kills = 4 THEN 'four'
    WHEN kills = 5 THEN 'five' ELSE 'five_plus' END AS multikill_category,
  kills > 0 AS kast_k, assists > 0 AS kast_a, traded_deaths > 0 AS kast_t, kills > 0 OR assists > 0 OR deaths = 0 OR traded_deaths > 0 AS kast FROM pr0""")
cte("bomb_counts", """SELECT round_id, count(*) FILTER (event_type = 'planted') AS n_planted, count(*) FILTER (event_type = 'defused') AS n_defused,
  count(*) FILTER (event_type = 'exploded') AS n_exploded FROM bombs WHERE phase = 'live' GROUP BY round_id""")
cte("tr0", """SELECT a.match_id, a.round_id, a.round_number, a.t_team_id AS team_id, a.ct_team_id AS opponent_team_id, 'T' AS side, a.max_t AS max_advantage, a.final_t AS final_alive,
  a.lineup_valid, a.winner_team_id, a.lead_team, a.lead_size, a.lead_lost FROM adv a
  UNION ALL SELECT a.match_id, a.round_id, a.round_number, a.ct_team_id, a.t_team_id, 'CT', a.max_ct, a.final_ct, a.lineup_valid, a.winner_team_id, a.lead_team, a.lead_size, a.lead_lost FROM adv a""")
cte("tr1", """SELECT t.*, t.team_id = t.winner_team_id AS won, coalesce(o.a_team = t.team_id, FALSE) AS ok, coalesce(o.v_team = t.team_id, FALSE) AS od,
  coalesce(t.lead_team = t.team_id, FALSE) AS gained, coalesce(t.lead_team <> t.team_id, FALSE) AS behind,
  (SELECT count(*) FROM trd x WHERE x.round_id = t.round_id AND x.team_id = t.team_id) AS traded,
  (SELECT count(*) FROM vd x WHERE x.round_id = t.round_id AND x.v_team = t.team_id) AS opps,
  coalesce(b.n_planted, 0) AS np, coalesce(b.n_defused, 0) AS nd, coalesce(b.n_exploded, 0) AS ne,
  (SELECT count(*) FROM pr p WHERE p.round_id = t.round_id AND p.team_id = t.team_id) AS participant_count,
  CAST(coalesce((SELECT sum(kills) FROM pr p WHERE p.round_id = t.round_id AND p.team_id = t.team_id), 0) AS BIGINT) AS kills,
  CAST(coalesce((SELECT sum(enemy_deaths) FROM pr p WHERE p.round_id = t.round_id AND p.team_id = t.team_id), 0) AS BIGINT) AS deaths,
  CAST(coalesce((SELECT sum(assists) FROM pr p WHERE p.round_id = t.round_id AND p.team_id = t.team_id), 0) AS BIGINT) AS assists,
  CAST(coalesce((SELECT sum(enemy_damage) FROM pr p WHERE p.round_id = t.round_id AND p.team_id = t.team_id), 0) AS BIGINT) AS enemy_damage
  FROM tr0 t LEFT JOIN opn o USING (round_id) LEFT JOIN bomb_counts b USING (round_id)""")
cte("tr", """SELECT match_id, round_id, round_number, team_id, opponent_team_id, side, participant_count, lineup_valid, won AS round_won, kills, deaths, assists, enemy_damage,
  ok AS opening_kill, od AS opening_death, CASE WHEN ok THEN won END AS opening_kill_converted, CASE WHEN od THEN won END AS recovered_after_opening_death,
  opps AS trade_opportunities, traded AS successful_trades, traded AS traded_deaths, deaths - traded AS untraded_deaths, gained AS gained_first_advantage,
  CASE WHEN gained THEN lead_size ELSE 0 END AS first_advantage_size, gained AND lead_lost AS lost_first_advantage,
  CASE WHEN gained AND lineup_valid THEN won END AS converted_first_advantage, CASE WHEN behind AND lineup_valid THEN won END AS recovered_after_first_disadvantage,
  behind AS first_disadvantage, max_advantage >= 2 AS reached_plus_two, CASE WHEN max_advantage >= 2 AND lineup_valid THEN won END AS converted_plus_two,
  max_advantage, final_alive, CASE WHEN side = 'T' THEN np ELSE 0 END AS plants, CASE WHEN side = 'CT' THEN nd ELSE 0 END AS defuses,
  CASE WHEN side = 'T' THEN ne ELSE 0 END AS explosions, side = 'T' AND np > 0 AS planted_round, CASE WHEN side = 'T' AND np > 0 THEN won END AS post_plant_won,
  side = 'T' AND np > 0 AND nd + ne > 0 AS bomb_outcome_observed, np > 0 AS round_has_plant FROM tr1""")
cte("gates", """SELECT match_id, bool_and(outcome_status = 'available') AS win_ok, bool_and(n_t > 0 AND n_ct > 0) AS trade_ok FROM ro GROUP BY match_id""")

R = "match_id, round_id, round_number"


@query("e01_eligible_rounds", "SELECT match_id, round_id, round_number FROM rounds WHERE is_complete AND NOT is_warmup")
def _(t):
    return S.eligible_rounds(t.rounds).select(*ROUND)


@query("d07_participants", "SELECT * FROM part")
def _(t):
    return stats(t).members


@query("e02_kill_classes", "SELECT match_id, round_id, event_id, kill_class FROM ck")
def _(t):
    return stats(t).classified.select("match_id", "round_id", "event_id", "kill_class")


@query("e03_first_deaths", "SELECT match_id, round_id, victim_player_id, event_id, tick, kill_class FROM fd")
def _(t):
    f = stats(t).frame.select("match_id", "round_id", F.explode("deaths").alias("d"))
    return f.select("match_id", "round_id", F.col("d.victim").alias("victim_player_id"), "d.event_id", "d.tick", "d.kill_class")


def _player_cols(name, cols):
    @query(name, f"SELECT {R}, player_id, {', '.join(cols)} FROM pr")
    def _(t):
        return stats(t).player_rounds.select(*ROUND, "player_id", *cols)


_player_cols("e04_kill_counts", ["kills", "headshots", "enemy_deaths", "teamkills", "suicides", "deaths"])
_player_cols("e05_assists", ["assists"])
_player_cols("e11_damage_split", ["damage", "enemy_damage", "team_damage"])
_player_cols("e12_shots", ["shots"])
_player_cols("e14_survival", ["survived"])
_player_cols("e15_kast", ["kast_k", "kast_a", "survived", "kast_t", "kast"])
_player_cols("e16_multikill", ["kills", "multikill_category"])
_player_cols("e21_player_round", ["team_id", "side", "kills", "deaths", "assists", "headshots", "damage", "enemy_damage", "team_damage", "shots", "survived",
                                  "traded_kills", "traded_deaths", "trade_opportunities", "opening_kill", "opening_death", "multikill_category", "kast",
                                  "teamkills", "suicides", "plants", "defuses"])


@query("e06_opening_duels", """SELECT o.match_id, o.round_id, o.round_number, o.event_id, o.tick, o.relative_tick, o.attacker_player_id AS killer_player_id,
  o.victim_player_id, o.a_team AS killer_team_id, o.v_team AS victim_team_id, o.a_side AS killer_side, o.v_side AS victim_side,
  CASE WHEN r.winner_team_id IS NOT NULL THEN r.winner_side END AS round_winner, o.a_team = r.winner_team_id AS opening_team_won,
  greatest(0.0::DOUBLE, (o.tick - r.freeze_end_tick) / 64.0::DOUBLE) AS seconds FROM opn o JOIN ro r USING (round_id)""")
def _(t):
    return S.RoundStats(t, StatsConfig(trade_window_ticks=WINDOW, tick_rate=64.0)).openings


@query("e07_trades", "SELECT *, tick_delta / 64.0::DOUBLE AS seconds_delta FROM trd")
def _(t):
    return S.RoundStats(t, StatsConfig(trade_window_ticks=WINDOW, tick_rate=64.0)).trades


@query("e08_team_trades", f"SELECT {R}, team_id, trade_opportunities, successful_trades FROM tr")
def _(t):
    return stats(t).team_rounds.select(*ROUND, "team_id", "trade_opportunities", "successful_trades")


@query("e09_trade_opportunities", "SELECT * FROM opp")
def _(t):
    return stats(t).opportunities


@query("e10_effective_damage", "SELECT * FROM dmg")
def _(t):
    return stats(t).damage.select(*ROUND, "event_id", "attacker_player_id", "victim_player_id", "health_before", "effective", "damage_kind")


@query("e13_bomb_counts", f"SELECT {R}, team_id, plants, defuses, explosions FROM tr")
def _(t):
    return stats(t).team_rounds.select(*ROUND, "team_id", "plants", "defuses", "explosions")


@query("e17_man_advantage", """SELECT match_id, round_id, round_number, tick, event_id, tb AS t_alive_before, ta AS t_alive_after, cb AS ct_alive_before, ca AS ct_alive_after,
  tb - cb AS signed_before, ta - ca AS signed_after,
  CASE WHEN tb > cb THEN 't_advantage' WHEN tb < cb THEN 'ct_advantage' ELSE 'even' END AS state_before,
  CASE WHEN ta > ca THEN 't_advantage' WHEN ta < ca THEN 'ct_advantage' ELSE 'even' END AS state_after,
  attacker_player_id, victim_player_id, CASE WHEN repeated THEN 'repeated' ELSE kill_class END AS death_class FROM trn""")
def _(t):
    return stats(t).transitions


@query("e18_first_advantage", f"SELECT {R}, lead_team AS first_advantage_team_id, lead_size AS first_advantage_size, lead_lost AS first_advantage_lost FROM adv")
def _(t):
    return stats(t).advantage.select(*ROUND, "first_advantage_team_id", "first_advantage_size", "first_advantage_lost")


@query("e19_advantage_extent", f"SELECT {R}, max_t, max_ct, max_t >= 2 AS t_plus_two, max_ct >= 2 AS ct_plus_two, final_t, final_ct FROM adv")
def _(t):
    return stats(t).advantage.select(*ROUND, "max_t", "max_ct", "t_plus_two", "ct_plus_two", "final_t", "final_ct")


@query("e20_lineup_validity", f"SELECT {R}, n_t, n_ct, lineup_valid FROM ro")
def _(t):
    return stats(t).roster.select(*ROUND, "n_t", "n_ct", "lineup_valid")


@query("e22_team_round", "SELECT * FROM tr")
def _(t):
    return stats(t).team_rounds


@query("e23_seconds_to_ticks", "SELECT event_id, value AS seconds, CASE WHEN value > 0 THEN greatest(1, CAST(floor(value * 64 + 0.5) AS BIGINT)) END AS ticks FROM events")
def _(t):
    return t.read("events").select("event_id", F.col("value").alias("seconds"), S.seconds_to_ticks(F.col("value"), F.lit(64.0)).alias("ticks"))


def _pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN {n} * 100.0 / {d} END"


def _rat(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN {n} / {d} END"


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in S.PLAYER_COUNTERS)
cte("pm0", f"""SELECT match_id, player_id, count(*) AS rounds_played, {_SUMS}, count(*) FILTER (survived) AS survival_rounds, count(*) FILTER (pr.kills >= 2) AS multikill_rounds,
  count(*) FILTER (pr.kills = 2) AS two_k_rounds, count(*) FILTER (pr.kills = 3) AS three_k_rounds, count(*) FILTER (pr.kills = 4) AS four_k_rounds,
  count(*) FILTER (pr.kills = 5) AS five_k_rounds, count(*) FILTER (pr.kills >= 5) AS five_plus_rounds, count(*) FILTER (kast) AS kast_rounds,
  count(*) FILTER (kast_k) AS kast_k_rounds, count(*) FILTER (kast_a) AS kast_a_rounds, count(*) FILTER (kast_t) AS kast_t_rounds FROM pr GROUP BY match_id, player_id""")
cte("ow", """SELECT o.match_id, o.attacker_player_id AS player_id, count(*) FILTER (o.a_team = r.winner_team_id) AS w FROM opn o JOIN ro r USING (round_id) GROUP BY 1, 2""")
cte("pm", f"""SELECT match_id, player_id, rounds_played, kills, deaths, assists, {_rat('kills', 'deaths')} AS kd_ratio, kills - deaths AS kill_differential,
  {_rat('enemy_damage', 'rounds_played')} AS adr, {_rat('kills', 'rounds_played')} AS kpr, {_rat('deaths', 'rounds_played')} AS dpr, {_rat('assists', 'rounds_played')} AS apr,
  headshots, {_pct('headshots', 'kills')} AS headshot_percentage, damage AS total_damage, enemy_damage, team_damage, shots, survival_rounds,
  {_pct('survival_rounds', 'rounds_played')} AS survival_percentage, opening_kill AS opening_kills, opening_death AS opening_deaths,
  {_pct('opening_kill', '(opening_kill + opening_death)')} AS opening_success_percentage, CASE WHEN win_ok THEN coalesce(w, 0) END AS opening_kill_round_wins,
  CASE WHEN win_ok THEN {_pct('coalesce(w, 0)', 'opening_kill')} END AS opening_conversion_percentage,
  CASE WHEN trade_ok THEN traded_kills END AS traded_kills, CASE WHEN trade_ok THEN traded_deaths END AS traded_deaths,
  CASE WHEN trade_ok THEN trade_opportunities END AS trade_opportunities,
  CASE WHEN trade_ok THEN {_pct('traded_kills', 'trade_opportunities')} END AS trade_success_percentage,
  CASE WHEN trade_ok THEN {_pct('traded_deaths', 'enemy_deaths')} END AS traded_death_percentage,
  multikill_rounds, two_k_rounds, three_k_rounds, four_k_rounds, five_k_rounds, five_plus_rounds, CASE WHEN trade_ok THEN kast_rounds END AS kast_rounds,
  CASE WHEN trade_ok THEN {_pct('kast_rounds', 'rounds_played')} END AS kast_percentage, kast_k_rounds, kast_a_rounds,
  CASE WHEN trade_ok THEN kast_t_rounds END AS kast_t_rounds, teamkills, suicides, plants, defuses
  FROM pm0 LEFT JOIN ow USING (match_id, player_id) JOIN gates USING (match_id)""")


@query("f01_player_match", "SELECT * FROM pm")
def _(t):
    return stats(t).player_matches


_FLAGS = ["opening_kill", "opening_death", "opening_kill_converted", "recovered_after_opening_death", "gained_first_advantage", "converted_first_advantage",
          "first_disadvantage", "recovered_after_first_disadvantage", "reached_plus_two", "converted_plus_two", "planted_round", "post_plant_won", "bomb_outcome_observed"]
_TSUM = ["kills", "deaths", "assists", "enemy_damage", "trade_opportunities", "successful_trades", "traded_deaths", "plants", "defuses", "explosions"]
cte("tm0", "SELECT match_id, team_id, count(*) AS rounds_played, count(*) FILTER (round_won) AS round_wins, count(*) FILTER (side = 'T') AS t_rounds, "
    "count(*) FILTER (side = 'CT') AS ct_rounds, count(*) FILTER (side = 'T' AND round_won) AS t_round_wins, count(*) FILTER (side = 'CT' AND round_won) AS ct_round_wins, "
    + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in _FLAGS) + ", " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _TSUM)
    + ", count(*) FILTER (tr.defuses > 0) AS rounds_with_defuse, count(*) FILTER (tr.explosions > 0) AS rounds_with_explosion, "
    "count(*) FILTER (side = 'CT' AND round_has_plant) AS ct_plant_rounds, count(*) FILTER (side = 'CT' AND tr.defuses > 0) AS ct_defuse_rounds FROM tr GROUP BY match_id, team_id")


TEAM_MATCH = f"""SELECT match_id, team_id, rounds_played, CASE WHEN win_ok THEN round_wins END AS round_wins, t_rounds, ct_rounds,
  CASE WHEN win_ok THEN t_round_wins END AS t_round_wins, CASE WHEN win_ok THEN ct_round_wins END AS ct_round_wins, kills, deaths, assists, enemy_damage,
  {_rat('enemy_damage', 'rounds_played')} AS adr, opening_kill AS opening_kills, opening_death AS opening_deaths,
  CASE WHEN win_ok THEN opening_kill_converted END AS opening_kill_conversions, CASE WHEN win_ok THEN {_pct('opening_kill_converted', 'opening_kill')} END AS opening_conversion_percentage,
  CASE WHEN win_ok THEN {_pct('recovered_after_opening_death', 'opening_death')} END AS opening_recovery_percentage,
  CASE WHEN trade_ok THEN trade_opportunities END AS trade_opportunities, CASE WHEN trade_ok THEN successful_trades END AS successful_trades,
  CASE WHEN trade_ok THEN {_pct('successful_trades', 'trade_opportunities')} END AS trade_percentage, CASE WHEN trade_ok THEN deaths - traded_deaths END AS untraded_deaths,
  gained_first_advantage AS first_advantage_rounds, CASE WHEN win_ok THEN {_pct('converted_first_advantage', 'gained_first_advantage')} END AS first_advantage_conversion_percentage,
  first_disadvantage AS first_disadvantage_rounds, CASE WHEN win_ok THEN {_pct('recovered_after_first_disadvantage', 'first_disadvantage')} END AS first_disadvantage_recovery_percentage,
  reached_plus_two AS plus_two_rounds, CASE WHEN win_ok THEN {_pct('converted_plus_two', 'reached_plus_two')} END AS plus_two_conversion_percentage,
  plants, defuses, explosions, planted_round AS rounds_with_plant, rounds_with_defuse, rounds_with_explosion,
  CASE WHEN win_ok THEN {_pct('post_plant_won', 'planted_round')} END AS post_plant_conversion_percentage,
  {_pct('bomb_outcome_observed', 'planted_round')} AS bomb_outcome_coverage_percentage, {_pct('ct_defuse_rounds', 'ct_plant_rounds')} AS ct_defuse_success_percentage
  FROM tm0 JOIN gates USING (match_id)"""


@query("f02_team_match", TEAM_MATCH)
def _(t):
    return stats(t).team_matches


cte("av0", """SELECT match_id, count(*) AS population, count(*) FILTER (n_t > 0 AND n_ct > 0) AS combat, count(*) FILTER (outcome_status = 'available') AS win,
  count(*) FILTER (score_status = 'available') AS score, count(*) FILTER (outcome_status = 'unresolved_conflict') AS conflicts,
  count(*) FILTER (round_id IN (SELECT round_id FROM bombs WHERE phase = 'live')) AS bomb, count(*) FILTER (n_t + n_ct > 0 AND n_t = n_ct) AS adv_n FROM ro GROUP BY match_id""")
_AV = [("combat_metrics", "combat", "'missing_participants'"), ("opening_metrics", "combat", "'missing_participants'"), ("trade_metrics", "combat", "'missing_participants'"),
       ("kast_metrics", "combat", "'missing_participants'"), ("win_conversion_metrics", "win", "CASE WHEN conflicts > 0 THEN 'source_conflict' ELSE 'missing_round_winner' END"),
       ("score_metrics", "score", "'source_conflict'"), ("bomb_metrics", "bomb", "'unsupported_event_semantics'"), ("advantage_metrics", "adv_n", "'missing_participants'")]


@query("f03_metric_availability", " UNION ALL ".join(
    f"SELECT match_id, population, '{m}' AS metric, {c} AS covered, "
    + (f"CASE WHEN {c} > 0 THEN 'partial' ELSE 'unavailable' END AS status, {r} AS reason" if m == "bomb_metrics" else
       f"CASE WHEN {c} = population THEN 'available' WHEN {c} > 0 THEN 'partial' ELSE 'unavailable' END AS status, CASE WHEN {c} < population THEN {r} END AS reason")
    + " FROM av0" for m, c, r in _AV))
def _(t):
    return stats(t).availability
