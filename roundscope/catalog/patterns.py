"""Cross-match frequency and trust queries and oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import shared, text, union_all
from ..operators import economy as K
from ..plans import patterns as M
from ..plans import trust as N
from .facts import facts
from .registry import ORACLES, cte, query, with_clause

RATE = 64.0
CFG = N.TrustConfig()
ITER = CFG.iterations
BIN = tuple(M.BINARY)


def patterns(t):
    return t.layer("patterns", lambda: Patterns(t))


class Patterns:
    def __init__(self, t):
        self.t = t
        self.inputs = M.match_inputs(t.selections, t.matches, t.feature_runs, "v1")
        self.facts = facts(t)
        rounds = shared(M.round_inputs(self.inputs, t.rounds, K.Economy(t).teams))  # observations read it twice
        self.obs = shared(M.observations(rounds, self.facts.all, t.players, RATE))

    @property
    def freq(self):
        return M.frequencies(self.obs)


def frozen(t):
    p = patterns(t)
    f = t.layer("frequencies", lambda: shared(p.freq))
    return p, f, M.contributions(p.obs, f)


cte("pmi", """SELECT s.profile_id, s.match_id, s.team_id, coalesce(m.map_name, 'unknown') AS map_name, CASE WHEN f.rule_version = 'v1' THEN 'included' ELSE 'excluded' END AS status, CASE WHEN f.rule_version IS NULL THEN 'compatible_feature_run_unavailable' WHEN f.rule_version <> 'v1' THEN 'feature_rule_incompatible' END AS exclusion_reason
  FROM selections s LEFT JOIN matches m USING (match_id) LEFT JOIN feature_runs f USING (match_id)""")
cte("pin", """SELECT i.profile_id, i.match_id, r.round_id, r.round_number, i.team_id, CASE WHEN i.team_id = r.t_team_id THEN 'T' ELSE 'CT' END AS side, i.map_name, k.buy_type, r.winner_side = CASE WHEN i.team_id = r.t_team_id THEN 'T' ELSE 'CT' END AS won
  FROM pmi i JOIN er r ON r.match_id = i.match_id LEFT JOIN ktm k ON k.round_id = r.round_id AND k.team_id = i.team_id WHERE i.status = 'included'""")
cte("pids", "SELECT match_id, player_id, coalesce('steam:' || steam_id, 'occurrence:' || match_id || ':' || player_id) AS ident FROM players")
PR = "p.profile_id, p.match_id, p.round_id, p.round_number, p.team_id, p.side, p.map_name, p.buy_type"


def _obs(kind, side, body, reason, included=None, partial="part"):
    inc = included or "len(vals) > 0"
    return (f"SELECT {PR.replace('p.', '')}, '{kind}' AS pattern_type, coalesce({inc}, FALSE) AS included, CASE WHEN coalesce({inc}, FALSE) THEN vals ELSE [] END AS vals, coalesce({inc}, FALSE) AND coalesce({partial}, FALSE) AS partial, "
            f"CASE WHEN NOT coalesce({inc}, FALSE) THEN {reason} END AS reason FROM ({body}) WHERE {side}")


def _ff(kind, val):
    return f"SELECT {PR}, p.won, list_sort(coalesce(list(DISTINCT {val}) FILTER (f.availability IN ('available', 'partial') AND {val} IS NOT NULL), [])) AS vals, bool_or(f.availability = 'partial') AS part, bool_or(f.availability IN ('available', 'partial')) AS ok, bool_or(f.availability = 'not_applicable') AS neg FROM pin p LEFT JOIN facts f ON f.round_id = p.round_id AND f.team_id = p.team_id AND f.feature_type = '{kind}' GROUP BY {PR}, p.won"


cte("psec", f"SELECT {PR}, CASE WHEN f.availability IN ('available', 'partial') THEN CAST(f.value AS DOUBLE) / {RATE} END AS sec, f.availability IN ('available', 'partial') AS ok, f.availability = 'partial' AS part FROM pin p LEFT JOIN facts f ON f.round_id = p.round_id AND f.team_id = p.team_id AND f.feature_type = 'plant_timing'")
cte("pset", "SELECT round_id, team_id, string_agg(zone || '*' || n, ' ' ORDER BY zone) AS setup FROM (SELECT round_id, team_id, zone, count(*) AS n FROM (SELECT round_id, team_id, string_split(unnest(string_split(value, '|')), '=')[2] AS zone FROM facts WHERE feature_type = 'starting_zone_distribution' AND availability = 'available') GROUP BY 1, 2, 3) GROUP BY 1, 2")
cte("popn", f"""SELECT {PR}, p.won, CASE WHEN o.a_team = p.team_id THEN k.ident END AS killer, CASE WHEN o.a_team = p.team_id THEN o.attacker_player_id END AS kraw, CASE WHEN o.a_team <> p.team_id THEN v.ident END AS victim, CASE WHEN o.a_team <> p.team_id THEN o.victim_player_id END AS vraw, u.tick IS NOT NULL AS part
  FROM pin p LEFT JOIN opn o ON o.round_id = p.round_id LEFT JOIN unc u ON u.round_id = o.round_id AND u.tick = o.tick LEFT JOIN pids k ON k.match_id = p.match_id AND k.player_id = o.attacker_player_id LEFT JOIN pids v ON v.match_id = p.match_id AND v.player_id = o.victim_player_id""")
_LST = "CASE WHEN {0} IS NULL THEN [] ELSE [{0}] END"
cte("pcon", f"""SELECT {PR}, p.won, list_sort(coalesce(list(DISTINCT x.role || ':zone:' || z.zone_id) FILTER (z.zone_id IS NOT NULL), [])) AS vals, (SELECT bool_or(availability = 'partial') FROM facts f WHERE f.round_id = p.round_id AND f.team_id = p.team_id AND f.feature_type = 'first_contact') AS part FROM pin p LEFT JOIN (
  SELECT c.round_id, c.tick, y.* FROM ctc c, LATERAL (SELECT 'initiator' AS role, c.attacker_player_id AS pid, c.atm AS team_id UNION ALL SELECT 'receiver', c.victim_player_id, c.vt) y) x ON x.round_id = p.round_id AND x.team_id = p.team_id LEFT JOIN zsn z ON z.round_id = x.round_id AND z.tick = x.tick AND z.player_id = x.pid GROUP BY {PR}, p.won""")
cte("putl", f"""SELECT {PR}, p.won, list_sort(coalesce(list(DISTINCT 'utility:' || g.grenade_type || ':zone:' || coalesce(g.zone_id, 'unresolved')) FILTER (g.grenade_type IS NOT NULL), [])) AS vals, (SELECT bool_or(availability = 'partial') FROM facts f WHERE f.round_id = p.round_id AND f.team_id = p.team_id AND f.feature_type = 'first_utility') AS part
  FROM pin p LEFT JOIN fut u ON u.round_id = p.round_id AND u.team_id = p.team_id LEFT JOIN gzn g ON g.round_id = u.round_id AND g.team_id = u.team_id AND g.tick = u.tick AND g.phase = 'live' GROUP BY {PR}, p.won""")


def _bin(kind, label):
    return _obs(kind, "TRUE", f"SELECT *, CASE WHEN ok THEN ['{label}'] ELSE [] END AS v2 FROM ({_ff(kind, 'f.value')})".replace("SELECT *, CASE", "SELECT * EXCLUDE (vals), CASE").replace("AS v2", "AS vals"), f"'{kind}_availability_unproven'", "ok OR neg", "ok AND part")


cte("pobs", " UNION ALL ".join([
    _obs("site_preference", "side = 'T'", _ff("bombsite", "'site:' || f.value"), "'plant_site_unavailable'"),
    _obs("bomb_routing", "side = 'T'", _ff("bomb_route", "f.value"), "'bomb_route_unavailable'"),
    _obs("plant_timing", "side = 'T'", "SELECT *, CASE WHEN sec >= 60 THEN ['60s+'] WHEN sec >= 40 THEN ['40-60s'] WHEN sec >= 20 THEN ['20-40s'] WHEN sec >= 0 THEN ['0-20s'] ELSE [] END AS vals FROM psec", "CASE WHEN ok THEN 'plant_seconds_unavailable' ELSE 'plant_timing_unavailable' END"),
    _obs("ct_starting_position", "side = 'CT'", f"SELECT {PR}, {_LST.format('t.setup')} AS vals, FALSE AS part FROM pin p LEFT JOIN pset t ON t.round_id = p.round_id AND t.team_id = p.team_id", "'complete_ct_starting_setup_unavailable'"),
    _obs("early_zone_occupation", "TRUE", _ff("early_zone_presence", "'zone:' || f.zone_id"), "'early_zone_evidence_unavailable'", partial="FALSE"),
    _obs("recurring_opening_player", "TRUE", f"SELECT *, {_LST.format('killer')} AS vals FROM popn", "'opponent_opening_winner_not_observed'"),
    _obs("recurring_opening_death", "TRUE", f"SELECT *, {_LST.format('victim')} AS vals FROM popn", "'opponent_opening_loser_not_observed'"),
    _obs("first_contact_zone", "TRUE", "SELECT * FROM pcon", "'first_contact_zone_unresolved'"), _obs("first_utility", "TRUE", "SELECT * FROM putl", "'first_utility_unavailable'"),
    _obs("opening_kill_conversion", "TRUE", "SELECT *, CASE WHEN won THEN ['converted_opening_kill'] ELSE [] END AS vals FROM popn", "CASE WHEN kraw IS NULL THEN 'opening_winner_opportunity_unavailable' ELSE 'round_outcome_unavailable' END", "kraw IS NOT NULL AND won IS NOT NULL"),
    _obs("recovery_after_opening_death", "TRUE", "SELECT *, CASE WHEN won THEN ['recovered_after_opening_death'] ELSE [] END AS vals FROM popn", "CASE WHEN vraw IS NULL THEN 'opening_loser_opportunity_unavailable' ELSE 'round_outcome_unavailable' END", "vraw IS NOT NULL AND won IS NOT NULL"),
    _bin("lost_man_advantage", "round_contains_lost_man_advantage"), _bin("untraded_death", "round_contains_untraded_death")]))
SC = "profile_id, pattern_type, map_name, side, buy_type"
_REG = " UNION ALL ".join(f"SELECT '{a}' AS pt, '{b}' AS v" for a, b in M.registered_values())
cte("pob2", "SELECT * REPLACE (coalesce(buy_type, 'none') AS buy_type) FROM pobs")
cte("psco", f"SELECT {SC}, count(*) AS denominator, count(DISTINCT match_id) AS denominator_match_count, bool_or(partial) AS anyp FROM pob2 WHERE included GROUP BY {SC}")
cte("phit", f"SELECT {SC}, value, count(*) AS numerator, count(DISTINCT match_id) AS nm FROM (SELECT {SC}, match_id, unnest(vals) AS value FROM pob2 WHERE included) GROUP BY {SC}, value")
cte("pkey", f"SELECT {SC}, value FROM phit UNION SELECT {SC}, v FROM psco JOIN ({_REG}) ON pt = pattern_type")
_SC = ", ".join("k." + c for c in SC.split(", "))
cte("pfr", f"""SELECT sha256(concat_ws(':', {_SC}, k.value)) AS pattern_id, {_SC}, k.value, coalesce(h.numerator, 0) AS numerator, s.denominator, coalesce(h.numerator, 0) / s.denominator AS frequency, coalesce(h.nm, 0) AS numerator_match_count, s.denominator_match_count,
  CASE WHEN s.anyp OR k.buy_type = 'none' OR (k.pattern_type LIKE 'recurring_opening%' AND k.value LIKE 'occurrence:%') THEN 'partial' ELSE 'available' END AS availability, s.denominator < 5 AS small_sample
  FROM pkey k JOIN psco s USING ({SC}) LEFT JOIN phit h USING ({SC}, value)""")
cte("pct", f"SELECT f.pattern_id, o.match_id, o.round_id, o.round_number, list_contains(o.vals, f.value) AS contributed FROM pfr f JOIN pob2 o USING ({SC}) WHERE o.included")


@query("m01_match_selection", "SELECT * FROM pmi")
def _(t):
    return M.match_inputs(t.selections, t.matches, t.feature_runs, "v1")


OB = "profile_id, match_id, round_id, round_number, side, map_name, buy_type, pattern_type, included, partial, reason"


def _obq(name, rule):
    @query(name, f"SELECT {OB}, array_to_string(vals, ';') AS vals FROM pobs WHERE {rule}")
    def _(t):
        return patterns(t).obs.where(rule).select(*OB.split(", "), F.array_join("values", ";").alias("vals"))


_obq("m02_observations", "TRUE")
_obq("m03_zone_player_values", "pattern_type NOT IN ('plant_timing', 'opening_kill_conversion', 'recovery_after_opening_death', 'lost_man_advantage', 'untraded_death')")
_obq("m04_binary_patterns", "pattern_type IN ('opening_kill_conversion', 'recovery_after_opening_death', 'lost_man_advantage', 'untraded_death')")


@query("m05_timing_buckets", f"SELECT {SC}, value, numerator, denominator FROM pfr WHERE pattern_type = 'plant_timing'")
def _(t):
    return patterns(t).freq.where("pattern_type = 'plant_timing'").select(*SC.split(", "), "value", "numerator", "denominator")


@query("m06_frequencies", "SELECT * FROM pfr")
def _(t):
    return patterns(t).freq.drop("lower_bound", "upper_bound")


_Z = 1.959963984540054
cte("pwi", f"SELECT *, {_Z}::DOUBLE AS zz, numerator / denominator AS pp, denominator::DOUBLE AS dd FROM pfr")


@query("m07_wilson_bounds", """SELECT pattern_id, numerator, denominator, round(greatest(0, (pp + zz * zz / (2 * dd)) / (1 + zz * zz / dd) - zz * sqrt(pp * (1 - pp) / dd + zz * zz / (4 * dd * dd)) / (1 + zz * zz / dd)), 9) AS lower_bound,
  round(least(1, (pp + zz * zz / (2 * dd)) / (1 + zz * zz / dd) + zz * sqrt(pp * (1 - pp) / dd + zz * zz / (4 * dd * dd)) / (1 + zz * zz / dd)), 9) AS upper_bound FROM pwi""")
def _(t):
    return patterns(t).freq.select("pattern_id", "numerator", "denominator", F.round("lower_bound", 9).alias("lower_bound"), F.round("upper_bound", 9).alias("upper_bound"))


@query("m08_exclusions", f"SELECT {SC}, reason, count(*) AS rounds, count(DISTINCT match_id) AS matches FROM pob2 WHERE NOT included GROUP BY {SC}, reason")
def _(t):
    return M.exclusions(patterns(t).obs)


@query("m09_evidence_rounds", "SELECT * FROM pct")
def _(t):
    return frozen(t)[2]


@query("m10_pattern_capability", """SELECT o.profile_id, o.pattern_type, o.e AS eligible_rounds, o.x AS excluded_rounds, coalesce(p.n, 0) AS pattern_count, CASE WHEN o.e = 0 THEN 'unavailable' WHEN p.part THEN 'partial' ELSE 'available' END AS availability FROM (SELECT profile_id, pattern_type, count(*) FILTER (included) AS e, count(*) FILTER (NOT included) AS x FROM pobs GROUP BY 1, 2) o
  LEFT JOIN (SELECT profile_id, pattern_type, count(*) AS n, bool_or(availability = 'partial') AS part FROM pfr GROUP BY 1, 2) p USING (profile_id, pattern_type)""")
def _(t):
    p = patterns(t)
    return M.capability(p.obs, p.freq)


@query("m11_pattern_listing", f"SELECT pattern_id, {SC}, value, frequency, denominator FROM pfr WHERE side = 'T' ORDER BY profile_id, frequency DESC, denominator DESC, pattern_id")
def _(t):
    return M.listing(patterns(t).freq, side="T").select("pattern_id", *SC.split(", "), "value", "frequency", "denominator")


@query("m12_latest_runs", """SELECT profile_id, run_id, created_at FROM pattern_runs r WHERE (SELECT count(*) FROM run_inputs i WHERE i.run_id = r.run_id) = (SELECT count(*) FROM selections s WHERE s.profile_id = r.profile_id)
  AND NOT EXISTS (SELECT 1 FROM run_inputs i WHERE i.run_id = r.run_id AND (NOT EXISTS (SELECT 1 FROM selections s WHERE s.profile_id = r.profile_id AND s.match_id = i.match_id AND s.team_id = i.team_id)
    OR i.feature_fingerprint IS DISTINCT FROM (SELECT arg_max(feature_fingerprint, (created_at, feature_fingerprint)) FROM feature_history h WHERE h.match_id = i.match_id)))
  QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, run_id DESC) = 1""")
def _(t):
    return M.latest_compatible(t.pattern_runs, t.run_inputs, t.selections, t.feature_history)


cte("mvr", "SELECT p.steam_id, m.map_name, f.side, f.zone_id, f.match_id, f.round_number FROM (SELECT *, unnest(string_split(value, '|')) AS pid FROM f_early WHERE zone_id IS NOT NULL) f JOIN players p ON p.match_id = f.match_id AND p.player_id = f.pid AND p.steam_id IS NOT NULL JOIN matches m ON m.match_id = f.match_id")


@query("m13_movement_chapter", """SELECT z.*, s.denominator, numerator / denominator AS frequency, CAST(row_number() OVER (PARTITION BY steam_id, map_name ORDER BY numerator / denominator DESC, denominator DESC, side, lower(zone_id)) AS INT) AS rank FROM (SELECT steam_id, map_name, side, zone_id, count(DISTINCT (match_id, round_number)) AS numerator, count(DISTINCT match_id) AS match_count FROM mvr GROUP BY 1, 2, 3, 4) z
  JOIN (SELECT steam_id, map_name, side, count(DISTINCT (match_id, round_number)) AS denominator FROM mvr GROUP BY 1, 2, 3) s USING (steam_id, map_name, side)""".replace("z.*", "steam_id, map_name, side, zone_id, numerator, match_count"))
def _(t):
    return M.movement_chapter(facts(t).early_zones(), t.players, t.matches)


# -- trust -------------------------------------------------------------------
cte("tct", "SELECT pattern_id, match_id, count(*) FILTER (contributed) AS numerator, count(*) AS denominator, count(*) FILTER (contributed) / count(*) AS frequency FROM pct GROUP BY 1, 2")


def _r(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


@query("n01_match_contributions", "SELECT * FROM tct")
def _(t):
    return N.match_contributions(frozen(t)[2])


cte("tpk", "SELECT pattern_id, list({'n': numerator, 'd': denominator} ORDER BY match_id) AS cl, count(*) AS clusters, sum(numerator) / sum(denominator) AS point, unhex(sha256(pattern_id || ':trust-v1')) AS seed FROM tct GROUP BY 1 HAVING count(*) >= 2")
cte("tbo", f"""SELECT pattern_id, clusters, point, k, sum(cl[i]['n']) / sum(cl[i]['d']) AS est FROM (SELECT pattern_id, clusters, point, k, cl, CAST(('0x' || substr(sha256(seed || unhex(lpad(hex(k * clusters + j), 16, '0'))), 1, 16))::UBIGINT % clusters::UBIGINT AS BIGINT) + 1 AS i
  FROM (SELECT *, unnest(generate_series(0, {ITER - 1})) AS k FROM tpk) , LATERAL (SELECT unnest(generate_series(0, clusters - 1)) AS j)) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY pattern_id, clusters, point, k"))
_LO, _HI = int((1 - 0.95) / 2 * (ITER - 1)), int((1 - (1 - 0.95) / 2) * (ITER - 1))
cte("tbs", f"SELECT pattern_id, clusters, point, least(list(est ORDER BY est)[{_LO + 1}], point) AS lower_bound, greatest(list(est ORDER BY est)[{_HI + 1}], point) AS upper_bound FROM tbo GROUP BY 1, 2, 3")


@query("n02_cluster_bootstrap", "SELECT pattern_id, clusters, round(point, 9) AS point, round(lower_bound, 9) AS lower_bound, round(upper_bound, 9) AS upper_bound FROM tbs")
def _(t):
    return _r(N.bootstrap_interval(N.match_contributions(frozen(t)[2]), CFG), "point", "lower_bound", "upper_bound")


cte("tst", """SELECT pattern_id, clusters, CASE WHEN clusters >= 3 THEN mn END AS loo_min, CASE WHEN clusters >= 3 THEN mx END AS loo_max, CASE WHEN clusters >= 3 THEN mx - mn END AS loo_range, CASE WHEN clusters >= 3 THEN dir END AS direction, CASE WHEN clusters >= 3 THEN mx - mn <= 0.2 AND dir >= 0.6 END AS stable FROM (
  SELECT c.pattern_id, count(*) AS clusters, min((t.n - c.numerator) / (t.d - c.denominator)) FILTER (t.d > c.denominator) AS mn, max((t.n - c.numerator) / (t.d - c.denominator)) FILTER (t.d > c.denominator) AS mx, count(*) FILTER (c.frequency > 0.5) / count(*) AS dir FROM tct c JOIN (SELECT pattern_id, CAST(sum(numerator) AS BIGINT) AS n, CAST(sum(denominator) AS BIGINT) AS d FROM tct GROUP BY 1) t USING (pattern_id) GROUP BY 1)""")


@query("n03_leave_one_out", "SELECT pattern_id, clusters, round(loo_min, 9) AS loo_min, round(loo_max, 9) AS loo_max, round(loo_range, 9) AS loo_range, round(direction, 9) AS direction, stable FROM tst")
def _(t):
    return _r(N.stability(N.match_contributions(frozen(t)[2]), CFG), "loo_min", "loo_max", "loo_range", "direction")


_NULL = f"CASE WHEN pattern_type IN ({', '.join(repr(b) for b in BIN)}) THEN 0.5::DOUBLE WHEN value IN ('site:A', 'site:B') THEN 0.5::DOUBLE END"
cte("tnl", f"SELECT pattern_id, profile_id, {_NULL} AS null_frequency FROM pfr")


@query("n04_null_choice", "SELECT pattern_id, null_frequency FROM tnl")
def _(t):
    return frozen(t)[1].select("pattern_id", N.null_frequency(F.col("pattern_type"), F.col("value"), BIN).alias("null_frequency"))


cte("tsg", """SELECT pattern_id, any_value(profile_id) AS profile_id, count(*) FILTER (frequency > null_frequency) AS above, count(*) FILTER (frequency <> null_frequency) AS tested FROM tct JOIN tnl USING (pattern_id) WHERE null_frequency IS NOT NULL GROUP BY 1""")
cte("tpv", """SELECT s.pattern_id, s.profile_id, s.above, s.tested, CASE WHEN s.tested = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (SELECT sum(exp(lgamma(s.tested + 1) - lgamma(i + 1) - lgamma(s.tested - i + 1) - s.tested * ln(2))) FROM (SELECT unnest(generate_series(s.above, s.tested)) AS i))) END AS p_value FROM tsg s""")


@query("n05_sign_test", "SELECT pattern_id, above, tested, round(p_value, 9) AS p_value FROM tpv")
def _(t):
    _, f, rounds = frozen(t)
    p = f.withColumn("null_frequency", N.null_frequency(F.col("pattern_type"), F.col("value"), BIN))
    return _r(N.sign_test(N.match_contributions(rounds), p), "p_value")


cte("tqv", """SELECT pattern_id, least(1.0::DOUBLE, min(p_value * fam / rk) OVER (PARTITION BY profile_id ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value, p_value, fam FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(p_value, 12), pattern_id) AS rk, count(*) OVER (PARTITION BY profile_id) AS fam FROM tpv)""")


@query("n06_false_discovery", "SELECT pattern_id, round(p_value, 9) AS p_value, fam AS family_size, round(q_value, 9) AS q_value FROM tqv")
def _(t):
    _, f, rounds = frozen(t)
    p = f.withColumn("null_frequency", N.null_frequency(F.col("pattern_type"), F.col("value"), BIN))
    tests = N.sign_test(N.match_contributions(rounds), p).join(f.select("pattern_id", "profile_id"), "pattern_id")
    return _r(N.q_values(tests, ["profile_id"]), "p_value", "q_value").select("pattern_id", "p_value", "family_size", "q_value")


cte("tas", """SELECT f.pattern_id, f.profile_id, f.pattern_type, f.denominator_match_count, f.frequency - n.null_frequency AS effect_size, b.lower_bound AS low, s.direction, q.q_value, n.null_frequency IS NOT NULL AND q.p_value IS NOT NULL AS testable, CASE WHEN f.denominator_match_count >= 5 THEN 'pass' ELSE 'fail' END AS gate_clusters, CASE WHEN f.availability = 'available' THEN 'pass' ELSE 'fail' END AS gate_source,
  CASE WHEN f.frequency - n.null_frequency + 1e-12 >= 0.1 THEN 'pass' WHEN n.null_frequency IS NOT NULL AND q.p_value IS NOT NULL THEN 'fail' ELSE 'unavailable' END AS gate_effect, CASE WHEN b.lower_bound > n.null_frequency THEN 'pass' WHEN b.lower_bound IS NOT NULL AND n.null_frequency IS NOT NULL AND q.p_value IS NOT NULL THEN 'fail' ELSE 'unavailable' END AS gate_lower,
  CASE WHEN q.q_value <= 0.05 THEN 'pass' WHEN n.null_frequency IS NOT NULL AND q.p_value IS NOT NULL THEN 'fail' ELSE 'unavailable' END AS gate_multiple, CASE WHEN s.stable THEN 'pass' WHEN s.stable IS NOT NULL THEN 'fail' ELSE 'unavailable' END AS gate_stability
  FROM pfr f JOIN tnl n USING (pattern_id) LEFT JOIN tqv q USING (pattern_id) LEFT JOIN tbs b USING (pattern_id) LEFT JOIN tst s USING (pattern_id)""")
cte("tdc", """SELECT *, CASE WHEN NOT testable THEN 'not_testable' WHEN gate_clusters = 'fail' OR gate_stability = 'unavailable' THEN 'insufficient_data' WHEN gate_source = 'pass' AND gate_effect = 'pass' AND gate_lower = 'pass' AND gate_multiple = 'pass' AND gate_stability = 'pass' THEN 'supported' ELSE 'not_supported' END AS decision FROM tas""")
G6 = "gate_clusters, gate_source, gate_effect, gate_lower, gate_multiple, gate_stability"


@query("n07_trust_decision", f"SELECT pattern_id, {G6}, decision FROM tdc")
def _(t):
    _, f, rounds = frozen(t)
    return N.assess(f, rounds, BIN, CFG).select("pattern_id", *G6.split(", "), "decision")


@query("n08_reliability_rank")
def _(t):
    _, f, rounds = frozen(t)
    return _r(N.assess(f, rounds, BIN, CFG), "reliability_score").select("pattern_id", "profile_id", "decision", "reliability_score", "reliability_rank")


@query("n09_reliability_tier", "SELECT profile_id, count(*) AS matches, CASE WHEN count(*) >= 15 THEN 'high' WHEN count(*) >= 8 THEN 'tactical_trend' WHEN count(*) >= 3 THEN 'tactical_trend_small' WHEN count(*) >= 1 THEN 'match_facts' ELSE 'no_data' END AS tier FROM selections GROUP BY 1")
def _(t):
    g = t.selections.groupBy("profile_id").agg(F.count("*").alias("matches"))
    return g.withColumn("tier", N.reliability_tier(F.col("matches")))


@query("n10_label_metrics", """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1, missing = 0 AND unavailable = 0 AND unknown = 0 AND sample_size > 0 AS complete FROM (SELECT *, tp + fp + tn + fn AS sample_size, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS false_positive_rate FROM (
  SELECT count(*) FILTER (l = 'present' AND p = 'present') AS tp, count(*) FILTER (l = 'absent' AND p = 'present') AS fp, count(*) FILTER (l = 'absent' AND p = 'absent') AS tn, count(*) FILTER (l = 'present' AND p = 'absent') AS fn, count(*) FILTER (l = 'indeterminate') AS indeterminate, count(*) FILTER (l IN ('present', 'absent') AND p IS NULL) AS missing, count(*) FILTER (l IS NULL) AS unknown,
    count(*) FILTER (l IN ('present', 'absent') AND p = 'unavailable') AS unavailable FROM (SELECT a.value AS l, b.value AS p FROM case_labels a FULL JOIN case_predictions b USING (label_id))))""")
def _(t):
    return N.label_metrics(t.case_labels, t.case_predictions)


@query("n10_label_lists", " UNION ALL ".join(f"SELECT '{n}' AS list, label_id FROM (SELECT label_id, a.value AS l, b.value AS p FROM case_labels a FULL JOIN case_predictions b USING (label_id)) WHERE {r}" for n, r in (
    ("missing", "l IN ('present', 'absent') AND p IS NULL"), ("unknown", "l IS NULL"), ("unavailable", "l IN ('present', 'absent') AND p = 'unavailable'"), ("indeterminate", "l = 'indeterminate'"))))
def _(t):
    return N.label_lists(t.case_labels, t.case_predictions)


POLICY = {"matches": 3, "maps": 2, "sources": ("league", "ladder", "scrim"), "edges": ("overtime", "reconnect", "surrender"), "determinate": 50, "positive": 20, "negative": 20, "parsers": ("parser1", "parser2")}


#: A policy that some corpora meet: one source, one edge case, one parser.
EASY_POLICY = {"matches": 2, "maps": 2, "sources": ("league",), "edges": ("none",), "determinate": 40, "positive": 20, "negative": 15, "parsers": ("parser1",)}


def _coverage_sql(name, policy):
    absent = lambda column, wanted: "concat_ws(',', " + ", ".join(f"CASE WHEN NOT list_contains({column}, '{x}') THEN '{x}' END" for x in sorted(wanted)) + ")"
    parsers = ", ".join(f"'{x}'" for x in policy["parsers"])
    return f"""SELECT '{name}' AS policy, *, CASE WHEN confirmed_matches < {policy['matches']} OR distinct_maps < {policy['maps']} OR missing_sources <> '' OR missing_edges <> '' OR determinate < {policy['determinate']}
    OR positive < {policy['positive']} OR negative < {policy['negative']} OR parser_gaps > 0 THEN 'blocked' ELSE 'ready' END AS status FROM (
  SELECT b.target_id, confirmed_matches, distinct_maps, coalesce(l.determinate, 0) AS determinate, coalesce(l.positive, 0) AS positive, coalesce(l.negative, 0) AS negative, coalesce(g.n, 0) AS parser_gaps,
    {absent('ss', policy['sources'])} AS missing_sources, {absent('es', policy['edges'])} AS missing_edges
  FROM (SELECT target_id, count(*) AS confirmed_matches, count(DISTINCT map_name) AS distinct_maps, list(DISTINCT source) AS ss, list(DISTINCT edge_case) AS es FROM corpus_cases WHERE review_status = 'confirmed' GROUP BY 1) b
  LEFT JOIN (SELECT target_id, count(*) FILTER (value <> 'indeterminate') AS determinate, count(*) FILTER (value = 'present') AS positive, count(*) FILTER (value = 'absent') AS negative FROM corpus_labels GROUP BY 1) l USING (target_id)
  LEFT JOIN (SELECT c.target_id, count(DISTINCT c.case_id) AS n FROM corpus_cases c CROSS JOIN (SELECT unnest([{parsers}]) AS parser) q WHERE review_status = 'confirmed'
    AND NOT EXISTS (SELECT 1 FROM parser_support s WHERE s.case_id = c.case_id AND s.parser = q.parser AND s.supported) GROUP BY 1) g USING (target_id))"""


@query("n11_corpus_coverage", " UNION ALL ".join(_coverage_sql(n, p) for n, p in (("strict", POLICY), ("easy", EASY_POLICY))))
def _(t):
    q = union_all(*[N.corpus_coverage(t.corpus_cases, t.corpus_labels, t.parser_support, p).withColumn("policy", F.lit(n)) for n, p in (("strict", POLICY), ("easy", EASY_POLICY))])
    return q.withColumn("missing_sources", text(F.col("missing_sources"))).withColumn("missing_edges", text(F.col("missing_edges")))


ORACLES["n08_reliability_rank"] = with_clause("""SELECT pattern_id, profile_id, decision, round(sc, 9) AS reliability_score, CASE WHEN sc IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY profile_id, sc IS NULL ORDER BY sc DESC, denominator_match_count DESC, pattern_id) AS INT) END AS reliability_rank FROM (
  SELECT *, CASE WHEN decision = 'supported' THEN least(1.0, greatest(0.0, low - 0.5) * 0.5 + greatest(0.0, effect_size) * 0.3 + direction * 0.2) END AS sc FROM tdc)""")
