"""Storage, library and function queries and oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import percentage, ratio, text, union_all
from ..operators import lineage as S
from ..plans import library as Q

from ..sources import store as A
from ..sources.bridge import DOUBLES, TABLE_COLUMNS
from ..sources.layer import Layer

from .registry import cte, query
from .space import spatial
from .stats import stats


def families(t):
    return {"kill": t.kills, "damage": t.damages, "shot": t.shots, "grenade": t.grenades, "blind": t.blinds, "bomb": t.bombs}


_FAM = {"kill": "kills", "damage": "damages", "shot": "shots", "grenade": "grenades", "blind": "blinds", "bomb": "bombs"}


@query("a02_round_events", " UNION ALL ".join(f"SELECT match_id, round_number, tick, event_id, '{f}' AS family, phase FROM {s}" for f, s in _FAM.items()))
def _(t):
    return A.round_events(families(t))


@query("a03_save_run", """SELECT match_id, round_id, winner_side, CAST(official_end_tick + CASE WHEN match_no % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS official_end_tick,
  CAST((SELECT count(*) FROM kills k WHERE k.round_id = r.round_id) AS BIGINT) AS kills, CASE WHEN match_no % 2 = 0 THEN 'second' ELSE 'first' END AS run FROM rounds r JOIN matches USING (match_id)
  WHERE NOT (match_no % 7 = 5)""")
def _(t):
    """A derived table is brought up to date after the rounds of some matches changed and other matches went."""
    layer = Layer(t.spark, A.shared_folder(t.spark, "run"))

    def derive(run):
        return lambda tables: (tables["rounds"].join(tables["kills"].groupBy("round_id").agg(F.count("*").alias("kills")), "round_id", "left").fillna(0, ["kills"])
                               .select("match_id", "round_id", "winner_side", F.col("official_end_tick").cast("long").alias("official_end_tick"), "kills", F.lit(run).alias("run")))

    rounds, kills = t.rounds, t.kills
    layer.refresh("round_facts", {"rounds": rounds, "kills": kills}, derive("first"))
    left = t.matches.where("match_no % 7 <> 5").select("match_id", "match_no")
    moved = rounds.join(left, "match_id").withColumn("official_end_tick", F.col("official_end_tick") + F.when(F.col("match_no") % 2 == 0, 1).otherwise(0)).select(*rounds.columns)
    layer.refresh("round_facts", {"rounds": moved, "kills": kills.join(left, "match_id", "left_semi")}, derive("second"))
    return layer.read("round_facts")


#: Tables of a delete, with the SQL of what is left of each.
_GONE_MATCH, _GONE_RUN = "SELECT match_id FROM matches WHERE match_no % 3 = 1", "SELECT run_id FROM run_inputs WHERE match_id IN (SELECT match_id FROM matches WHERE match_no % 3 = 1)"
_KEPT = {n: f"SELECT * FROM {n} WHERE match_id NOT IN ({_GONE_MATCH})" for n in ("matches", "rounds", "players", "memberships", *_FAM.values())}
_KEPT |= {n: f"SELECT * FROM {n} WHERE run_id NOT IN ({_GONE_RUN})" for n in ("run_inputs", "pattern_runs")}


def _content_sql(name, rows, key):
    """Row count and 128-bit content sum of a relation, as the engine's fingerprint has them."""
    cells = []
    for c in sorted(TABLE_COLUMNS[name]):
        v = f"CAST({c} AS VARCHAR)" if c not in DOUBLES else f"CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR) || '+' || CAST(CAST(floor(({c} - floor({c})) * 4611686018427387904) AS BIGINT) AS VARCHAR)"
        cells.append(f"coalesce('{c}=' || length({v}) || ':' || ({v}), '{c}!')")
    half = lambda at: f"format('{{:016x}}', CAST(sum(CAST('0x' || substr(h, {at}, 16) AS UBIGINT)) % 18446744073709551616 AS UBIGINT))"
    group = f"{key}, " if key else ""
    return f"SELECT {group}'{name}' AS table_name, count(*) || ':' || {half(1)} || {half(17)} AS fingerprint FROM (SELECT {group}md5({" || ',' || ".join(cells)}) AS h FROM ({rows})) {f'GROUP BY {key}' if key else 'HAVING count(*) > 0'}"


@query("a05_delete_matches", " UNION ALL ".join(_content_sql(n, sql, "") for n, sql in _KEPT.items()))
def _(t):
    """Content of every table after some matches were deleted, with all that was derived from them."""
    layer = Layer(t.spark, A.shared_folder(t.spark, "delete"))
    for n in _KEPT:
        layer.write(n, getattr(t, n), "run_id" if n in ("run_inputs", "pattern_runs") else "match_id")
        if n not in ("matches", "pattern_runs"):
            layer.derived("matches", n)
    layer.derived("run_inputs", "pattern_runs", "run_id")  # a run that used a match goes with all its inputs
    layer.derived("pattern_runs", "run_inputs", "run_id")
    layer.delete("matches", t.matches.where("match_no % 3 = 1"))
    sums = union_all(*[S.content_sums(layer.read(n).withColumn("_all", F.lit(0)), n, "_all", layer.read(n).columns) for n in _KEPT])
    return S.merged_sums((1, sums), key="_all").select("table_name", S.fingerprint_text().alias("fingerprint"))


@query("a06_row_counts", "SELECT match_id, table_name, count(*) AS row_count FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS table_name, match_id FROM {s}" for f, s in _FAM.items()) + ") GROUP BY 1, 2")
def _(t):
    return A.row_counts(families(t))


# -- library -----------------------------------------------------------------
def teams_named(t):
    return t.matches.select("match_id", F.explode(F.array("team_a", "team_b")).alias("team_name"))


@query("f05_match_library", "SELECT match_id, map_name, match_no FROM matches m WHERE map_name LIKE '%a%' ORDER BY match_no DESC LIMIT 24")
def _(t):
    return Q.library(t.matches, teams_named(t), search="A").select("match_id", "map_name", "match_no")


@query("f05_library_count", "SELECT count(*) FILTER (map_name LIKE '%et%' OR team_a LIKE '%et%' OR team_b LIKE '%et%') AS total FROM matches")
def _(t):
    return Q.library_count(t.matches, teams_named(t), search="ET")


cte("psc", "SELECT match_id, team_id, arg_max(score, round_number) AS score FROM (SELECT match_id, round_number, t_team_id AS team_id, score_t_after AS score FROM rounds UNION ALL SELECT match_id, round_number, ct_team_id, score_ct_after FROM rounds) WHERE score IS NOT NULL GROUP BY 1, 2")


@query("f06_match_overview", """SELECT r.match_id, r.rounds, r.complete_rounds, b.plants, b.defuses, coalesce(o.n, 0) AS opening_duels, coalesce(t.n, 0) AS trades, p.players, p.kills, p.best_adr, s.score FROM (SELECT match_id, count(*) AS rounds, count(*) FILTER (is_complete) AS complete_rounds FROM rounds GROUP BY 1) r
  LEFT JOIN (SELECT match_id, count(*) FILTER (event_type = 'planted') AS plants, count(*) FILTER (event_type = 'defused') AS defuses FROM bombs GROUP BY 1) b USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM opn GROUP BY 1) o USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM trd GROUP BY 1) t USING (match_id)
  LEFT JOIN (SELECT match_id, count(*) AS players, CAST(sum(kills) AS BIGINT) AS kills, max(adr) AS best_adr FROM pm GROUP BY 1) p USING (match_id) LEFT JOIN (SELECT match_id, CASE WHEN count(*) = 2 THEN string_agg(CAST(score AS VARCHAR), ':' ORDER BY team_id) ELSE '-' END AS score FROM psc GROUP BY 1) s USING (match_id)""")
def _(t):
    s = stats(t)
    return Q.overview(t.rounds, t.bombs, s.openings, s.trades, s.player_matches)


@query("f07_player_events", " UNION ALL ".join(f"SELECT match_id, round_number, tick, event_id, 'kill' AS kind, '{r}' AS role, {r}_player_id AS player_id FROM kills WHERE {r}_player_id IS NOT NULL" for r in ("attacker", "victim", "assister")) + " UNION ALL SELECT match_id, round_number, tick, event_id, 'grenade', 'thrower', player_id FROM grenades")
def _(t):
    return Q.player_events(t.kills, t.grenades)


@query("f08_team_scores", "SELECT * FROM psc")
def _(t):
    return Q.team_scores(t.rounds)


@query("f09_layer_readiness", """SELECT match_id, missing_layers, CASE WHEN match_no % 5 = 4 THEN 'blocked' WHEN missing_layers <> '' OR spatial THEN 'limited' ELSE 'ready' END AS readiness FROM (SELECT m.match_id, m.match_no, concat_ws(',', CASE WHEN m.match_no % 4 = 3 THEN 'analytics' END, CASE WHEN p.s = 0 THEN 'spatial' END) AS missing_layers, p.s > 0 AND p.s < p.n AS spatial
  FROM matches m JOIN (SELECT match_id, count(*) AS n, count(*) FILTER (position_status = 'available') AS s FROM snp GROUP BY 1) p USING (match_id))""")
def _(t):
    m = t.matches
    layers = {"canonical": m.select("match_id", F.when(F.col("match_no") % 5 == 4, "partial").otherwise("available").alias("status")),
              "analytics": m.where("match_no % 4 <> 3").select("match_id", F.lit("available").alias("status")), "spatial": spatial(t).capability().where("metric = 'positions'").select("match_id", "status")}
    q = Q.layer_readiness(m, layers)
    return q.select("match_id", text(F.col("missing_layers")).alias("missing_layers"), "readiness")


# -- functions ---------------------------------------------------------------
@query("s01_stable_ids", "SELECT match_id, round_id, sha256(match_id || ':round:' || round_number) AS stable_id FROM rounds")
def _(t):
    return t.rounds.select("match_id", "round_id", S.stable_id("match_id", F.lit("round"), F.col("round_number")).alias("stable_id"))


FINGERPRINTED = ("matches", "rounds", "players", "memberships", *_FAM.values(), "effects")


def fingerprinted(t):
    return {n: getattr(t, n) for n in FINGERPRINTED}


#: The ten canonical tables.
TEN = ("matches", "rounds", "players", "memberships", *_FAM.values())


@query("a01_canonical_load", " UNION ALL ".join(_content_sql(n, f"SELECT * FROM {n}", "match_id") for n in TEN))
def _(t):
    """Every table of the documents, by the content of each match."""
    path = A.shared_folder(t.spark, "canonical")
    whole = {n: getattr(t, n) for n in TEN}
    A.write_canonical(whole, f"{path}/version=1")
    A.write_canonical({"matches": t.matches}, f"{path}/version=2", 2)  # must be left out
    loaded = A.load_canonical(t.spark, path, {n: df.schema for n, df in whole.items()})
    sums = union_all(*[S.content_sums(df, n) for n, df in loaded.items()])
    return sums.select("match_id", "table_name", S.fingerprint_text().alias("fingerprint"))


@query("s02_dataset_fingerprint", " UNION ALL ".join(_content_sql(n, f"SELECT * FROM {n}", "match_id") for n in FINGERPRINTED))
def _(t):
    sums = union_all(*[S.content_sums(df, n) for n, df in fingerprinted(t).items()])
    return sums.select("match_id", "table_name", S.fingerprint_text().alias("fingerprint"))


@query("s03_text_functions", "SELECT s_suppkey, lower(trim(s_name)) AS folded, regexp_replace(s_name, '[#0]+', ' ', 'g') AS spaced, regexp_replace(s_name, '^Supplier', '') AS bare, contains(lower(s_name), '7') AS has_seven, regexp_extract(s_name, '([0-9]+)$', 1) AS tag FROM supplier")
def _(t):
    s = t.read("supplier")
    n = F.col("s_name")
    return s.select("s_suppkey", F.lower(F.trim(n)).alias("folded"), F.regexp_replace(n, "[#0]+", " ").alias("spaced"), F.regexp_replace(n, "^Supplier", "").alias("bare"), F.lower(n).contains("7").alias("has_seven"), F.regexp_extract(n, "([0-9]+)$", 1).alias("tag"))


@query("s04_math_functions", "SELECT event_id, j, round(sqrt(x * x + y * y), 6) AS distance, CAST(floor(x / 512) AS BIGINT) AS cell, round(cos(radians(yaw)), 6) AS heading_x, round(sin(radians(yaw)), 6) AS heading_y FROM samples")
def _(t):
    a = F.radians("yaw")
    return t.samples.select("event_id", "j", F.round(F.hypot("x", "y"), 6).alias("distance"), F.floor(F.col("x") / 512).alias("cell"), F.round(F.cos(a), 6).alias("heading_x"), F.round(F.sin(a), 6).alias("heading_y"))


@query("s05_safe_ratio", "SELECT l_orderkey, sum_q, late, CASE WHEN late > 0 THEN sum_q / late END AS ratio, CASE WHEN n > 0 THEN late * 100.0 / n END AS percentage FROM (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS sum_q, count(*) FILTER (l_returnflag = 'R') AS late, count(*) AS n FROM lineitem GROUP BY 1)")
def _(t):
    g = t.read("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("sum_q"), F.count_if(F.col("l_returnflag") == "R").alias("late"), F.count("*").alias("n"))
    return g.select("l_orderkey", "sum_q", "late", ratio(F.col("sum_q"), F.col("late")).alias("ratio"), percentage(F.col("late"), F.col("n")).alias("percentage"))


@query("s06_array_functions", "SELECT match_id, round_id, list_aggregate(list_sort(list_distinct(ws)), 'string_agg', ',') AS weapons, list_contains(ws, 'awp') AS has_awp, len(list_intersect(list_distinct(ws), ['awp', 'ak47'])) AS shared FROM (SELECT match_id, round_id, list(weapon) AS ws FROM kills GROUP BY 1, 2)")
def _(t):
    g = t.kills.groupBy("match_id", "round_id").agg(F.collect_set("weapon").alias("ws"))
    return g.select("match_id", "round_id", F.array_join(F.sort_array(F.array_distinct("ws")), ",").alias("weapons"), F.array_contains("ws", "awp").alias("has_awp"), F.size(F.array_intersect("ws", F.array(F.lit("awp"), F.lit("ak47")))).cast("bigint").alias("shared"))


@query("s07_map_counters", "SELECT match_id, string_agg(weapon || '=' || n, ',' ORDER BY weapon) AS counters FROM (SELECT match_id, weapon, count(*) AS n FROM kills GROUP BY 1, 2) GROUP BY 1")
def _(t):
    g = t.kills.groupBy("match_id", "weapon").agg(F.count("*").alias("n")).groupBy("match_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("weapon", "n")))).alias("m"))
    return g.select("match_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counters"))


@query("s08_source_pins", "SELECT match_id, match_no FROM matches WHERE match_no % 3 <> 0")
def _(t):
    fp = t.layer("fingerprints", lambda: t.stored(S.dataset_fingerprint(fingerprinted(t)), "fingerprints"))
    runs = t.matches.join(fp, "match_id").select("match_id", "match_no", F.when(F.col("match_no") % 3 == 0, F.lit("stale")).otherwise(F.col("fingerprint")).alias("source_fingerprint"))
    return S.fresh_runs(runs, fp).select("match_id", "match_no")
