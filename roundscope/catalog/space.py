"""Spatial, zone and economy queries and oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import shared, text
from ..operators import economy as K
from ..operators import spatial as I
from ..operators import zones as J
from .registry import cte, query
from .stats import stats
from .timeline import state_sql, tl


def wanted(t):
    return I.sampling_targets(t.rounds.where("NOT is_warmup"), t.ev.select("match_id", "round_id", "tick"))


def spatial(t) -> I.Spatial:
    def build():
        s = I.Spatial(t, tl(t), wanted(t))
        s.snapshots = shared(s.snapshots)
        return s

    return t.layer("spatial", build)


def polygons(t):
    """Vertices of the literal zone grid: squares, and one triangle (cell 16)."""
    def pt(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    square = F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1"))
    return t.zone_boxes.select("map_name", "zone_id", "priority", "verification", "min_z", "max_z",
                               F.when(F.col("cell") == 16, F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x0", "y1"))).otherwise(square).alias("vertices"))


cte("tgt", """SELECT DISTINCT match_id, round_id, round_number, tick FROM (
  SELECT match_id, round_id, round_number, unnest(list_concat(generate_series(freeze_end_tick, hi, 16), [freeze_end_tick, hi]))::INT AS tick FROM (SELECT *, least(official_end_tick, coalesce(lead(start_tick) OVER (PARTITION BY match_id ORDER BY start_tick) - 1, official_end_tick)) AS hi FROM rounds WHERE NOT is_warmup)
  UNION ALL SELECT e.match_id, e.round_id, e.rn, e.tick FROM ev e JOIN rounds r USING (round_id) WHERE NOT r.is_warmup AND e.tick >= r.freeze_end_tick AND e.tick <= r.official_end_tick)""")
cte("smp", """SELECT g.match_id, g.round_id, g.round_number, s.tick, p.player_id, s.x, s.y, s.z, s.pitch, s.yaw, s.source_alive, s.source_team_number, s.carried_item_id, s.utility_a, s.utility_b, count(*) OVER (PARTITION BY g.round_id, s.tick, p.player_id) AS copies
  FROM samples s JOIN tgt g ON g.match_id = s.match_id AND g.tick = s.tick JOIN players p ON p.match_id = s.match_id AND p.steam_id = s.steam_id
  QUALIFY row_number() OVER (PARTITION BY g.round_id, s.tick, p.player_id ORDER BY s.event_id, s.j) = 1""")
cte("und", "SELECT round_id, min(tick) AS undecided FROM grp WHERE final_status <> 'deterministic' GROUP BY 1")
_UT = "CASE {0} WHEN 'hegrenade' THEN 'he_grenade' WHEN 'molotov' THEN 'molotov' WHEN 'flashbang' THEN 'flashbang' WHEN 'smokegrenade' THEN 'smoke' END"
cte("snp", f"""SELECT match_id, round_id, round_number, tick, player_id, copies, team_id, side, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN z END AS z, pitch, yaw, alive,
  CASE WHEN NOT ok THEN 'unavailable' WHEN alive = FALSE THEN 'unreliable' ELSE 'available' END AS position_status, CASE WHEN alive = FALSE THEN 'unreliable' ELSE 'available' END AS angle_status, carried_item_id = 49 AS has_bomb,
  concat_ws(',', {_UT.format('utility_a')}, {_UT.format('utility_b')}) AS utility, coalesce(source_alive <> alive, FALSE) AS alive_mismatch, coalesce(source_team_number <> CASE side WHEN 'T' THEN 2 WHEN 'CT' THEN 3 END, FALSE) AS team_mismatch FROM (
  SELECT s.*, p.team_id, coalesce(p.side, 'UNKNOWN') AS side, s.x IS NOT NULL AND s.y IS NOT NULL AND s.z IS NOT NULL AS ok,
    CASE WHEN coalesce(u.undecided <= s.tick, FALSE) OR p.player_id IS NULL THEN NULL WHEN f.tick <= s.tick THEN FALSE WHEN p.initial_life = 'alive' THEN TRUE END AS alive
  FROM smp s LEFT JOIN ps p ON p.round_id = s.round_id AND p.player_id = s.player_id AND p.participation_status <> 'not_participating' LEFT JOIN tfd f ON f.round_id = s.round_id AND f.victim_player_id = s.player_id LEFT JOIN und u ON u.round_id = s.round_id)""")
RTP = ["match_id", "round_id", "round_number", "tick", "player_id"]


@query("i01_sampling_targets", "SELECT * FROM tgt")
def _(t):
    return wanted(t)


def _snap(name, cols):
    @query(name, f"SELECT {', '.join(RTP + cols)} FROM snp")
    def _(t):
        s = spatial(t).snapshots.withColumn("utility", text(F.col("utility")))
        return s.select(*RTP, *cols)


_snap("i02_snapshots", ["copies", "team_id", "side", "team_mismatch"])
_snap("i03_alive_link", ["alive", "alive_mismatch"])
_snap("i04_valid_positions", ["x", "y", "z", "pitch", "yaw", "position_status", "angle_status"])
_snap("i05_inventory_flags", ["has_bomb", "utility"])
cte("car", "SELECT match_id, round_id, round_number, tick, player_id, x, y, z FROM snp WHERE has_bomb AND alive AND x IS NOT NULL")


@query("i06_bomb_carriers", "SELECT * FROM car")
def _(t):
    return spatial(t).carriers


@query("i07_source_order", "SELECT match_id, steam_id, event_id, j, p AS previous_tick, tick FROM (SELECT *, lag(tick) OVER (PARTITION BY match_id, steam_id ORDER BY event_id, j) AS p FROM samples) WHERE tick < p")
def _(t):
    return I.Spatial(t, None, None).order_issues()


@query("i08_spatial_coverage", """SELECT match_id, m.metric, m.population, m.covered, m.status FROM (SELECT g.match_id, g.ticks, coalesce(s.n, 0) AS n, coalesce(s.pos, 0) AS pos, coalesce(s.ang, 0) AS ang, coalesce(c.b, 0) AS b FROM (SELECT match_id, count(DISTINCT tick) AS ticks FROM tgt GROUP BY 1) g
  LEFT JOIN (SELECT match_id, count(*) AS n, count(*) FILTER (position_status = 'available') AS pos, count(*) FILTER (angle_status = 'available') AS ang FROM snp GROUP BY 1) s USING (match_id) LEFT JOIN (SELECT match_id, count(DISTINCT tick) AS b FROM car GROUP BY 1) c USING (match_id)),
  LATERAL (SELECT 'positions' AS metric, n AS population, pos AS covered, CASE WHEN n = 0 OR pos = 0 THEN 'unavailable' WHEN pos = n THEN 'available' ELSE 'partial' END AS status UNION ALL SELECT 'view_angles', n, ang, CASE WHEN n = 0 OR ang = 0 THEN 'unavailable' WHEN ang = n THEN 'available' ELSE 'partial' END
   UNION ALL SELECT 'bomb_positions', ticks, b, CASE WHEN b > 0 THEN 'partial' ELSE 'unavailable' END UNION ALL SELECT 'sampling_frequency', ticks, ticks, 'available') m""")
def _(t):
    return spatial(t).capability()


cte("smap", "SELECT s.match_id, s.event_id, s.j, m.map_name, s.x, s.y, s.z FROM samples s JOIN matches m USING (match_id)")


def sample_points(t):
    return t.samples.select("match_id", "event_id", "j", "x", "y", "z").join(t.matches.select("match_id", "map_name"), "match_id")


@query("i09_map_projection", """SELECT match_id, event_id, j, map_name, x, y, z, CASE WHEN ok THEN px END AS pixel_x, CASE WHEN ok THEN py END AS pixel_y, CASE WHEN ok THEN nx END AS normalized_x, CASE WHEN ok THEN ny END AS normalized_y,
  CASE WHEN ok THEN lv END AS level, CASE WHEN ok THEN NOT (nx BETWEEN 0 AND 1 AND ny BETWEEN 0 AND 1) END AS out_of_bounds, CASE WHEN ok THEN origin_x + px * scale END AS world_x, CASE WHEN ok THEN origin_y - py * scale END AS world_y,
  CASE WHEN NOT ok THEN 'unavailable' WHEN NOT (nx BETWEEN 0 AND 1 AND ny BETWEEN 0 AND 1) OR (two_levels AND lv = 'unknown') THEN 'partial' ELSE 'available' END AS availability FROM (
  SELECT *, px / image_width AS nx, py / image_height AS ny, origin_x IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AS ok, CASE WHEN NOT two_levels THEN 'default' WHEN z IS NULL OR (z = upper_min_z AND z = lower_max_z) THEN 'unknown' WHEN z > upper_min_z THEN 'upper' WHEN z < lower_max_z THEN 'lower' ELSE 'unknown' END AS lv
  FROM (SELECT s.*, d.* EXCLUDE (map_name), (x - origin_x) / scale AS px, (origin_y - y) / scale AS py FROM smap s JOIN map_defs d USING (map_name)))""")
def _(t):
    return I.project(sample_points(t), t.map_defs)


@query("i10_map_revision", """SELECT match_id, map_name, CASE WHEN n > 0 THEN CASE WHEN manual_revision IS NOT NULL THEN CASE WHEN mok THEN manual_revision END WHEN NOT bad THEN coalesce(ph, ch, single) END END AS revision_id,
  CASE WHEN n = 0 THEN 'unsupported' WHEN manual_revision IS NOT NULL THEN CASE WHEN mok THEN 'proven' ELSE 'unsupported' END WHEN bad THEN 'unsupported' WHEN coalesce(ph, ch) IS NOT NULL THEN 'proven' WHEN single IS NOT NULL THEN 'unproven' ELSE 'unsupported' END AS status FROM (
  SELECT *, pn > 1 OR cn > 1 OR coalesce(ph <> ch, FALSE) AS bad FROM (SELECT e.match_id, e.map_name, any_value(e.manual_revision) AS manual_revision, count(r.revision_id) AS n, coalesce(bool_or(r.revision_id = e.manual_revision), FALSE) AS mok,
    count(*) FILTER (r.patch_version = e.patch_version) AS pn, count(*) FILTER (r.map_crc = e.map_crc) AS cn, CASE WHEN count(*) FILTER (r.patch_version = e.patch_version) = 1 THEN max(r.revision_id) FILTER (r.patch_version = e.patch_version) END AS ph,
    CASE WHEN count(*) FILTER (r.map_crc = e.map_crc) = 1 THEN max(r.revision_id) FILTER (r.map_crc = e.map_crc) END AS ch, CASE WHEN count(r.revision_id) = 1 THEN max(r.revision_id) WHEN count(*) FILTER (r.is_current) = 1 THEN max(r.revision_id) FILTER (r.is_current) END AS single
    FROM map_evidence e LEFT JOIN map_revisions r USING (map_name) GROUP BY 1, 2))""")
def _(t):
    return I.choose_revision(t.map_evidence, t.map_revisions)


cte("stk", "SELECT match_id, round_id, round_number, tick, count(*) AS players, CAST(row_number() OVER w AS INT) AS position, lag(tick) OVER w AS previous_tick, lead(tick) OVER w AS next_tick FROM snp GROUP BY 1, 2, 3, 4 WINDOW w AS (PARTITION BY round_id ORDER BY tick)")


@query("i11_tick_navigation", "SELECT * FROM stk")
def _(t):
    return spatial(t).ticks


@query("i12_filtered_samples", "SELECT match_id, round_id, round_number, tick, player_id, team_id FROM snp WHERE side = 'T' AND alive AND has_bomb")
def _(t):
    return spatial(t).snapshots.where("side = 'T' AND alive AND has_bomb").select(*RTP, "team_id")


@query("i13_player_paths", "SELECT match_id, round_id, round_number, tick, player_id, x, y, z FROM snp WHERE position_status = 'available' ORDER BY match_id, round_number, player_id, tick")
def _(t):
    return spatial(t).snapshots.where("position_status = 'available'").select(*RTP, "x", "y", "z").orderBy("match_id", "round_number", "player_id", "tick")


@query("i14_nearest_players", """SELECT a.match_id, a.round_id, a.round_number, a.tick, a.player_id, CAST(row_number() OVER (PARTITION BY a.round_id, a.tick, a.player_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.player_id) AS INT) AS rank,
  b.player_id AS other_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance, a.team_id = b.team_id AS same_team FROM snp a JOIN snp b ON a.round_id = b.round_id AND a.tick = b.tick AND a.player_id <> b.player_id WHERE a.x IS NOT NULL AND b.x IS NOT NULL QUALIFY rank <= 9""")
def _(t):
    return spatial(t).nearest(9)


cte("slc", "SELECT match_id, round_id, round_number, CAST((position - 1) // 64 AS BIGINT) AS slice, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS tick_count, CAST(sum(players) AS BIGINT) AS player_rows FROM stk GROUP BY 1, 2, 3, 4")


@query("i15_playback_slices", "SELECT * FROM slc")
def _(t):
    return spatial(t).slices(64)


@query("i16_active_effects", "SELECT s.match_id, s.round_id, s.slice, e.effect_id, e.effect_type FROM slc s JOIN effects e ON e.round_id = s.round_id AND e.start_tick <= s.last_tick AND (e.end_tick IS NULL OR e.end_tick >= s.first_tick)")
def _(t):
    return I.effects_in_ranges(spatial(t).slices(64), t.effects)


@query("i17_throw_tick", """SELECT q.match_id, q.round_id, q.event_id, q.tick, arg_min(s.tick, (abs(s.tick - q.tick), s.tick)) AS sample_tick, q.tick - arg_min(s.tick, (abs(s.tick - q.tick), s.tick)) AS "offset"
  FROM (SELECT match_id, round_id, event_id, tick + CAST(event_id % 30 AS INT) AS tick FROM grenades) q JOIN stk s ON s.round_id = q.round_id AND abs(s.tick - q.tick) <= 16 GROUP BY 1, 2, 3, 4""")
def _(t):
    q = t.grenades.select("match_id", "round_id", "event_id", (F.col("tick") + (F.col("event_id") % 30).cast("int")).alias("tick"))
    return I.nearest_tick(q, spatial(t).ticks)


cte("mrk", """SELECT m.match_id, m.round_id, m.tick, m.player_id, m.kind, m.event_id, s.x, s.y, s.z FROM (SELECT match_id, round_id, tick, 'death' AS kind, event_id, victim_player_id AS player_id FROM kills UNION ALL SELECT match_id, round_id, tick, 'damage', event_id, victim_player_id FROM damages
  UNION ALL SELECT match_id, round_id, tick, 'shot', event_id, player_id FROM shots UNION ALL SELECT match_id, round_id, tick, 'bomb', event_id, player_id FROM bombs UNION ALL SELECT match_id, round_id, tick, 'opening', event_id, victim_player_id FROM opn
  UNION ALL SELECT t.match_id, t.round_id, k.tick, 'trade', t.trade_event_id, t.traded_enemy_id FROM trd t JOIN kills k ON k.event_id = t.trade_event_id) m LEFT JOIN snp s ON s.round_id = m.round_id AND s.tick = m.tick AND s.player_id = m.player_id AND s.x IS NOT NULL
  UNION ALL SELECT match_id, round_id, tick, player_id, 'grenade', event_id, x, y, z FROM grenades""")


def event_markers(t):
    s = stats(t)
    return spatial(t).markers(t.kills, t.damages, t.shots, t.bombs, t.grenades, s.openings, s.trades)


cte("slt", "SELECT match_id, round_id, round_number, tick, CAST((position - 1) // 64 AS BIGINT) AS slice FROM stk")
cte("sls", state_sql("(SELECT match_id, round_id, round_number, slice, first_tick AS tick FROM slc)", "match_id, round_id, round_number, slice, tick"))


@query("i15_playback_content", """SELECT match_id, round_id, slice, 'state' AS kind, CAST(tick AS BIGINT) AS tick, CAST(NULL AS VARCHAR) AS subject, t_alive || '/' || ct_alive || '/' || bomb_state || '/' || phase AS value, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS z FROM sls
  UNION ALL SELECT s.match_id, s.round_id, l.slice, 'player', s.tick, s.player_id, s.side || '/' || CASE WHEN alive THEN 'alive' WHEN NOT alive THEN 'dead' ELSE 'unknown' END || '/' || position_status || '/' || CASE WHEN has_bomb THEN 'bomb' ELSE '-' END, s.x, s.y, s.z FROM snp s JOIN slt l USING (round_id, tick)
  UNION ALL SELECT c.match_id, c.round_id, l.slice, 'bomb', c.tick, c.player_id, 'carried', c.x, c.y, c.z FROM car c JOIN slt l USING (round_id, tick)
  UNION ALL SELECT s.match_id, s.round_id, s.slice, 'effect', NULL, CAST(e.effect_id AS VARCHAR), e.effect_type, NULL, NULL, NULL FROM slc s JOIN effects e ON e.round_id = s.round_id AND e.start_tick <= s.last_tick AND (e.end_tick IS NULL OR e.end_tick >= s.first_tick)
  UNION ALL SELECT m.match_id, m.round_id, l.slice, 'event', m.tick, CAST(m.event_id AS VARCHAR), concat_ws('/', m.kind, m.player_id), m.x, m.y, m.z FROM mrk m JOIN slt l USING (round_id, tick)""")
def _(t):
    return spatial(t).playback(event_markers(t), t.effects)


@query("i18_event_markers", "SELECT * FROM mrk")
def _(t):
    return event_markers(t)


cte("seg", """SELECT *, sum(nw) OVER (PARTITION BY match_id, entity_id ORDER BY tick, projectile_type, steam_id NULLS FIRST, bounce, x) AS track_no FROM (SELECT *, CASE WHEN lag(tick) OVER w IS NULL OR lag(projectile_type) OVER w <> projectile_type OR lag(steam_id) OVER w IS DISTINCT FROM steam_id
  OR tick - lag(tick) OVER w <> 1 OR coalesce(bounce < lag(bounce) OVER w, FALSE) THEN 1 ELSE 0 END AS nw FROM projectile_points WINDOW w AS (PARTITION BY match_id, entity_id ORDER BY tick, projectile_type, steam_id NULLS FIRST, bounce, x))""")
cte("trk", """SELECT match_id || ':' || entity_id || ':' || track_no AS track_id, match_id, entity_id, CAST(track_no AS BIGINT) AS track_no, projectile_type, steam_id, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS points, arg_max(x, (tick, bounce, x)) AS last_x, arg_max(y, (tick, bounce, x)) AS last_y FROM seg GROUP BY 1, 2, 3, 4, 5, 6""")


@query("i19_projectile_tracks", "SELECT * FROM trk")
def _(t):
    return I.segment_tracks(t.projectile_points)


cte("thc", """SELECT k.match_id, k.track_id, k.entity_id, k.track_no, list(h.throw_id ORDER BY h.tick DESC, h.throw_id) AS c FROM trk k JOIN throws h ON h.match_id = k.match_id AND h.steam_id IS NOT DISTINCT FROM k.steam_id AND h.projectile_type = k.projectile_type AND k.first_tick - h.tick BETWEEN 0 AND 64 GROUP BY 1, 2, 3, 4""")
cte("ths", "SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY entity_id, track_no) AS n FROM thc")
cte("thr", """SELECT match_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS track_id, CAST(NULL AS BIGINT) AS rid, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT match_id FROM ths)
  UNION ALL SELECT s.match_id, s.n, s.track_id, list_filter(s.c, lambda x: NOT list_contains(r.used, x))[1], list_append(r.used, list_filter(s.c, lambda x: NOT list_contains(r.used, x))[1]) FROM thr r JOIN ths s ON s.match_id = r.match_id AND s.n = r.n + 1""")


@query("i20_throw_match", "SELECT r.match_id, r.track_id, r.rid AS throw_id, k.first_tick - h.tick AS \"offset\" FROM thr r JOIN trk k USING (match_id, track_id) JOIN throws h ON h.throw_id = r.rid WHERE r.rid IS NOT NULL")
def _(t):
    return I.match_throws(I.segment_tracks(t.projectile_points), t.throws)


cte("tec0", """SELECT k.match_id, k.track_id, k.entity_id, k.track_no, e.terminal_id, abs(e.tick - k.last_tick) AS dt, sqrt((e.x - k.last_x) * (e.x - k.last_x) + (e.y - k.last_y) * (e.y - k.last_y)) AS d, e.entity_id = k.entity_id AND e.tick BETWEEN k.first_tick AND k.last_tick + 4 AS direct,
  e.projectile_type = k.projectile_type AND (k.steam_id IS NULL OR e.steam_id IS NULL OR e.steam_id = k.steam_id) AND e.tick BETWEEN k.last_tick - 8 AND k.last_tick + 64 AND sqrt((e.x - k.last_x) * (e.x - k.last_x) + (e.y - k.last_y) * (e.y - k.last_y)) <= 512 AS near
  FROM trk k JOIN terminals e ON e.match_id = k.match_id AND e.tick BETWEEN k.first_tick - 10 AND k.last_tick + 64""")
cte("tec", "SELECT match_id, track_id, entity_id, track_no, list(terminal_id ORDER BY CASE WHEN direct THEN 0 ELSE 1 END, dt, CASE WHEN direct THEN 0 ELSE d END, terminal_id) AS c FROM tec0 WHERE direct OR near GROUP BY 1, 2, 3, 4")
cte("tes", "SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY entity_id, track_no) AS n FROM tec")
cte("ter", """SELECT match_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS track_id, CAST(NULL AS BIGINT) AS rid, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT match_id FROM tes)
  UNION ALL SELECT s.match_id, s.n, s.track_id, list_filter(s.c, lambda x: NOT list_contains(r.used, x))[1], list_append(r.used, list_filter(s.c, lambda x: NOT list_contains(r.used, x))[1]) FROM ter r JOIN tes s ON s.match_id = r.match_id AND s.n = r.n + 1""")


@query("i21_terminal_match", "SELECT match_id, track_id, rid AS terminal_id FROM ter WHERE rid IS NOT NULL")
def _(t):
    return I.match_terminals(I.segment_tracks(t.projectile_points), t.terminals)


cte("plc", """SELECT k.track_id, k.match_id, r.round_id, r.round_number, k.projectile_type, k.first_tick, p.player_id AS owner_player_id, p.team_id AS owner_team_id FROM trk k JOIN rounds r ON r.match_id = k.match_id AND k.first_tick BETWEEN r.freeze_end_tick AND r.official_end_tick
  LEFT JOIN players p ON p.match_id = k.match_id AND p.steam_id = k.steam_id QUALIFY row_number() OVER (PARTITION BY k.track_id ORDER BY r.round_number) = 1""")


def placed(t):
    return I.place_tracks(I.segment_tracks(t.projectile_points), t.rounds, t.players)


@query("i22_projectile_rounds", "SELECT * FROM plc")
def _(t):
    return placed(t)


@query("i23_effect_links", """SELECT e.effect_id, e.match_id, e.round_id, e.effect_type, e.owner_player_id, arg_max(p.track_id, (p.first_tick, p.track_id)) AS track_id, e.start_tick + 12 AS start_tick, e.end_tick, coalesce(e.end_tick < e.start_tick + 12, FALSE) AS inverted
  FROM effects e LEFT JOIN plc p ON p.round_id = e.round_id AND p.projectile_type = e.effect_type AND p.owner_player_id = e.owner_player_id AND e.start_tick + 12 - p.first_tick BETWEEN 0 AND 64 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY e.effect_id, e.match_id, e.round_id, e.effect_type, e.owner_player_id, e.start_tick, e.end_tick"))
def _(t):
    return I.link_effects(t.effects.withColumn("start_tick", F.col("start_tick") + 12), placed(t))


@query("i24_motion_class", """SELECT match_id, round_id, round_number, player_id, tick, tick_gap, planar AS planar_distance, planar / tick_gap AS speed, coalesce(planar = 0 AND dz = 0, FALSE) AS repeated,
  CASE WHEN pt IS NULL OR planar IS NULL OR (alive AND pa AND NOT (position_status = 'available' AND pp = 'available')) THEN 'unavailable' WHEN NOT coalesce(alive AND pa, FALSE) OR planar > 1024 OR dz > 512 OR lv <> plv OR tick_gap > 64 THEN 'discontinuity' WHEN tick_gap <= 16 THEN 'normal' ELSE 'large' END AS motion_class FROM (
  SELECT *, tick - pt AS tick_gap, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS planar, abs(z - pz) AS dz FROM (SELECT *, lag(tick) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(alive) OVER w AS pa, lag(position_status) OVER w AS pp, lag(lv) OVER w AS plv
    FROM (SELECT *, CASE WHEN z IS NULL THEN 'unknown' WHEN z > 128 THEN 'upper' WHEN z < 128 THEN 'lower' ELSE 'unknown' END AS lv FROM snp) WINDOW w AS (PARTITION BY round_id, player_id ORDER BY tick)))""")
def _(t):
    return spatial(t).motion()


# -- zones -------------------------------------------------------------------
_IN = "(CASE WHEN z.cell = 16 THEN s.x >= z.x0 AND s.y >= z.y0 AND (s.x - z.x0) * (z.y1 - z.y0) + (s.y - z.y0) * (z.x1 - z.x0) <= (z.x1 - z.x0) * (z.y1 - z.y0) ELSE s.x BETWEEN z.x0 AND z.x1 AND s.y BETWEEN z.y0 AND z.y1 END)"
cte("zhit", f"""SELECT s.match_id, s.event_id, s.j, s.map_name, s.x, s.y, s.z, zz.zone_id, zz.priority, zz.area FROM smap s LEFT JOIN (SELECT *, CASE WHEN cell = 16 THEN (x1 - x0) * (y1 - y0) / 2 ELSE (x1 - x0) * (y1 - y0) END AS area FROM zone_boxes WHERE verification <> 'proposed') zz
  ON zz.map_name = s.map_name AND {_IN.replace('z.', 'zz.')} AND (zz.min_z IS NULL OR (s.z >= zz.min_z AND s.z <= zz.max_z))""")
cte("zas", "SELECT match_id, event_id, j, map_name, x, y, z, zone_id FROM zhit QUALIFY row_number() OVER (PARTITION BY event_id, j ORDER BY priority DESC, area, zone_id) = 1")
cte("zst", "SELECT match_id, event_id, j, map_name, x, y, z, CASE WHEN x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL THEN zone_id END AS zone_id, CASE WHEN x IS NULL OR y IS NULL OR z IS NULL THEN 'unavailable' WHEN zone_id IS NULL THEN 'unknown' ELSE 'resolved' END AS zone_status, CASE WHEN x IS NULL OR y IS NULL OR z IS NULL THEN 'position_unavailable' END AS zone_reason FROM zas")


@query("j01_point_in_polygon", f"SELECT s.event_id, s.j, z.zone_id FROM smap s JOIN zone_boxes z ON z.map_name = s.map_name AND {_IN}")
def _(t):
    idx = J.cell_index(polygons(t).withColumn("verification", F.lit("verified")))
    q = sample_points(t).withColumn("gx", F.floor(F.col("x") / J.CELL)).withColumn("gy", F.floor(F.col("y") / J.CELL)).join(idx, ["map_name", "gx", "gy"])
    return q.select("event_id", "j", F.explode(F.expr(f"transform(filter(candidates, c -> {J.contains('c.edges')}), c -> c.zone_id)")).alias("zone_id"))


@query("j02_polygon_area", "SELECT map_name, zone_id, CASE WHEN cell = 16 THEN (x1 - x0) * (y1 - y0) / 2 ELSE (x1 - x0) * (y1 - y0) END AS area FROM zone_boxes")
def _(t):
    return J.with_edges(polygons(t)).select("map_name", "zone_id", "area")


@query("j03_zone_pick", "SELECT match_id, event_id, j, zone_id FROM zas")
def _(t):
    return J.assign_zones(sample_points(t), polygons(t)).select("match_id", "event_id", "j", "zone_id")


@query("j04_zone_assignment", "SELECT match_id, event_id, j, zone_id, zone_status, zone_reason FROM zst")
def _(t):
    return J.assignment_status(sample_points(t), polygons(t)).select("match_id", "event_id", "j", "zone_id", "zone_status", "zone_reason")


@query("j05_zone_coverage", """SELECT match_id, population, position_available, resolved, unknown, unavailable, CASE WHEN position_available > 0 THEN resolved / position_available END AS coverage, CASE WHEN unknown + unavailable > 0 THEN 'partial' ELSE 'available' END AS status FROM (
  SELECT match_id, count(*) AS population, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL) AS position_available, count(*) FILTER (zone_status = 'resolved') AS resolved, count(*) FILTER (zone_status = 'unknown') AS unknown, count(*) FILTER (zone_status = 'unavailable') AS unavailable FROM zst GROUP BY 1)""")
def _(t):
    return J.coverage(J.assignment_status(sample_points(t), polygons(t)))


@query("j06_polygon_checks", """SELECT map_name, zone_id, unnest(CASE WHEN cell % 3 = 0 THEN ['zero_area_polygon', 'self_intersection:0:2'] WHEN cell % 3 = 1 THEN ['repeated_vertex:0:1', 'zero_length_edge:0', 'self_intersection:1:4'] ELSE ['inverted_z_bounds'] END) AS code FROM zone_boxes WHERE cell < 16
  UNION ALL SELECT map_name, zone_id, 'duplicate_zone_id' FROM zone_boxes WHERE cell = 16 AND map_name <> 'beta'""")
def _(t):
    """Every zone: those with a number are damaged in three ways, the triangle is sound but stands twice on two maps."""
    p, z = polygons(t).withColumn("cell", F.regexp_extract("zone_id", "[0-9]+$", 0).try_cast("int")), F.col("vertices")
    bow = F.array(z[0], z[2], z[1], F.try_element_at(z, F.lit(4)))
    p = p.withColumn("vertices", F.when(F.col("cell") % 3 == 0, bow).when(F.col("cell") % 3 == 1, F.concat(F.array(z[0]), z)).otherwise(z))
    p = p.withColumn("min_z", F.when(F.col("cell") % 3 == 2, 10.0)).withColumn("max_z", F.when(F.col("cell") % 3 == 2, 5.0))
    return J.polygon_issues(p.unionByName(p.where("cell IS NULL AND map_name <> 'beta'")))


cte("gpt", "SELECT map_name, origin_x + image_width * scale * (c + 0.5::DOUBLE) / 64 AS x, origin_y - image_height * scale * (r + 0.5::DOUBLE) / 64 AS y FROM map_defs, LATERAL (SELECT unnest(generate_series(0, 63)) AS c), LATERAL (SELECT unnest(generate_series(0, 63)) AS r) WHERE origin_x IS NOT NULL")


@query("j07_grid_coverage", f"SELECT s.map_name, count(*) FILTER (EXISTS (SELECT 1 FROM zone_boxes z WHERE z.map_name = s.map_name AND z.verification <> 'proposed' AND z.min_z IS NULL AND {_IN})) / count(*) AS coverage FROM gpt s GROUP BY 1")
def _(t):
    return J.grid_coverage(polygons(t), t.map_defs)


AREAS = {"a_ramp": "a", "mid1": "mid", "mid2": "mid", "bombsite_a0": "a", "bombsite_b3": "b"}
_AREA = "CASE zone_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AREAS.items()) + " END"


@query("j08_zone_area_class", f"SELECT map_name, zone_id, {_AREA} AS area FROM zone_boxes")
def _(t):
    return t.zone_boxes.select("map_name", "zone_id", J.area_class(F.col("zone_id"), AREAS).alias("area"))


# -- economy -----------------------------------------------------------------
_KEYF = "trim(replace(replace(replace(lower({0}), 'weapon_', ''), 'item_', ''), '_', ''))"


def _isu(c):
    return f"{_KEYF.format(c)} IN ({', '.join(repr(u) for u in K.UTILITY_NAMES)})"


def _isw(c):
    return f"NOT ({_isu(c)}) AND {_KEYF.format(c)} NOT IN ({', '.join(repr(u) for u in K.NON_WEAPON_NAMES)})"


cte("kmem", """SELECT match_id, round_id, round_number, freeze_end_tick, team_id, side, player_id, member_side, is_warmup, is_complete FROM (SELECT r.*, s.team_id, s.side, m.player_id, m.side AS member_side, m.valid_from_tick FROM rounds r,
  LATERAL (SELECT r.t_team_id AS team_id, 'T' AS side UNION ALL SELECT r.ct_team_id, 'CT') s JOIN memberships m ON m.match_id = r.match_id AND m.team_id = s.team_id AND m.valid_from_tick <= r.freeze_end_tick AND (m.valid_to_tick IS NULL OR r.freeze_end_tick <= m.valid_to_tick))
  QUALIFY row_number() OVER (PARTITION BY round_id, team_id, player_id ORDER BY valid_from_tick DESC) = 1""")
cte("kpl", f"""SELECT m.match_id, m.round_id, m.round_number, m.freeze_end_tick, m.team_id, m.side, m.player_id, e.current_equip_value AS equipment_value, e.cash_spent, e.balance, e.has_helmet, e.has_defuser, e.team_num,
  CASE WHEN e.player_id IS NOT NULL THEN concat_ws(',', CASE WHEN {_isw('item_a')} THEN item_a END, CASE WHEN {_isw('item_b')} THEN item_b END) END AS weapons, CASE WHEN e.player_id IS NOT NULL THEN concat_ws(',', CASE WHEN {_isu('item_a')} THEN item_a END, CASE WHEN {_isu('item_b')} THEN item_b END) END AS utility,
  concat_ws(',', CASE WHEN is_warmup THEN 'warmup_round' END, CASE WHEN NOT is_complete THEN 'incomplete_round' END, CASE WHEN e.player_id IS NULL THEN 'freeze_end_player_sample_unavailable' END, CASE WHEN member_side <> m.side THEN 'canonical_membership_side_conflict' END,
    CASE WHEN e.team_num <> CASE WHEN m.side = 'T' THEN 2 ELSE 3 END THEN 'source_team_number_conflict' END) AS exclusion_reasons, FALSE AS duplicate_sample
  FROM kmem m LEFT JOIN economy_samples e ON e.match_id = m.match_id AND e.tick = m.freeze_end_tick AND e.player_id = m.player_id""")


@query("k01_freeze_samples", "SELECT match_id, tick AS freeze_end_tick, player_id, count(*) AS copies, CASE WHEN count(*) = 1 THEN any_value(current_equip_value) END AS equip FROM economy_samples GROUP BY 1, 2, 3")
def _(t):
    return K.Economy(t).samples.select("match_id", "freeze_end_tick", "player_id", "copies", F.col("s.current_equip_value").alias("equip"))


@query("k02_active_members", "SELECT * FROM kmem")
def _(t):
    return K.Economy(t).members


@query("k03_inventory_split", "SELECT match_id, round_id, player_id, weapons, utility FROM kpl")
def _(t):
    return K.Economy(t).players.select("match_id", "round_id", "player_id", text(F.col("weapons")).alias("weapons"), text(F.col("utility")).alias("utility"))


@query("k04_player_equipment", "SELECT * FROM kpl")
def _(t):
    p = K.Economy(t).players
    return p.withColumn("weapons", text(F.col("weapons"))).withColumn("utility", text(F.col("utility"))).withColumn("exclusion_reasons", text(F.col("exclusion_reasons")))


_STA = "CASE WHEN coalesce(n, 0) > 0 AND {0} = n THEN 'available' WHEN coalesce({0}, 0) > 0 THEN 'partial' ELSE 'unresolved' END"
cte("ktm0", f"""SELECT r.match_id, r.round_id, r.round_number, s.team_id, s.side, coalesce(n, 0) AS player_count, CASE WHEN en > 0 THEN ev_ END AS equipment_value, {_STA.format('en')} AS equipment_status, cs AS cash_spent, {_STA.format('cn')} AS spent_status, bal AS balance,
  CASE WHEN hn > 0 THEN hel END AS helmet_count, {_STA.format('hn')} AS helmet_status, CASE WHEN dn > 0 THEN kit END AS defuse_kit_count, CASE WHEN tn = n AND lo = hi THEN lo END AS consensus_team_num, w AS weapons, u AS utility, r.is_overtime, r.score_status, s.sf + s.sa AS score_total,
  concat_ws(',', CASE WHEN r.is_warmup THEN 'warmup_round' END, CASE WHEN NOT r.is_complete THEN 'incomplete_round' END, CASE WHEN coalesce(n, 0) <> 5 THEN 'roster_size_mismatch' END, CASE WHEN bad > 0 THEN 'player_snapshot_ineligible' END, CASE WHEN coalesce(en, 0) <> coalesce(n, -1) THEN 'complete_equipment_value_unavailable' END) AS exclusion_reasons
  FROM rounds r, LATERAL (SELECT r.t_team_id AS team_id, 'T' AS side, r.score_t_before AS sf, r.score_ct_before AS sa UNION ALL SELECT r.ct_team_id, 'CT', r.score_ct_before, r.score_t_before) s
  LEFT JOIN (SELECT round_id, team_id, side, count(*) AS n, count(*) FILTER (exclusion_reasons <> '') AS bad, CAST(sum(equipment_value) AS BIGINT) AS ev_, count(equipment_value) AS en, CAST(sum(cash_spent) AS BIGINT) AS cs, count(cash_spent) AS cn, CAST(sum(balance) AS BIGINT) AS bal, count(*) FILTER (has_helmet) AS hel,
    count(has_helmet) AS hn, count(*) FILTER (has_defuser) AS kit, count(has_defuser) AS dn, min(team_num) AS lo, max(team_num) AS hi, count(team_num) AS tn, array_to_string(list_sort(list_filter(flatten(list(string_split(weapons, ','))), lambda x: x <> '')), ',') AS w,
    array_to_string(list_sort(list_filter(flatten(list(string_split(utility, ','))), lambda x: x <> '')), ',') AS u FROM kpl GROUP BY 1, 2, 3) g USING (round_id, team_id, side)""".replace("USING (round_id, team_id, side)", "ON g.round_id = r.round_id AND g.team_id = s.team_id AND g.side = s.side"))
cte("ktm", """SELECT * EXCLUDE (is_overtime, score_status, score_total), exclusion_reasons = '' AS eligible, CASE WHEN exclusion_reasons <> '' OR equipment_value IS NULL THEN 'unknown' WHEN NOT is_overtime AND score_status = 'available' AND score_total IN (0, 12) THEN 'pistol' WHEN equipment_value >= 20000 THEN 'full'
  WHEN spent_status = 'available' AND cash_spent >= 10000 THEN 'force' WHEN spent_status = 'available' AND equipment_value <= 7500 AND cash_spent <= 5000 THEN 'eco' WHEN equipment_value > 7500 THEN 'semi' ELSE 'unknown' END AS buy_type FROM ktm0""")


def _kt(name, cols):
    @query(name, f"SELECT match_id, round_id, round_number, team_id, side, {', '.join(cols)} FROM ktm")
    def _(t):
        d = K.Economy(t).teams
        for c in ("weapons", "utility", "exclusion_reasons"):
            d = d.withColumn(c, text(F.col(c)))
        return d.select("match_id", "round_id", "round_number", "team_id", "side", *cols)


_kt("k05_team_equipment", ["player_count", "equipment_value", "equipment_status", "cash_spent", "spent_status", "balance", "helmet_count", "helmet_status", "defuse_kit_count", "consensus_team_num", "weapons", "utility", "eligible", "exclusion_reasons"])
_kt("k06_buy_class", ["equipment_value", "cash_spent", "eligible", "buy_type"])


@query("k07_buy_counts", "SELECT match_id, coalesce(side, 'ALL') AS side, buy_type, count(*) AS team_rounds FROM ktm GROUP BY GROUPING SETS ((match_id, buy_type), (match_id, side, buy_type))")
def _(t):
    return K.Economy(t).buy_counts()


@query("k08_full_buys", "SELECT match_id, round_number, side, team_id, equipment_value FROM ktm WHERE side = 'CT' AND buy_type = 'full' ORDER BY match_id, round_number")
def _(t):
    return K.Economy(t).teams.where("side = 'CT' AND buy_type = 'full'").select("match_id", "round_number", "side", "team_id", "equipment_value").orderBy("match_id", "round_number")


@query("k09_side_by_side", "SELECT t.match_id, t.round_id, t.round_number, t.equipment_value AS t_equipment_value, t.cash_spent AS t_cash_spent, t.buy_type AS t_buy_type, c.equipment_value AS ct_equipment_value, c.cash_spent AS ct_cash_spent, c.buy_type AS ct_buy_type FROM ktm t JOIN ktm c ON c.round_id = t.round_id AND c.side = 'CT' WHERE t.side = 'T'")
def _(t):
    return K.Economy(t).side_by_side()
