"""Position samples, projectiles and playback queries."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SpatialConfig
from ..functions.common import count_if, coverage_status, lagged, truth, union_all

KEY = ["match_id", "round_id"]
# Fixed value: inventory spellings of utility.
UTILITY = {"flashbang": "flashbang", "smokegrenade": "smoke", "hegrenade": "he_grenade", "molotov": "molotov", "incgrenade": "incendiary",
           "incendiarygrenade": "incendiary", "decoy": "decoy", "decoygrenade": "decoy"}
BOMB_ITEM = 49
MATCH_EARLY, MATCH_LATE, MATCH_RADIUS, THROW_OFFSET = 8, 64, 512.0, 64


def sampling_targets(rounds: DataFrame, event_ticks: DataFrame, cfg: SpatialConfig = SpatialConfig()) -> DataFrame:
    """Every n-th live tick, the boundaries and all event ticks, clipped before the next round."""
    nxt = F.lead("start_tick").over(Window.partitionBy("match_id").orderBy("start_tick", "round_number"))
    last = F.coalesce("official_end_tick", "end_tick")
    r = rounds.withColumn("lo", F.coalesce("freeze_end_tick", "start_tick")).withColumn("_n", nxt).withColumn("hi", F.when(last >= F.col("_n"), F.col("_n") - 1).otherwise(last))
    r = r.where("lo IS NOT NULL AND hi >= lo").select(*KEY, "round_number", "lo", "hi")
    grid = r.select(*KEY, "round_number", F.explode(F.concat(F.sequence("lo", "hi", F.lit(cfg.sample_every)), F.array("lo", "hi"))).alias("tick"))
    extra = event_ticks.select(*KEY, "tick").join(r, KEY).where("tick BETWEEN lo AND hi").select(*KEY, "round_number", "tick")
    return grid.unionByName(extra).distinct()


def utility_names(items: Column) -> Column:
    def key(i):
        return F.replace(F.replace(F.replace(F.lower(i), F.lit("weapon_")), F.lit(" ")), F.lit("_"))

    names = F.create_map(*[F.lit(x) for kv in UTILITY.items() for x in kv])
    return F.array_compact(F.transform(items, lambda i: F.try_element_at(names, key(i))))


class Spatial:
    """Snapshots of all matches; ``timeline`` supplies state, ``targets`` the wanted ticks."""

    def __init__(self, tables, timeline, targets: DataFrame, cfg: SpatialConfig = SpatialConfig()):
        self.t, self.timeline, self.targets, self.cfg = tables, timeline, targets, cfg

    @cached_property
    def mapped(self) -> DataFrame:
        """Samples at wanted ticks mapped to players by platform id, one per (tick, player)."""
        s = self.t.samples.withColumnRenamed("round_id", "_r").drop("round_number", "player_id", "team_id", "side")
        s = s.join(self.targets, ["match_id", "tick"])
        who = self.t.players.where("steam_id IS NOT NULL").select("match_id", "steam_id", "player_id")
        s = s.join(who, ["match_id", "steam_id"])
        cols = ["x", "y", "z", "pitch", "yaw", "source_alive", "source_team_number", "carried_item_id", "utility_a", "utility_b"]
        g = s.groupBy(*KEY, "round_number", "tick", "player_id").agg(F.count("*").alias("copies"), F.min_by(F.struct(*cols), F.struct("event_id", "j")).alias("s"))
        return g.select(*KEY, "round_number", "tick", "player_id", "copies", "s.*")

    @cached_property
    def snapshots(self) -> DataFrame:
        f = self.timeline.frame.select(*KEY, "people", "dead", "undecided")
        q = self.mapped.join(f, KEY)
        me = F.col("people")[F.col("player_id")]
        died = F.expr("exists(dead, d -> d.victim = player_id AND d.tick <= tick)")
        settled = ~truth(F.col("undecided") <= F.col("tick"))
        alive = F.when(settled & me.isNotNull(), F.when(truth(died), False).when(me["life"] == "alive", True))
        limit = self.cfg.coordinate_limit
        ok = F.lit(True)
        for c in ("x", "y", "z"):
            ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) <= limit)
        ok = F.coalesce(ok, F.lit(False))
        q = q.withColumn("alive", alive)
        dead = truth(~F.col("alive"))
        pos = F.when(ok, F.when(dead, "unreliable").otherwise("available")).otherwise("unavailable")
        bad = truth(F.isnan("pitch")) | truth(F.isnan("yaw")) | (F.col("pitch").isNull() & F.col("yaw").isNull())
        ang = F.when(bad, "unavailable").when(dead, "unreliable").when(F.col("pitch").isNotNull() & F.col("yaw").isNotNull(), "available").otherwise("partial")
        want = F.when(me["side"] == "T", 2).when(me["side"] == "CT", 3)
        return q.select(
            *KEY, "round_number", "tick", "player_id", "copies", me["team_id"].alias("team_id"), F.coalesce(me["side"], F.lit("UNKNOWN")).alias("side"),
            *[F.when(ok, F.col(c)).alias(c) for c in ("x", "y", "z")], F.when(~bad, F.col("pitch")).alias("pitch"), F.when(~bad, F.col("yaw")).alias("yaw"), "alive",
            pos.alias("position_status"), ang.alias("angle_status"), F.array_contains(F.array("carried_item_id"), BOMB_ITEM).alias("has_bomb"),
            utility_names(F.array_compact(F.array("utility_a", "utility_b"))).alias("utility"), truth(F.col("source_alive") != F.col("alive")).alias("alive_mismatch"),
            truth(F.col("source_team_number") != want).alias("team_mismatch"))

    @cached_property
    def carriers(self) -> DataFrame:
        return self.snapshots.where("has_bomb AND alive AND x IS NOT NULL").select(*KEY, "round_number", "tick", "player_id", "x", "y", "z")

    def order_issues(self) -> DataFrame:
        """Samples whose tick is lower than the one delivered before for the player."""
        s = self.t.samples.where("steam_id IS NOT NULL").select("match_id", "steam_id", "event_id", "j", "tick", F.floor(F.col("event_id") / 720).alias("chunk"))
        p = lagged(s, ["match_id", "steam_id"], ["event_id", "j"], {"tick": "previous_tick"}, "chunk")
        return p.where("tick < previous_tick").select("match_id", "steam_id", "event_id", "j", "previous_tick", "tick")

    def capability(self) -> DataFrame:
        s, c = self.snapshots, F.col
        g = s.groupBy("match_id").agg(F.count("*").alias("n"), count_if(c("position_status") == "available").alias("pos"), count_if(c("angle_status") == "available").alias("ang"))
        t = self.targets.groupBy("match_id").agg(F.countDistinct("tick").alias("ticks"))
        b = self.carriers.groupBy("match_id").agg(F.countDistinct("tick").alias("bomb"))
        g = t.join(g, "match_id", "left").join(b, "match_id", "left").fillna(0, ["n", "pos", "ang", "bomb"])
        rows = [("positions", c("n"), c("pos"), coverage_status(c("pos"), c("n"))), ("view_angles", c("n"), c("ang"), coverage_status(c("ang"), c("n"))),
                ("bomb_positions", c("ticks"), c("bomb"), F.when(c("bomb") > 0, "partial").otherwise("unavailable")), ("sampling_frequency", c("ticks"), c("ticks"), F.lit("available"))]
        return g.select("match_id", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), p.alias("population"), v.alias("covered"), st.alias("status")) for n, p, v, st in rows])))

    def nearest(self, k: int = 9) -> DataFrame:
        """k nearest players of every player at each tick; a tick holds one roster."""
        s = self.snapshots.where("x IS NOT NULL")
        g = s.groupBy(*KEY, "round_number", "tick").agg(F.collect_list(F.struct("player_id", "team_id", "x", "y", "z")).alias("ps"))
        near = F.expr(f"""transform(ps, a -> named_struct('source', a.player_id, 'near', slice(sort_array(transform(filter(ps, b -> b.player_id <> a.player_id), b -> named_struct(
            'd', sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 'player', b.player_id, 'same', a.team_id = b.team_id))), 1, {int(k)})))""")
        g = g.select(*KEY, "round_number", "tick", F.inline(near)).select(*KEY, "round_number", "tick", F.col("source").alias("player_id"), F.posexplode("near").alias("i", "n"))
        return g.select(*KEY, "round_number", "tick", "player_id", (F.col("i") + 1).alias("rank"), F.col("n.player").alias("other_id"), F.col("n.d").alias("distance"), F.col("n.same").alias("same_team"))

    @cached_property
    def ticks(self) -> DataFrame:
        """Distinct sampled ticks with their position and neighbours."""
        w = Window.partitionBy(*KEY).orderBy("tick")
        d = self.snapshots.groupBy(*KEY, "round_number", "tick").agg(F.count("*").alias("players"))
        return d.withColumn("position", F.row_number().over(w)).withColumn("previous_tick", F.lag("tick").over(w)).withColumn("next_tick", F.lead("tick").over(w))

    def slices(self, size: int = 64) -> DataFrame:
        """Playback slices: n consecutive ticks with players and tick range."""
        chunk = F.floor((F.col("position") - 1) / size)
        return self.ticks.groupBy(*KEY, "round_number", chunk.alias("slice")).agg(F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), F.count("*").alias("tick_count"), F.sum("players").alias("player_rows"))

    def playback(self, markers: DataFrame, effects: DataFrame, size: int = 64) -> DataFrame:
        """Content of every playback slice, one row each: the state that it starts from, the players and the bomb at its ticks, effects alive in it, events at its ticks.

        ``kind`` says what a row is, ``subject`` whom it is about, ``value`` what is known.
        """
        none, text = F.lit(None).cast("string"), lambda *c: F.concat_ws("/", *c)
        no_place = [F.lit(None).cast("double").alias(c) for c in ("x", "y", "z")]
        at = self.ticks.select(*KEY, "tick", F.floor((F.col("position") - 1) / size).alias("slice"))
        head = [*KEY, "slice"]

        def rows(df, kind, tick, subject, value, place=("x", "y", "z")):
            return df.select(*head, F.lit(kind).alias("kind"), tick.cast("long").alias("tick"), subject.cast("string").alias("subject"), value.alias("value"), *place)

        spans = self.slices(size)
        state = self.timeline.state_at(spans.select(*KEY, "round_number", "slice", F.col("first_tick").alias("tick")))
        known = text(F.col("t_alive").cast("string"), F.col("ct_alive").cast("string"), "bomb_state", "phase")
        life = F.when(F.col("alive"), "alive").when(~F.col("alive"), "dead").otherwise("unknown")
        carrier = F.when(F.col("has_bomb"), "bomb")
        return union_all(
            rows(state, "state", F.col("tick"), none, known, no_place),
            rows(self.snapshots.join(at, [*KEY, "tick"]), "player", F.col("tick"), F.col("player_id"), text("side", life, "position_status", F.coalesce(carrier, F.lit("-")))),
            rows(self.carriers.join(at, [*KEY, "tick"]), "bomb", F.col("tick"), F.col("player_id"), F.lit("carried")),
            rows(effects_in_ranges(spans, effects), "effect", F.lit(None), F.col("effect_id"), F.col("effect_type"), no_place),
            rows(markers.withColumnRenamed("kind", "what").join(at, [*KEY, "tick"]), "event", F.col("tick"), F.col("event_id"), F.concat_ws("/", "what", "player_id")))

    def motion(self, tick_bucket: int = 600) -> DataFrame:
        """Motion class between consecutive samples of a player."""
        s = self.snapshots.withColumn("_b", F.floor(F.col("tick") / tick_bucket))
        s = s.withColumn("level", F.when(F.col("z").isNull(), "unknown").when(F.col("z") > 128, "upper").when(F.col("z") < 128, "lower").otherwise("unknown"))
        p = lagged(s, KEY + ["player_id"], ["tick"], {c: f"p_{c}" for c in ("tick", "x", "y", "z", "alive", "position_status", "level")}, "_b")
        c, cfg = F.col, self.cfg
        gap = c("tick") - c("p_tick")
        known = c("x").isNotNull() & c("p_x").isNotNull()
        planar = F.hypot(c("x") - c("p_x"), c("y") - c("p_y"))
        dz = F.abs(c("z") - c("p_z"))
        lives = truth(c("alive")) & truth(c("p_alive"))
        good = (c("position_status") == "available") & (c("p_position_status") == "available")
        jump = (planar > cfg.jump_planar) | (dz > cfg.jump_vertical)
        cls = (F.when(c("p_tick").isNull() | ~known | (lives & ~good), "unavailable")
               .when(~lives | jump | (c("level") != c("p_level")) | (gap > cfg.large_gap), "discontinuity").when(gap <= cfg.normal_gap, "normal").otherwise("large"))
        return p.select(*KEY, "round_number", "player_id", "tick", gap.alias("tick_gap"), F.when(known, planar).alias("planar_distance"), F.when(known, planar / gap).alias("speed"),
                        truth(known & (planar == 0) & (dz == 0)).alias("repeated"), cls.alias("motion_class"))

    def markers(self, kills: DataFrame, damages: DataFrame, shots: DataFrame, bombs: DataFrame, grenades: DataFrame, openings: DataFrame, trades: DataFrame) -> DataFrame:
        """Event markers at the position of the subject (victim for death, damage and trade)."""
        def rows(df, kind, event, who):
            return df.select(*KEY, "tick", F.lit(kind).alias("kind"), F.col(event).alias("event_id"), F.col(who).alias("player_id"))

        at = kills.select("event_id", "tick")
        tr = trades.join(at.withColumnRenamed("event_id", "trade_event_id"), "trade_event_id")
        m = union_all(rows(kills, "death", "event_id", "victim_player_id"), rows(damages, "damage", "event_id", "victim_player_id"), rows(shots, "shot", "event_id", "player_id"),
                      rows(bombs, "bomb", "event_id", "player_id"), rows(openings, "opening", "event_id", "victim_player_id"), rows(tr, "trade", "trade_event_id", "traded_enemy_id"))
        pos = self.snapshots.where("x IS NOT NULL").select(*KEY, "tick", "player_id", "x", "y", "z")
        own = grenades.select(*KEY, "tick", F.lit("grenade").alias("kind"), "event_id", "player_id", "x", "y", "z")
        return m.join(pos, KEY + ["tick", "player_id"], "left").unionByName(own)


def _bisect(array: str, value: str) -> str:
    """How many leading elements of a sorted array are at most ``value``; a fold that halves the stretch."""
    return (f"aggregate(sequence(1, 32), named_struct('lo', 0, 'hi', size({array})), (b, _) -> CASE WHEN b.lo >= b.hi THEN b "
            f"WHEN {array}[int((b.lo + b.hi) div 2)] <= {value} THEN named_struct('lo', int((b.lo + b.hi) div 2) + 1, 'hi', b.hi) ELSE named_struct('lo', b.lo, 'hi', int((b.lo + b.hi) div 2)) END, b -> b.lo)")


def interval_index(intervals: DataFrame, keys: list[str], start: str, stop: str, keep: list[str]) -> DataFrame:
    """One row per key: its intervals by start, their starts, and the largest stop up to each; an open stop lasts on."""
    item = F.struct(F.col(start).alias("start"), F.coalesce(F.col(stop), F.lit(2**31 - 1)).alias("stop"), *keep)
    packed = intervals.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    reach = """aggregate(_items, named_struct('m', -1, 'out', CAST(array() AS array<int>)),
        (s, x) -> named_struct('m', greatest(s.m, int(x.stop)), 'out', concat(s.out, array(greatest(s.m, int(x.stop))))), s -> s.out)"""
    return packed.withColumn("_starts", F.expr("transform(_items, x -> int(x.start))")).withColumn("_reach", F.expr(reach))


def overlapping(ranges: DataFrame, index: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Ranges with the intervals that share a tick with them, one row each.

    Of the intervals of a key, those up to the last start in range and from the first that reaches the range on are looked at.
    """
    r = ranges.join(index, keys)
    low, high = _bisect("_reach", f"{first} - 1"), _bisect("_starts", last)
    r = r.withColumn("_low", F.expr(low)).withColumn("_high", F.expr(high))
    some = F.expr(f"filter(slice(_items, _low + 1, greatest(_high - _low, 0)), x -> x.stop >= {first})")
    return r.select(*ranges.columns, F.inline(some))


def effects_in_ranges(ranges: DataFrame, effects: DataFrame) -> DataFrame:
    """Effects alive anywhere in [first_tick, last_tick]; an open end lasts on."""
    index = interval_index(effects, KEY, "start_tick", "end_tick", ["effect_id", "effect_type"])
    return overlapping(ranges, index, KEY, "first_tick", "last_tick").select(*KEY, "slice", "effect_id", "effect_type")


def nearest_tick(requests: DataFrame, ticks: DataFrame, within: int = 16) -> DataFrame:
    """Nearest tick of the round within a distance; the earlier one on a tie.  Equi join on tick buckets."""
    b = F.floor(F.col("tick") / within)
    q = requests.select("*", F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    t = ticks.select(*KEY, F.col("tick").alias("sample_tick"), F.floor(F.col("tick") / within).alias("_b"))
    gap = F.abs(F.col("sample_tick") - F.col("tick"))
    hit = q.join(t, KEY + ["_b"]).where(gap <= within)
    keep = [c for c in requests.columns if c not in KEY + ["tick"]]
    g = hit.groupBy(*KEY, *keep, "tick").agg(F.min(F.struct(gap.alias("gap"), "sample_tick")).alias("n"))
    return g.select(*requests.columns, F.col("n.sample_tick").alias("sample_tick"), (F.col("tick") - F.col("n.sample_tick")).alias("offset"))


def project(points: DataFrame, maps: DataFrame) -> DataFrame:
    """World position to overview pixel, normalized position, level and bounds flag; and back."""
    q, c = points.join(maps, "map_name", "left"), F.col
    ready = c("origin_x").isNotNull() & c("origin_y").isNotNull() & c("x").isNotNull() & c("y").isNotNull()
    px, py = (c("x") - c("origin_x")) / c("scale"), (c("origin_y") - c("y")) / c("scale")
    nx, ny = px / c("image_width"), py / c("image_height")
    level = (F.when(~c("two_levels"), "default").when(c("z").isNull(), "unknown").when((c("z") == c("upper_min_z")) & (c("z") == c("lower_max_z")), "unknown")
             .when(c("z") >= c("upper_min_z"), "upper").when(c("z") <= c("lower_max_z"), "lower").otherwise("unknown"))
    inside = nx.between(0.0, 1.0) & ny.between(0.0, 1.0)
    status = F.when(~ready, "unavailable").when(~inside | (c("two_levels") & (level == "unknown")), "partial").otherwise("available")
    vals = {"pixel_x": px, "pixel_y": py, "normalized_x": nx, "normalized_y": ny, "level": level, "out_of_bounds": ~inside, "world_x": c("origin_x") + px * c("scale"), "world_y": c("origin_y") - py * c("scale")}
    return q.select(*points.columns, *[F.when(ready, v).alias(n) for n, v in vals.items()], status.alias("availability"))


def choose_revision(evidence: DataFrame, revisions: DataFrame) -> DataFrame:
    """Map revision by precedence: manual, patch, checksum; conflicts are unsupported."""
    known = revisions.groupBy("map_name").agg(F.count("*").alias("n"), F.count_if("is_current").alias("current_n"), F.max(F.when(F.col("is_current"), F.col("revision_id"))).alias("current"),
                                              F.collect_list(F.struct("revision_id", "patch_version", "map_crc")).alias("revs"))
    q, c = evidence.join(known, "map_name", "left"), F.col
    q = q.withColumn("by_patch", F.expr("transform(filter(revs, r -> r.patch_version = patch_version), r -> r.revision_id)")).withColumn("by_crc", F.expr("transform(filter(revs, r -> r.map_crc = map_crc), r -> r.revision_id)"))
    for k in ("patch", "crc"):
        q = q.withColumn(f"{k}_n", F.coalesce(F.size(f"by_{k}"), F.lit(0))).withColumn(f"{k}_hit", F.when(F.col(f"{k}_n") == 1, F.element_at(f"by_{k}", 1)))
    manual_ok = F.expr("exists(revs, r -> r.revision_id = manual_revision)")
    many = ((c("patch_version").isNotNull()) & (c("patch_n") > 1)) | (c("map_crc").isNotNull() & (c("crc_n") > 1))
    clash = c("patch_hit") != c("crc_hit")
    hit = F.coalesce("patch_hit", "crc_hit")
    single = F.when(c("n") == 1, F.element_at("revs", 1)["revision_id"]).when(c("current_n") == 1, c("current"))
    status = (F.when(c("n").isNull(), "unsupported").when(c("manual_revision").isNotNull(), F.when(manual_ok, "proven").otherwise("unsupported")).when(truth(many) | truth(clash), "unsupported")
              .when(hit.isNotNull(), "proven").when(single.isNotNull(), "unproven").otherwise("unsupported"))
    picked = F.when(c("n").isNotNull(), F.when(c("manual_revision").isNotNull(), F.when(manual_ok, c("manual_revision"))).when(~(truth(many) | truth(clash)), F.coalesce(hit, single)))
    return q.select("match_id", "map_name", picked.alias("revision_id"), status.alias("status"))


def segment_tracks(points: DataFrame) -> DataFrame:
    """Projectile tracks: a new one on another owner or type, a tick gap, a repeated tick or fewer bounces."""
    w = Window.partitionBy("match_id", "entity_id").orderBy("tick", "projectile_type", "steam_id", "bounce", "x")
    p = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND entity_id IS NOT NULL AND tick IS NOT NULL")
    prev = {c: F.lag(c).over(w) for c in ("tick", "projectile_type", "steam_id", "bounce")}
    p = p.withColumn("_t", prev["tick"]).withColumn("_y", prev["projectile_type"]).withColumn("_s", prev["steam_id"]).withColumn("_b", prev["bounce"])
    new = F.col("_t").isNull() | (F.col("_y") != F.col("projectile_type")) | ~F.col("_s").eqNullSafe(F.col("steam_id")) | (F.col("tick") - F.col("_t") != 1) | truth(F.col("bounce") < F.col("_b"))
    p = p.withColumn("track_no", F.sum(new.cast("int")).over(w)).drop("_t", "_y", "_s", "_b")
    g = p.groupBy("match_id", "entity_id", "track_no", "projectile_type", "steam_id").agg(
        F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), F.count("*").alias("points"), F.max_by(F.struct("x", "y"), F.struct("tick", "bounce", "x")).alias("last"))
    tid = F.concat_ws(":", "match_id", "entity_id", "track_no")
    return g.select(tid.alias("track_id"), "match_id", "entity_id", "track_no", "projectile_type", "steam_id", "first_tick", "last_tick", "points", F.col("last.x").alias("last_x"), F.col("last.y").alias("last_y"))


def tick_islands(candidates: DataFrame, scope: list[str], width: int = 64) -> DataFrame:
    """Adds ``island`` to edges with ticks ``lo`` to ``hi``: edges of different islands share no tick, so neither a track nor a partner.

    Edges are short, so they lie in few buckets of ticks; islands are stretches of occupied buckets.  Distinct buckets of a match are as many as its
    ticks allow, however many edges they hold.
    """
    key = ["match_id", *scope]
    held = candidates.select(*key, F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("_b")).distinct()
    start = F.coalesce(F.col("_b") - F.lag("_b").over(Window.partitionBy(*key).orderBy("_b")) > 1, F.lit(True))
    held = held.withColumn("island", F.sum(start.cast("int")).over(Window.partitionBy(*key).orderBy("_b")))
    return candidates.withColumn("_b", F.floor(F.col("lo") / width)).join(held, [*key, "_b"]).drop("_b")


def greedy_match(candidates: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """candidates(match_id, entity_id, track_no, track_id, pref, right_id, lo, hi): tracks in order take their best free partner.

    Using up partners is sequential, but only among edges that can share one: each island of ticks (and each value of ``scope``, which a track and
    all its partners have in common) is folded by itself.
    """
    scope = scope or []
    group = ["match_id", *scope, "island"]
    edges = tick_islands(candidates, scope)
    per = edges.groupBy(*group, "entity_id", "track_no", "track_id").agg(F.sort_array(F.collect_list(F.struct("pref", "right_id"))).alias("c"))
    q = per.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("entity_id", "track_no", "track_id", "c"))).alias("q"))
    fold = """aggregate(q, named_struct('used', CAST(array() AS array<bigint>), 'out', CAST(array() AS array<struct<track_id:string,right_id:bigint>>)),
        (s, t) -> element_at(transform(array(try_element_at(filter(t.c, x -> NOT array_contains(s.used, x.right_id)), 1)), b -> CASE WHEN b IS NULL THEN s
            ELSE named_struct('used', concat(s.used, array(b.right_id)), 'out', concat(s.out, array(named_struct('track_id', t.track_id, 'right_id', b.right_id)))) END), 1), s -> s.out)"""
    return q.select("match_id", F.inline(F.expr(fold)))


def match_throws(tracks: DataFrame, throws: DataFrame, offset: int = THROW_OFFSET) -> DataFrame:
    """Latest unused throw of the same owner and type shortly before the track starts; a track and a throw both without owner may match."""
    b = F.floor(F.col("first_tick") / offset)
    owner = F.coalesce("steam_id", F.lit("")).alias("owner")
    t = tracks.select("match_id", "entity_id", "track_no", "track_id", "projectile_type", "first_tick", owner, F.explode(F.array(b - 1, b)).alias("_b"))
    r = throws.select("match_id", owner, "projectile_type", F.col("tick").alias("throw_tick"), F.col("throw_id").alias("right_id"), F.floor(F.col("tick") / offset).alias("_b"))
    c = t.join(r, ["match_id", "owner", "projectile_type", "_b"]).where(f"first_tick - throw_tick BETWEEN 0 AND {offset}")
    pref = F.struct((-F.col("throw_tick")).alias("a"), F.lit(0.0).alias("b"))
    won = greedy_match(c.select("match_id", "owner", "projectile_type", "entity_id", "track_no", "track_id", pref.alias("pref"), "right_id", F.col("throw_tick").alias("lo"), F.col("first_tick").alias("hi")),
                       ["owner", "projectile_type"])
    return won.join(throws.select("match_id", F.col("throw_id").alias("right_id"), F.col("tick").alias("throw_tick")), ["match_id", "right_id"]).join(
        tracks.select("match_id", "track_id", "first_tick"), ["match_id", "track_id"]).select("match_id", "track_id", F.col("right_id").alias("throw_id"), (F.col("first_tick") - F.col("throw_tick")).alias("offset"))


def match_terminals(tracks: DataFrame, terminals: DataFrame) -> DataFrame:
    """Terminal event by entity, else the nearest compatible one in time and space."""
    r = terminals.select("match_id", F.col("terminal_id").alias("right_id"), F.col("entity_id").alias("t_entity"), F.col("projectile_type").alias("t_type"), F.col("steam_id").alias("t_steam"),
                         F.col("tick").alias("t_tick"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.floor(F.col("tick") / MATCH_LATE).alias("_b"))
    lo, hi = F.floor((F.least("first_tick", F.col("last_tick") - MATCH_EARLY)) / MATCH_LATE), F.floor((F.col("last_tick") + MATCH_LATE) / MATCH_LATE)
    c = tracks.select("*", F.explode(F.sequence(lo, hi)).alias("_b")).join(r, ["match_id", "_b"])
    dt, d = F.abs(F.col("t_tick") - F.col("last_tick")), F.hypot(F.col("tx") - F.col("last_x"), F.col("ty") - F.col("last_y"))
    direct = (F.col("t_entity") == F.col("entity_id")) & F.col("t_tick").between(F.col("first_tick"), F.col("last_tick") + 4)
    near = (F.col("t_type") == F.col("projectile_type")) & (F.col("steam_id").isNull() | F.col("t_steam").isNull() | (F.col("steam_id") == F.col("t_steam"))) \
        & F.col("t_tick").between(F.col("last_tick") - MATCH_EARLY, F.col("last_tick") + MATCH_LATE) & (d <= MATCH_RADIUS)
    c = c.withColumn("kind", F.when(direct, 0).when(near, 1)).where("kind IS NOT NULL")
    pref = F.struct((F.col("kind") * 1_000_000 + dt).cast("bigint").alias("a"), F.when(F.col("kind") == 1, d).otherwise(0.0).alias("b"))
    won = greedy_match(c.select("match_id", "entity_id", "track_no", "track_id", pref.alias("pref"), "right_id", F.least("t_tick", "last_tick").alias("lo"), F.greatest("t_tick", "last_tick").alias("hi")))
    return won.withColumnRenamed("right_id", "terminal_id")


def place_tracks(tracks: DataFrame, rounds: DataFrame, players: DataFrame) -> DataFrame:
    """Round whose live window holds the first tick, and the owner; unmapped owners are kept."""
    item = F.struct("round_number", "round_id", F.coalesce("freeze_end_tick", "start_tick").alias("lo"), F.coalesce("official_end_tick", "end_tick").alias("hi"))
    r = rounds.groupBy("match_id").agg(F.sort_array(F.collect_list(item)).alias("_r"))
    q = tracks.join(r, "match_id").withColumn("hit", F.expr("try_element_at(filter(_r, r -> first_tick BETWEEN r.lo AND r.hi), 1)")).where("hit IS NOT NULL")
    who = players.where("steam_id IS NOT NULL").select("match_id", "steam_id", F.col("player_id").alias("owner_player_id"), F.col("team_id").alias("owner_team_id"))
    return q.join(who, ["match_id", "steam_id"], "left").select("track_id", "match_id", F.col("hit.round_id").alias("round_id"), F.col("hit.round_number").alias("round_number"), "projectile_type", "first_tick", "owner_player_id", "owner_team_id")


def link_effects(effects: DataFrame, placed: DataFrame, tick_slack: int = 64) -> DataFrame:
    """Effects with the projectile of the same owner and type that started last before them."""
    b = F.floor(F.col("start_tick") / tick_slack)
    e = effects.select("effect_id", "match_id", "round_id", "effect_type", "owner_player_id", "start_tick", "end_tick", F.explode(F.array(b - 1, b)).alias("_b"))
    p = placed.select("match_id", "round_id", F.col("projectile_type").alias("effect_type"), "owner_player_id", "track_id", "first_tick", F.floor(F.col("first_tick") / tick_slack).alias("_b"))
    hit = e.join(p, ["match_id", "round_id", "effect_type", "owner_player_id", "_b"]).where(f"start_tick - first_tick BETWEEN 0 AND {tick_slack}")
    best = hit.groupBy("match_id", "effect_id").agg(F.max(F.struct("first_tick", "track_id")).alias("b")).select("match_id", "effect_id", F.col("b.track_id").alias("track_id"))
    return effects.join(best, ["match_id", "effect_id"], "left").select("effect_id", "match_id", "round_id", "effect_type", "owner_player_id", "track_id", "start_tick", "end_tick",
                                                                        truth(F.col("end_tick") < F.col("start_tick")).alias("inverted"))
