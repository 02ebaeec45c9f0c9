"""Rules on hand-written rounds."""
import hashlib
import math
import random
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from roundscope.config import StatsConfig
from roundscope.functions.common import lagged
from roundscope.operators import identity as D
from roundscope.operators import normalize as B
from roundscope.operators import spatial as I
from roundscope.operators import zones as J
from roundscope.operators.economy import buy_class
from roundscope.config import EconomyConfig
from roundscope.operators.stats import RoundStats, clamp_damage
from roundscope.plans import tactical as O
from roundscope.plans import trust as N

from .scenario import tables


def stats(spark, **kw):
    return RoundStats(tables(spark, **kw), StatsConfig(320))


def players(s):
    return {r.player_id: r for r in s.player_rounds.collect()}


def test_opening_skips_teamkill_suicide_and_world(spark):
    s = stats(spark, kills=[("a1", "a2", 120), ("a3", "a3", 121), (None, "a4", 122), ("b1", "a5", 130)])
    o = s.openings.collect()
    assert [(r.killer_player_id, r.victim_player_id, r.tick) for r in o] == [("b1", "a5", 130)]


def test_same_tick_opening_takes_lower_id_and_empty_round_has_none(spark):
    assert stats(spark, kills=[("a1", "b1", 120), ("b2", "a2", 120)]).openings.first().event_id == 1
    assert stats(spark).openings.count() == 0


def test_conversion_is_null_without_winner(spark):
    s = stats(spark, kills=[("a1", "b1", 120)], winner=None)
    assert s.openings.first().opening_team_won is None
    assert {r.opening_kill_converted for r in s.team_rounds.collect()} == {None}


def test_trades_direct_chain_and_dead_killer(spark):
    s = stats(spark, kills=[("a1", "b1", 200), ("b2", "a1", 300), ("a2", "b2", 400), ("a3", "b2", 410)])
    got = {(r.trade_event_id, r.original_event_id) for r in s.trades.collect()}
    assert got == {(2, 1), (3, 2)}


def test_trade_keeps_latest_original_and_window(spark):
    s = stats(spark, kills=[("a1", "b1", 200), ("a1", "b2", 250), ("b3", "a1", 500)])
    assert [(r.original_event_id, r.tick_delta) for r in s.trades.collect()] == [(2, 250)]
    assert stats(spark, kills=[("a1", "b1", 200), ("b3", "a1", 521)]).trades.count() == 0
    assert stats(spark, kills=[("a1", "b1", 200), ("b3", "a1", 520)]).trades.count() == 1


def test_kast_letters(spark):
    p = players(stats(spark, kills=[("a1", "b1", 200, "a2"), ("b2", "a1", 300), ("a3", "b2", 320)]))
    assert (p["a1"].kast_k, p["a1"].kast_t, p["a2"].kast_a, p["a2"].survived) == (True, True, True, True)
    assert p["b1"].kast is True and p["b1"].kast_t is True and p["b2"].kast_k is True


def test_advantage_lost_in_tied_sequence_and_plus_two(spark):
    a = stats(spark, kills=[("a1", "b1", 200), ("b2", "a1", 300), ("a2", "b2", 400), ("a2", "b3", 410), ("a2", "b4", 420)]).advantage.first()
    assert (a.first_advantage_team_id, a.first_advantage_size, a.first_advantage_lost, a.max_t, a.t_plus_two, a.final_t, a.final_ct) == ("A", 1, True, 3, True, 4, 1)  # four against one at the end


def test_unequal_lineup_has_no_advantage(spark):
    t = tables(spark, kills=[("a1", "b1", 200)])
    t.memberships = t.memberships.where("player_id <> 'b5'")
    a = RoundStats(t).advantage.first()
    assert not a.lineup_valid and a.first_advantage_team_id is None and a.max_t == 0


def test_repeated_death_changes_nothing(spark):
    r = stats(spark, kills=[("a1", "b1", 200), ("a2", "b1", 250)]).transitions.orderBy("event_id").collect()
    assert r[1].death_class == "repeated" and r[1].ct_alive_before == r[1].ct_alive_after == 4


def test_overkill_is_clamped_with_and_without_reports(spark):
    d = stats(spark, damages=[("a1", "b1", 120, 30, None), ("a1", "b1", 121, 90, None), ("a1", "b1", 122, 5, None), ("a1", "b2", 130, 27, 73), ("a2", "b2", 131, 200, None)]).damage
    assert [r.effective for r in d.orderBy("event_id").collect()] == [30, 70, 0, 27, 73]


def test_zero_denominators_are_null(spark):
    m = {r.player_id: r for r in stats(spark).player_matches.collect()}["a1"]
    assert m.kd_ratio is None and m.headshot_percentage is None and m.adr == 0.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_row_order_does_not_matter(spark, seed):
    kills = [("a1", "b1", 200), ("b2", "a1", 200), ("a2", "b2", 400), ("b3", "a2", 410), ("a3", "b3", 410)]
    t = tables(spark, kills=kills)
    want = sorted(map(tuple, RoundStats(t).player_rounds.collect()))
    t.kills = t.kills.orderBy(F.rand(seed))
    assert sorted(map(tuple, RoundStats(t).player_rounds.collect())) == want


def test_lag_across_buckets_equals_plain_lag(spark):
    rows = [(k, t, t // 7) for k in "ab" for t in (1, 2, 6, 7, 30, 31, 90)]
    df = spark.createDataFrame(rows, "k string, t int, b int")
    got = {(r.k, r.t): r.prev for r in lagged(df, ["k"], ["t"], {"t": "prev"}, "b").collect()}
    for k in "ab":
        last = None
        for t in (1, 2, 6, 7, 30, 31, 90):
            assert got[(k, t)] == last
            last = t


def test_copies_are_numbered_across_chunks(spark):
    df = spark.createDataFrame([("x",)] * 7 + [("y",)], "h string")
    got = sorted((r.h, r.ordinal) for r in B.numbered_copies(df, ["h"], chunk=3).collect())
    assert got == [("x", i) for i in range(7)] + [("y", 0)]


def polygon(spark, rows):
    return spark.createDataFrame(rows, "map_name string, zone_id string, priority int, verification string, vertices array<struct<x:double,y:double>>, min_z double, max_z double")


def test_zone_boundary_band_and_priority(spark):
    sq = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    z = polygon(spark, [("m", "big", 1, "verified", sq, None, None), ("m", "small", 1, "verified", [(0.0, 0.0), (50.0, 0.0), (0.0, 50.0)], None, None),
                        ("m", "roof", 9, "verified", sq, 200.0, 300.0), ("m", "draft", 99, "proposed", sq, None, None)])
    pts = [(1, 50.0, 50.0, 0.0, "big"), (2, 25.0, 25.0, 0.0, "small"), (3, 100.0, 40.0, 0.0, "big"), (4, 0.0, 0.0, 0.0, "small"), (5, 50.0, 50.0, 250.0, "roof"), (6, 101.0, 50.0, 0.0, None), (7, 60.0, 60.0, None, "big")]
    p = spark.createDataFrame([("m", *r[:4]) for r in pts], "map_name string, id int, x double, y double, z double")
    got = {r.id: r.zone_id for r in J.assign_zones(p, z).collect()}
    assert got == {r[0]: r[4] for r in pts}


def test_nearest_tick_edges(spark):
    q = spark.createDataFrame([("m", "r", 100, 1), ("m", "r", 117, 2), ("m", "r", 200, 3)], "match_id string, round_id string, tick int, id int")
    t = spark.createDataFrame([("m", "r", 90), ("m", "r", 110), ("m", "r", 184)], "match_id string, round_id string, tick int")
    got = {r.id: (r.sample_tick, r.offset) for r in I.nearest_tick(q, t).collect()}
    assert got == {1: (90, 10), 2: (110, 7), 3: (184, 16)}


def test_recent_sample_edges(spark):
    s = spark.createDataFrame([("m", "r", "p", t, 0.0, 0.0, 0.0, z, True, []) for t, z in ((68, "a"), (100, "b"))], "match_id string, round_id string, player_id string, tick int, x double, y double, z double, zone_id string, alive boolean, utility array<string>")
    q = spark.createDataFrame([("m", "r", "p", t) for t in (100, 99, 132, 133)], "match_id string, round_id string, player_id string, tick int")
    got = {r.tick: r.sample_tick for r in O.recent_sample(q, s, 32).collect()}
    assert got == {100: 100, 99: 68, 132: 100}
    assert {r.tick: r.sample_tick for r in O.recent_sample(q, s, 32, strict=True).collect()}[100] == 68


def test_greedy_match_uses_partners_once(spark):
    kinds = "match_id string, entity_id int, track_no long, track_id string, pref struct<a:bigint,b:double>, right_id bigint, lo int, hi int"
    c = spark.createDataFrame([("m", 1, 1, "t1", (0, 0.0), 10, 5, 9), ("m", 1, 2, "t2", (0, 0.0), 10, 5, 9), ("m", 1, 2, "t2", (5, 0.0), 11, 7, 9)], kinds)
    assert {(r.track_id, r.right_id) for r in I.greedy_match(c).collect()} == {("t1", 10), ("t2", 11)}
    # against one fold over everything: tracks at random ticks, partners up to 64 ticks before
    rng = random.Random(3)
    partners = [(100 + i, rng.randrange(60_000)) for i in range(400)]
    edges = []
    for n in range(400):
        at = rng.randrange(60_000)
        edges += [("m", n % 5, n, f"t{n}", (at - tick, 0.0), i, tick, at) for i, tick in partners if 0 <= at - tick <= 300]
    used, wanted = set(), set()
    for entity, n in sorted({(e[1], e[2]) for e in edges}):
        free = sorted((e[4], e[5]) for e in edges if (e[1], e[2]) == (entity, n) and e[5] not in used)
        if free:
            used.add(free[0][1])
            wanted.add((f"t{n}", free[0][1]))
    df = spark.createDataFrame(edges, kinds)
    assert {(r.track_id, r.right_id) for r in I.greedy_match(df).collect()} == wanted
    assert I.tick_islands(df, []).groupBy("island").count().agg(F.max("count")).first()[0] < len(edges) / 4


def test_clamp_in_many_stretches(spark):
    """A round of one victim with thousands of rows, some with reported health, against a loop; stretches are tasks of their own."""
    rng = random.Random(5)
    rows = [("m", "r", i, rng.randrange(20_000), "a", "v", "live", rng.choice([None, 0, 3, 20, 40]), rng.choice([None] * 9 + [rng.randrange(101)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "match_id string, round_id string, event_id long, tick int, attacker_player_id string, victim_player_id string, phase string, damage_health long, victim_health_after long")
    frame = spark.createDataFrame([("m", "r", {"a": ("x", "T"), "v": ("y", "CT")})], "match_id string, round_id string, roster map<string,struct<team_id:string,side:string>>")
    health, wanted = 100, {}
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        effective = min(r[7] or 0, health)
        wanted[r[2]] = (health, effective)
        health = r[8] if r[8] is not None else max(0, health - effective)
    for width in (64, 1_000_000):
        assert {r.event_id: (r.health_before, r.effective) for r in clamp_damage(df, frame, width).collect()} == wanted


def test_interval_index_finds_every_overlap(spark):
    rng = random.Random(7)
    spans = [("m", "r", i, a, None if i % 9 == 0 else a + rng.randrange(200), "smoke") for i in range(300) for a in [rng.randrange(5000)]]
    ranges = [("m", "r", i, a, a + 63) for i, a in enumerate(range(0, 5200, 64))]
    effects = spark.createDataFrame(spans, "match_id string, round_id string, effect_id long, start_tick int, end_tick int, effect_type string")
    slices = spark.createDataFrame(ranges, "match_id string, round_id string, slice long, first_tick int, last_tick int")
    got = I.effects_in_ranges(slices, effects)
    assert {(r.slice, r.effect_id) for r in got.collect()} == {(s[2], e[2]) for s in ranges for e in spans if e[3] <= s[4] and (e[4] is None or e[4] >= s[3])}


def test_buy_classes(spark):
    rows = [(True, 21000, 0, 5, False, "full"), (True, 100, 0, 0, False, "pistol"), (True, 9000, 12000, 5, False, "force"), (True, 7000, 4000, 5, False, "eco"), (True, 9000, 4000, 5, False, "semi"), (True, 7000, 6000, 5, False, "unknown"), (False, 21000, 0, 5, False, "unknown"), (True, 8000, 0, 12, True, "semi")]
    df = spark.createDataFrame(rows, "e boolean, v int, s int, t int, o boolean, want string")
    got = df.select("want", buy_class(F.col("e"), F.col("v"), F.col("s"), F.col("t"), F.col("o"), EconomyConfig()).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_bootstrap_bounds_match_plain_python(spark):
    rows = [("p", f"m{i}", i, 5, i / 5) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "pattern_id string, match_id string, numerator bigint, denominator bigint, frequency double")
    cfg = N.TrustConfig(iterations=200)
    seed, est, counter = hashlib.sha256(b"p:trust-v1").digest(), [], 0
    for _ in range(200):
        pick = []
        for _ in rows:
            pick.append(rows[int.from_bytes(hashlib.sha256(seed + counter.to_bytes(8, "big")).digest()[:8], "big") % 4])
            counter += 1
        est.append(sum(r[2] for r in pick) / sum(r[3] for r in pick))
    est.sort()
    alpha = (1 - cfg.confidence) / 2
    for size in (100, 33, 500):  # how iterations are dealt doesn't change the bounds
        got = N.bootstrap_interval(df, replace(cfg, slice=size)).first()
        assert (got.lower_bound, got.upper_bound) == (min(est[int(alpha * 199)], 0.5), max(est[int((1 - alpha) * 199)], 0.5))


def test_bootstrap_of_many_patterns_parts_and_clusters(spark):
    """Bounds of patterns with two and with many clusters, whole and in parts, are those of all draws made one by one."""
    rng = random.Random(5)
    rows = [(p, f"m{i:03}", (x := rng.randrange(9)), x + rng.randrange(1, 9), 0.0) for p, n in (("a", 2), ("b", 2), ("c", 37), ("d", 3), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "pattern_id string, match_id string, numerator bigint, denominator bigint, frequency double")
    want, cfg = {}, N.TrustConfig(iterations=300)
    alpha = (1 - cfg.confidence) / 2
    for p in "abcd":
        seed, cl = hashlib.sha256(f"{p}:trust-v1".encode()).digest(), [r[2:4] for r in rows if r[0] == p]
        drawn = [cl[int.from_bytes(hashlib.sha256(seed + at.to_bytes(8, "big")).digest()[:8], "big") % len(cl)] for at in range(300 * len(cl))]
        est = sorted(sum(x for x, _ in drawn[k:k + len(cl)]) / sum(y for _, y in drawn[k:k + len(cl)]) for k in range(0, len(drawn), len(cl)))
        point = sum(x for x, _ in cl) / sum(y for _, y in cl)
        want[p] = (len(cl), point, min(est[int(alpha * 299)], point), max(est[int((1 - alpha) * 299)], point))
    for size, draws in ((100, 1 << 18), (10, 200), (7, 1)):
        got = N.bootstrap_interval(df, replace(cfg, slice=size, part_draws=draws)).collect()
        assert {r.pattern_id: (r.clusters, r.point, r.lower_bound, r.upper_bound) for r in got} == want


def test_bootstrap_moves_bounds_not_draws(spark):
    """A draw is no row of the plan: a pattern's estimates stay in the task that makes them."""
    df = spark.createDataFrame([("p", f"m{i}", i, 5, i / 5) for i in range(2)], "pattern_id string, match_id string, numerator bigint, denominator bigint, frequency double")
    plan = N.bootstrap_interval(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("MapInArrow") == 1


def test_draws_are_sha256_for_any_counter_and_block(monkeypatch):
    np = pytest.importorskip("numpy")
    from roundscope.functions import seeded

    raw = [hashlib.sha256(bytes([i])).digest() for i in range(3)]
    seeds = np.array([np.frombuffer(x, ">u4") for x in raw]).astype(np.uint32)
    for first in (0, 2**32 - 3, 2**62):
        want = [[int.from_bytes(hashlib.sha256(x + (first + i).to_bytes(8, "big")).digest()[:8], "big") for i in range(7)] for x in raw]
        assert seeded.digests(seeds, first, 7).tolist() == want
    above = np.arange(33).reshape(3, 11) % 5
    whole = seeded.resampled(seeds, above, above + 1, 3, 40).tolist()
    for block in (4, 11, 64):  # blocks smaller than a resample, as large, and larger
        monkeypatch.setattr(seeded, "BLOCK", block)
        assert seeded.resampled(seeds, above, above + 1, 3, 40).tolist() == whole


def test_sign_test_tail(spark):
    df = spark.createDataFrame([(3, 3), (5, 7), (0, 4), (0, 0)], "k bigint, n bigint")
    got = [round(r[0], 9) for r in df.select(N.upper_tail(F.col("k"), F.col("n"))).collect()]
    assert got == [0.125, round(29 / 128, 9), 1.0, 1.0]


def test_q_values(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.5)], "fam string, pattern_id string, p_value double")
    got = {r.pattern_id: round(r.q_value, 6) for r in N.q_values(df, ["fam"]).collect()}
    assert got == {"a": 0.04, "c": 0.053333, "b": 0.053333, "d": 0.5}


def test_sign_test_of_long_series(spark):
    from roundscope.plans.trust import upper_tail

    rows = spark.createDataFrame([(5, 1100), (1100, 2000), (7, 10), (0, 0)], "k long, n long").select(upper_tail(F.col("k"), F.col("n")).alias("p")).collect()
    exact = sum(math.comb(2000, i) for i in range(1100, 2001)) / 2**2000
    assert [round(r.p, 9) for r in rows] == [1.0, round(exact, 9), round(176 / 1024, 9), 1.0]


def test_recent_zoned_sample_is_not_hidden(spark):
    """A newer sample without zone, of the other side or of a dead player hides none; age counts by the clock; two zones give none."""
    rows = [("p", 90, "mid", "T", True), ("p", 95, None, "T", True), ("p", 96, "b", "CT", True), ("p", 97, "b", "T", False), ("p", 300, "a", "T", True), ("p", 300, "b", "T", True)]
    s = spark.createDataFrame([("m", "r", *x) for x in rows], "match_id string, round_id string, player_id string, tick int, zone_id string, side string, alive boolean")
    q = spark.createDataFrame([("m", "r", "p", "T", t, 1 / 64) for t in (100, 122, 123, 300)], "match_id string, round_id string, player_id string, side string, tick int, seconds_per_tick double")
    assert {r.tick: (r.sample_tick, r.zone_id) for r in O.recent_zoned(q, s).collect()} == {100: (90, "mid"), 122: (90, "mid")}
    slow = q.where("tick = 300").withColumn("seconds_per_tick", F.lit(0.001)).withColumn("tick", F.lit(590))
    assert O.recent_zoned(slow, s.where("tick < 100")).collect()[0].sample_tick == 90


def test_contacts_of_the_live_round(spark):
    """Damage before the live start or after the end, of team mates, of outsiders or of no health is no contact."""
    hits = [(50, "a", "x", 9), (100, "a", "x", 0), (110, "a", "b", 9), (120, "o", "x", 9), (130, "x", "a", 9), (400, "a", "x", 9)]
    d = spark.createDataFrame([("m", "r", t, i, a, v, "ak47", h) for i, (t, a, v, h) in enumerate(hits)],
                              "match_id string, round_id string, tick int, event_id long, attacker_player_id string, victim_player_id string, weapon string, damage_health int")
    kinds = [(140, False, False), (150, True, False), (160, None, True), (170, None, None)]
    k = spark.createDataFrame([("m", "r", t, 100 + t, "a", "x", "awp", mate, own) for t, mate, own in kinds],
                              "match_id string, round_id string, tick int, event_id long, attacker_player_id string, victim_player_id string, weapon string, is_teamkill boolean, is_suicide boolean")
    view = spark.createDataFrame([("m", "r", 90, 300), ("m", "r", 90, 300)], "match_id string, round_id string, live_tick int, last_tick int")
    people = spark.createDataFrame([("m", "r", p, t) for p, t in (("a", "1"), ("b", "1"), ("x", "2"))], "match_id string, round_id string, player_id string, team_id string")
    plan = object.__new__(O.Tactical)
    plan.v, plan.members, plan.t = view, people, SimpleNamespace(damages=d, kills=k)
    assert sorted(r.tick for r in plan.live_contacts.collect()) == [130, 140, 170]


def test_team_name_of_a_former_nickname(spark):
    """A clan name `team_<name>` counts if any name that a member is known by is <name>, not the current one only."""
    marks = spark.createDataFrame([("m", "round_start", i * 100, "team_Fox", "team_nobody") for i in range(3)], "match_id string, source_event string, tick int, t_clan string, ct_clan string")
    rounds = spark.createDataFrame([("m", f"r{i}", i + 1, i * 100, i * 100 + 5, i * 100 + 90, "a", "b") for i in range(3)],
                                   "match_id string, round_id string, round_number int, start_tick int, freeze_end_tick int, end_tick int, t_team_id string, ct_team_id string")
    players = spark.createDataFrame([("m", "a", "now", ["fox", "now"]), ("m", "b", "other", ["other"])], "match_id string, team_id string, current_name string, known_names array<string>")
    got = {r.team_id: r.display_name for r in D.team_names(marks, rounds, players).collect()}
    assert got == {"a": "team_Fox", "b": None}
    assert {r.display_name for r in D.team_names(marks, rounds, players.drop("known_names")).collect()} == {None}
