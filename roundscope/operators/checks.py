"""Integrity checks: each check is one query returning violations, all unioned."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_if, truth, union_all

TICKS = ("start_tick", "freeze_end_tick", "end_tick", "official_end_tick")


def issues(df: DataFrame, code: str, entity: str, entity_id: Column) -> DataFrame:
    return df.select("match_id", F.lit(code).alias("code"), F.lit(entity).alias("entity_type"), entity_id.cast("string").alias("entity_id"))


def round_issues(rounds: DataFrame) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy("round_number")
    r = rounds.withColumn("next_start", F.lead("start_tick").over(w))
    seen = F.array_compact(F.array(*[F.col(c) for c in TICKS]))
    tests = {"negative_round_tick": F.exists(seen, lambda t: t < 0), "round_boundaries_not_monotonic": seen != F.sort_array(seen),
             "rounds_overlap": F.col("end_tick") > F.col("next_start")}
    found = F.array_compact(F.array(*[F.when(truth(c), F.lit(n)) for n, c in tests.items()]))
    return r.select("match_id", F.explode(found).alias("code"), F.lit("round").alias("entity_type"), F.col("round_id").alias("entity_id"))


def event_issues(events: DataFrame, rounds: DataFrame) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy("round_number")
    bounds = rounds.select("match_id", "round_id", "start_tick", F.lead("start_tick").over(w).alias("next_start"))
    dup = events.groupBy("match_id", "event_id").agg(F.count("*").alias("n")).where("n > 1")
    e = events.join(bounds, ["match_id", "round_id"], "left")
    outside = truth(F.col("tick") < F.col("start_tick")) | truth(F.col("tick") >= F.col("next_start"))
    return union_all(issues(dup, "duplicate_event_id", "event", F.col("event_id")), issues(events.where("tick < 0"), "negative_event_tick", "event", F.col("event_id")),
                     issues(e.where(outside), "assigned_event_outside_round_window", "event", F.col("event_id")))


def reference_issues(events: DataFrame, rounds: DataFrame, players: DataFrame, teams: DataFrame, memberships: DataFrame) -> DataFrame:
    def missing(df, column, known, other):
        ref = known.select("match_id", F.col(other).alias(column)).distinct()
        return df.where(F.col(column).isNotNull()).join(ref, ["match_id", column], "left_anti")

    out = [issues(missing(memberships, "player_id", players, "player_id"), "unknown_player_reference", "membership", F.col("player_id")),
           issues(missing(memberships, "team_id", teams, "team_id"), "unknown_team_reference", "membership", F.col("team_id")),
           issues(missing(events, "round_id", rounds, "round_id"), "unknown_round_reference", "event", F.col("event_id")),
           issues(missing(events, "player_id", players, "player_id"), "unknown_player_reference", "event", F.col("event_id")),
           issues(missing(events, "team_id", teams, "team_id"), "unknown_team_reference", "event", F.col("event_id"))]
    out += [issues(missing(rounds, c, teams, "team_id"), "unknown_team_reference", "round", F.col("round_id")) for c in ("t_team_id", "ct_team_id")]
    return union_all(*out)


def quality_issues(events: DataFrame, rounds: DataFrame, players: DataFrame) -> DataFrame:
    """Per match counts turned into issues when they break a rule."""
    p = players.groupBy("match_id").agg(F.count("*").alias("players"), count_if(F.col("steam_id").isNull()).alias("unknown"))
    e = events.groupBy("match_id").agg(count_if(F.col("round_id").isNull()).alias("unassigned"))
    r = rounds.groupBy("match_id").agg(
        count_if(~F.col("is_complete")).alias("incomplete"), F.max(F.struct("round_number", F.col("official_end_tick").isNull().cast("int").alias("open"))).alias("last"),
        count_if(F.col("t_team_id").isNull() | F.col("ct_team_id").isNull()).alias("uncertain"))
    m = r.join(p, "match_id", "left").join(e, "match_id", "left")
    n_players = F.coalesce("players", F.lit(0))
    tests = [("implausible_player_count", F.when((n_players < 2) | (n_players > 64), n_players)), ("unassigned_events", F.col("unassigned")),
             ("unknown_players", F.col("unknown")), ("incomplete_rounds", F.col("incomplete")), ("missing_final_round_end", F.col("last.open")),
             ("side_resolution_uncertainty", F.col("uncertain"))]
    rows = F.array(*[F.struct(F.lit(c).alias("code"), v.cast("long").alias("count")) for c, v in tests])
    return m.select("match_id", F.inline(rows)).where("count > 0")


def contract_counts(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Import contract per table: row count, rows with a repeated key, rows without a key."""
    out = []
    for name, df in tables.items():
        per_key = df.groupBy("match_id", F.col(keys[name]).cast("string").alias("key")).agg(F.count("*").alias("n"))
        out.append(per_key.groupBy("match_id").agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("repeated_rows"),
                                                   F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("missing_keys"))
                   .select("match_id", F.lit(name).alias("table_name"), "row_count", "repeated_rows", "missing_keys"))
    return union_all(*out)


def stats_invariants(stats) -> DataFrame:
    """Cross checks of the derived statistics; an empty result means all hold."""
    pr, tr, op, td, tn, pm = stats.player_rounds, stats.team_rounds, stats.openings, stats.trades, stats.transitions, stats.player_matches
    tm, av = stats.team_matches, stats.availability

    def totals(df, col, label):
        return df.groupBy("match_id").agg(F.sum(col).alias(label))

    want = stats.classified.where("kill_class = 'enemy'").groupBy("match_id").agg(F.count("*").alias("expected"))
    sums = want.join(totals(pr, "kills", "pk"), "match_id", "full").join(totals(tr, "kills", "tk"), "match_id", "full").join(totals(tr, "deaths", "td"), "match_id", "full")
    out = []

    def add(df, code, entity, col):
        out.append(issues(df, code, entity, F.col(col)))

    for code, c in (("player_kill_sum_mismatch", "pk"), ("team_kill_sum_mismatch", "tk"), ("team_death_sum_mismatch", "td")):
        add(sums.where(F.coalesce(c, F.lit(0)) != F.coalesce("expected", F.lit(0))), code, "match", "match_id")
    add(op.groupBy("match_id", "round_id").count().where("count > 1"), "multiple_opening_duels", "round", "round_id")
    add(td.groupBy("match_id", "original_event_id").count().where("count > 1"), "original_kill_traded_multiple_times", "event", "original_event_id")
    add(td.groupBy("match_id", "trade_event_id").count().where("count > 1"), "trade_kill_used_multiple_times", "event", "trade_event_id")
    add(td.where("tick_delta < 0"), "negative_trade_tick_delta", "event", "trade_event_id")
    seconds = stats.cfg.tick_rate is not None
    add(td.where(F.col("seconds_delta").isNull() if seconds else F.col("seconds_delta").isNotNull()),
        "trade_seconds_missing_in_seconds_mode" if seconds else "trade_seconds_asserted_without_seconds_mode", "event", "trade_event_id")
    add(pm.where("kast_rounds > rounds_played"), "kast_exceeds_rounds", "player", "player_id")
    add(pm.where("survival_rounds > rounds_played"), "survival_exceeds_rounds", "player", "player_id")
    want_cat = F.when(F.col("kills") > 5, "five_plus").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("zero", "one", "two", "three", "four", "five")]), F.least(F.col("kills"), F.lit(5)).cast("int") + 1))
    add(pr.where(F.col("multikill_category") != want_cat), "multikill_category_mismatch", "player_round", "player_id")
    add(tn.where("least(t_alive_before, t_alive_after, ct_alive_before, ct_alive_after) < 0"), "negative_alive_count", "event", "event_id")
    v = tn.join(stats.members.select("round_id", F.col("player_id").alias("victim_player_id"), F.col("side").alias("victim_side")), ["round_id", "victim_player_id"], "left")
    add(v.where("victim_side IS NULL"), "advantage_victim_not_participant", "event", "event_id")
    drop = F.when(F.col("death_class") == "repeated", 0).otherwise(1)
    t_drop, ct_drop = F.when(F.col("victim_side") == "T", drop).otherwise(0), F.when(F.col("victim_side") == "CT", drop).otherwise(0)
    add(v.where((F.col("t_alive_after") != F.greatest(F.lit(0), F.col("t_alive_before") - t_drop)) | (F.col("ct_alive_after") != F.greatest(F.lit(0), F.col("ct_alive_before") - ct_drop))),
        "advantage_victim_team_mismatch", "event", "event_id")
    add(tr.where("traded_deaths + untraded_deaths <> deaths"), "team_trade_death_sum_mismatch", "team_round", "team_id")
    win = av.where("metric = 'win_conversion_metrics'").select("match_id", F.col("status").alias("win_status"), F.col("covered"))
    wins = tr.groupBy("match_id").agg(count_if(F.col("round_won")).alias("wins")).join(win, "match_id")
    add(wins.where("win_status = 'available' AND wins <> covered"), "team_round_win_coverage_mismatch", "match", "match_id")
    add(pm.join(win, "match_id").where("win_status <> 'available' AND (opening_kill_round_wins IS NOT NULL OR opening_conversion_percentage IS NOT NULL)"),
        "opening_conversion_without_winner", "player", "player_id")
    add(tr.join(win, "match_id").where("win_status <> 'available' AND coalesce(round_won, opening_kill_converted, recovered_after_opening_death, converted_first_advantage, "
                                       "recovered_after_first_disadvantage, converted_plus_two, post_plant_won) IS NOT NULL"),
        "team_conversion_without_winner", "team_round", "team_id")
    add(tm.join(win, "match_id").where("win_status <> 'available' AND coalesce(round_wins, opening_conversion_percentage, opening_recovery_percentage, "
                                       "first_advantage_conversion_percentage, first_disadvantage_recovery_percentage, plus_two_conversion_percentage, post_plant_conversion_percentage) IS NOT NULL"),
        "match_conversion_without_winner", "team", "team_id")
    tra = av.where("metric = 'trade_metrics'").select("match_id", F.col("status").alias("trade_status"))
    add(pm.join(tra, "match_id").where("trade_status = 'unavailable' AND coalesce(trade_success_percentage, traded_kills, traded_deaths, kast_rounds, kast_percentage) IS NOT NULL"),
        "trade_metric_serialized_when_unavailable", "player", "player_id")
    add(tm.join(tra, "match_id").where("trade_status = 'unavailable' AND coalesce(trade_percentage, trade_opportunities, untraded_deaths) IS NOT NULL"),
        "team_match_trade_serialized_when_unavailable", "team", "team_id")
    return union_all(*out)
