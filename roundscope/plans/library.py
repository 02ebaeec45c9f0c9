"""Match library, overview, scores and data-layer readiness."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import count_if, reasons, union_all


def library(matches: DataFrame, teams: DataFrame, search: str = "", sort: str = "newest", page: int = 1, page_size: int = 24) -> DataFrame:
    """One page of matches whose map or team name contains the text."""
    text = search.strip().lower()
    if text:
        by_team = teams.where(F.lower("team_name").contains(text)).select("match_id").distinct().withColumn("hit", F.lit(True))
        matches = matches.join(by_team, "match_id", "left").where(F.col("hit") | F.lower("map_name").contains(text)).drop("hit")
    order = {"newest": [F.desc("match_no")], "oldest": [F.asc("match_no")], "map": [F.asc("map_name"), F.desc("match_no")]}[sort]
    return matches.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def library_count(matches: DataFrame, teams: DataFrame, search: str = "") -> DataFrame:
    text = search.strip().lower()
    hit = teams.where(F.lower("team_name").contains(text)).select("match_id").distinct().withColumn("hit", F.lit(True))
    return matches.join(hit, "match_id", "left").agg(count_if(F.col("hit") | F.lower("map_name").contains(text)).alias("total"))


def team_scores(rounds: DataFrame) -> DataFrame:
    """Last known score of each physical team, whichever side it played."""
    sides = F.array(F.struct(F.col("t_team_id").alias("team_id"), F.col("score_t_after").alias("score")), F.struct(F.col("ct_team_id").alias("team_id"), F.col("score_ct_after").alias("score")))
    s = rounds.select("match_id", "round_number", F.inline(sides)).where("team_id IS NOT NULL AND score IS NOT NULL")
    return s.groupBy("match_id", "team_id").agg(F.max_by("score", "round_number").alias("score"))


def overview(rounds: DataFrame, bombs: DataFrame, openings: DataFrame, trades: DataFrame, player_matches: DataFrame) -> DataFrame:
    r = rounds.groupBy("match_id").agg(F.count("*").alias("rounds"), count_if(F.col("is_complete")).alias("complete_rounds"))
    b = bombs.groupBy("match_id").agg(count_if(F.lower("event_type").contains("plant")).alias("plants"), count_if(F.lower("event_type").contains("defus")).alias("defuses"))
    o = openings.groupBy("match_id").agg(F.count("*").alias("opening_duels"))
    t = trades.groupBy("match_id").agg(F.count("*").alias("trades"))
    p = player_matches.groupBy("match_id").agg(F.count("*").alias("players"), F.sum("kills").alias("kills"), F.max("adr").alias("best_adr"))
    s = team_scores(rounds).groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("team_id", "score"))).alias("s"))
    for x in (b, o, t, p, s):
        r = r.join(x, "match_id", "left")
    score = F.when(F.size("s") == 2, F.concat_ws(":", F.col("s")[0]["score"], F.col("s")[1]["score"])).otherwise("-")
    return r.withColumn("score", score).drop("s").fillna(0, ["plants", "defuses", "opening_duels", "trades", "players", "kills"])


def player_events(kills: DataFrame, grenades: DataFrame, player_id: str | None = None) -> DataFrame:
    """Kills in any role and grenades of a player (all players when no id is given)."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_player_id").alias("player_id")) for r in ("attacker", "victim", "assister")])
    k = kills.select("match_id", "round_number", "tick", "event_id", F.lit("kill").alias("kind"), F.inline(roles)).where("player_id IS NOT NULL")
    out = union_all(k, grenades.select("match_id", "round_number", "tick", "event_id", F.lit("grenade").alias("kind"), F.lit("thrower").alias("role"), "player_id"))
    if player_id is not None:
        out = out.where(F.col("player_id") == player_id)
    return out.orderBy("match_id", "round_number", "tick", "event_id", "role")


def layer_readiness(matches: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """blocked / limited / ready from layer(match_id, status) tables; ``canonical`` decides blocking."""
    q = matches.select("match_id")
    for n, df in layers.items():
        q = q.join(df.select("match_id", F.col("status").alias(f"{n}_status")), "match_id", "left").fillna("unavailable", [f"{n}_status"])
    rest = [n for n in layers if n != "canonical"]

    def off(n) -> Column:
        return F.col(f"{n}_status") == "unavailable"

    missing = reasons(*[(off(n), n) for n in rest])
    part = F.col("spatial_status").isin("partial", "unreliable") if "spatial" in layers else F.lit(False)
    status = F.when(F.col("canonical_status") != "available", "blocked").when((F.size("missing_layers") > 0) | part, "limited").otherwise("ready")
    return q.withColumn("missing_layers", missing).withColumn("readiness", status)
