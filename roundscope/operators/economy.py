"""Freeze-end equipment, team roll-up and purchase classes."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EconomyConfig
from ..functions.common import count_if, reasons, truth

KEY = ["match_id", "round_id"]
# Inventory names that are utility, and those that are neither utility nor weapon.
UTILITY_NAMES = ("decoy", "decoygrenade", "flashbang", "hegrenade", "incgrenade", "incendiarygrenade", "molotov", "smoke", "smokegrenade")
NON_WEAPON_NAMES = ("assaultsuit", "c4", "defuser", "heavyassaultsuit", "helmet", "kevlar", "vest", "vesthelm")


def item_key(name: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.lower(name), "weapon_|item_", ""), F.lit("_"), F.lit("")))


def split_inventory(items: Column) -> tuple[Column, Column]:
    """Weapons and utility of an inventory array; the rest is dropped."""
    utility = F.filter(items, lambda i: item_key(i).isin(*UTILITY_NAMES))
    weapons = F.filter(items, lambda i: ~item_key(i).isin(*UTILITY_NAMES, *NON_WEAPON_NAMES))
    return weapons, utility


def active_members(rounds: DataFrame, memberships: DataFrame) -> DataFrame:
    """Membership covering the freeze end, the latest start per player and side team."""
    sides = F.array(F.struct(F.col("t_team_id").alias("team_id"), F.lit("T").alias("side")), F.struct(F.col("ct_team_id").alias("team_id"), F.lit("CT").alias("side")))
    r = rounds.select(*KEY, "round_number", "freeze_end_tick", "is_warmup", "is_complete", "is_overtime", "score_status", "score_t_before", "score_ct_before", F.inline(sides))
    m = memberships.select("match_id", "team_id", "player_id", F.col("side").alias("member_side"), "valid_from_tick", "valid_to_tick")
    hit = r.join(m, ["match_id", "team_id"]).where("valid_from_tick <= freeze_end_tick AND (valid_to_tick IS NULL OR freeze_end_tick <= valid_to_tick)")
    best = F.max(F.struct("valid_from_tick", "member_side")).alias("b")
    return hit.groupBy(*KEY, "round_number", "freeze_end_tick", "team_id", "side", "player_id").agg(best, F.first("is_warmup").alias("is_warmup"), F.first("is_complete").alias("is_complete"))\
        .withColumn("member_side", F.col("b.member_side")).drop("b")


class Economy:
    def __init__(self, tables, cfg: EconomyConfig = EconomyConfig(), team_size: int = 5):
        self.t, self.cfg, self.team_size = tables, cfg, team_size

    @cached_property
    def members(self) -> DataFrame:
        return active_members(self.t.rounds, self.t.memberships)

    @cached_property
    def samples(self) -> DataFrame:
        """Exactly one sample per (tick, player); repeated samples are reported, not picked."""
        cols = ["current_equip_value", "cash_spent", "balance", "has_helmet", "has_defuser", "team_num", "item_a", "item_b"]
        packed = F.struct(*cols)
        g = self.t.economy_samples.groupBy("match_id", "tick", "player_id").agg(F.count("*").alias("copies"), F.first(packed).alias("s"))
        return g.select("match_id", F.col("tick").alias("freeze_end_tick"), "player_id", "copies", F.when(F.col("copies") == 1, F.col("s")).alias("s"))

    @cached_property
    def players(self) -> DataFrame:
        p = self.members.join(self.samples, ["match_id", "freeze_end_tick", "player_id"], "left")
        want = F.when(F.col("side") == "T", 2).otherwise(3)
        ex = reasons((F.col("is_warmup"), "warmup_round"), (~F.col("is_complete"), "incomplete_round"), (F.col("s").isNull(), "freeze_end_player_sample_unavailable"),
                     (F.col("member_side") != F.col("side"), "canonical_membership_side_conflict"), (F.col("s.team_num") != want, "source_team_number_conflict"))
        inv = F.array_compact(F.array("s.item_a", "s.item_b"))
        weapons, utility = split_inventory(inv)
        have = F.col("s").isNotNull()
        return p.select(*KEY, "round_number", "freeze_end_tick", "team_id", "side", "player_id", F.col("s.current_equip_value").alias("equipment_value"), F.col("s.cash_spent").alias("cash_spent"),
                        F.col("s.balance").alias("balance"), F.col("s.has_helmet").alias("has_helmet"), F.col("s.has_defuser").alias("has_defuser"), F.col("s.team_num").alias("team_num"),
                        F.when(have, weapons).alias("weapons"), F.when(have, utility).alias("utility"), ex.alias("exclusion_reasons"),
                        truth(F.col("copies") > 1).alias("duplicate_sample"))

    @cached_property
    def teams(self) -> DataFrame:
        """Sums with availability, and the purchase class."""
        col = F.col

        def have(c):
            return F.count(c).alias(f"{c}_n")

        g = self.players.groupBy(*KEY, "team_id", "side").agg(
            F.count("*").alias("player_count"), count_if(F.size("exclusion_reasons") > 0).alias("bad_players"),
            *[F.sum(c).alias(c) for c in ("equipment_value", "cash_spent", "balance")], *[have(c) for c in ("equipment_value", "cash_spent", "balance", "has_helmet", "has_defuser", "weapons")],
            count_if(col("has_helmet")).alias("helmets"), count_if(col("has_defuser")).alias("kits"), F.sort_array(F.flatten(F.collect_list("weapons"))).alias("weapons"),
            F.sort_array(F.flatten(F.collect_list("utility"))).alias("utility"), F.min("team_num").alias("_lo"), F.max("team_num").alias("_hi"), F.count("team_num").alias("_tn"))
        sides = F.array(F.struct(col("t_team_id").alias("team_id"), F.lit("T").alias("side"), col("score_t_before").alias("score_for"), col("score_ct_before").alias("score_against")),
                        F.struct(col("ct_team_id").alias("team_id"), F.lit("CT").alias("side"), col("score_ct_before").alias("score_for"), col("score_t_before").alias("score_against")))
        r = self.t.rounds.select(*KEY, "round_number", "is_warmup", "is_complete", "is_overtime", "score_status", "freeze_end_tick", F.inline(sides))
        t = r.join(g, KEY + ["team_id", "side"], "left").fillna(0, ["player_count", "bad_players", "equipment_value_n", "cash_spent_n", "balance_n", "has_helmet_n", "has_defuser_n", "helmets", "kits"])
        n = col("player_count")

        def status(c):
            return F.when((n > 0) & (col(c) == n), "available").when(col(c) > 0, "partial").otherwise("unresolved")

        t = t.withColumn("equipment_status", status("equipment_value_n")).withColumn("spent_status", status("cash_spent_n")).withColumn("helmet_status", status("has_helmet_n"))
        t = t.withColumn("consensus_team_num", F.when((col("_tn") == n) & (col("_lo") == col("_hi")), col("_lo")))
        ex = reasons((col("is_warmup"), "warmup_round"), (~col("is_complete"), "incomplete_round"), (col("freeze_end_tick").isNull(), "freeze_end_tick_unavailable"),
                     (col("team_id").isNull(), "physical_team_unresolved"), (n != self.team_size, "roster_size_mismatch"),
                     (col("bad_players") > 0, "player_snapshot_ineligible"), (col("equipment_status") != "available", "complete_equipment_value_unavailable"))
        t = t.withColumn("exclusion_reasons", ex).withColumn("eligible", F.size("exclusion_reasons") == 0)
        ok_score = (col("score_status") == "available") & col("score_for").isNotNull() & col("score_against").isNotNull()
        t = t.withColumn("buy_type", buy_class(col("eligible"), col("equipment_value"), F.when(col("spent_status") == "available", col("cash_spent")),
                                               F.when(ok_score, col("score_for") + col("score_against")), col("is_overtime"), self.cfg))
        return t.select(*KEY, "round_number", "team_id", "side", "player_count", F.when(col("equipment_value_n") > 0, col("equipment_value")).alias("equipment_value"), "equipment_status",
                        "cash_spent", "spent_status", "balance", F.when(col("has_helmet_n") > 0, col("helmets")).alias("helmet_count"), "helmet_status",
                        F.when(col("has_defuser_n") > 0, col("kits")).alias("defuse_kit_count"), "consensus_team_num", "weapons", "utility", "eligible", "exclusion_reasons", "buy_type")

    def buy_counts(self) -> DataFrame:
        """Counts per buy type and per side and buy type in one pass."""
        g = self.teams.groupingSets([["match_id", "buy_type"], ["match_id", "side", "buy_type"]], "match_id", "side", "buy_type").agg(F.count("*").alias("team_rounds"))
        return g.select("match_id", F.coalesce("side", F.lit("ALL")).alias("side"), "buy_type", "team_rounds")

    def side_by_side(self) -> DataFrame:
        cols = ["equipment_value", "cash_spent", "buy_type"]
        p = self.teams.groupBy(*KEY, "round_number").pivot("side", ["T", "CT"]).agg(*[F.first(c).alias(c) for c in cols])
        return p.select(*KEY, "round_number", *[F.col(f"{s}_{c}").alias(f"{s.lower()}_{c}") for s in ("T", "CT") for c in cols])


def buy_class(eligible: Column, value: Column, spent: Column, score_total: Column, overtime: Column, cfg: EconomyConfig) -> Column:
    return (F.when(~eligible | value.isNull(), "unknown").when(truth(~overtime & score_total.isin(0, 12)), "pistol").when(value >= cfg.full_buy, "full")
            .when(truth(spent >= cfg.force_spent), "force").when(truth((value <= cfg.eco_value) & (spent <= cfg.eco_spent)), "eco")
            .when(value > cfg.eco_value, "semi").otherwise("unknown"))
