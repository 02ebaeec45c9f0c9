"""Cleaning of raw landing rows: ``raw(match_id, source_event, data map<string,string>)``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import once

# Field spellings, side names, grenade and bomb source events, site names.
WARMUP = ("is_warmup_period", "is_warmup", "warmup")
MARKERS = ("total_rounds_played", "round_number", "round_num", "round")
TICKS = ("tick", "event_tick")
T_NAMES = ("2", "t", "terrorist", "terrorists", "team_t")
CT_NAMES = ("3", "ct", "counter-terrorist", "counter-terrorists", "team_ct")
TRUE_WORDS = ("1", "true", "yes", "y")
FALSE_WORDS = ("0", "false", "no", "n")
GRENADE_EVENTS = {
    "smokegrenade_detonate": ("smoke", "detonated"), "smokegrenade_expired": ("smoke", "expired"),
    "inferno_startburn": ("inferno", "started"), "inferno_expire": ("inferno", "expired"),
    "flashbang_detonate": ("flashbang", "detonated"), "hegrenade_detonate": ("he_grenade", "detonated"),
    "decoy_detonate": ("decoy", "detonated"),
}
BOMB_EVENTS = {"bomb_planted": "planted", "bomb_defused": "defused", "bomb_exploded": "exploded"}
SITES = {"a": "A", "bombsite_a": "A", "site_a": "A", "b": "B", "bombsite_b": "B", "site_b": "B"}
PRESENCE = ("player_connect_full", "player_disconnect")
PLAYER_LIST = "player_info"
ROLES = {"player_death": ("attacker", "victim", "assister"), "player_hurt": ("attacker", "victim"), "player_blind": ("attacker", "user")}


def alias_column(df: DataFrame, aliases: tuple[str, ...]) -> Column:
    """First existing column among the aliases, case-insensitive; NULL if none exists."""
    known = {c.lower(): c for c in df.columns}
    hit = next((known[a.lower()] for a in aliases if a.lower() in known), None)
    return F.col(hit) if hit else F.lit(None).cast("string")


def field(*aliases: str) -> Column:
    """First alias that the lower-cased ``data`` map has, whatever its value: a NULL there is not replaced by a later alias."""
    data = F.col("data")
    out = F.when(F.map_contains_key(data, aliases[0].lower()), data[aliases[0].lower()])
    for a in aliases[1:]:
        out = out.when(F.map_contains_key(data, a.lower()), data[a.lower()])
    return out


def optional_text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def optional_int(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("bigint"))


def non_negative_int(c: Column) -> Column:
    v = optional_int(c)
    return F.when(v >= 0, v)


def optional_float(c: Column) -> Column:
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def non_negative_float(c: Column) -> Column:
    v = optional_float(c)
    return F.when(v >= 0, v)


def optional_bool(c: Column) -> Column:
    w = F.lower(F.trim(c))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def normalize_side(c: Column) -> Column:
    w = F.lower(F.trim(c))
    return F.when(w.isin(*T_NAMES), "T").when(w.isin(*CT_NAMES), "CT").otherwise("UNKNOWN")


def steam_id(c: Column) -> Column:
    v = F.regexp_replace(F.trim(c), r"^([0-9]+)\.0$", "$1")
    return F.when(v.rlike("^[0-9]{1,32}$") & ~v.rlike("^0+$"), v)


def normalize_site(c: Column) -> Column:
    pairs = [F.lit(x) for kv in SITES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(optional_text(c)))


def lowered(raw: DataFrame) -> DataFrame:
    return once(raw, data=F.transform_keys("data", lambda k, _: F.lower(k)))


def payload(data: Column) -> Column:
    """Canonical JSON text of a row, independent of key order."""
    return F.to_json(F.sort_array(F.map_entries(data)))


def stable_rows(raw: DataFrame) -> DataFrame:
    """Rows with tick, payload hash and row key; warm-up rows go, those of the player list stay."""
    df = once(raw, row_hash=F.sha2(payload(F.col("data")), 256), data=F.transform_keys("data", lambda k, _: F.lower(k)))
    df = once(df, warm=F.coalesce(optional_bool(field(*WARMUP)), F.lit(False)), tick=non_negative_int(field(*TICKS)).cast("int"))
    df = df.where((F.col("source_event") == PLAYER_LIST) | ~F.col("warm")).drop("warm")
    return numbered_copies(df, ["match_id", "source_event", "row_hash"], keep=["data", "tick"]).withColumn("row_key", F.concat_ws(":", "row_hash", "ordinal"))


def numbered_copies(rows: DataFrame, keys: list[str], chunk: int = 100_000, keep: list[str] | None = None) -> DataFrame:
    """Row key = hash plus duplicate ordinal; ``keep`` names columns that equal rows have in common.

    Copies are identical, so they are counted with map-side combine and expanded again;
    a huge group of copies is expanded in chunks spread over the cluster.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in keep or []])
    few = counted.where(F.col("copies") <= chunk).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    parts = counted.where(F.col("copies") > chunk).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / chunk))))
    parts = parts.repartition(*keys, "part")
    first, last = F.col("part") * chunk, F.least((F.col("part") + 1) * chunk, F.col("copies")) - 1
    many = parts.withColumn("ordinal", F.explode(F.sequence(first, last))).drop("part")
    return few.unionByName(many).drop("copies")


def player_key(match: Column, steam: Column, name: Column, source: Column, row_key: Column, role_name: Column) -> Column:
    """One id per platform id; rows without one keep an id of their own."""
    known = F.concat_ws(":", match, F.lit("player"), F.lit("steam"), steam)
    loose = F.concat_ws(":", match, F.lit("player"), F.lit("unknown"), source, row_key, role_name, F.coalesce(name, F.lit("")))
    return F.when(steam.isNotNull(), F.sha2(known, 256)).when(name.isNotNull() | (source == PLAYER_LIST), F.sha2(loose, 256))


def role_rows(rows: DataFrame) -> DataFrame:
    """One row per present role: the raw texts are unpivoted first, then cleaned once.  Connections count only with a platform id."""
    death, pair, other = F.col("source_event") == "player_death", F.col("source_event").isin("player_death", "player_hurt"), F.col("source_event").isin(*ROLES)

    def texts(name: str, prefix: str, used: Column) -> Column:
        sid, nm = field(f"{prefix}_steamid", f"{prefix}_steam_id"), field(f"{prefix}_name")
        side, bot = field(f"{prefix}_team_name", f"{prefix}_team"), field(f"{prefix}_isbot", f"{prefix}_is_bot")
        if name == "user":
            plain = steam_id(sid).isNull() & optional_text(nm).isNull()
            sid, nm = F.when(plain, field("steamid", "steam_id", "player_steamid")).otherwise(sid), F.when(plain, field("name", "player_name")).otherwise(nm)
            side, bot = F.when(plain, field("team_name", "team", "player_team")).otherwise(side), F.when(plain, field("isbot", "is_bot")).otherwise(bot)
        return F.when(used, F.struct(F.lit(name).alias("role"), sid.alias("sid"), nm.alias("nm"), side.alias("sd"), bot.alias("bt")))

    items = F.array_compact(F.array(texts("attacker", "attacker", other), texts("victim", "user", pair), texts("assister", "assister", death), texts("user", "user", ~pair)))
    out = rows.select("match_id", "source_event", "tick", "row_key", F.inline(items))
    out = once(out, steam=steam_id(F.col("sid")), name=optional_text(F.col("nm")))
    out = out.where(~F.col("source_event").isin(*PRESENCE) | F.col("steam").isNotNull())
    pid = player_key(F.col("match_id"), F.col("steam"), F.col("name"), F.col("source_event"), F.col("row_key"), F.col("role"))
    return once(out, player_id=pid).select("match_id", "source_event", "tick", "row_key", "role", "steam", "name", normalize_side(F.col("sd")).alias("side"),
                      F.coalesce(optional_bool(F.col("bt")), F.lit(False)).alias("is_bot"), "player_id").where("player_id IS NOT NULL")


def event_profile(raw: DataFrame) -> DataFrame:
    """Per event name and field: rows with the field, missing values, rows without a usable tick, distinct players.

    Fields are unpivoted and counted with map-side combine; players are distinct (event, id) pairs before they are counted.
    """
    df = lowered(raw)
    text = F.lower(F.trim("value"))
    fields = df.select("source_event", F.explode("data").alias("field", "value")).groupBy("source_event", "field").agg(
        F.count("*").alias("present"), F.count_if(F.col("value").isNull() | (text == "")).alias("missing"))
    per = df.groupBy("source_event").agg(F.count("*").alias("row_count"), F.count_if(non_negative_int(field(*TICKS)).isNull()).alias("missing_tick"))
    ids = df.select("source_event", F.explode(F.array(
        steam_id(field("attacker_steamid", "attacker_steam_id")), steam_id(field("user_steamid", "user_steam_id")), steam_id(field("steamid", "steam_id", "player_steamid")))).alias("steam"))
    players = ids.where("steam IS NOT NULL").distinct().groupBy("source_event").agg(F.count("*").alias("player_count"))
    return fields.join(per, "source_event").join(players, "source_event", "left").fillna(0, ["player_count"])


EVENT = ["event_id", "match_id", "round_id", "round_number", "tick", "relative_tick", "phase"]


def normalize_events(rows: DataFrame, roles: DataFrame, rounds: DataFrame, players: DataFrame) -> DataFrame:
    """Rows of every family with round, phase, and each role's player, team and side.

    ``players(match_id, player_id, team_id, spans)`` is joined to the role rows on both keys, so players without a platform id, of whom there are as
    many as rows, never pile up in one row of a match.  A side that the row doesn't tell is that of the player's membership at its tick.
    """
    from .rounds import assign_rounds

    r = roles.where("tick IS NOT NULL").join(players, ["match_id", "player_id"], "left")
    span = F.expr("try_element_at(filter(spans, s -> tick >= s.valid_from_tick AND (s.valid_to_tick IS NULL OR tick <= s.valid_to_tick)), 1).side")
    side = F.when(F.col("side") != "UNKNOWN", F.col("side")).otherwise(F.coalesce(span, F.lit("UNKNOWN")))
    who = F.struct("player_id", "team_id", side.alias("side"))
    names = ("attacker", "victim", "assister", "user")
    wide = r.groupBy("match_id", "source_event", "row_key").agg(*[F.max(F.when(F.col("role") == n, who)).alias(n) for n in names])
    ev = assign_rounds(rows.where("tick IS NOT NULL"), rounds).join(wide, ["match_id", "source_event", "row_key"], "left")
    return ev.select("*", *[c for n in names for c in (F.col(f"{n}.player_id").alias(f"{n}_player_id"), F.col(f"{n}.team_id").alias(f"{n}_team_id"),
                                                       F.coalesce(f"{n}.side", F.lit("UNKNOWN")).alias(f"{n}_side"))]).drop(*names)


def _family(ev: DataFrame, kind: str, rule: Column, *cols) -> DataFrame:
    key = F.concat_ws(":", "match_id", F.lit("event"), F.lit(kind), "source_event", F.col("tick").cast("string"), "row_key")
    return ev.where(rule).select(F.sha2(key, 256).alias("event_id"), *EVENT[1:], *cols)


def _of(role_name: str, out: str = "") -> list[Column]:
    return [F.col(f"{role_name}_{c}").alias(f"{out}_{c}" if out else c) for c in ("player_id", "team_id", "side")]


def normalize_kills(ev: DataFrame) -> DataFrame:
    a, v = F.col("attacker_player_id"), F.col("victim_player_id")
    same = F.col("attacker_team_id") == F.col("victim_team_id")
    return _family(
        ev, "kill", F.col("source_event") == "player_death", "attacker_player_id", "victim_player_id", "assister_player_id",
        "attacker_team_id", "victim_team_id", "attacker_side", "victim_side", optional_text(field("weapon")).alias("weapon"),
        optional_bool(field("headshot")).alias("headshot"), non_negative_int(field("penetrated")).alias("penetrated"),
        non_negative_float(field("distance")).alias("distance"),
        F.coalesce(a == v, F.lit(False)).alias("is_suicide"), F.coalesce(same & (a != v), F.lit(False)).alias("is_teamkill"))


def normalize_damages(ev: DataFrame) -> DataFrame:
    return _family(ev, "damage", F.col("source_event") == "player_hurt", *_of("attacker", "attacker"), *_of("victim", "victim"), optional_text(field("weapon")).alias("weapon"),
                   non_negative_int(field("dmg_health")).alias("damage_health"), non_negative_int(field("health")).alias("victim_health_after"))


def normalize_shots(ev: DataFrame) -> DataFrame:
    return _family(ev, "shot", F.col("source_event") == "weapon_fire", *_of("user"), optional_text(field("weapon")).alias("weapon"))


def normalize_blinds(ev: DataFrame) -> DataFrame:
    return _family(ev, "blind", F.col("source_event") == "player_blind", *_of("attacker", "attacker"), *_of("user", "victim"),
                   non_negative_float(field("blind_duration", "duration")).alias("duration_seconds"))


def normalize_grenades(ev: DataFrame) -> DataFrame:
    types = F.create_map(*[x for k, (t, life) in GRENADE_EVENTS.items() for x in (F.lit(k), F.struct(F.lit(t).alias("t"), F.lit(life).alias("l")))])
    kind = types[F.col("source_event")]
    return _family(ev, "grenade", F.col("source_event").isin(*GRENADE_EVENTS), *_of("user"), kind["t"].alias("grenade_type"), kind["l"].alias("lifecycle_event"))


def normalize_bombs(ev: DataFrame) -> DataFrame:
    types = F.create_map(*[F.lit(x) for kv in BOMB_EVENTS.items() for x in kv])
    raw_site = field("site", "bombsite")
    return _family(ev, "bomb", F.col("source_event").isin(*BOMB_EVENTS), *_of("user"), types[F.col("source_event")].alias("event_type"),
                   raw_site.alias("site_raw"), normalize_site(raw_site).alias("site_normalized"))


FAMILIES = {"kills": normalize_kills, "damages": normalize_damages, "shots": normalize_shots, "grenades": normalize_grenades, "blinds": normalize_blinds, "bombs": normalize_bombs}
