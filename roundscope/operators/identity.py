"""Player identity, physical teams, memberships, names and cross-match rosters."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_if, ratio, truth, union_all

# Names that say nothing about a team.
GENERIC_NAMES = ("ct", "counter-terrorist", "counter-terrorists", "counterterrorist", "counterterrorists", "t", "terrorist",
                 "terrorists", "teamalpha", "teambravo", "unknown", "unassigned")
NAME_SOURCES = ("round_freeze_end", "round_start", "round_poststart", "round_prestart", "round_end")
BRACKET_TAG = r"^\[([A-Za-z0-9_-]{2,12})\]"
SEPARATOR_TAG = r"^([A-Za-z0-9_-]{2,12})\s*[|:]\s*"


def player_identities(roles: DataFrame) -> DataFrame:
    """One row per player of a match.  Rows of the player list and rows without tick come before all others."""
    tick = F.when(F.col("source_event") == "player_info", -1).otherwise(F.coalesce("tick", F.lit(-1)))
    named = F.when(F.col("name").isNotNull(), F.struct(tick.alias("t"), F.col("name").alias("n")))
    on, off = (F.when(F.col("source_event") == s, F.col("tick")) for s in ("player_connect_full", "player_disconnect"))
    g = roles.groupBy("match_id", "player_id").agg(
        F.max("steam").alias("steam_id"), F.max(named).alias("latest"), F.sort_array(F.collect_set("name")).alias("known_names"),
        F.bool_or("is_bot").alias("is_bot"), truth(F.max(on) > F.min(off)).alias("reconnect_observed"))
    unknown = F.concat(F.lit("UnknownPlayer-"), F.substring("player_id", 1, 8))
    names = F.when(F.size("known_names") > 0, F.col("known_names")).otherwise(F.array(unknown))
    return g.select("match_id", "player_id", "steam_id", F.coalesce("latest.n", unknown).alias("current_name"), names.alias("known_names"), "is_bot",
                    (F.size("known_names") > 1).alias("nickname_change_observed"), "reconnect_observed", F.col("steam_id").isNull().alias("steam_id_missing"))


def side_observations(roles: DataFrame, rounds: DataFrame) -> DataFrame:
    from .rounds import assign_rounds

    obs = roles.where("tick IS NOT NULL AND side <> 'UNKNOWN'").withColumn("source", F.concat_ws(".", "source_event", "role"))
    return assign_rounds(obs.select("match_id", "player_id", "tick", "side", "source"), rounds).where("round_number IS NOT NULL")


def count_observations(obs: DataFrame) -> DataFrame:
    """Observations per (match, round, side, player) with the earliest one."""
    return obs.groupBy("match_id", "round_number", "side", "player_id").agg(
        F.count("*").alias("n"), F.min(F.struct("tick", "player_id", "source")).alias("at"))


def first_sides(seen: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("at.tick"), F.col("at.source"), "side", "round_number"))
    return seen.groupBy("match_id", "player_id").agg(first.alias("f")).select("match_id", "player_id", F.col("f.round_number").alias("first_round"), F.col("f.side").alias("first_side"))


def seed_teams(firsts: DataFrame) -> DataFrame:
    """Players of the first observed round grouped by side; the id comes from the sorted roster."""
    start = firsts.groupBy("match_id").agg(F.min("first_round").alias("seed_round"))
    g = (firsts.join(start, "match_id").where("first_round = seed_round").groupBy("match_id", "seed_round", "first_side")
         .agg(F.sort_array(F.collect_set("player_id")).alias("starting_player_ids")))
    sig = F.array_join("starting_player_ids", ",")
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy(sig))
    n = F.size("starting_player_ids")
    return g.select("match_id", "seed_round", F.sha2(F.concat_ws(":", "match_id", F.lit("physical-team"), sig), 256).alias("team_id"),
                    F.when(rank == 1, "TeamAlpha").otherwise("TeamBravo").alias("internal_name"), "starting_player_ids",
                    F.when(n >= 2, 1.0).otherwise(0.5).alias("identity_confidence"))


def player_teams(seen: DataFrame, firsts: DataFrame, teams: DataFrame) -> DataFrame:
    """Seed members keep their team; later players join the majority team of their first side.

    A late player counts as known for players arriving after it, so the votes of a match
    are folded in arrival order over pre-counted votes (a roster-sized list).
    """
    seeds = teams.select("match_id", "team_id", F.explode("starting_player_ids").alias("player_id"))
    late = firsts.join(seeds.select("match_id", "player_id"), ["match_id", "player_id"], "left_anti")
    votes = late.join(seen.withColumnRenamed("player_id", "observer"),
                      (late.match_id == seen.match_id) & (late.first_round == seen.round_number) & (late.first_side == seen.side))
    votes = votes.groupBy(late.match_id, "first_round", "player_id").agg(F.collect_list(F.struct("observer", "n", "at")).alias("votes"))
    queue = votes.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("first_round", "player_id", "votes"))).alias("queue"))
    known = seeds.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("player_id", "team_id"))).alias("known"), F.sort_array(F.collect_set("team_id")).alias("team_ids"))
    best = """element_at(transform(array(filter(transform(team_ids, t -> named_struct(
        'n', aggregate(filter(q.votes, v -> s[v.observer] = t), 0L, (x, v) -> x + v.n),
        'at', array_min(transform(filter(q.votes, v -> s[v.observer] = t), v -> v.at)), 'team', t)), c -> c.n > 0)),
        cs -> CASE WHEN size(cs) = 0 THEN NULL WHEN size(cs) = 1 OR cs[0].n > cs[1].n OR (cs[0].n = cs[1].n AND cs[0].at < cs[1].at) THEN cs[0].team ELSE cs[1].team END), 1)"""
    fold = f"aggregate(queue, known, (s, q) -> element_at(transform(array({best}), w -> CASE WHEN w IS NULL THEN s ELSE map_concat(s, map(q.player_id, w)) END), 1))"
    full = known.join(queue, "match_id", "left")
    full = full.withColumn("all", F.when(F.col("queue").isNull(), F.col("known")).otherwise(F.expr(fold)))
    return full.select("match_id", F.explode("all").alias("player_id", "team_id"))


def resolve_sides(rounds: DataFrame, seen: DataFrame, assigned: DataFrame, teams: DataFrame) -> DataFrame:
    """Majority team per side and round, the missing side filled, unseen rounds carried forward."""
    v = seen.join(assigned, ["match_id", "player_id"]).groupBy("match_id", "round_number", "side", "team_id").agg(
        F.sum("n").alias("n"), F.min("at").alias("at"))
    best = v.groupBy("match_id", "round_number", "side").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("at"), F.col("team_id"))).alias("b"))
    pick = best.groupBy("match_id", "round_number").agg(
        F.max(F.when(F.col("side") == "T", F.col("b.team_id"))).alias("t"), F.max(F.when(F.col("side") == "CT", F.col("b.team_id"))).alias("ct"))
    ids = teams.groupBy("match_id").agg(F.sort_array(F.collect_set("team_id")).alias("ids"))
    r = rounds.drop("t_team_id", "ct_team_id").join(pick, ["match_id", "round_number"], "left").join(ids, "match_id", "left")
    two = F.size(F.coalesce("ids", F.array())) == 2

    def other(c):
        return F.when(two, F.when(F.col(c) == F.col("ids")[0], F.col("ids")[1]).otherwise(F.col("ids")[0]))

    t0, ct0 = F.col("t"), F.col("ct")
    r = r.withColumn("t1", F.coalesce(t0, F.when(ct0.isNotNull(), other("ct")))).withColumn("ct1", F.coalesce(ct0, F.when(t0.isNotNull(), other("t"))))
    pair = F.when(F.col("t1").isNotNull() & F.col("ct1").isNotNull() & (F.col("t1") != F.col("ct1")), F.struct(F.col("t1").alias("t"), F.col("ct1").alias("c")))
    w = Window.partitionBy("match_id").orderBy("round_number")
    r = r.withColumn("pair", pair).withColumn("prev", F.last("pair", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    carry = F.col("t1").isNull() & F.col("ct1").isNull() & two
    switch = F.coalesce((F.col("pair.t") == F.col("prev.c")) & (F.col("pair.c") == F.col("prev.t")), F.lit(False)).cast("int")
    r = r.withColumn("t_team_id", F.when(carry, F.col("prev.t")).otherwise(F.col("t1"))).withColumn("ct_team_id", F.when(carry, F.col("prev.c")).otherwise(F.col("ct1")))
    r = r.withColumn("switches", F.sum(switch).over(w))
    return r.select("match_id", "round_number", "start_tick", "end_tick", "t_team_id", "ct_team_id", (F.col("is_overtime") | (F.col("switches") >= 2)).alias("is_overtime"),
                    truth(F.col("t_team_id") != F.col("ct_team_id")).alias("side_certain"))


def membership_intervals(sides: DataFrame, assigned: DataFrame) -> DataFrame:
    """Consecutive rounds of equal side merged; spans are found per team, then given to its players.

    Of a team that a round shows on both sides, the T side counts.
    """
    other = F.when(~F.col("t_team_id").eqNullSafe(F.col("ct_team_id")), F.col("ct_team_id"))
    legs = F.array(F.struct(F.col("t_team_id").alias("team_id"), F.lit("T").alias("side")), F.struct(other.alias("team_id"), F.lit("CT").alias("side")))
    s = sides.where("start_tick IS NOT NULL").select("match_id", "round_number", "start_tick", "end_tick", F.inline(legs)).where("team_id IS NOT NULL")
    w = Window.partitionBy("match_id", "team_id").orderBy("round_number")
    s = s.withColumn("new", F.coalesce((F.col("side") != F.lag("side").over(w)).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    g = s.groupBy("match_id", "team_id", "island", "side").agg(F.min("start_tick").alias("valid_from_tick"), F.max_by("end_tick", "round_number").alias("last_end"))
    nxt = F.lead("valid_from_tick").over(Window.partitionBy("match_id", "team_id").orderBy("island"))
    g = g.withColumn("valid_to_tick", F.when(nxt.isNotNull(), nxt - 1).otherwise(F.col("last_end")))
    return g.join(assigned, ["match_id", "team_id"]).select("match_id", "player_id", "team_id", "side", "valid_from_tick", "valid_to_tick")


def player_spans(assigned: DataFrame, memberships: DataFrame) -> DataFrame:
    """One row per player with a team: its memberships in order, of which there are as many as side changes."""
    spans = memberships.groupBy("match_id", "player_id").agg(F.sort_array(F.collect_list(F.struct("valid_from_tick", "valid_to_tick", "side"))).alias("spans"))
    return assigned.select("match_id", "player_id", "team_id").join(spans, ["match_id", "player_id"], "left")


def participation_status(rounds: DataFrame, players: DataFrame, memberships: DataFrame, evidence: DataFrame) -> DataFrame:
    """Membership against event evidence per (round, player).

    ``evidence(match_id, round_id, player_id, team_id, side, tick)`` is reduced to smallest and
    largest value per player before it is joined.
    """
    r = rounds.where("NOT is_warmup").withColumn("_end", F.coalesce("official_end_tick", "end_tick", "start_tick"))
    side_of = F.when(F.col("team_id") == F.col("t_team_id"), "T").when(F.col("team_id") == F.col("ct_team_id"), "CT")
    m = r.join(memberships.select("match_id", "player_id", "team_id", "valid_from_tick", "valid_to_tick"), "match_id").where(
        "valid_from_tick <= _end AND (valid_to_tick IS NULL OR valid_to_tick >= start_tick)").withColumn("s", side_of).where("s IS NOT NULL")
    val = F.struct(F.col("team_id"), F.col("s"))
    mem = m.groupBy("match_id", "round_id", "player_id").agg(F.min(val).alias("m_lo"), F.max(val).alias("m_hi"))
    e = evidence.where("player_id IS NOT NULL").join(r.select("match_id", "round_id", "t_team_id", "ct_team_id"), ["match_id", "round_id"])
    by_team = F.when(side_of.isNotNull() & F.col("side").isin("UNKNOWN") | (F.col("side") == side_of), F.struct(F.col("team_id"), side_of.alias("s")))
    by_side = F.when(F.col("side") == "T", F.struct(F.col("t_team_id").alias("team_id"), F.lit("T").alias("s"))).when(
        F.col("side") == "CT", F.struct(F.col("ct_team_id").alias("team_id"), F.lit("CT").alias("s")))
    e = e.withColumn("v", F.when(F.col("team_id").isNotNull(), by_team).otherwise(by_side))
    e = e.withColumn("v", F.when(F.col("v.team_id").isNotNull(), F.col("v")))
    obs = e.groupBy("match_id", "round_id", "player_id").agg(F.min("v").alias("o_lo"), F.max("v").alias("o_hi"), F.min("tick").alias("first_seen_tick"), F.max("tick").alias("last_seen_tick"))
    people = union_all(players.select("match_id", "player_id"), memberships.select("match_id", "player_id")).distinct()
    grid = union_all(r.select("match_id", "round_id", "round_number").join(people, "match_id"),
                     obs.select("match_id", "round_id", "player_id").join(r.select("match_id", "round_id", "round_number"), ["match_id", "round_id"])).distinct()
    g = grid.join(mem, ["match_id", "round_id", "player_id"], "left").join(obs, ["match_id", "round_id", "player_id"], "left")
    one_m = F.col("m_lo").isNotNull() & (F.col("m_lo") == F.col("m_hi"))
    many_m = F.col("m_lo") != F.col("m_hi")
    one_o = F.col("o_lo").isNotNull() & (F.col("o_lo") == F.col("o_hi"))
    clash = F.col("o_lo").isNotNull() & ((F.col("o_lo") != F.col("m_lo")) | (F.col("o_hi") != F.col("m_lo")))
    status = (F.when(one_m & clash, "unresolved").when(one_m, "inferred_from_membership").when(many_m, "unresolved")
              .when(one_o, "event_observed").when(F.col("first_seen_tick").isNotNull(), "unresolved").otherwise("not_participating"))
    who = F.when(one_m, F.col("m_lo")).when(~truth(many_m) & one_o, F.col("o_lo"))
    g = g.withColumn("status", status).withColumn("who", who)
    life = F.when(F.col("status") == "inferred_from_membership", "alive").when(F.col("status") == "not_participating", "not_participating").otherwise("unknown")
    return g.select("match_id", "round_id", "round_number", "player_id", F.col("who.team_id").alias("team_id"), F.coalesce("who.s", F.lit("UNKNOWN")).alias("side"),
                    F.col("status").alias("participation_status"), life.alias("initial_life"), "first_seen_tick", "last_seen_tick")


def team_names(marks: DataFrame, rounds: DataFrame, players: DataFrame) -> DataFrame:
    """Majority clan name over rounds, else a tag shared by most roster nicknames."""
    from .rounds import assign_rounds

    rank = F.array_position(F.array(*[F.lit(s) for s in NAME_SOURCES]), F.col("source_event"))
    m = assign_rounds(marks.where(F.col("source_event").isin(*NAME_SOURCES)).select("match_id", "source_event", "tick", "t_clan", "ct_clan"), rounds)
    legs = F.array(F.struct(F.col("round_t_team").alias("team_id"), F.col("t_clan").alias("raw")), F.struct(F.col("round_ct_team").alias("team_id"), F.col("ct_clan").alias("raw")))
    m = m.where("round_number IS NOT NULL").select("match_id", "round_number", rank.alias("rank"), F.inline(legs))
    name = F.trim(F.regexp_replace("raw", r"\s+", " "))
    m = m.withColumn("name", F.nullif(name, F.lit(""))).where("team_id IS NOT NULL AND name IS NOT NULL")
    per = m.groupBy("match_id", "team_id", "round_number", "rank").agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    per = per.groupBy("match_id", "team_id", "round_number").agg(F.min(F.struct("rank", "lo", "hi")).alias("b")).where("b.lo = b.hi")
    votes = per.groupBy("match_id", "team_id", F.col("b.lo").alias("name")).agg(F.count("*").alias("n"))
    tally = votes.groupBy("match_id", "team_id").agg(F.sum("n").alias("denominator"), F.sort_array(F.collect_list(
        F.struct((-F.col("n")).alias("neg"), F.lower("name").alias("folded"), F.col("name")))).alias("ranked"))
    tag = F.coalesce(*[F.nullif(F.regexp_extract(F.trim("current_name"), p, 1), F.lit("")) for p in (BRACKET_TAG, SEPARATOR_TAG)])
    p = players.withColumn("tag", tag).withColumn("tag", F.when(~F.lower("tag").isin(*GENERIC_NAMES), F.col("tag")))
    # every name that a player is known by, of which there are a few each
    every = F.array_union(F.col("known_names"), F.array("current_name")) if "known_names" in players.columns else F.array("current_name")
    sizes = p.groupBy("match_id", "team_id").agg(F.count("*").alias("roster_size"))
    known = p.select("match_id", "team_id", F.explode(every).alias("name")).groupBy("match_id", "team_id").agg(F.collect_set(F.lower("name")).alias("known"))
    names = sizes.join(known, ["match_id", "team_id"], "left")
    spell = p.where("tag IS NOT NULL").groupBy("match_id", "team_id", F.lower("tag").alias("folded"), "tag").agg(F.count("*").alias("n"))
    folded = spell.groupBy("match_id", "team_id", "folded").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("neg"), F.col("tag"))).alias("best"))
    tags = folded.groupBy("match_id", "team_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("folded"), F.col("best.tag").alias("tag")))).alias("tags"))
    g = names.join(tally, ["match_id", "team_id"], "left").join(tags, ["match_id", "team_id"], "left")
    top, second = F.try_element_at("ranked", F.lit(1)), F.try_element_at("ranked", F.lit(2))
    low = top["folded"]
    fine = F.when(low.isin(*GENERIC_NAMES) | low.rlike("^[0-9]+$") | top["name"].rlike("(?i)^team[_ -]?[0-9]+$"), False).when(
        low.startswith("team_"), F.array_contains("known", F.trim(F.regexp_replace(low, "^team_", "")))).otherwise(F.length(top["name"]).between(2, 100))
    ok = truth((second.isNull() | (second["neg"] != top["neg"])) & (-top["neg"] / F.col("denominator") >= 0.6) & fine)
    t1, t2 = F.try_element_at("tags", F.lit(1)), F.try_element_at("tags", F.lit(2))
    tag_ok = truth((F.col("roster_size") >= 3) & (t2.isNull() | (t2["neg"] != t1["neg"])) & (-t1["neg"] >= 3) & (-t1["neg"] / F.col("roster_size") > 0.5))
    return g.select(
        "match_id", "team_id", F.when(ok, top["name"]).when(tag_ok, t1["tag"]).alias("display_name"),
        F.when(ok, "round_team_clan_name").when(tag_ok, "player_nickname_clan_tag").alias("source"),
        F.when(ok, -top["neg"]).when(tag_ok, -t1["neg"]).otherwise(0).cast("long").alias("numerator"),
        F.when(ok, F.col("denominator")).when(tag_ok, F.col("roster_size")).otherwise(F.coalesce("denominator", F.lit(0))).cast("long").alias("denominator"))


def selected_roster(selections: DataFrame, players: DataFrame) -> DataFrame:
    """Identity appearances over the selected matches of every profile."""
    n = selections.groupBy("profile_id").agg(F.count("*").alias("selected_match_count"))
    s = selections.join(players, ["match_id", "team_id"])
    key = F.when(F.col("steam_id").isNotNull(), F.concat(F.lit("steam:"), F.col("steam_id"))).otherwise(F.concat_ws(":", F.lit("occurrence"), "match_id", "player_id"))
    g = s.withColumn("identity_key", key).groupBy("profile_id", "identity_key").agg(
        F.max("steam_id").alias("steam_id"), F.countDistinct("match_id").alias("appearance_count"), F.max(F.struct("selection_order", "current_name")).alias("latest"))
    g = g.join(n, "profile_id")
    role = F.when(F.col("steam_id").isNull(), "unresolved_identity").when(F.col("appearance_count") == F.col("selected_match_count"), "core").otherwise("partial")
    return g.select("profile_id", "identity_key", "steam_id", F.col("latest.current_name").alias("current_name"), "appearance_count", "selected_match_count", role.alias("role"))


def _confirmed(roster: DataFrame) -> DataFrame:
    return roster.where("steam_id IS NOT NULL").select("profile_id", "steam_id").distinct()


def _team_sizes(players: DataFrame) -> DataFrame:
    return players.groupBy("match_id", "team_id").agg(F.countDistinct("steam_id").alias("overlap_denominator"), count_if(F.col("steam_id").isNull()).alias("missing_ids"))


def _with_strength(teams: DataFrame, scored) -> DataFrame:
    n, f = F.col("overlap_numerator"), ratio(F.col("overlap_numerator"), F.col("overlap_denominator"))
    strength = F.when(~scored, "unscored").when((n >= 3) & (f >= 0.6), "strong").when(n >= 2, "possible").otherwise("weak")
    return teams.withColumn("overlap_frequency", f).withColumn("strength", strength)


def candidate_overlap(selections: DataFrame, roster: DataFrame, players: DataFrame) -> DataFrame:
    """Teams of unselected matches that share an identity with the roster, and their opponents, by a join on the identity.

    The teams that share none are as many as profiles times matches: ``overlap_counts`` counts them without a row for each, ``profile_candidates`` lists
    them for one profile.
    """
    hits = players.where("steam_id IS NOT NULL").join(_confirmed(roster), "steam_id")
    shared = hits.groupBy("profile_id", "match_id", "team_id").agg(F.countDistinct("steam_id").alias("overlap_numerator"))
    pairs = shared.select("profile_id", "match_id").distinct().join(selections.select("profile_id", "match_id"), ["profile_id", "match_id"], "left_anti")
    c = pairs.join(_team_sizes(players), "match_id").join(shared, ["profile_id", "match_id", "team_id"], "left").fillna(0, ["overlap_numerator"])
    return _with_strength(c, F.lit(True))


def overlap_counts(selections: DataFrame, roster: DataFrame, players: DataFrame) -> DataFrame:
    """Per profile, how many teams of unselected matches are strong, possible, weak and unscored candidates.

    Weak ones are what is left of all teams; a profile without a confirmed identity leaves all of them unscored.
    """
    teams = players.select("match_id", "team_id").distinct()
    own = selections.select("profile_id", "match_id").distinct().join(teams.groupBy("match_id").agg(F.count("*").alias("n")), "match_id", "left")
    base = own.groupBy("profile_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("own")).withColumn("total", F.lit(teams.count()))
    found = candidate_overlap(selections, roster, players).groupBy("profile_id").agg(
        *[count_if(F.col("strength") == s).alias(s) for s in ("strong", "possible")])
    scored = _confirmed(roster).select("profile_id").distinct().withColumn("scored", F.lit(True))
    g = base.join(found, "profile_id", "left").join(scored, "profile_id", "left").fillna(0, ["strong", "possible"])
    rest, known = F.col("total") - F.col("own"), truth(F.col("scored"))
    return g.select("profile_id", "strong", "possible", F.when(known, rest - F.col("strong") - F.col("possible")).otherwise(0).cast("long").alias("weak"), F.when(known, 0).otherwise(rest).cast("long").alias("unscored"))


def profile_candidates(profile_id: str, selections: DataFrame, roster: DataFrame, players: DataFrame) -> DataFrame:
    """Every team of the matches that one profile hasn't selected, with its overlap."""
    own = _confirmed(roster).where(F.col("profile_id") == profile_id)
    shared = players.where("steam_id IS NOT NULL").join(own, "steam_id", "left_semi").groupBy("match_id", "team_id").agg(F.countDistinct("steam_id").alias("overlap_numerator"))
    chosen = selections.where(F.col("profile_id") == profile_id).select("match_id")
    c = _team_sizes(players).join(chosen, "match_id", "left_anti").join(shared, ["match_id", "team_id"], "left").fillna(0, ["overlap_numerator"])
    return _with_strength(c, F.lit(not own.isEmpty())).withColumn("profile_id", F.lit(profile_id))


def clear_candidates(overlap: DataFrame) -> DataFrame:
    """Matches with exactly one strong team and no merely possible one."""
    g = overlap.groupBy("profile_id", "match_id").agg(count_if(F.col("strength") == "strong").alias("strong"), count_if(F.col("strength") == "possible").alias("possible"),
                                                      F.max(F.when(F.col("strength") == "strong", F.col("team_id"))).alias("team_id"))
    return g.where("strong = 1 AND possible = 0").select("profile_id", "match_id", "team_id")
