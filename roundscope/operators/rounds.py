"""Round resolution from markers, event assignment and outcome resolution.

A match has a few dozen rounds, so per-match round lists are packed into one array
row per match; events look their round up in that array after an equi join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_if

# Fixed precedence lists.
START_SOURCES = ("round_prestart", "round_start", "round_poststart", "round_freeze_end")
END_SOURCES = ("round_end", "round_officially_ended")
FAMILY_START = ("round_prestart", "round_start", "round_poststart")
FAMILY_END = ("round_officially_ended", "round_end")
TERMINAL_SOURCES = ("cs_win_panel_match", "round_announce_final")
OUTCOME_SOURCES = ("round_end", "round_officially_ended", "cs_win_panel_round", "cs_win_panel_match")


def _rank(sources: tuple[str, ...]):
    return F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source_event"))


def boundaries(marks: DataFrame) -> DataFrame:
    """Latest row per (match, source, round); a source without markers numbers its distinct ticks."""
    kinds = [*START_SOURCES, *END_SOURCES]
    m = marks.where(F.col("source_event").isin(*kinds) & F.col("tick").isNotNull())
    starts = F.col("source_event").isin(*START_SOURCES)
    m = m.withColumn("round_number", F.when(F.col("marker").isNotNull(), F.when(starts, F.col("marker") + 1).otherwise(F.col("marker"))))
    marked = (m.where("round_number > 0").groupBy("match_id", "source_event", "round_number").agg(F.max("tick").alias("tick")))
    has = m.groupBy("match_id", "source_event").agg(F.bool_or(F.coalesce(F.col("round_number") > 0, F.lit(False))).alias("has_marker"))
    bare = (m.where("marker IS NULL").select("match_id", "source_event", "tick").distinct()
            .join(has.where("NOT has_marker"), ["match_id", "source_event"]))
    order = F.row_number().over(Window.partitionBy("match_id", "source_event").orderBy("tick"))
    bare = bare.select("match_id", "source_event", order.alias("round_number"), "tick")
    return marked.unionByName(bare)


def round_count(marks: DataFrame) -> DataFrame:
    """Candidates and selected round count of each match."""
    counter = F.max(F.when(F.col("marker") > 0, F.col("marker")))
    per_source = marks.groupBy("match_id", "source_event").agg(
        F.count("*").alias("rows"), F.countDistinct(F.coalesce("marker", "tick")).alias("all_n"),
        F.countDistinct("marker").alias("marked"), F.countDistinct("tick").alias("ticks"), counter.alias("counter"))
    n = F.when(F.col("marked") > 0, F.col("marked")).when(F.col("ticks") > 0, F.col("ticks")).otherwise(F.col("rows"))

    def family(sources):
        return F.min(F.when(F.col("source_event").isin(*sources), F.struct(_rank(sources).alias("r"), n.alias("n"))))["n"]

    g = per_source.groupBy("match_id").agg(
        F.max("counter").cast("long").alias("counter_rounds"), family(FAMILY_END).alias("end_rounds"), family(FAMILY_START).alias("start_rounds"))
    chosen = F.coalesce("counter_rounds", "end_rounds", "start_rounds")
    source = (F.when(F.col("counter_rounds").isNotNull(), "max_total_rounds_played")
              .when(F.col("end_rounds").isNotNull(), "canonical_round_end_count").when(F.col("start_rounds").isNotNull(), "canonical_round_start_count"))
    differs = F.coalesce(F.col("end_rounds") != chosen, F.lit(False)) | F.coalesce(F.col("start_rounds") != chosen, F.lit(False))
    return g.select("match_id", "counter_rounds", "end_rounds", "start_rounds", chosen.alias("selected"), source.alias("selected_source"), differs.alias("disagreement"))


def terminal(marks: DataFrame, counts: DataFrame) -> DataFrame:
    """Match-end panel row carrying the last round's number."""
    t = marks.where(F.col("source_event").isin(*TERMINAL_SOURCES)).join(counts.select("match_id", "selected"), "match_id")
    t = t.where("marker = selected").groupBy("match_id", "source_event").agg(F.max("tick").alias("tick"))
    best = F.min(F.struct(_rank(TERMINAL_SOURCES).alias("r"), F.col("tick"), F.col("source_event")))
    return t.groupBy("match_id").agg(best.alias("b")).select("match_id", F.col("b.tick").alias("panel_tick"), F.concat(F.lit("fallback:"), F.col("b.source_event")).alias("panel_source"))


def overtime_start(marks: DataFrame) -> DataFrame:
    """Round after the second finished match phase."""
    p = marks.where("source_event = 'announce_phase_end' AND marker > 0").groupBy("match_id").agg(F.sort_array(F.collect_set("marker")).alias("m"))
    return p.select("match_id", (F.try_element_at("m", F.lit(2)) + 1).alias("overtime_from"))


def resolve_rounds(marks: DataFrame) -> DataFrame:
    counts = round_count(marks)
    b = boundaries(marks)

    def first(sources):
        return F.min(F.when(F.col("source_event").isin(*sources), F.struct(_rank(sources).alias("r"), F.col("tick"), F.col("source_event").alias("source"))))

    found = b.groupBy("match_id", "round_number").agg(
        first(START_SOURCES).alias("s"), first(END_SOURCES).alias("e"),
        F.max(F.when(F.col("source_event") == "round_freeze_end", F.col("tick"))).alias("freeze_end_tick"),
        F.max(F.when(F.col("source_event") == "round_officially_ended", F.col("tick"))).alias("official_end_tick"))
    grid = counts.where("selected > 0").select("match_id", "selected", F.explode(F.sequence(F.lit(1), F.col("selected").cast("int"))).alias("round_number"))
    r = (grid.join(found, ["match_id", "round_number"], "left").join(terminal(marks, counts), "match_id", "left")
         .join(overtime_start(marks), "match_id", "left"))
    last = F.col("round_number") == F.col("selected")
    r = r.withColumn("end_tick", F.coalesce("e.tick", F.when(last, F.col("panel_tick")))).withColumn("end_source", F.coalesce("e.source", F.when(last, F.col("panel_source"))))
    no_end = F.when(F.col("end_tick").isNull(), F.when(last, "missing_final_round_end").otherwise("missing_round_end"))
    return r.select(
        "match_id", "round_number", F.col("s.tick").alias("start_tick"), "freeze_end_tick", "end_tick", "official_end_tick",
        F.col("s.source").alias("start_source"), "end_source",
        F.coalesce(F.col("round_number") >= F.col("overtime_from"), F.lit(False)).alias("is_overtime"),
        (F.col("s.tick").isNotNull() & F.col("end_tick").isNotNull()).alias("is_complete"),
        F.coalesce(no_end, F.when(F.col("s.tick").isNull(), "missing_round_start")).alias("exclusion_reason"))


def pack_rounds(rounds: DataFrame) -> DataFrame:
    """One row per match with its started rounds in order."""
    item = F.struct("round_number", "round_id", "start_tick", "freeze_end_tick", "end_tick", "t_team_id", "ct_team_id")
    return rounds.where("start_tick IS NOT NULL").groupBy("match_id").agg(F.sort_array(F.collect_list(item)).alias("_rounds"))


def assign_rounds(events: DataFrame, rounds: DataFrame) -> DataFrame:
    """As-of: the last round starting at or before the tick, its phase and relative tick."""
    e = events.join(pack_rounds(rounds), "match_id", "left")
    e = e.withColumn("_r", F.when(F.col("tick") >= 0, F.expr("try_element_at(filter(_rounds, r -> r.start_tick <= tick), -1)"))).drop("_rounds")
    t = F.col("tick")
    phase = (F.when(F.col("_r").isNull(), "unknown").when(t < F.col("_r.freeze_end_tick"), "freeze_time")
             .when(t >= F.col("_r.end_tick"), "post_round").when(t >= F.col("_r.freeze_end_tick"), "live").otherwise("unknown"))
    return (e.withColumn("round_id", F.col("_r.round_id")).withColumn("round_number", F.col("_r.round_number"))
            .withColumn("relative_tick", t - F.col("_r.start_tick")).withColumn("phase", phase)
            .withColumn("round_t_team", F.col("_r.t_team_id")).withColumn("round_ct_team", F.col("_r.ct_team_id")).drop("_r"))


def observations(marks: DataFrame) -> DataFrame:
    """Per (match, round): sides, score pairs and reasons of the latest row of every outcome source."""
    from .normalize import normalize_side, optional_text

    o = marks.where(F.col("source_event").isin(*OUTCOME_SOURCES) & (F.col("marker") >= 1) & F.col("tick").isNotNull())
    latest = o.groupBy("match_id", "marker", "source_event").agg(F.max("tick").alias("tick"))
    o = o.join(latest, ["match_id", "marker", "source_event", "tick"])
    side = normalize_side(F.col("winner"))
    pair = F.when(F.col("t_score").isNotNull() & F.col("ct_score").isNotNull(), F.struct(F.col("t_score").cast("long").alias("t"), F.col("ct_score").cast("long").alias("ct")))
    return o.groupBy("match_id", F.col("marker").alias("round_number")).agg(
        F.sort_array(F.collect_set(F.when(F.col("winner").isNotNull() & (side != "UNKNOWN"), side))).alias("sides"),
        F.bool_or(F.col("winner").isNotNull()).alias("any_winner"),
        F.sort_array(F.collect_set(pair)).alias("scores"),
        F.sort_array(F.collect_set(optional_text(F.col("reason")))).alias("end_reasons"))


def resolve_outcomes(rounds: DataFrame, marks: DataFrame) -> DataFrame:
    """Winner, score and end reason of every round.

    The running score is a fold over the rounds of one match (a few dozen entries).
    """
    r = rounds.select("match_id", "round_number").join(observations(marks), ["match_id", "round_number"], "left")
    one = F.size(F.coalesce("sides", F.array())) == 1
    r = r.withColumn("winner", F.when(one, F.element_at("sides", 1)))
    r = r.withColumn("status", F.when(one, "source_event").when(F.coalesce("any_winner", F.lit(False)), "unresolved_conflict").otherwise("missing_from_source"))
    n_reason = F.size(F.coalesce("end_reasons", F.array()))
    r = r.withColumn("end_reason", F.when(n_reason == 1, F.element_at("end_reasons", 1)))
    r = r.withColumn("end_reason_status", F.when(n_reason == 1, "available").when(n_reason > 1, "unresolved").otherwise("missing_from_source"))
    r = r.withColumn("scores", F.coalesce("scores", F.expr("slice(array(named_struct('t', 0L, 'ct', 0L)), 1, 0)")))
    item = F.struct("round_number", "winner", "status", "scores", "end_reason", "end_reason_status")
    packed = r.groupBy("match_id").agg(F.sort_array(F.collect_list(item)).alias("rs"))
    hit = "(c.t = {0} + {2} AND c.ct = {1} + {3})"
    t_win = hit.format("s.pt", "s.pc", 1, 0) + " OR " + hit.format("s.pc", "s.pt", 1, 0)
    ct_win = hit.format("s.pt", "s.pc", 0, 1) + " OR " + hit.format("s.pc", "s.pt", 0, 1)
    step = f"""
      element_at(transform(transform(transform(array(
        CASE WHEN r.status = 'missing_from_source' AND s.pt IS NOT NULL THEN
          CASE WHEN exists(r.scores, c -> {t_win}) AND NOT exists(r.scores, c -> {ct_win}) THEN 'T'
               WHEN exists(r.scores, c -> {ct_win}) AND NOT exists(r.scores, c -> {t_win}) THEN 'CT' END END),
        d -> named_struct('w', coalesce(r.winner, d), 'st', CASE WHEN d IS NOT NULL THEN 'derived_from_authoritative_score_delta' ELSE r.status END,
                          'dt', CASE WHEN coalesce(r.winner, d) = 'T' THEN 1L ELSE 0L END, 'dc', CASE WHEN coalesce(r.winner, d) = 'CT' THEN 1L ELSE 0L END)),
        x -> named_struct('x', x, 'm', CASE WHEN x.w IS NULL THEN NULL WHEN s.pt IS NOT NULL THEN array_distinct(concat(
               transform(filter(r.scores, c -> c.t = s.pt + x.dt AND c.ct = s.pc + x.dc), c -> named_struct('bt', s.pt, 'bc', s.pc, 'at', c.t, 'ac', c.ct)),
               transform(filter(r.scores, c -> c.t = s.pc + x.dt AND c.ct = s.pt + x.dc), c -> named_struct('bt', s.pc, 'bc', s.pt, 'at', c.t, 'ac', c.ct))))
             ELSE transform(r.scores, c -> named_struct('bt', c.t - x.dt, 'bc', c.ct - x.dc, 'at', c.t, 'ac', c.ct)) END)),
        y -> named_struct('x', y.x, 'hit', CASE WHEN size(y.m) = 1 AND y.m[0].bt >= 0 AND y.m[0].bc >= 0 THEN y.m[0] END)), 1)"""
    fold = f"""
      aggregate(rs, named_struct('pt', CAST(NULL AS BIGINT), 'pc', CAST(NULL AS BIGINT), 'out', slice(array(named_struct(
          'round_number', rs[0].round_number, 'winner_side', rs[0].winner, 'outcome_status', rs[0].status, 'score', CASE WHEN size(rs) < 0 THEN named_struct('bt', CAST(NULL AS BIGINT), 'bc', CAST(NULL AS BIGINT), 'at', CAST(NULL AS BIGINT), 'ac', CAST(NULL AS BIGINT)) END,
          'score_status', rs[0].status, 'end_reason', rs[0].end_reason, 'end_reason_status', rs[0].end_reason_status)), 1, 0)),
        (s, r) -> element_at(transform(array({step}), z -> named_struct('pt', z.hit.at, 'pc', z.hit.ac, 'out', concat(s.out, array(named_struct(
          'round_number', r.round_number, 'winner_side', z.x.w, 'outcome_status', z.x.st, 'score', z.hit,
          'score_status', CASE WHEN size(r.scores) = 0 THEN 'missing_from_source' WHEN z.hit IS NULL THEN 'unresolved' ELSE 'available' END,
          'end_reason', r.end_reason, 'end_reason_status', r.end_reason_status))))), 1), s -> s.out)"""
    out = packed.select("match_id", F.inline(F.expr(fold)))
    return out.select("match_id", "round_number", "winner_side", "outcome_status", F.col("score.bt").alias("score_t_before"), F.col("score.bc").alias("score_ct_before"),
                      F.col("score.at").alias("score_t_after"), F.col("score.ac").alias("score_ct_after"), "score_status", "end_reason", "end_reason_status")


def coverage_policy(outcomes: DataFrame) -> DataFrame:
    """Availability of winner, score and end reason; win metrics need full winner coverage."""
    won = F.col("outcome_status").isin("source_event", "derived_from_authoritative_score_delta", "available")
    kinds = {"round_winner": (won, F.col("outcome_status")), "round_score": (F.col("score_status") == "available", F.col("score_status")),
             "round_end_reason": (F.col("end_reason_status") == "available", F.col("end_reason_status"))}
    rows = F.array(*[F.struct(F.lit(n).alias("capability"), ok.alias("ok"), st.alias("st")) for n, (ok, st) in kinds.items()])
    g = outcomes.select("match_id", F.inline(rows)).groupBy("match_id", "capability").agg(
        F.count("*").alias("total"), count_if(F.col("ok")).alias("rounds_available"), count_if(~F.col("ok") & (F.col("st") == "missing_from_source")).alias("rounds_missing"))
    g = g.withColumn("rounds_unresolved", F.col("total") - F.col("rounds_available") - F.col("rounds_missing"))
    status = (F.when(F.col("rounds_available") == F.col("total"), "available").when(F.col("rounds_available") > 0, "partial")
              .when(F.col("rounds_unresolved") > 0, "unresolved").otherwise("missing_from_source"))
    return g.withColumn("status", status).withColumn("can_compute", F.col("status") == "available").withColumn("coverage", F.col("rounds_available") / F.col("total"))
