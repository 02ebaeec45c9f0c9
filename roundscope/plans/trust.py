"""Statistical trust of cross-match frequencies: matches are the clusters."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import count_if, importable, ratio, shared, truth


@dataclass(frozen=True)
class TrustConfig:
    confidence: float = 0.95
    iterations: int = 2000
    slice: int = 100  # fewest iterations of a pattern that a task draws
    part_draws: int = 1 << 18  # draws that make a part of a pattern, unless ``slice`` iterations take more
    null_frequency: float = 0.5
    min_effect: float = 0.1
    false_discovery: float = 0.05
    min_clusters: int = 5
    min_stability: int = 3
    max_range: float = 0.2
    min_direction: float = 0.6
    salt: str = "trust-v1"


def match_contributions(rounds: DataFrame) -> DataFrame:
    """Per pattern and match: positives, rounds, share."""
    g = rounds.groupBy("pattern_id", "match_id").agg(count_if(F.col("contributed")).alias("numerator"), F.count("*").alias("denominator"))
    return g.withColumn("frequency", ratio(F.col("numerator"), F.col("denominator")))


def packed(contrib: DataFrame) -> DataFrame:
    """One row per pattern with its match clusters in id order (one entry per selected match)."""
    return contrib.groupBy("pattern_id").agg(F.sort_array(F.collect_list(F.struct("match_id", "numerator", "denominator", "frequency"))).alias("cl"),
                                             F.sum("numerator").alias("total_n"), F.sum("denominator").alias("total_d"), F.count("*").alias("clusters"))


def _bounds(low: int, high: int, iterations: int):
    """Worker of ``bootstrap_interval``: makes the draws of each row's resamples, and gives the estimates that may be a bound."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ..functions.seeded import resampled

        for batch in batches:
            rows = batch.to_pydict()
            alike: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(rows["clusters"], rows["first"], rows["last"], rows["parts"])):
                alike.setdefault(key, []).append(i)
            lows, highs = [None] * batch.num_rows, [None] * batch.num_rows
            for (_, first, last, parts), some in alike.items():
                seeds = np.array([np.frombuffer(rows["seed"][i], ">u4") for i in some]).astype(np.uint32)
                above, below = (np.array([rows[x][i] for i in some], np.int64) for x in ("above", "below"))
                for i, e in zip(some, np.sort(resampled(seeds, above, below, first, last), axis=1)):
                    lows[i], highs[i] = (e[low:low + 1], e[high:high + 1]) if parts == 1 else (e[:low + 1], e[-(iterations - high):])
            out = [batch.column(batch.schema.get_field_index(x)) for x in ("pattern_id", "clusters", "point", "parts")]
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(x, pa.list_(pa.float64())) for x in (lows, highs))], ["pattern_id", "clusters", "point", "parts", "low", "high"])

    return run


def bootstrap_interval(contrib: DataFrame, cfg: TrustConfig = TrustConfig()) -> DataFrame:
    """Cluster bootstrap with hash-driven draws, so every run gives the same bounds.

    Counter j of iteration k is k * n + j; a draw is an unsigned 64-bit number modulo n.  All draws of a pattern are made in one task, which gives its bounds only.
    A pattern of many clusters is dealt in parts of ``slice`` iterations at least, each with its own copy of the clusters, so its work spreads over many tasks;
    the lowest and highest estimates of its parts, which alone can be bounds, meet again by pattern.
    """
    c, spark = F.col, contrib.sparkSession
    alpha = (1 - cfg.confidence) / 2
    lo, hi = int(alpha * (cfg.iterations - 1)), int((1 - alpha) * (cfg.iterations - 1))
    every = F.lit(cfg.iterations).cast("long")
    p = packed(contrib).where("clusters >= 2").withColumn("seed", F.unhex(F.sha2(F.concat_ws(":", "pattern_id", F.lit(cfg.salt)), 256)))
    wanted = F.ceil(c("clusters") * every / cfg.part_draws)
    p = p.withColumn("size", F.greatest(F.least(F.lit(cfg.slice), every), F.ceil(every / wanted)).cast("long")).withColumn("parts", F.ceil(every / c("size")))
    p = p.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), every - 1, c("size"))))
    p = p.select("pattern_id", "clusters", (c("total_n") / c("total_d")).alias("point"), "seed", c("cl.numerator").alias("above"), c("cl.denominator").alias("below"), "parts", "first",
                 F.least(c("first") + c("size"), every).alias("last"))
    importable(spark)
    # small rows of much work: a set number of tasks, for Spark would join them by their size
    e = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pattern_id", "first").mapInArrow(
        _bounds(lo, hi, cfg.iterations), "pattern_id string, clusters long, point double, parts long, low array<double>, high array<double>")
    g = e.groupBy("pattern_id").agg(*[F.max(x).alias(x) for x in ("clusters", "point", "parts")], *[F.sort_array(F.flatten(F.collect_list(x))).alias(x) for x in ("low", "high")])
    whole = c("parts") == 1
    low, high = F.element_at("low", F.when(whole, 1).otherwise(lo + 1)), F.element_at("high", F.when(whole, -1).otherwise(hi - cfg.iterations))
    return g.select("pattern_id", "clusters", "point", F.least(low, "point").alias("lower_bound"), F.greatest(high, "point").alias("upper_bound"))


def stability(contrib: DataFrame, cfg: TrustConfig = TrustConfig()) -> DataFrame:
    """Leave-one-match-out range and share of matches above the null."""
    p = packed(contrib)
    loo = F.expr("transform(filter(cl, c -> total_d > c.denominator), c -> (total_n - c.numerator) / (total_d - c.denominator))")
    p = p.withColumn("loo", loo)
    enough = F.col("clusters") >= cfg.min_stability
    low, high = F.array_min("loo"), F.array_max("loo")
    direction = F.size(F.filter("cl", lambda c: c["frequency"] > cfg.null_frequency)) / F.col("clusters")
    p = p.select("pattern_id", "clusters", *[F.when(enough, v).alias(n) for n, v in (("loo_min", low), ("loo_max", high), ("loo_range", high - low), ("direction", direction))])
    return p.withColumn("stable", F.when(F.col("direction").isNotNull(), (F.col("loo_range") <= cfg.max_range) & (F.col("direction") >= cfg.min_direction)))


def null_frequency(pattern_type: Column, value: Column, binary: tuple[str, ...], cfg: TrustConfig = TrustConfig()) -> Column:
    """Registered null for yes/no patterns and the two sites; NULL otherwise."""
    return F.when(pattern_type.isin(*binary), cfg.null_frequency).when(value.isin("site:A", "site:B"), 0.5)


def upper_tail(successes: Column, trials: Column) -> Column:
    """P(X >= successes) for fair coin flips, by the recurrence C(n, i+1) = C(n, i)(n-i)/(i+1) on logarithms, which long series don't underflow."""
    fold = F.aggregate(
        F.sequence(F.lit(0).cast("long"), trials), F.struct((trials * -math.log(2.0)).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct(
            (a["t"] + F.log(F.greatest(trials - i, F.lit(1).cast("long")).cast("double")) - F.log((i + 1).cast("double"))).alias("t"),
            F.when(i >= successes, a["s"] + F.exp(a["t"])).otherwise(a["s"]).alias("s")), lambda a: a["s"])
    return F.when(trials == 0, 1.0).otherwise(F.least(F.lit(1.0), fold))


def sign_test(contrib: DataFrame, nulls: DataFrame) -> DataFrame:
    """Matches above against below the null, exact one-sided p value."""
    q = contrib.join(nulls.where("null_frequency IS NOT NULL").select("pattern_id", "null_frequency"), "pattern_id")
    g = q.groupBy("pattern_id").agg(count_if(F.col("frequency") > F.col("null_frequency")).alias("above"), count_if(F.col("frequency") < F.col("null_frequency")).alias("below"))
    n = F.col("above") + F.col("below")
    return g.select("pattern_id", "above", n.alias("tested"), upper_tail(F.col("above"), n).alias("p_value"))


def q_values(tests: DataFrame, family: list[str]) -> DataFrame:
    """Benjamini-Hochberg inside each family (one report's tested patterns)."""
    w = Window.partitionBy(*family).orderBy("p_value", "pattern_id")
    t = tests.withColumn("rank", F.row_number().over(w)).withColumn("family_size", F.count("*").over(Window.partitionBy(*family)))
    back = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return t.withColumn("q_value", F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("family_size") / F.col("rank")).over(back)))


def assess(patterns: DataFrame, rounds: DataFrame, binary: tuple[str, ...], cfg: TrustConfig = TrustConfig()) -> DataFrame:
    """Gates, decision, reliability score and rank of every pattern."""
    c = F.col
    contrib = shared(match_contributions(rounds))  # three tests read it
    p = patterns.withColumn("null_frequency", null_frequency(c("pattern_type"), c("value"), binary, cfg))
    tests = sign_test(contrib, p).join(p.select("pattern_id", "profile_id"), "pattern_id")
    q = p.join(q_values(tests, ["profile_id"]).drop("profile_id", "rank"), "pattern_id", "left")
    b = bootstrap_interval(contrib, cfg).select("pattern_id", c("lower_bound").alias("cluster_low"), c("upper_bound").alias("cluster_high"))
    q = q.join(b, "pattern_id", "left").join(stability(contrib, cfg).drop("clusters"), "pattern_id", "left")
    testable = c("null_frequency").isNotNull() & c("p_value").isNotNull()
    effect = F.when(c("null_frequency").isNotNull(), c("frequency") - c("null_frequency"))

    def gate(passed, known):
        return F.when(truth(passed), "pass").when(known, "fail").otherwise("unavailable")

    q = q.withColumn("effect_size", effect).withColumn("testable", testable)
    gates = {
        "gate_clusters": gate(c("denominator_match_count") >= cfg.min_clusters, F.lit(True)), "gate_source": gate(c("availability") == "available", F.lit(True)),
        "gate_effect": gate(c("effect_size") + 1e-12 >= cfg.min_effect, c("testable")), "gate_lower": gate(c("cluster_low") > c("null_frequency"), c("cluster_low").isNotNull() & c("testable")),
        "gate_multiple": gate(c("q_value") <= cfg.false_discovery, c("testable")), "gate_stability": gate(c("stable"), c("stable").isNotNull())}
    for n, g in gates.items():
        q = q.withColumn(n, g)
    every = F.lit(True)
    for n in gates:
        every = every & (c(n) == "pass")
    q = q.withColumn("decision", F.when(~c("testable"), "not_testable").when((c("gate_clusters") == "fail") | (c("gate_stability") == "unavailable"), "insufficient_data").when(every, "supported").otherwise("not_supported"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("cluster_low") - cfg.null_frequency) * 0.5 + F.greatest(F.lit(0.0), c("effect_size")) * 0.3 + c("direction") * 0.2)
    q = q.withColumn("reliability_score", F.when(c("decision") == "supported", score))
    ranks = q.where("reliability_score IS NOT NULL").select("pattern_id", F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("reliability_score"), F.desc("denominator_match_count"), "pattern_id")).alias("reliability_rank"))
    return q.join(ranks, "pattern_id", "left")


def reliability_tier(matches: Column) -> Column:
    return F.when(matches >= 15, "high").when(matches >= 8, "tactical_trend").when(matches >= 3, "tactical_trend_small").when(matches >= 1, "match_facts").otherwise("no_data")


def label_metrics(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Confusion counts and rates; a full outer join keeps labels without prediction and the reverse."""
    c = F.col
    q = labels.select("label_id", c("value").alias("l")).join(predictions.select("label_id", c("value").alias("p")), "label_id", "full")
    det = c("l").isin("present", "absent")
    use = det & c("p").isin("present", "absent")
    g = q.agg(*[count_if(use & (c("l") == a) & (c("p") == b)).alias(n) for n, a, b in (("tp", "present", "present"), ("fp", "absent", "present"), ("tn", "absent", "absent"), ("fn", "present", "absent"))],
              count_if(c("l") == "indeterminate").alias("indeterminate"), count_if(det & c("p").isNull()).alias("missing"), count_if(c("l").isNull()).alias("unknown"), count_if(det & (c("p") == "unavailable")).alias("unavailable"))
    tp, fp, tn, fn = c("tp"), c("fp"), c("tn"), c("fn")
    g = g.withColumn("sample_size", tp + fp + tn + fn).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("false_positive_rate", ratio(fp, fp + tn))
    g = g.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))
    return g.withColumn("complete", (c("missing") == 0) & (c("unavailable") == 0) & (c("unknown") == 0) & (c("sample_size") > 0))


def label_lists(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """(list, label_id): determinate labels without prediction or with an unavailable one, predictions without label, indeterminate labels."""
    c = F.col
    q = labels.select("label_id", c("value").alias("l")).join(predictions.select("label_id", c("value").alias("p")), "label_id", "full")
    det = c("l").isin("present", "absent")
    found = [F.when(truth(rule), F.lit(name)) for name, rule in (("missing", det & c("p").isNull()), ("unknown", c("l").isNull()), ("unavailable", det & (c("p") == "unavailable")), ("indeterminate", c("l") == "indeterminate"))]
    return q.select(F.explode(F.array_compact(F.array(*found))).alias("list"), "label_id")


def corpus_coverage(cases: DataFrame, labels: DataFrame, support: DataFrame, policy: dict) -> DataFrame:
    """Corpus against policy: counts, missing sources and edge cases, label minimums, parser gaps."""
    c = F.col
    ok = cases.where("review_status = 'confirmed'")
    base = ok.groupBy("target_id").agg(F.count("*").alias("confirmed_matches"), F.countDistinct("map_name").alias("distinct_maps"), F.collect_set("source").alias("sources"), F.collect_set("edge_case").alias("edges"))
    l = labels.groupBy("target_id").agg(count_if(c("value") != "indeterminate").alias("determinate"), count_if(c("value") == "present").alias("positive"), count_if(c("value") == "absent").alias("negative"))
    need = ok.select("target_id", "case_id", F.explode(F.array(*[F.lit(x) for x in policy["parsers"]])).alias("parser"))
    gaps = need.join(support.where("supported").select("case_id", "parser"), ["case_id", "parser"], "left_anti").groupBy("target_id").agg(F.countDistinct("case_id").alias("parser_gaps"))
    q = base.join(l, "target_id", "left").join(gaps, "target_id", "left").fillna(0, ["determinate", "positive", "negative", "parser_gaps"])
    q = q.withColumn("missing_sources", F.sort_array(F.array_except(F.array(*[F.lit(x) for x in policy["sources"]]), "sources"))).withColumn("missing_edges", F.sort_array(F.array_except(F.array(*[F.lit(x) for x in policy["edges"]]), "edges")))
    blocked = (c("confirmed_matches") < policy["matches"]) | (c("distinct_maps") < policy["maps"]) | (F.size("missing_sources") > 0) | (F.size("missing_edges") > 0) \
        | (c("determinate") < policy["determinate"]) | (c("positive") < policy["positive"]) | (c("negative") < policy["negative"]) | (c("parser_gaps") > 0)
    return q.withColumn("status", F.when(blocked, "blocked").otherwise("ready")).drop("sources", "edges")
