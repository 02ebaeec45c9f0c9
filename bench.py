"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts without reused layers, so its time covers the whole derivation.
"""
import json
import os
import sys
import time

from roundscope.catalog import QUERIES, forget_layers
from tests.spark_session import session

HEADLINE = {
    "import": "c06_event_rounds", "economy": "k05_team_equipment", "player_statistics": "f01_player_match", "team_statistics": "f02_team_match", "trades": "e07_trades",
    "damage": "e10_effective_damage", "timeline": "h10_transition_log", "state_at_tick": "h08_state_at_tick", "spatial": "i04_valid_positions",
    "nearest_players": "i14_nearest_players", "zones": "j04_zone_assignment", "round_facts": "l15_fact_counts", "frequencies": "m06_frequencies", "bootstrap": "n02_cluster_bootstrap",
    "tactical": "o21_binary_share",
}


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    QUERIES["e01_eligible_rounds"](spark, path).collect()
    took = {}
    for label, name in HEADLINE.items():
        forget_layers()
        start = time.time()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        took[label] = round(time.time() - start, 3)
        print(label, took[label], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
