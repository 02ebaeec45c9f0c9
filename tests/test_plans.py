"""Shape of the plans that matter at scale."""
import pytest

from roundscope.catalog import ORACLES, QUERIES, forget_layers
from roundscope.catalog.registry import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e21_player_round", "e07_trades", "h01_event_union", "j04_zone_assignment", "k05_team_equipment", "c06_event_rounds"])
def test_no_python_and_no_cartesian(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "Python" not in p and "ArrowEval" not in p and "CartesianProduct" not in p


def test_event_filter_and_columns_reach_the_scan(spark):
    p = plan(tables(spark, SF).kills.select("event_id", "match_id"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in p.replace("\n", "")
    assert "value" not in p.split("ReadSchema:")[1].split("\n")[0]


def scans(spark, run):
    """How often ``events`` is read by all that ``run`` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    forget_layers()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listed = store.executionsList()
    plans = [listed.apply(i).physicalPlanDescription() for i in range(before, listed.size())]
    return sum(p.count("/events.parquet]") for p in plans), len(plans)


@pytest.mark.parametrize("name", ["f01_player_match", "f02_team_match", "e21_player_round", "f06_match_overview", "b13_raw_to_player_match", "h10_transition_log", "l15_fact_counts"])
def test_events_are_scanned_once(spark, name):
    found, plans = scans(spark, lambda: QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    assert plans > 1 and found == 1


def test_every_query_has_an_oracle(spark):
    assert set(QUERIES) == set(ORACLES)
