"""Tables of many parts are stored part by part."""
import pytest
from pyspark.sql import functions as F

from roundscope.catalog import facts as facts_queries
from roundscope.catalog import tactical as tactical_queries
from roundscope.catalog.registry import tables
from roundscope.functions.common import shared_union, union_all
from roundscope.plans import trust as N

SF = "/root/testdata/sf0.001"


def folders(df):
    """Folders that a table's files lie in."""
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def test_parts_hold_what_their_union_holds(spark):
    a = spark.createDataFrame([(1, "x", {"k": 1.0}), (1, "x", {"k": 1.0}), (None, None, None)], "id int, name string, m map<string,double>")
    b = spark.createDataFrame([("y", 2**40)], "name string, id bigint")
    c = a.where("id > 5")
    got, want = shared_union(a, b, c), union_all(a, b, c)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(folders(got)) >= 2 and got.count() == 4


def test_facts_are_stored_part_by_part(spark):
    """One plan over all thirteen families would hold the metrics of all of them for each of its tasks."""
    f = facts_queries.facts(tables(spark, SF)).all
    assert len(folders(f)) == 13


@pytest.mark.parametrize("name, parts", [("bin_occ", 9), ("cat_occ", 7), ("insights", 3)])
def test_tactical_families_are_stored_one_by_one(spark, name, parts):
    t = tables(spark, SF)
    assert len({f.split("/")[-2] for f in getattr(tactical_queries, name)(t).inputFiles()}) == parts


def test_assessment_reads_rounds_once(spark):
    """The contributions that the bootstrap, leave-one-out and the sign test read are counted once and stored."""
    kinds = "pattern_id string, profile_id string, pattern_type string, value string, frequency double, denominator_match_count bigint, availability string"
    p = spark.createDataFrame([("p", "f", "untraded_death", "round_contains_untraded_death", 0.5, 3, "available")], kinds)
    r = spark.createDataFrame([("p", f"m{i % 3}", i % 2 == 0) for i in range(9)], "pattern_id string, match_id string, contributed boolean")
    q = N.assess(p, r.where(F.col("match_id") != "none"), ("untraded_death",))
    assert "contributed" not in q._jdf.queryExecution().optimizedPlan().toString()
    assert q.first().decision == "insufficient_data"
