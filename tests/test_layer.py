"""The columnar layer: fingerprints, incremental refresh, delete with cascade, bucket pruning."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from roundscope.operators import lineage as S
from roundscope.sources.layer import BUCKET, Layer

COLS = "match_id string, id long, name string, x double, ok boolean"
ROWS = [(f"m{i % 12}", i, None if i % 5 == 0 else f"n{i % 3}", i / 7, i % 2 == 0) for i in range(240)]


@pytest.fixture
def layer(spark, tmp_path):
    return Layer(spark, str(tmp_path / "layer"), buckets=6)


def files(layer, name):
    """Content files of a table: path -> (inode, time)."""
    return {f: (os.stat(f).st_ino, os.stat(f).st_mtime_ns) for f in glob.glob(f"{layer.path(name)}/{BUCKET}=*/*.parquet")}


def of_bucket(paths, b):
    return {p for p in paths if f"{BUCKET}={b}/" in p}


def total(df):
    return {tuple(r) for r in S.content_sums(df, "t").collect()}


def test_sums_tell_every_cell_and_nothing_else(spark):
    df = spark.createDataFrame(ROWS, COLS)
    base = total(df)
    assert total(df.orderBy(F.desc("id")).repartition(5)) == base == total(df.select(*reversed(df.columns)))
    for i, row in ((0, ("m0", 0, None, 1e-15, True)), (3, ("m3", 3, None, 3 / 7, False)), (4, ("m4", 4, "n1", 4 / 7, None)), (6, ("m6", 6, "n0", None, True)), (7, ("m7", 8, "n1", 1.0, False))):
        assert total(spark.createDataFrame([*ROWS[:i], row, *ROWS[i + 1 :]], COLS)) != base
    assert total(spark.createDataFrame([*ROWS, ROWS[0]], COLS)) != base
    # texts that would be equal if cells were only strung together
    pair = [[("a", "b,c")], [("a,b", "c")], [("a", None)], [(None, "a")], [("1:a", "")]]
    assert len({tuple(S.content_sums(spark.createDataFrame(r, "p string, q string").withColumn("match_id", F.lit("m")), "t").first()) for r in pair}) == 5


def test_sums_merge_and_subtract(spark):
    df = spark.createDataFrame(ROWS, COLS)
    some, rest = df.where("id % 4 = 1"), df.where("id % 4 <> 1")
    full, a, b = (S.content_sums(x, "t") for x in (df, some, rest))
    same = lambda x, y: {tuple(r) for r in x.collect()} == {tuple(r) for r in y.collect()}
    assert same(S.merged_sums((1, a), (1, b)), full) and same(S.merged_sums((1, full), (-1, a)), b)
    assert S.merged_sums((1, full), (-1, full)).count() == 0
    sets = {"t": df, "u": df.select("match_id", "id")}
    one = {tuple(r) for r in S.dataset_fingerprint(sets).collect()}
    moved = {**sets, "u": df.select("match_id", (F.col("id") + F.when(F.col("id") == 5, 1).otherwise(0)).alias("id"))}
    other = {tuple(r) for r in S.dataset_fingerprint(moved).collect()}
    assert {m for m, _ in one - other} == {"m5"} and len(one) == 12


def test_reads_prune_buckets(spark, layer):
    layer.write("t", spark.createDataFrame(ROWS, COLS))
    got = layer.read("t", ["m3", "m4"])
    assert {r.match_id for r in got.collect()} == {"m3", "m4"} and got.count() == 40
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f"{BUCKET}#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "name" not in layer.read("t").select("id")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def derive(tables):
    return tables["t"].groupBy("match_id").agg(F.sum("id").alias("s"), F.max(F.lit(os.environ.get("ROUNDSCOPE_RUN", "a"))).alias("run"))


def test_refresh_rewrites_the_changed_bucket_only(spark, layer, monkeypatch):
    df = spark.createDataFrame(ROWS, COLS)
    asked = []

    def watched(tables):
        asked.append({r[0] for r in tables["t"].select("match_id").distinct().collect()})
        return derive(tables)

    assert layer.refresh("d", {"t": df}, watched) != []
    before = files(layer, "d")
    assert layer.refresh("d", {"t": df.repartition(3)}, watched) == [] and files(layer, "d") == before
    changed = df.withColumn("name", F.when(F.col("id") == 17, "other").otherwise(F.col("name")))  # match m5
    touched = layer.refresh("d", {"t": changed}, watched)
    after = files(layer, "d")
    assert len(touched) == 1 and asked == [{f"m{i}" for i in range(12)}, {"m5"}]
    assert {p: v for p, v in before.items() if p not in of_bucket(before, touched[0])} == {p: v for p, v in after.items() if p not in of_bucket(after, touched[0])}
    assert of_bucket(before, touched[0]).isdisjoint(of_bucket(after, touched[0]))
    expected = {tuple(r) for r in derive({"t": df}).collect()}
    assert {tuple(r) for r in layer.read("d").collect()} == expected
    layer = Layer(spark, layer.root, layer.buckets)  # another session
    layer.refresh("d", {"t": changed.where("match_id <> 'm2'")}, watched)  # a match that went
    assert {tuple(r) for r in layer.read("d").collect()} == {r for r in expected if r[0] != "m2"} and len(asked) == 3 and asked[-1] == set()
    layer.refresh("d", {"t": df}, watched)  # back again
    assert {tuple(r) for r in layer.read("d").collect()} == expected and asked[-1] == {"m2", "m5"}


def test_refresh_after_an_attempt_without_pins(spark, layer):
    df = spark.createDataFrame(ROWS, COLS)
    layer.write("d", derive({"t": df.where("id < 100")}))  # an earlier attempt got so far
    again = Layer(spark, layer.root, layer.buckets)
    again.refresh("d", {"t": df}, derive)
    assert {tuple(r) for r in again.read("d").collect()} == {tuple(r) for r in derive({"t": df}).collect()}
    with pytest.raises(ValueError):
        Layer(spark, layer.root, layer.buckets).write("d", df)


def test_delete_follows_the_lineage(spark, layer):
    df = spark.createDataFrame(ROWS, COLS)
    inputs = spark.createDataFrame([(f"r{i % 5}", f"m{i}") for i in range(12)] + [("r9", None)], "run_id string, match_id string")
    tables = {"matches": df.select("match_id").distinct(), "facts": df, "inputs": inputs, "runs": inputs.select("run_id").distinct(), "patterns": spark.createDataFrame([(f"p{i}", f"r{i % 5}") for i in range(40)], "pattern_id string, run_id string")}
    keys = {"runs": "run_id", "patterns": "run_id", "inputs": "run_id"}
    for name, table in tables.items():
        layer.write(name, table, keys.get(name, "match_id"))
    for parent, child, column in (("matches", "facts", "match_id"), ("matches", "inputs", "match_id"), ("inputs", "runs", "run_id"), ("runs", "inputs", "run_id"), ("runs", "patterns", "run_id")):
        layer.derived(parent, child, column)
    sums, before = {n: total(layer.read(n)) for n in ("matches", "facts")}, {n: files(layer, n) for n in tables}
    touched = layer.delete("matches", spark.createDataFrame([("m3",), ("m8",), ("nowhere",)], "match_id string"))  # both belong to run r3
    left = {n: layer.read(n).collect() for n in tables}
    assert {r.match_id for r in left["facts"]} == {r.match_id for r in left["matches"]} == {f"m{i}" for i in range(12)} - {"m3", "m8"}
    assert {r.run_id for r in left["inputs"]} == {"r0", "r1", "r2", "r4", "r9"} and {r.run_id for r in left["runs"]} == {"r0", "r1", "r2", "r4", "r9"}
    assert {r.run_id for r in left["patterns"]} == {"r0", "r1", "r2", "r4"} and len(left["patterns"]) == 32
    for name, was in before.items():  # buckets without a deleted row keep their files
        now = files(layer, name)
        for b in range(layer.buckets):
            same = {p: v for p, v in was.items() if p in of_bucket(was, b)} == {p: v for p, v in now.items() if p in of_bucket(now, b)}
            assert same != (b in touched.get(name, []))
    assert layer.delete("matches", spark.createDataFrame([("m3",)], "match_id string")) == {}
    again = df.where("match_id IN ('m3', 'm8')")
    for name, rows in (("matches", again.select("match_id").distinct()), ("facts", again)):
        assert total(layer.read(name).unionByName(rows)) == sums[name]
    layer.delete("matches", layer.read("matches"))
    assert layer.read("matches").count() == layer.read("facts").count() == 0
    assert {r.run_id for r in layer.read("runs").collect()} == {"r9"}
