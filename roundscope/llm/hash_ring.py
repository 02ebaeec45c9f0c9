"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells.  Each shard owns virtual nodes; a cell belongs to the first virtual node clockwise.
A shard takes the keys of its own cells, in ring order, up to its quota.  Keys beyond the quota continue clockwise, first
come first served, to the next virtual nodes whose shards have room.  Quotas differ by one row at most and add up to
the number of rows, so the counts of the shards do too (law ``rows``).

Only counts per cell, a table of fixed size, are planned globally.  Rows meet that plan by a broadcast of at most
cells + overflow pieces (some 36,000 rows for 2^14 cells), whatever the input.  Which copy of identical rows gets which slot
makes no difference.  A null key is a key like any other.  An empty table gives no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import text_or_empty


@dataclass(frozen=True)
class Ring:
    shards: int = 24
    nodes: int = 64
    cell_bits: int = 14


def _cell(h: Column, ring: Ring) -> Column:
    return F.shiftrightunsigned(h, 64 - ring.cell_bits).cast("int")


def _before(value: str, by: list[str], order: str) -> Column:
    window = Window.partitionBy(*by) if by else Window
    return F.coalesce(F.sum(value).over(window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def virtual_nodes(spark: SparkSession, ring: Ring) -> DataFrame:
    """arc (clockwise number), at (cell) and shard of each virtual node."""
    ids = spark.range(0, ring.shards * ring.nodes, 1, 1)
    shard, replica = (F.col("id") % ring.shards).cast("int"), F.floor(F.col("id") / ring.shards)
    h = F.xxhash64(F.lit("node"), shard, replica)
    nodes = ids.select(shard.alias("shard"), h.alias("h"), _cell(h, ring).alias("at"))
    return nodes.select("shard", "at", (F.row_number().over(Window.orderBy("at", "h", "shard")) - 1).alias("arc"))


def cell_owners(spark: SparkSession, ring: Ring) -> DataFrame:
    """cell, arc, shard, turn: turn counts cells clockwise from the one after the last virtual node."""
    size = 1 << ring.cell_bits
    nodes = virtual_nodes(spark, ring)
    last = F.max("at").over(Window.partitionBy())
    reach = nodes.select("arc", "shard", "at", last.alias("last"), F.lag("at", 1, -1).over(Window.orderBy("arc")).alias("prev"))
    own = reach.where("at > prev").select("arc", "shard", "last", F.explode(F.sequence(F.col("prev") + 1, "at")).alias("cell"))
    wrap = reach.where((F.col("arc") == 0) & (F.col("last") < size - 1)).select(
        "arc", "shard", "last", F.explode(F.sequence(F.col("last") + 1, F.lit(size - 1))).alias("cell"))
    return own.unionByName(wrap).select("cell", "arc", "shard", F.pmod(F.col("cell") - F.col("last") - 1, F.lit(size)).alias("turn"))


def placement(counts: DataFrame, ring: Ring) -> DataFrame:
    """Pieces cell, lo, hi, shard, slot0: the rows of a cell with ranks lo to hi - 1 go to the shard's slots from slot0."""
    spark = counts.sparkSession
    cells = cell_owners(spark, ring).join(counts, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = F.sum("n").over(Window.partitionBy())
    quota = F.floor(total / ring.shards) + (F.col("shard") < total % ring.shards).cast("long")
    cells = cells.withColumn("quota", quota).withColumn("before", _before("n", ["shard"], "turn"))
    home = F.greatest(F.lit(0).cast("long"), F.least("n", F.col("quota") - F.col("before")))
    cells = cells.withColumn("home", home).withColumn("over", F.col("n") - F.col("home"))
    cells = cells.withColumn("slot0", _before("home", ["shard"], "turn")).withColumn("over0", _before("over", [], "turn"))

    own = cells.where("home > 0").select("cell", F.lit(0).cast("long").alias("lo"), F.col("home").alias("hi"), "shard", "slot0")

    rooms = cells.groupBy("shard").agg(F.sum("home").alias("home"), F.sum("n").alias("n"))
    lap = virtual_nodes(spark, ring).join(cells.groupBy("arc").agg(F.sum("over").alias("over")), "arc", "left")
    lap = lap.select(F.struct("arc", "shard", F.coalesce("over", F.lit(0).cast("long")).alias("over")).alias("node"))
    both = lap.unionByName(rooms.select(F.struct("shard", "home").alias("room"), "n"), allowMissingColumns=True)
    both = both.agg(F.sort_array(F.collect_list("node")).alias("lap"), F.map_from_entries(F.collect_list("room")).alias("homes"), F.sum("n").alias("total"))
    walk = both.select(F.expr(f"""
        aggregate(
          concat(lap, transform(lap, a -> struct(a.arc, a.shard, 0L as over))),
          struct(0L as carry, transform(sequence(0, {ring.shards - 1}), s -> total div {ring.shards} + if(s < total % {ring.shards}, 1L, 0L) - coalesce(homes[s], 0L)) as room,
                 cast(array() as array<struct<shard:int,taken:bigint>>) as out),
          (s, a) -> struct(
            s.carry + a.over - least(s.carry + a.over, s.room[a.shard]) as carry,
            transform(s.room, (r, i) -> if(i = a.shard, r - least(s.carry + a.over, r), r)) as room,
            if(least(s.carry + a.over, s.room[a.shard]) > 0,
               concat(s.out, array(struct(a.shard as shard, least(s.carry + a.over, s.room[a.shard]) as taken))), s.out) as out),
          s -> s.out)""").alias("out"))
    taken = walk.select(F.posexplode("out").alias("k", "x")).select("k", "x.shard", "x.taken")
    taken = taken.withColumn("pos", _before("taken", [], "k")).withColumn("used", _before("taken", ["shard"], "k"))
    taken = taken.join(rooms.select("shard", "home"), "shard", "left")  # a shard may own no cell
    taken = taken.select("pos", F.struct("shard", "pos", (F.coalesce("home", F.lit(0)) + F.col("used")).alias("slot0")).alias("to"))

    moved = cells.where("over > 0").select(F.col("over0").alias("pos"), F.struct("cell", "home", "over0").alias("of"))
    end = cells.agg(F.sum("over").alias("pos"))
    order = Window.orderBy("pos", F.col("of").isNull(), F.col("to").isNull())
    cuts = moved.unionByName(taken, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)
    cuts = cuts.select("pos", F.last("of", True).over(order).alias("of"), F.last("to", True).over(order).alias("to"), F.lead("pos").over(order).alias("next"))
    lo = F.col("of.home") + F.col("pos") - F.col("of.over0")
    spill = cuts.where("next > pos").select(
        F.col("of.cell").alias("cell"), lo.alias("lo"), (lo + F.col("next") - F.col("pos")).alias("hi"),
        F.col("to.shard").alias("shard"), (F.col("to.slot0") + F.col("pos") - F.col("to.pos")).alias("slot0"))
    return own.unionByName(spill)


def assign(rows: DataFrame, key: str, ring: Ring = Ring()) -> DataFrame:
    """All rows with ``shard`` and ``slot`` (gapless from 0 in each shard); columns of those names in the input are replaced.

    Rows travel once, so select narrow columns first.  Identical rows are counted before they are dealt to tasks.
    """
    rows = rows.drop("shard", "slot")
    kept = rows.columns
    h = F.xxhash64(F.lit("key"), F.col(key))
    grouped = rows.groupBy(*kept).agg(F.count(F.lit(1)).alias("_rs_n")).withColumn("_rs_h", h).withColumn("_rs_cell", _cell(F.col("_rs_h"), ring))
    counts = grouped.groupBy(F.col("_rs_cell").alias("cell")).agg(F.sum("_rs_n").alias("n"))
    order = Window.partitionBy("_rs_cell").orderBy("_rs_h", *kept).rowsBetween(Window.unboundedPreceding, -1)
    ranked = grouped.withColumn("_rs_rank", F.coalesce(F.sum("_rs_n").over(order), F.lit(0)))
    ranked = ranked.select(*kept, "_rs_cell", F.explode(F.sequence(F.col("_rs_rank"), F.col("_rs_rank") + F.col("_rs_n") - 1)).alias("_rs_rank"))
    pieces = F.broadcast(placement(counts, ring).withColumnsRenamed({"cell": "_rs_cell", "lo": "_rs_lo", "hi": "_rs_hi", "slot0": "_rs_slot0"}))
    placed = ranked.join(pieces, (ranked["_rs_cell"] == pieces["_rs_cell"]) & (F.col("_rs_rank") >= F.col("_rs_lo")) & (F.col("_rs_rank") < F.col("_rs_hi")))
    return placed.select(*[ranked[c] for c in kept], "shard", (F.col("_rs_slot0") + F.col("_rs_rank") - F.col("_rs_lo")).alias("slot"))


def shard_documents(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) for every row of documents."""
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text_or_empty()).alias("text_crc32"))
    return assign(rows, "doc_id", ring).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
