"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target of words; a document of the source should be taken target / source words times.  The whole part of that number
is taken outright.  The fractions are rounded together: two fractional probabilities meet, and one random transfer of mass makes one
of them 0 or 1.  Mass is words: what one document gains the other loses, so the words of the pair stay, and the odds keep each
document's expected copies.  The other document meets the next one.  A group starts with its longest document and leaves one residual.

The groups form a reduction tree.  A leaf is a source, a size class and a prefix of the document's hash, with about ``fan_in``
documents whatever the source's size, so a source with a third of all rows is many leaves.  Each level drops some bits of the prefix
and combines the residuals of the level below; the last residual of a source is rounded by a draw of its own.
Draws are hashes of the documents and a seed, so reruns agree.

Null text has size 0; documents of size 0 are rounded like others.  Null is a source of its own, last in order.  Rows that repeat doc_id, source and size are
counted as one unit whose copies are dealt evenly, so no row exceeds its limit.  An empty table gives no rows.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import stored

#: More sources than this are joined by a shuffle; below it their table (some 50 bytes a row) is broadcast.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    seed: int = 17
    fan_in: int = 128


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, target from (source, source_size); the table has one row for each source.

    A common level raises every source to level x weight, or to ``most`` times its size where that is less.  This is where giving the excess
    of capped sources to the others by weight ends.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (rank % len(mix.weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(mix.most)).withColumn("r", F.col("cap") / F.col("weight"))
    order = Window.orderBy("r", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - capped) / free)
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "level"))).over(Window.partitionBy())["level"])
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def _round_group(level: int, mix: Mix) -> str:
    """One pass over the sorted documents of a group: struct(res, out), the residual and the documents that are decided.

    Two documents trade copies for copies so that their words stay.  Either the first rises by ``up`` words and the second falls, or the
    first falls by ``down`` words; the odds keep both expectations.  In either case one of them ends at 0 or 1.
    """
    kept = ["size", "h", "doc_id", "source", "n", "source_size", "target", "base", "cls"]
    kinds = ["bigint", "bigint", "bigint", "string", "bigint", "bigint", "double", "bigint", "int"]
    kind = ",".join(f"{f}:{k}" for f, k in zip(kept, kinds, strict=True))
    of = lambda who: ", ".join(f"{who}.{f} as {f}" for f in kept)
    weight = lambda who: f"greatest(cast({who}.size as double), 1e-3D)"
    p, q, a, b = "s.res.p", "x.p", weight("s.res"), weight("x")
    up, down = f"least((1 - {p}) * {a}, {q} * {b})", f"least({p} * {a}, (1 - {q}) * {b})"
    draw = f"(shiftrightunsigned(xxhash64(s.res.h, x.h, {level}, {mix.seed}), 11) / {float(1 << 53)}D)"
    rises = f"({draw} * ({up} + {down}) < {down})"
    first_ends = f"if({rises}, (1 - {p}) * {a} <= {q} * {b}, {p} * {a} <= (1 - {q}) * {b})"
    within = lambda x: f"cast(greatest(0D, least(1D, {x})) as double)"
    return f"""
      aggregate(items, struct(cast(null as struct<{kind},p:double>) as res, cast(array() as array<struct<{kind},extra:bigint>>) as out),
        (s, x) -> if(s.res is null, struct(x as res, s.out as out),
          if({first_ends},
             struct(struct({of('x')}, {within(f'if({rises}, {q} - {up} / {b}, {q} + {down} / {b})')} as p) as res,
                    concat(s.out, array(struct({of('s.res')}, if({rises}, 1L, 0L) as extra))) as out),
             struct(struct({of('s.res')}, {within(f'if({rises}, {p} + {up} / {a}, {p} - {down} / {a})')} as p) as res,
                    concat(s.out, array(struct({of('x')}, if({rises}, 0L, 1L) as extra))) as out))))"""


def copies(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, n, source_size, target, total (copies that the n equal rows share) from rows of doc_id, source, size."""
    units = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    units = stored(units, "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    sizes = stored(sizes, "sources")
    counts = sizes.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("units"), F.lit(0)).alias("units")).first()
    targets = source_targets(sizes.drop("units"), mix).withColumnRenamed("source", "_rs_source")
    targets = F.broadcast(targets) if counts["sources"] <= BROADCAST_SOURCES else targets
    want = F.when(F.col("source_size") > 0, F.col("n") * (F.col("target") / F.col("source_size"))).otherwise(0.0)
    units = units.join(targets, units["source"].eqNullSafe(targets["_rs_source"])).drop("_rs_source").withColumn("want", want)
    whole = F.floor(F.col("want") + 1e-9)
    units = units.select(
        "size", F.xxhash64("doc_id", "size", F.lit(mix.seed)).alias("h"), "doc_id", "source", "n", "source_size", "target", whole.alias("base"),
        F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int").alias("cls"), F.greatest(F.lit(0.0), F.col("want") - whole).alias("p"))
    whole_only = units.where("p <= 1e-9").drop("p").withColumn("extra", F.lit(0).cast("long"))

    item = F.struct("size", "h", "doc_id", "source", "n", "source_size", "target", "base", "cls", "p")
    bits, step = max(0, math.ceil(math.log2(max(1, counts["units"]) / mix.fan_in))), int(math.log2(mix.fan_in))
    levels: list[int | None] = [*range(bits, 0, -step), 0, None]
    current, decided = units.where("p > 1e-9"), [whole_only]
    for depth, prefix in enumerate(levels):
        keys = [F.col("source")] if prefix is None else [F.col("source"), F.col("cls"), (F.shiftrightunsigned("h", 64 - prefix) if prefix else F.lit(0).cast("long")).alias("prefix")]
        groups = current.groupBy(*keys).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
        folded = stored(groups.select(F.expr(_round_group(depth, mix)).alias("x")).select("x.res", "x.out"), f"level{depth}")
        decided.append(folded.select(F.inline("out")))
        current = folded.select("res.*")
    last = current.withColumn("extra", (_uniform(F.col("h"), F.lit(mix.seed), F.lit(-1)) < F.col("p")).cast("long")).drop("p")
    decided.append(last)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("base") + F.col("extra")).alias("total"))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of documents."""
    each = copies(_narrow(docs), mix).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    share = F.floor(F.col("total") / F.col("n")) + (F.col("i") <= F.col("total") % F.col("n")).cast("long")
    return each.withColumn("copies", share).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them."""
    dealt = copies(_narrow(docs), mix).where("total > 0").select(
        F.col("doc_id").alias("_rs_doc"), F.col("source").alias("_rs_source"), F.col("size").alias("_rs_size"), F.col("n").alias("_rs_n"), F.col("total").alias("_rs_total"))
    rows = docs.withColumn("_rs_words", words(F.col("text")))
    joined = rows.join(dealt, rows["doc_id"].eqNullSafe(dealt["_rs_doc"]) & rows["source"].eqNullSafe(dealt["_rs_source"]) & (rows["_rs_words"] == dealt["_rs_size"]))
    many = joined.where("_rs_n > 1").withColumn("_rs_i", F.row_number().over(Window.partitionBy("_rs_doc", "_rs_source", "_rs_size").orderBy("_rs_n")))
    every = joined.where("_rs_n = 1").withColumn("_rs_i", F.lit(1)).unionByName(many)
    share = (F.floor(F.col("_rs_total") / F.col("_rs_n")) + (F.col("_rs_i") <= F.col("_rs_total") % F.col("_rs_n")).cast("long")).cast("int")
    return every.withColumn("_rs_copies", share).where("_rs_copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), "_rs_copies")).alias("_rs_copy")).drop("_rs_copy")
