"""Importance resampling toward a target, with features counted once for each distinct line.

Features are runs of one and two words, hashed to buckets.  Newlines separate words, so they cut a text into lines whose features stand alone; the
only others are the pairs of a line's last word and the next line's first.  Lines of equal words are one row: its features are found once, counted times its
occurrences and, when gains are known, summed once for all documents that hold it.  Pairs across lines are added separately.

Lines are told apart by their words where they are counted, and by 128-bit BLAKE2 digests of these where documents look up their sums.  Lines that make
up a ten-thousandth or more of all occurrences, ten thousand at most, are looked up in a broadcast table, the others by a shuffle, where none is hot.

The table of gains has a row for each bucket (``buckets``, a parameter), and goes to the tasks whole.  Equal scores go by doc_id, a null one last.  A null
doc_id draws with an empty name.  Null and blank texts have no feature.  Rows that repeat a doc_id are each scored and drawn.  Other columns are ignored;
an empty table gives no rows, an empty target only small counts.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import importable, stored, tasks

#: Upper case to lower case, other separators than the newline to a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c == 10 or 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HEAVY = 10_000


@dataclass(frozen=True)
class Resampling:
    """``percent`` of the documents of ``least_words`` or more are drawn."""
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: str = "7"


def lines(text: str | None) -> list[bytes]:
    """The words of each line that has any, joined by a blank."""
    return [line for part in (text or "").encode().translate(_WORDS).split(b"\n") if (line := b" ".join(part.split()))]


def line_features(line: bytes, buckets: int) -> np.ndarray:
    """Buckets of a line's words and pairs of words, repeats included."""
    out, before = [], None
    for word in line.split(b" "):
        out.append(crc32(word))
        if before is not None:
            out.append(crc32(word, before))
        before = crc32(b" ", out[-1] if before is None else out[-2])
    return (np.array(out, np.uint32) % buckets).astype(np.uint32)


def crossing_features(some: list[bytes], buckets: int) -> list[int]:
    """Buckets of the pairs of words that a newline parts."""
    return [crc32(b.partition(b" ")[0], crc32(a.rpartition(b" ")[2] + b" ")) % buckets for a, b in zip(some, some[1:])]


def line_key(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _cut(rule: Resampling):
    """Documents as the keys of their lines and the pairs across them."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, doc, text in zip(batch.column("node").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                some = lines(text.as_py())
                out.append((node, doc, sum(x.count(b" ") + 1 for x in some), [line_key(x) for x in some], crossing_features(some, rule.buckets)))
            if out:
                columns = zip(zip(*out, strict=True), kinds, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["node", "doc_id", "n_words", "keys", "crossing"])

    return run


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each batch with how often they occur in it."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            found: dict[bytes, int] = {}
            for text in batch.column("text")[i : i + 512]:
                for x in lines(text.as_py()):
                    found[x] = found.get(x, 0) + 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["line", "n"])


def _features(rule: Resampling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                found = some.column("line").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(line_key, found), pa.binary()), some.column("n"), pa.array((line_features(x, rule.buckets).tobytes() for x in found), pa.binary())],
                    names=["key", "n", "features"])

    return run


def _bucket_sums(rule: Resampling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rule.buckets, np.int64)
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("features").to_pylist(), strict=True):
                np.add.at(total, np.frombuffer(data, np.uint32), n)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    return run


def _line_sums(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gains[np.frombuffer(data, np.uint32)].sum()) for data in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(sums, pa.int64())], names=["key", "n", "gain"])

    return run


def _crossing_sums(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gains[np.array(c, np.int64)].sum()) for c in batch.column("crossing").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "doc_id", "n_words")), pa.array(sums, pa.int64())], names=["node", "doc_id", "n_words", "gain"])

    return run


class Segments:
    """The lines of a table of texts: ``documents`` (node, doc_id, n_words, keys, crossing) and distinct ``lines`` (key, n, features)."""

    def __init__(self, docs: DataFrame, name: str, rule: Resampling = Resampling()):
        importable(docs.sparkSession)
        rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col(name).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rule = rule
        self.documents = stored(rows.mapInArrow(_cut(rule), "node long, doc_id long, n_words long, keys array<binary>, crossing array<int>"), "segments")
        distinct = rows.select("text").mapInArrow(_lines, "line binary, n long").groupBy("line").agg(F.sum("n").alias("n"))
        self.lines = stored(distinct.mapInArrow(_features(rule), "key binary, n long, features binary"), "lines")

    def buckets(self) -> DataFrame:
        """(bucket, n) of all features."""
        inside = self.lines.select("n", "features").mapInArrow(_bucket_sums(self.rule), "bucket int, n long")
        across = self.documents.select(F.explode("crossing").alias("bucket"), F.lit(1).cast("long").alias("n"))
        return inside.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: Segments, target: Segments) -> np.ndarray:
    """By how much a feature of each bucket speaks for the target: floor of 1000 times the logarithm of its smoothed ratio."""
    rule, spark = corpus.rule, corpus.documents.sparkSession
    both = corpus.buckets().select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.buckets().select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(spark.range(rule.buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    counts = np.array([tuple(r) for r in both.groupBy("bucket").agg(F.sum("s"), F.sum("t")).collect()], np.int64)  # a row for each bucket
    counts = counts[np.argsort(counts[:, 0])]
    s, t = counts[:, 1].astype(float), counts[:, 2].astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + rule.buckets) / ((s + 1) * (t.sum() + rule.buckets)))).astype(np.int64)


def document_gains(corpus: Segments, gains: np.ndarray) -> DataFrame:
    """node, doc_id, n_words, gain (sum over all features) of every document."""
    sums = stored(corpus.lines.mapInArrow(_line_sums(gains), "key binary, n long, gain long"), "line_gains")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = sums.where(F.col("n") * HEAVY >= total).select("key", F.col("gain").alias("often"))  # HEAVY rows at most
    held = corpus.documents.select("node", F.explode("keys").alias("key")).groupBy("node", "key").agg(F.count(F.lit(1)).alias("times"))
    held = held.join(F.broadcast(often), "key", "left")
    seldom = held.where("often is null").join(sums.where(F.col("n") * HEAVY < total).select("key", "gain"), "key")
    no_id, none = F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words")
    parts = corpus.documents.mapInArrow(_crossing_sums(gains), "node long, doc_id long, n_words long, gain long").unionByName(
        held.where("often is not null").select("node", no_id, none, (F.col("often") * F.col("times")).alias("gain"))).unionByName(
        seldom.select("node", no_id, none, (F.col("gain") * F.col("times")).alias("gain")))
    return parts.groupBy("node").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("gain").alias("gain"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted part with their part's number and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "place"])
        at += n


def resample(docs: DataFrame, target: DataFrame, rule: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) for every row of ``docs`` (doc_id, text), drawn toward ``target`` (item_id, text)."""
    corpus = Segments(docs, "doc_id", rule)
    gains = bucket_gains(corpus, Segments(target, "item_id", rule))
    features = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    rows = document_gains(corpus, gains).withColumn("n_features", features)
    rows = rows.withColumn("weight", F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features")))
    name = F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = rows.select("node", "doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), (F.col("n_words") >= rule.least_words).alias("able"))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("node")]
    rows = rows.repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order)
    sorted_ = stored(rows.mapInArrow(_numbered, "node long, doc_id long, n_features long, weight long, score long, able boolean, part int, place long"), "scores")
    parts = sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("able").alias("able_rows"))  # a row for each range
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.expr(f"sum(able_rows) over () * {rule.percent} div 100")
    parts = parts.select("part", first.alias("first"), drawn.alias("drawn"))
    rank = F.col("first") + F.col("place") + 1
    return sorted_.join(F.broadcast(parts), "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= F.col("drawn")), rank).alias("rank"))
