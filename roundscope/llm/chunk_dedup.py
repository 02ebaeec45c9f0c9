"""Exact deduplication by content-defined chunk recipes.

A text is normalised (each run of ASCII white space becomes one space), then cut where a rolling hash of its last bytes
meets a mask, so equal passages give equal chunks wherever they stand.  A chunk moves once, to be counted among the
distinct chunks; a document travels on as its recipe, the ordered list of chunk identifiers.  Two texts are equal when
their recipes are.

Identifiers are verified: chunks are grouped by identifier and content, and an identifier with two contents is doubtful.
Documents that use a doubtful identifier are compared by recipe and whole text, so a collision can't merge two texts.

Null text counts as empty; all empty texts are equal.  Rows that repeat a doc_id with an equal text are copies, of which one is
kept.  A null doc_id comes after all others.  Other columns are ignored.  An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import importable, stored

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUN = re.compile(b"  +")


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes; ``id_bits`` below 64 makes identifiers collide, for tests."""
    least: int = 512
    mean_bits: int = 11
    most: int = 16384
    id_bits: int = 64


def normalise(text: str | None) -> bytes:
    flat = (text or "").encode().translate(_SPACES)
    return _RUN.sub(b" ", flat) if b"  " in flat else flat


def _gear() -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(bytes([i]), 7) for i in range(256)], np.uint32)


def boundaries(data: bytes, rule: Chunking) -> list[int]:
    """Ends of the chunks.  Whether a place may end a chunk depends on the 32 bytes before it alone."""
    n = len(data)
    if n <= rule.least:
        return [n] if n else []
    h = _gear()[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after each turn a value covers twice as many bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    cuts = (np.flatnonzero(h >> np.uint32(32 - rule.mean_bits) == 0) + 1).tolist()
    ends, start = [], 0
    for cut in [*cuts, n]:
        while cut - start > rule.most:
            start += rule.most
            ends.append(start)
        if cut - start >= rule.least or cut == n and cut > start:
            ends.append(start := cut)
    return ends


def _identifier(chunk: bytes, rule: Chunking) -> int:
    return (xxhash.xxh3_64_intdigest(chunk) >> (64 - rule.id_bits)) - (1 << (rule.id_bits - 1))


def _cut(data: bytes, rule: Chunking) -> list[bytes]:
    ends = boundaries(data, rule)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _recipes(rule: Chunking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalise(x) for x in batch.column("text").to_pylist()]
            recipe = [[_identifier(c, rule) for c in _cut(x, rule)] for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(recipe, pa.list_(pa.int64()))],
                names=["doc_id", "text_sha256", "recipe"])

    return run


def _contents(rule: Chunking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                chunks = {(_identifier(c, rule), c) for x in batch.column("text").slice(i, 256).to_pylist() for c in _cut(normalise(x), rule)}
                if chunks:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chunks], pa.int64()), pa.array([c for _, c in chunks], pa.binary())], names=["chunk_id", "content"])

    return run


def doubtful_identifiers(docs: DataFrame, rule: Chunking = Chunking()) -> DataFrame:
    """chunk_id of identifiers that stand for several contents.  Every distinct chunk is compared byte by byte."""
    chunks = docs.select("text").mapInArrow(_contents(rule), "chunk_id long, content binary")
    distinct = chunks.groupBy("chunk_id", "content").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id")


def exact_duplicates(docs: DataFrame, rule: Chunking = Chunking()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text)."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    recipes = stored(docs.mapInArrow(_recipes(rule), "doc_id long, text_sha256 string, recipe array<long>"), "recipes")
    doubtful = stored(doubtful_identifiers(docs, rule), "doubtful")
    keys = ["recipe", "proof"]
    if doubtful.isEmpty():
        rows = recipes.withColumn("proof", F.lit(""))
    else:
        # the whole text decides, as a column of the documents that use such an identifier
        suspects = recipes.select("doc_id", "text_sha256", F.explode("recipe").alias("chunk_id")).join(doubtful, "chunk_id", "left_semi").select("doc_id", "text_sha256").distinct()
        texts = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ").alias("proof"))
        texts = texts.withColumn("text_sha256", F.sha2("proof", 256)).distinct()
        same = (recipes["doc_id"].eqNullSafe(F.col("t.doc_id"))) & (recipes["text_sha256"] == F.col("t.text_sha256"))
        proven = texts.join(suspects.alias("s"), texts["doc_id"].eqNullSafe(F.col("s.doc_id")) & (texts["text_sha256"] == F.col("s.text_sha256")), "left_semi")
        rows = recipes.join(proven.alias("t"), same, "left").select(recipes["*"], F.coalesce(F.col("t.proof"), F.lit("")).alias("proof"))
    # rows that repeat a doc_id are counted first, so that one of them is kept
    units = rows.groupBy("doc_id", "text_sha256", *keys).agg(F.count(F.lit(1)).alias("n"))
    groups = units.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1")
    found = units.join(groups, keys, "left")
    first = F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id"))
    return found.select("doc_id", "text_sha256", "keep_id", "group_size", first.alias("first"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).select(
        "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, rule: Chunking = Chunking()) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept; of rows that repeat a doc_id and a text, one."""
    decisions = exact_duplicates(docs, rule).where("kept").select(F.col("doc_id").alias("_rs_doc"), F.col("text_sha256").alias("_rs_digest"))
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    rows = docs.withColumn("_rs_own", digest)
    joined = rows.join(decisions, rows["doc_id"].eqNullSafe(decisions["_rs_doc"]) & (rows["_rs_own"] == decisions["_rs_digest"]))
    return joined.dropDuplicates(["_rs_doc", "_rs_digest"]).select(*docs.columns)
