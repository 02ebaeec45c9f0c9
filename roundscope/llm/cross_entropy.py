"""Cross-entropy difference of matched character n-gram models.

A target and a background model are counted in one pass over the corpus and share their vocabulary (the characters seen at least
``min_count`` times in the whole corpus, an unknown mark and a start mark), order and smoothing.  Tokens are characters: the vocabulary
is closed and small however much text there is, and no word list is cut.  The probability of a token mixes its n-gram orders
by Witten-Bell weights, down to a uniform share of the vocabulary.  A document scores the mean over its tokens of target loss minus background
loss, in nats: low means like the target.

Background are all documents, so every n-gram of a document has a value.  Target are documents whose label has quality 1.

Text is lower-cased, every run of white space is one space and every digit one mark.  Null or blank text has 0 tokens and a null score, as has every
document when there is no target text.  Rows that repeat a doc_id are scored each by its own text.  Null doc_ids are kept.
Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import importable, stored

START, UNKNOWN = 1, 2
#: A code point takes 16 bits of an n-gram's key; four fit into one.  Rarer planes share the unknown mark.
_PLANE = 1 << 16
#: Tokens that a task works on at once.
PIECE = 1 << 19


@dataclass(frozen=True)
class Models:
    """``broadcast_rows``: a table of n-gram values up to this size (16 bytes a row) goes to every task, a larger one is joined."""
    min_count: int = 2
    broadcast_rows: int = 2_000_000


def codes(text: str | None) -> np.ndarray:
    """Vocabulary code of each token of a text, before rare characters are replaced."""
    flat = " ".join((text or "").lower().split())
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((points >= _PLANE) | (points <= UNKNOWN), UNKNOWN, points).astype(np.uint16)
    out[(out >= 48) & (out <= 57)] = 48
    return out


def _groups(texts: list[str | None], common: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and codes of neighbouring texts with about PIECE tokens together."""
    group, first, size = [], 0, 0
    for i, text in enumerate(texts):
        x = codes(text)
        x[~common[x]] = UNKNOWN
        group.append(x)
        size += len(x)
        if size >= PIECE:
            yield first, group
            group, first, size = [], i + 1, 0
    if group:
        yield first, group


def _windows(group: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """4-gram keys of all tokens of a group, and the row of each, at most PIECE places at a time.  Earlier tokens stand in the higher bits."""
    start = np.full(3, START, np.uint16)
    padded = np.concatenate([y for x in group for y in (start, x)])
    row = np.repeat(np.arange(len(group), dtype=np.int32), [len(x) + 3 for x in group])
    real = np.ones(len(padded), bool)
    real[(np.cumsum([0, *[len(x) + 3 for x in group[:-1]]])[:, None] + np.arange(3)).ravel()] = False
    for i in range(3, len(padded), PIECE):
        j = min(len(padded), i + PIECE)
        key = padded[i:j].astype(np.uint64)
        for back in (1, 2, 3):
            key |= padded[i - back : j - back].astype(np.uint64) << np.uint64(16 * back)
        yield key[real[i:j]].view(np.int64), row[i:j][real[i:j]]


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, every = np.zeros(_PLANE, np.int64), np.ones(_PLANE, bool)
    for batch in batches:
        for _, group in _groups(batch.column("text").to_pylist(), every):
            seen += np.bincount(np.concatenate(group), minlength=_PLANE)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["code", "n"])


def _count(common: np.ndarray):
    def rows(keys: np.ndarray, target: bool) -> pa.RecordBatch:
        distinct, n = np.unique(keys, return_counts=True)
        n = pa.array(n.astype(np.int64))
        zero = pa.array(np.zeros(len(distinct), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(distinct), zero if target else n, n if target else zero], names=["key", "background", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target = np.array(batch.column("target").to_pylist(), bool)
            for first, group in _groups(batch.column("text").to_pylist(), common):
                for keys, row in _windows(group):
                    yield rows(keys, False)
                    yield rows(keys[target[row + first]], True)

    return run


def ngram_counts(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """key, background, target of each 4-gram over all of ``docs`` (text, target)."""
    parts = docs.select("text", "target").mapInArrow(_count(common), "key long, background long, target long")
    return parts.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def ngram_values(counts: DataFrame, vocabulary: int) -> DataFrame:
    """key, value: the loss under the target model minus the loss under the background model of a 4-gram's last token.

    Order k has the key's last k tokens.  Witten-Bell: p_k = (count + kinds x p_(k-1)) / (context count + kinds), where kinds is the
    number of distinct tokens after the context.
    """
    last = lambda k: F.col("key").bitwiseAND((1 << 16 * k) - 1) if k < 4 else F.col("key")
    table = counts
    for k in (1, 2, 3, 4):
        table = table.withColumn(f"g{k}", last(k)).withColumn(f"c{k}", F.shiftrightunsigned(last(k), 16))
    for k in (1, 2, 3, 4):
        grams = counts.groupBy(last(k).alias("g")).agg(F.sum("background").alias("nb"), F.sum("target").alias("nt"))
        grams = grams.withColumn("c", F.shiftrightunsigned("g", 16))
        contexts = grams.groupBy("c").agg(F.sum("nb").alias("cb"), F.sum("nt").alias("ct"), F.count(F.lit(1)).alias("kb"), F.count(F.when(F.col("nt") > 0, 1)).alias("kt"))
        grams = grams.join(contexts, "c").select(F.col("g").alias(f"g{k}"), *[F.col(x).alias(f"{x}{k}") for x in ("nb", "nt", "cb", "ct", "kb", "kt")])
        table = table.join(grams, f"g{k}")
    p = {m: F.lit(1.0 / vocabulary) for m in "bt"}
    for k in (1, 2, 3, 4):
        for m in "bt":
            n, c, kinds = (F.col(f"{x}{m}{k}") for x in "nck")
            p[m] = F.when(c > 0, (n + kinds * p[m]) / (c + kinds)).otherwise(p[m])
    return table.select("key", (F.log(p["b"]) - F.log(p["t"])).alias("value"))


def _score(common: np.ndarray, keys: np.ndarray, values: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in _groups(batch.column("text").to_pylist(), common):
                total = np.zeros(len(group))
                for grams, row in _windows(group):
                    at, distinct = pd.factorize(grams)
                    if len(distinct):
                        total += np.bincount(row, values[np.searchsorted(keys, distinct)][at], minlength=len(group))
                lengths = np.array([len(x) for x in group], np.int64)
                score = np.divide(total, lengths, out=np.zeros(len(lengths)), where=lengths > 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(group)), pa.array(lengths), pa.array(score, mask=lengths == 0)], names=["doc_id", "n_tokens", "score"])

    return run


def _document_grams(common: np.ndarray):
    """n-grams of each row; a long text may list one in several windows.  A row without tokens gives one entry of none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                for _, group in _groups([text], common):
                    for grams, _ in _windows(group) if len(group[0]) else [(np.empty(0, np.int64), None)]:
                        distinct, n = np.unique(grams, return_counts=True)
                        if not len(distinct):
                            distinct, n = np.zeros(1, np.int64), np.zeros(1, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(n), pa.int64()), pa.array([rows[i]] * len(n), pa.int64()), pa.array(distinct), pa.array(n)], names=["doc_id", "row", "key", "n"])

    return run


def cross_entropy_difference(docs: DataFrame, target: DataFrame, models: Models = Models()) -> DataFrame:
    """doc_id, n_tokens, score for every row of ``docs`` (doc_id, text); ``target`` holds the doc_ids of the target texts."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 65,536 codes, whatever the corpus
    seen = rows.select("text").mapInArrow(_count_characters, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    kept = [r["code"] for r in seen.where(F.col("n") >= models.min_count).collect()]
    common = np.zeros(_PLANE, bool)
    common[[*kept, START, UNKNOWN]] = True
    chosen = target.select(F.col("doc_id").cast("long").alias("_target")).where("_target is not null").distinct()
    # the same kind of join at every size: the labels grow with the documents
    marked = rows.join(chosen.hint("merge"), rows["doc_id"] == chosen["_target"], "left").select("text", F.col("_target").isNotNull().alias("target"))
    values = stored(ngram_values(stored(ngram_counts(marked, common), "ngrams"), len(kept) + 1), "values")
    if target.isEmpty() or rows.isEmpty():
        values = values.withColumn("value", F.lit(None).cast("double"))
    if values.count() <= models.broadcast_rows:
        table = values.orderBy("key").toArrow()
        keys, worth = table.column("key").to_numpy(), table.column("value").to_numpy(zero_copy_only=False).astype(float)
        out = rows.mapInArrow(_score(common, keys, worth), "doc_id long, n_tokens long, score double")
        return out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    grams = numbered.mapInArrow(_document_grams(common), "doc_id long, row long, key long, n long")
    each = grams.join(values, "key", "left").groupBy("row", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("value")).alias("total"))
    return each.select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, F.col("total") / F.col("n_tokens")).alias("score"))
