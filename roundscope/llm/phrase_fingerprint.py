"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (LZ78 over its UTF-8 bytes): the longest phrase known so far plus one byte is the next phrase.
The set of phrases is hashed, the hashes are dealt to ``slots`` classes and the least of each class is kept: a one-permutation
minimum-hash signature.  Likeness is the share of classes with equal minima among those that either signature fills, which estimates
the overlap of the phrase sets.  Two empty signatures have likeness 1.

The dictionary starts afresh every ``window`` bytes of a text, which bounds memory; the phrases of all windows count.

In the query, documents follow each other by descending doc_id; equal doc_ids by descending text; a null doc_id stands last.  Null text counts as empty.
A single document follows itself.  Other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import importable, tasks

SLOTS, WINDOW, EMPTY = 128, 1 << 20, 0xFFFFFFFF
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LEAST_ID = -(1 << 63)


def _inverse() -> np.uint64:
    return np.uint64(pow(int(_BASE), -1, 1 << 64))


class Parse:
    """LZ78 parse that can be fed piece by piece and forked: texts that share a start parse it once."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.node = self.count = self.at = 0
        self.ends: list[int] = []

    def fork(self) -> Parse:
        twin = Parse()
        twin.known, twin.ends = self.known.copy(), self.ends.copy()
        twin.node, twin.count, twin.at = self.node, self.count, self.at
        return twin

    def feed(self, data: bytes) -> None:
        done = 0
        while done < len(data):
            piece = data[done : done + WINDOW - self.at % WINDOW]
            known, get, push, node, count = self.known, self.known.get, self.ends.append, self.node, self.count
            for at, byte in enumerate(piece, self.at + 1):
                step = get(node | byte)
                if step is None:
                    count += 256
                    known[node | byte] = count
                    push(at)
                    node = 0
                else:
                    node = step
            self.node, self.count, self.at, done = node, count, self.at + len(piece), done + len(piece)
            if self.at % WINDOW == 0:
                self.close()
                self.known, self.node, self.count = {}, 0, 0

    def close(self) -> list[int]:
        """Ends of the phrases; what is left at the end of a window or text is a phrase too."""
        if self.at and (not self.ends or self.ends[-1] != self.at):
            self.ends.append(self.at)
        return self.ends


def phrase_ends(data: bytes) -> list[int]:
    parse = Parse()
    parse.feed(data)
    return parse.close()


def signature(data: bytes, ends: list[int], powers: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """Minimum of 32-bit hash values in each class; a phrase's hash depends on its bytes alone.  No phrase reaches over a window's end, so windows are hashed one by one."""
    out = np.full(SLOTS, EMPTY, np.uint32)
    stops = np.asarray(ends, np.int64)
    for base in range(0, len(data), WINDOW):
        stop = stops[np.searchsorted(stops, base, "right") : np.searchsorted(stops, base + WINDOW, "right")] - base
        some = np.frombuffer(data, np.uint8, min(WINDOW, len(data) - base), base)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((some.astype(np.uint64) + np.uint64(1)) * powers[: len(some)])])
        start = np.concatenate([[0], stop[:-1]])
        h = (sums[stop] - sums[start]) * inverses[start] + (stop - start).astype(np.uint64)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(33)
        np.minimum.at(out, (h >> np.uint64(57)).astype(np.int64), np.minimum(h & np.uint64(EMPTY), np.uint64(EMPTY - 1)).astype(np.uint32))
    return out


class Fingerprinter:
    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(1 << 16, min(2 * n, WINDOW))
            with np.errstate(over="ignore"):
                self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE))])
                self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _inverse()))])

    def of(self, data: bytes, ends: list[int]) -> np.ndarray:
        self._tables(min(len(data), WINDOW))
        return signature(data, ends, self.powers, self.inverses)

    def one(self, data: bytes) -> np.ndarray:
        return self.of(data, phrase_ends(data))

    def cut(self, text: str) -> tuple[str, bytes, Parse, np.ndarray]:
        """The part of a text that an edit keeps, its bytes and its parse, and the whole text's signature."""
        kept = text[: len(text) - len(text) // 3]
        head, rest = kept.encode(), text[len(kept) :].encode()
        parse = Parse()
        parse.feed(head)
        full = parse.fork()
        full.feed(rest)
        return kept, head, parse, self.of(head + rest, full.close())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != EMPTY) | (b != EMPTY)
    return float(np.count_nonzero((a == b) & filled) / np.count_nonzero(filled)) if filled.any() else 1.0


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one or more ranges, each in order and closed by a guest, the document that follows its last one."""
    maker, held, rows = Fingerprinter(), None, []
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for r in batch.slice(i, 256).to_pylist():
                text = r["text"]
                kept, head, parse, own = maker.cut(text)
                if held is not None:
                    doc, n, before, before_head, open_parse, sig = held
                    tail = text[: n - len(before)].encode()
                    open_parse.feed(tail)
                    new = before_head + tail
                    new_sig = maker.of(new, open_parse.close())
                    rows.append((doc, n, hashlib.sha256(new).hexdigest(), to_text(sig), to_text(new_sig), likeness(sig, new_sig), likeness(sig, own)))
                held = None if r["guest"] else (r["doc_id"], len(text), kept, head, parse, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=names)
                rows = []


def fingerprints(docs: DataFrame) -> DataFrame:
    """The query's columns for every row of ``docs`` (doc_id, text).

    Documents are dealt once, to ranges of doc_id.  Of each range only the first document goes to the range that it follows; there are
    as many as tasks.
    """
    spark = docs.sparkSession
    importable(spark)
    n = tasks(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LEAST_ID)))
    # n bounds and n greatest ids: as many numbers as tasks come to the driver
    bounds = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("b")).first()["b"] or []
    inner = sorted(set(bounds))
    bucket = F.array_size(F.filter(F.array(*[F.lit(x).cast("long") for x in inner]), lambda x: x < F.col("key"))) if inner else F.lit(0)
    dealt = rows.withColumn("range", bucket.cast("int"))
    heads = sorted((r["range"], r["head"]) for r in dealt.groupBy("range").agg(F.max("key").alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], _FIELDS)
    # the document after the last of range k is the first of the range below; below the lowest stands the highest
    follows = {heads[k - 1][1]: heads[k][0] for k in range(len(heads))}
    to = F.create_map(*[F.lit(x) for head, at in follows.items() for x in (head, at)])
    guests = rows.where(F.coalesce(F.col("doc_id").isin([h for h in follows if h != _LEAST_ID]), F.lit(False)) | (F.col("key") == F.lit(_LEAST_ID)) & F.lit(_LEAST_ID in follows))
    guests = guests.groupBy("key").agg(F.max("text").alias("text")).select(F.col("key").alias("doc_id"), "text", "key", F.element_at(to, F.col("key")).cast("int").alias("range"), F.lit(True).alias("guest"))
    every = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    placed = every.repartitionById(n, F.col("range")).sortWithinPartitions(F.col("range"), F.col("guest"), F.col("key").desc(), F.col("text").desc())
    return placed.select("doc_id", "text", "guest").mapInArrow(_fingerprints, _FIELDS)
