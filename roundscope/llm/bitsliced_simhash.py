"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints are one entry.  With four bands of 16 bits, two fingerprints that differ in at most two bits agree on two whole bands, so
entries meet in buckets by pairs of bands (six keys of 32 bits).  In a bucket, fingerprints are stored as 64 bit planes: word j of plane b holds
bit b of 64 neighbours.  A fingerprint is compared with whole blocks of them: each plane is flipped where the query has a one, and added
to vertical carry-save counters; bits that would exceed the radius go to a saturation plane, and a block stops as soon as all its lanes have
saturated.  A bucket gives spanning links, at most one for each entry.

A bucket with more than ``bucket_rows`` entries (a group of near copies may hold a third of all rows) is not compared in one task.
Its entries go to the keys of their neighbourhood instead: two fingerprints that differ in at most two bits share a value that differs from each in
at most one.  A key has at most 65 entries, so this is exact and even.

Components are found by alternating large-star and small-star steps over links of fingerprints, written to the shared folder after each round; a
component is named by the smallest doc_id of its rows.

Null or blank text has fingerprint zero, linked like any other.  Rows that repeat a doc_id get fingerprints of their own; each takes part in the
component of its fingerprint only.  A null doc_id is never the smallest, but its row links others; a component without any doc_id has a null name.  An
empty table gives no rows.  Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import discard, importable, stored

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class NearRule:
    """``radius`` is at most 2; ``words`` to a shingle; ``seed`` of XXH64."""
    words: int = 3
    seed: int = 42
    bucket_rows: int = 2048


def shingle_hashes(text: str | None, rule: NearRule = NearRule()) -> np.ndarray:
    """XXH64 values of all shingles, repeats included; the whole sequence of fewer words is one, a text without words has none."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    flat, k = b" ".join(parts), min(rule.words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, seed = xxhash.xxh64_intdigest, rule.seed
    count = len(parts) - k + 1
    return np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts[:count].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, count)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the values, as a signed integer; zero if there are none."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: str | None, rule: NearRule = NearRule()) -> int:
    """64-bit fingerprint as a signed integer."""
    return majority(shingle_hashes(text, rule))


def _fingerprint_rows(rule: NearRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([simhash(t, rule) for t in some.column("text").to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return run


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 planes of ceil(n / 64) words; lane i of word j belongs to value 64 j + i.  Spare lanes are zero."""
    lanes = np.zeros((len(values) + 63) // 64 * 64, np.uint64)
    lanes[: len(values)] = values
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within_two(planes: np.ndarray, value: int) -> np.ndarray:
    """Mask words of the lanes whose value differs from ``value`` in at most two bits."""
    ones = np.zeros(planes.shape[1], np.uint64)
    twos, over = ones.copy(), ones.copy()
    blocks = np.arange(planes.shape[1])
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(64):
        differs = planes[b, blocks] ^ (full if value >> b & 1 else np.uint64(0))
        carry = ones & differs
        ones ^= differs
        over |= twos & (carry | ones)
        twos |= carry
        if b % 8 == 7:  # three or more: give up blocks in which every lane has saturated
            open_ = over != full
            if not open_.all():
                blocks, ones, twos, over = blocks[open_], ones[open_], twos[open_], over[open_]
                if not len(blocks):
                    break
    out = np.zeros(planes.shape[1], np.uint64)
    out[blocks] = ~over
    return out


def spanning_links(values: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs (member, root) that join all values within two bits of each other, directly or by way of others."""
    n = len(values)
    if n < 2:
        return []
    root = np.arange(n)
    planes = bit_planes(values)
    todo = np.ones(n, bool)
    for first in range(n):
        if not todo[first]:
            continue
        front, todo[first] = [first], False
        while front:  # each value is compared with all others once
            near = np.unpackbits(within_two(planes, int(values[front.pop()])).view(np.uint8), bitorder="little")[:n].astype(bool) & todo
            found = np.flatnonzero(near)
            root[found] = first
            todo[found] = False
            front.extend(found.tolist())
    return [(i, int(root[i])) for i in range(n) if root[i] != i]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp, rep) sorted by bucket; links between representatives."""
    bucket, held = None, []

    def close() -> list[tuple[int, int]]:
        return [(held[i][1], held[j][1]) for i, j in spanning_links(np.array([h[0] for h in held], np.int64).view(np.uint64))]

    for batch in batches:
        out = []
        for b, fp, rep in zip(*(batch.column(c).to_pylist() for c in ("bucket", "fp", "rep")), strict=True):
            if b != bucket:
                out += close()
                bucket, held = b, []
            held.append((fp, rep))
        if out:
            yield _links(out)
    if held and (out := close()):
        yield _links(out)


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _band_keys(fp: Column) -> Column:
    bands = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    return F.array(*[F.struct(F.lit(k).alias("k"), (F.shiftleft(bands[i], 16).bitwiseOR(bands[j])).alias("v")) for k, (i, j) in enumerate(combinations(range(4), 2))])


def near_links(entries: DataFrame, rule: NearRule = NearRule()) -> DataFrame:
    """Links (a, b) of representatives that connect all entries (fp, rep) within two bits of each other."""
    keyed = entries.select("fp", "rep", F.explode(_band_keys(F.col("fp"))).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = stored(keyed.join(sizes, "bucket"), "buckets")
    small = sized.where(F.col("n") <= rule.bucket_rows).select("bucket", "fp", "rep")
    found = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links, "a long, b long")
    large = sized.where(F.col("n") > rule.bucket_rows).select("fp", "rep").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    shared = large.select("rep", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("middle"))
    stars = shared.groupBy("middle").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()
    return found.unionByName(stars)


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for each node of ``links`` (a, b) but the smallest of a component itself; a stored table."""
    current = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a node go to its smallest neighbour or itself
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        large = stored(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        before, current = current, stored(small.where("a <> b").distinct(), "small")
        discard(before, large)
        # equal links in two rounds mean that every node points at its smallest
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now


def near_duplicates(docs: DataFrame, rule: NearRule = NearRule()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text)."""
    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stored(rows.mapInArrow(_fingerprint_rows(rule), "doc_id long, fp long"), "fingerprints")
    entries = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    found = components(near_links(entries.select("fp", F.col("fp").alias("rep")), rule))
    # the fingerprint that names a component has no row there
    named = entries.join(found, entries["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
