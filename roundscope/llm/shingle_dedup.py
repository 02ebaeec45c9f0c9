"""Near copies by bit-sliced SimHash and the Jaccard similarity of word shingles.

Two texts are linked if their sets of shingles of five words are similar by 0.8 or more; near copies are the connected components of links.  Words
are split at ASCII white space and lowered as ASCII, as for SimHash; a text of fewer words is one shingle.  Null and blank texts are equal.

Candidates are found by the operator of ``bitsliced_simhash``: fingerprints of the same shingles, compared by bit planes, link at two or fewer differing
bits, and the texts that such links join are a bucket.  About 10 of 64 bits differ at a similarity of 0.8, so most edited copies lie beyond that radius.
For them, each of 32 bands of five MinHash values is a bucket too.  A pair of similarity s shares no band with probability (1 - s^5)^32: 3.0e-6 at 0.8 and
less above.  Nothing else is lost: all texts of a bucket are compared by their whole sets (64-bit hashes of shingles) unless they are connected already.

1. Every text meets the smallest one of one bucket, then those of its other buckets that it isn't connected to.
2. Of a bucket that still holds several components, the texts outside its largest one meet all texts of that component.
3. The texts outside are compared with each other, once for equal lists of texts.

Pairs of texts of one component are thus compared in the first step only, and sets travel for pairs of ids, not for buckets.  Where a text has many
partners, or a component or bucket many texts, they are dealt to groups of a bounded number of sets, so that no group of copies is one task.

Nodes are distinct texts, so null and repeated doc_ids take part like others.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitsliced_simhash import NearRule, _links, components, majority, near_links, shingle_hashes
from .support import discard, importable, stored


@dataclass(frozen=True)
class ShingleRule:
    """Similar means a Jaccard similarity of at least ``most`` / ``of``.  ``together`` sets at most of each kind are compared in one group."""
    words: int = 5
    most: int = 4
    of: int = 5
    bands: int = 32
    rows: int = 5
    seed: int = 42
    together: int = 512


def _hashes(text: str | None, rule: ShingleRule) -> np.ndarray:
    return shingle_hashes(text, NearRule(words=rule.words, seed=rule.seed))


def _distinct(hashes: np.ndarray, rule: ShingleRule) -> np.ndarray:
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", rule.seed)], np.uint64)


def shingles(text: str | None, rule: ShingleRule = ShingleRule()) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles; one value for a text without words."""
    return _distinct(_hashes(text, rule), rule)


def band_keys(values: np.ndarray, rule: ShingleRule = ShingleRule()) -> list[int]:
    """One signed 64-bit key for each band: a hash of its MinHash values."""
    factors = np.random.default_rng(rule.seed).integers(0, 1 << 63, rule.bands * rule.rows, dtype=np.uint64) | np.uint64(1)
    least = np.full(len(factors), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(values), 1024):
        x = values[None, i : i + 1024] * factors[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(least.reshape(rule.bands, rule.rows))]


def similar_links(sets: list[np.ndarray], rule: ShingleRule = ShingleRule()) -> list[tuple[int, int]]:
    """Index pairs (member, root) that join all similar sets, directly or by way of others."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    root, todo = np.arange(n), np.ones(n, bool)
    held = np.arange(n)  # the sets that postings hold; they are made anew when most are done

    def postings() -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([sets[i] for i in held])
        order = np.argsort(flat, kind="stable")
        return flat[order], np.repeat(held, sizes[held])[order]

    flat, owner = postings()
    for first in range(n):
        if not todo[first]:
            continue
        front, todo[first] = [first], False
        while front:  # each set is compared with all that no component has yet
            if not (left := int(todo.sum())):
                return [(i, int(root[i])) for i in range(n) if root[i] != i]
            if 2 * left < len(held):
                held = np.flatnonzero(todo)
                flat, owner = postings()
            one = front.pop()
            a, b = np.searchsorted(flat, sets[one]), np.searchsorted(flat, sets[one], "right")
            count = b - a
            at = np.arange(count.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            both = np.bincount(owner[at], minlength=n)
            found = np.flatnonzero(todo & (rule.of * both >= rule.most * (sizes[one] + sizes - both)))
            root[found] = first
            todo[found] = False
            front.extend(found.tolist())
    return [(i, int(root[i])) for i in range(n) if root[i] != i]


def _band_rows(rule: ShingleRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some, prints, keys = batch.slice(i, 1024), [], []
                for t in some.column("text"):
                    hashes = _hashes(t.as_py(), rule)
                    prints.append(majority(hashes))
                    keys.append(band_keys(_distinct(hashes, rule), rule))
                yield pa.RecordBatch.from_arrays(
                    [some.column("digest"), some.column("doc_id"), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["digest", "doc_id", "fp", "buckets"])

    return run


def _set_rows(rule: ShingleRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([some.column("node"), pa.array((shingles(t.as_py(), rule).tobytes() for t in some.column("text")), pa.binary())], names=["node", "set"])

    return run


def _similar_pairs(rule: ShingleRule):
    """Rows (a, b, set, other): the pairs that are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, one, two in zip(*(batch.column(c) for c in ("a", "b", "set", "other")), strict=True):
                x, y = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, True)) if rule.of * min(len(x), len(y)) >= rule.most * max(len(x), len(y)) else 0
                if rule.of * both >= rule.most * (len(x) + len(y) - both):
                    out.append((a.as_py(), b.as_py()))
            if out:
                yield _links(out)

    return run


def _group_links(rule: ShingleRule):
    """Rows (part, i, j, inner, node, set) sorted by part, i, j: links in a group; nodes that are ``inner`` are connected already and not compared with each other."""
    def close(nodes: list[int], inner: list[bool], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        if not any(inner):
            return [(nodes[i], nodes[j]) for i, j in similar_links(sets, rule)]
        held = [i for i, x in enumerate(inner) if x]
        size = np.fromiter((len(sets[i]) for i in held), np.int64, len(held))
        flat, owner = np.concatenate([sets[i] for i in held]), np.repeat(np.arange(len(held)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner, out = flat[order], owner[order], []
        for i, x in enumerate(inner):
            if not x:
                a, b = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], "right")
                at = np.arange((b - a).sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a)
                both = np.bincount(owner[at], minlength=len(held))
                found = np.flatnonzero(rule.of * both >= rule.most * (len(sets[i]) + size - both))
                out += [(nodes[i], nodes[held[k]]) for k in found[:1].tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, inner, sets = None, [], [], []
        for batch in batches:
            out = []
            for *key, own, node, one in zip(*(batch.column(c).to_pylist() for c in ("part", "i", "j", "inner", "node", "set")), strict=True):
                if key != group:
                    out += close(nodes, inner, sets) if nodes else []
                    group, nodes, inner, sets = key, [], [], []
                nodes.append(node)
                inner.append(own)
                sets.append(np.frombuffer(one, np.uint64))
            if out:
                yield _links(out)
        if nodes and (out := close(nodes, inner, sets)):
            yield _links(out)

    return run


def _met(pairs: DataFrame, sets: DataFrame, rule: ShingleRule) -> DataFrame:
    """The similar ones of ``pairs`` (a, b).  A text that many meet goes to several groups."""
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / rule.together).cast("int").alias("groups"))
    others = many.join(sets.withColumnRenamed("set", "other"), many["b"] == sets["node"]).select("b", "other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("group"))
    dealt = dealt.join(sets, dealt["a"] == sets["node"]).select("a", "b", "group", "set").join(others, ["b", "group"])
    return dealt.select("a", "b", "set", "other").mapInArrow(_similar_pairs(rule), "a long, b long")


def _compared(rows: DataFrame, sets: DataFrame, rule: ShingleRule) -> DataFrame:
    dealt = rows.join(sets, "node").select("part", "i", "j", "inner", "node", "set").repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")
    return dealt.mapInArrow(_group_links(rule), "a long, b long")


def _named(shared: DataFrame, found: DataFrame) -> DataFrame:
    """``shared`` with each node's component."""
    both = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    return shared.join(both, "node", "left").withColumn("component", F.coalesce("component", "node"))


def fingerprint_classes(entries: DataFrame, rule: ShingleRule = ShingleRule()) -> DataFrame:
    """node, class for each node of ``entries`` (node, fp): nodes that bit-sliced SimHash links, directly or by way of others, are one class."""
    prints = stored(entries.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    found = components(near_links(prints, NearRule(words=rule.words, seed=rule.seed))).withColumnRenamed("node", "rep")
    named = prints.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("class"))
    return entries.select("node", "fp").join(named, "fp").select("node", "class")


def similar_nodes(entries: DataFrame, sets_of, rule: ShingleRule = ShingleRule()) -> DataFrame:
    """node, component for each node of ``entries`` (node, fp, buckets) that has a near copy, but the smallest of a component; a stored table.

    ``sets_of`` gives (node, set) for a table of nodes.
    """
    together = rule.together
    chunk = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    groups = lambda n: F.ceil(n / together).cast("int")
    classes = fingerprint_classes(entries, rule).select("node", F.xxhash64(F.lit("simhash"), "class").alias("bucket"))
    keyed = entries.select("node", F.explode("buckets").alias("bucket")).unionByName(classes)
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1").select("bucket", "least")
    shared = stored(keyed.join(sizes, "bucket"), "shared")
    sets = stored(sets_of(shared.select("node").distinct()), "sets")
    # 1: smallest texts of buckets
    pairs = stored(shared.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "pairs")
    first = pairs.groupBy("a").agg(F.min("b").alias("b"))
    links = stored(_met(first, sets, rule), "met")
    found = components(links)
    ends = _named(_named(pairs.join(first, ["a", "b"], "left_anti").withColumnRenamed("a", "node"), found).select(F.col("node").alias("a"), F.col("component").alias("ca"), F.col("b").alias("node")), found)
    more = stored(_met(ends.where("ca <> component").select("a", F.col("node").alias("b")), sets, rule), "more")
    found = components(links.unionByName(more))
    # 2: texts outside the largest component of their bucket, and that component
    named = stored(_named(shared.select("bucket", "node"), found), "named")
    largest = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(
        F.max_by("component", F.struct("n", -F.col("component"))).alias("part"), F.count(F.lit(1)).alias("components")).where("components > 1").select("bucket", "part")
    outside = stored(named.join(largest, "bucket").where("component <> part").select("bucket", "node", "part"), "outside")
    size = found.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("n"))
    asked = outside.select("node", "part").distinct().join(size.withColumnRenamed("component", "part"), "part", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    # a component of one text has been met if it was the smallest of the bucket, or the other was
    alone = [(F.col("node") == F.col(x)) & (F.col("part") == F.col(y)) & (F.col("n") == 1) for x, y in (("a", "b"), ("b", "a"))]
    asked = stored(asked.join(pairs, alone[0], "left_anti").join(pairs, alone[1], "left_anti"), "asked")
    extra = []
    if not asked.isEmpty():
        parts = asked.groupBy("part").agg(groups(F.first("n")).alias("rows"), groups(F.count(F.lit(1))).alias("columns"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = found.unionByName(asked.select(F.col("part").alias("node"), F.col("part").alias("component")).distinct()).withColumnRenamed("component", "part")
        inner = own.join(parts, "part").select("part", chunk(F.col("rows")).alias("i"), every("columns").alias("j"), F.lit(True).alias("inner"), "node")
        outer = asked.select("node", "part").join(parts, "part").select("part", every("rows").alias("i"), chunk(F.col("columns")).alias("j"), F.lit(False).alias("inner"), "node")
        extra.append(stored(_compared(inner.unionByName(outer), sets, rule), "outer"))
    # 3: texts outside, with each other
    now = components(links.unionByName(more).unionByName(extra[0])) if extra else found
    rest = _named(outside.select("bucket", "node"), now)
    lists = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("component").alias("components"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    lists = lists.where("components > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    rest = stored(rest.select("bucket", "node").join(lists.select("bucket", groups(F.col("n")).alias("k")), "bucket"), "rest")
    if not rest.isEmpty():
        own = rest.withColumn("c", chunk(F.col("k")))
        own = own.select("bucket", "node", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("d"))
        own = own.select(F.col("bucket").alias("part"), F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), F.lit(False).alias("inner"), "node")
        extra.append(stored(_compared(own, sets, rule), "inner"))
    if extra:
        for table in extra:
            links = links.unionByName(table)
        now = components(links.unionByName(more))
    now = stored(now, "components")
    discard(shared, sets, pairs, named, outside, asked, rest, more, *extra)
    return now


def drop_similar(docs: DataFrame, rule: ShingleRule = ShingleRule()) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: the row with the smallest doc_id of a component stays, one without doc_id last.

    Of rows that repeat both doc_id and text, one stays.
    """
    importable(docs.sparkSession)
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    digest = F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))
    rows = docs.select(digest.alias("digest"), doc.alias("doc_id"), text.alias("text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    entries = rows.mapInArrow(_band_rows(rule), "digest binary, doc_id long, fp long, buckets array<long>").groupBy("digest").agg(
        first.alias("first"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets"), F.count(F.lit(1)).alias("rows"))
    entries = stored(entries.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "rows", "fp", "buckets"), "entries")
    ids = entries.select("node", "digest", F.col("first.doc_id").alias("id"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = ids.join(nodes, "node").withColumnRenamed("digest", "wanted")
        texts = rows.join(wanted, (rows["digest"] == wanted["wanted"]) & rows["doc_id"].eqNullSafe(wanted["id"])).select("node", "text")
        return texts.mapInArrow(_set_rows(rule), "node long, set binary").dropDuplicates(["node"])

    found = similar_nodes(entries.select("node", "fp", "buckets"), sets_of, rule)
    both = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    members = entries.join(both, "node", "left").select("node", "digest", "first", "rows", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("alone"))
    members = members.where("rows > 1 or not alone")
    kept = members.groupBy("component").agg(F.min(F.struct("first.none", "first.doc_id", "node")).alias("x")).select(F.col("x.node").alias("node"), F.lit(True).alias("stays"))
    listed = stored(members.join(kept, "node", "left").select("digest", F.col("first.doc_id").alias("id"), "rows", F.coalesce("stays", F.lit(False)).alias("stays")), "listed")
    discard(entries)
    marked = docs.withColumn("_rs_digest", digest)
    out = marked.join(listed.where("not stays").select("digest"), marked["_rs_digest"] == F.col("digest"), "left_anti")
    repeated = listed.where("stays and rows > 1").select(F.col("digest").alias("_rs_of"), F.col("id").alias("_rs_id"))
    if repeated.isEmpty():
        return out.select(*docs.columns)
    # of rows of one text, one stays: it has the smallest doc_id, and rows that repeat this too are alike but for other columns
    once = out.join(repeated, (F.col("_rs_digest") == F.col("_rs_of")) & doc.eqNullSafe(F.col("_rs_id"))).dropDuplicates(["_rs_digest"])
    return out.join(repeated.select("_rs_of"), F.col("_rs_digest") == F.col("_rs_of"), "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
