"""Runs of repeated words by string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least 2q long, that no neighbouring word extends.

Periods below six are found by comparing words with those 1 to 5 further on.  Longer ones are found at dyadic scales: scale t = 2, 4, 8, ... stands for
the periods from 3t to 6t - 1.  Hashes of t words name the fragments.  A position is in the synchronising set of its scale if, of the fragments that
begin in the t + 1 positions from it on, the first or the last has the smallest hash; fragments of period t/3 or less don't count.  Whether a position
is in the set thus depends on 2t words only, its context.  Two positions of the set with equal contexts, 3t to 6t - 1 apart, propose their distance as a period.
Equal contexts are more than t/3 apart, so a position proposes 18 periods at most.

Nothing is lost.  Take a run from s with period q, 3t <= q < 6t.  If the set has a position i from s to s + q - 2t, the run holds the contexts of i and i + q.
Otherwise every fragment that begins there has a period of t/3 or less, hence the words s to s + q - 1 have one such period p <= q/9.  Then the run joins two
maximal regions of period p, found at a smaller scale, that touch; these propose every q by which the first can be shifted onto the second in step.

Hashes only propose: a period stands after comparing the words themselves.  Many documents are searched at once, as one sequence with a mark of
its own after each.  A document is searched in one task, with some 150 bytes of memory a word.
"""
from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import importable

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
_SMALL, _NONE = 6, np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class RunRule:
    """Runs of fewer than ``least`` words don't count.  Documents of up to ``together`` words in all are searched at once."""
    least: int = 12
    together: int = 1 << 16


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.minimum(x, _NONE - np.uint64(1))


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each ``size`` (a power of two) neighbouring values."""
    width = 1
    while width < size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x


def _same_ahead(seq: np.ndarray, at: int, shift: int) -> int:
    """End of the stretch from ``at`` on where each word equals the one ``shift`` further on."""
    step, top = 32, len(seq) - shift
    while at < top:
        end = min(at + step, top)
        differs = seq[at:end] != seq[at + shift : end + shift]
        if differs.any():
            return at + int(differs.argmax())
        at, step = end, min(step * 4, 1 << 20)
    return top


def _same_behind(seq: np.ndarray, at: int, shift: int) -> int:
    """Start of the stretch before ``at`` where each word equals the one ``shift`` further on."""
    step = 32
    while at > 0:
        low = max(at - step, 0)
        differs = (seq[low:at] != seq[low + shift : at + shift])[::-1]
        if differs.any():
            return at - int(differs.argmax())
        at, step = low, min(step * 4, 1 << 20)
    return 0


class _Found:
    """Stretches (start, end) with their smallest proposed period."""

    def __init__(self, seq: np.ndarray):
        self.seq, self.period = seq, {}

    def add(self, low: int, high: int, shift: int) -> None:
        """The words from ``low`` to ``high`` equal those ``shift`` further on, and no more do."""
        if high - low >= shift:
            key = (low, high + shift)
            self.period[key] = min(shift, self.period.get(key, shift))

    def grow(self, at: int, shift: int) -> int:
        """Add the stretch around ``at``, a position whose word equals the one ``shift`` further on; gives its end."""
        high = _same_ahead(self.seq, at, shift)
        if high > at:
            self.add(_same_behind(self.seq, at, shift), high, shift)
        return max(high, at + 1)

    def regions(self, most: int, least: int) -> list[tuple[int, int, int]]:
        return sorted((a, b, p) for (a, b), p in self.period.items() if p <= most and b - a >= least)


def _small_periods(found: _Found) -> None:
    seq = found.seq
    for shift in range(1, min(_SMALL, len(seq))):
        same = np.concatenate([[0], (seq[:-shift] == seq[shift:]).view(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        low, high = edge[::2], edge[1::2]
        long = high - low >= shift
        for a, b in zip(low[long].tolist(), high[long].tolist(), strict=True):
            found.add(a, b, shift)


def _equal_contexts(names: np.ndarray, wide: np.ndarray, scale: int, regions: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of positions of the synchronising set with equal contexts, 3 to 6 scales apart."""
    names = names.copy()
    for a, b, _ in regions:  # fragments of a small period
        names[a : b - scale + 1] = _NONE
    size = len(names) - scale
    least = np.minimum(_window_min(names, scale)[:size], names[scale:])
    at = np.flatnonzero((least != _NONE) & ((least == names[:size]) | (least == names[scale:])))
    at = at[at < len(wide)]
    context = wide[at]
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    left, shift, k = [], [], 1
    alive = np.arange(len(at))
    while True:
        alive = alive[alive + k < len(at)]
        gap = at[alive + k] - at[alive]
        keep = (context[alive + k] == context[alive]) & (gap < 6 * scale)
        alive, gap = alive[keep], gap[keep]
        if not len(alive):
            break
        far = gap >= 3 * scale
        left.append(at[alive[far]])
        shift.append(gap[far])
        k += 1
    return (np.concatenate(left), np.concatenate(shift)) if left else (at[:0], at[:0])


def _turned(word: np.ndarray, other: np.ndarray) -> int | None:
    """By how many places ``word`` has to be turned to give ``other``."""
    twice, wanted, at = np.concatenate([word, word[:-1]]).tobytes(), other.tobytes(), -1
    while (at := twice.find(wanted, at + 1)) >= 0:
        if at % word.itemsize == 0:
            return at // word.itemsize
    return None


def _joined_regions(found: _Found, scale: int, regions: list[tuple[int, int, int]]) -> None:
    """Runs of a period from 3 to 6 scales whose first period lies in a region of small period and the second in the next one that it touches."""
    seq, by = found.seq, {}
    for a, b, p in regions:
        by.setdefault(p, []).append((a, b))
    for p, some in by.items():
        for (a1, b1), (a2, b2) in zip(some, some[1:]):
            if a2 > b1:
                continue
            step = _turned(seq[a1 : a1 + p], seq[a2 : a2 + p])
            if step is None:
                continue
            first = 3 * scale + (a2 - a1 - step - 3 * scale) % p
            for q in range(first, min(6 * scale, b1 - a1 + 1, b2 - a2 + 1), p):
                if a2 - a1 == q or b2 - b1 == q:  # both regions begin or end together, so that the equal words may go on
                    found.grow(max(a1, a2 - q), q)
                else:
                    found.add(max(a1, a2 - q), min(b1, b2 - q), q)


def find_runs(seq: np.ndarray, lengths: np.ndarray, rule: RunRule = RunRule()) -> np.ndarray:
    """Rows (start, end, period), sorted, of all runs of ``rule.least`` words or more.

    ``seq`` holds word numbers; after each document of ``lengths`` words comes a number that occurs nowhere else.
    """
    if not len(seq):
        return np.zeros((0, 3), np.int64)
    found = _Found(seq)
    _small_periods(found)
    names, scale, longest = _mixed(seq.astype(np.uint64), np.uint64(1)), 1, int(lengths.max(initial=0))
    while 12 * scale <= longest:  # two periods of three times the next scale
        scale *= 2
        names = _mixed(names[: -scale // 2], names[scale // 2 :])
        if len(names) <= 2 * scale:
            break
        periodic = found.regions(scale // 3, scale)
        at, shift = _equal_contexts(names, _mixed(names[:-scale], names[scale:]), scale, periodic)
        order = np.lexsort((at, shift))
        done, last = -1, -1
        for i, d in zip(at[order].tolist(), shift[order].tolist(), strict=True):
            if d != last:
                done, last = -1, d
            if i >= done:
                done = found.grow(i, d)
        _joined_regions(found, scale, [r for r in periodic if r[1] - r[0] >= 3 * scale])
    out = sorted((a, b, p) for (a, b), p in found.period.items() if b - a >= rule.least)
    return np.array(out, np.int64).reshape(-1, 3)


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a document whose repetition is planted; None for the others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def _digest(parts: Iterator[str] | list) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _described(doc_id: int | None, parts: list[bytes], runs: np.ndarray) -> tuple:
    """The row of one document; runs are counted from its first word."""
    start, length, period = runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]
    order = np.lexsort((period, start))
    listed = (f"{a},{n},{q}\n" for a, n, q in zip(start[order].tolist(), length[order].tolist(), period[order].tolist(), strict=True))
    text, kept = parts, len(parts)
    best = (None,) * 4
    if len(runs):
        top = np.lexsort((period, start, -length))[0]
        best = (int(start[top]), int(length[top]), int(period[top]), int(1000 * length[top] // period[top]))
        depth = np.zeros(len(parts) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, runs[:, 1], -1)
        stay = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
        text, kept = [parts[i] for i in stay.tolist()], len(stay)
    return (doc_id, len(runs), *best, _digest(listed), hashlib.sha256(b" ".join(text)).hexdigest(), len(parts), len(parts) - kept)


def _rows(rule: RunRule, plant: bool):
    fields = [f.split(" ") for f in SCHEMA.split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in fields]

    def search(docs: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        number: dict[bytes, int] = defaultdict(count().__next__)
        lengths = np.fromiter((len(parts) for _, parts in docs), np.int64, len(docs))
        pieces, begins, at = [], [], 0
        for k, (_, parts) in enumerate(docs):
            pieces.append(np.array(list(map(number.__getitem__, parts)), np.int64))
            pieces.append(np.array([-1 - k], np.int64))
            begins.append(at)
            at += len(parts) + 1
        runs = find_runs(np.concatenate(pieces), lengths, rule)
        begin = np.array(begins, np.int64)
        cut = np.searchsorted(runs[:, 0], np.append(begin, at))
        out = [_described(doc, parts, runs[cut[k] : cut[k + 1]] - np.array([begin[k], begin[k], 0])) for k, (doc, parts) in enumerate(docs)]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc, parts = doc.as_py(), (text.as_py() or "").encode().split()
                other = planted(len(parts), doc) if plant else None
                if other is not None:
                    parts = [parts[i] for i in other.tolist()]
                if held and words + len(parts) > rule.together:
                    yield search(held)
                    held, words = [], 0
                held.append((doc, parts))
                words += len(parts)
        if held:
            yield search(held)

    return run


def periodic_runs(docs: DataFrame, rule: RunRule = RunRule(), plant: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): its runs of words, split at ASCII white space, and the text without repetitions.

    ``plant`` first repeats words of about a tenth of the documents, chosen by a hash of the doc_id; a null doc_id is never chosen.
    Null and blank texts have no words and no run.  Rows that repeat a doc_id are each searched.  Other columns are ignored; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rows(rule, plant), SCHEMA)
