"""Language identification by a string kernel.

The blended spectrum of a text is the set of its letter n-grams of one to three places.  The kernel of two texts is the number of
n-grams present in both, divided by the geometric mean of their numbers of n-grams.  Training texts serve as Nystroem landmarks, and
one-versus-rest kernel ridge regression is solved in the landmarks' feature space.  N-grams that no landmark holds can't add to a kernel
value, so the landmarks' n-grams are the vocabulary, and a batch of texts is scored by matrix products: presence by landmarks, then
kernel values by weights.

Training takes at most ``per_language`` texts of each language, those with the smallest hashes of doc_id, and of these at most ``landmarks`` as
landmarks; texts over ``longest`` code points are left out of that sample, and of more than ``languages`` values of lang the most frequent are taught.
Prediction reads whole texts.

A text that is null or has no letter is ``und`` with score 0.  A text that shares no n-gram with a letter with the landmarks gets the first language
with score 0.
Ties go to the first language by code point.  Without any labelled text all are ``und``.  Rows that repeat a doc_id are each predicted.
Other columns are ignored; an empty table gives no rows.

The score only ranks the taught languages, so ``keep_identified`` goes by evidence: the share of a text's n-grams (repeats included, blank ones not) that
landmarks hold.  The training texts say how large it is for texts of the taught languages, landmarks by n-grams that other landmarks hold too.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import importable

UNDECIDED = "und"
_SLOT_BITS = 20
#: Cells of the matrix of texts by n-grams that is made at once.
_CELLS = 1 << 23
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Keys of the n-grams of spaces alone.
_BLANK = [np.uint64(32), np.uint64(32 << 21 | 32), np.uint64(32 << 42 | 32 << 21 | 32)]


@dataclass(frozen=True)
class Training:
    per_language: int = 200
    landmarks: int = 32
    longest: int = 20_000
    languages: int = 256
    ridge: float = 1e-2


def _letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(1 << 16)])


def grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, bool]:
    """Keys of all n-grams of a text, repeats included, and whether it has a letter.  What is no letter counts as a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = points >= 1 << 16
    is_letter = letters[np.where(wide, 0, points)]
    if wide.any():
        is_letter[wide] = [chr(p).isalpha() for p in points[wide].tolist()]
    x = np.where(is_letter, points, 32).astype(np.uint64)
    x = np.concatenate([np.full(1, 32, np.uint64), x, np.full(1, 32, np.uint64)])
    two = (x[:-1] << np.uint64(21)) | x[1:]
    three = (two[:-1] << np.uint64(21)) | x[2:]
    return np.concatenate([x, two, three]), bool(is_letter.any())


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * _MIX) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


class Kernel:
    """Vocabulary and landmark matrix.  A table finds most n-grams of the vocabulary, a binary search those that fall on another's slot of it."""

    def __init__(self, landmarks: list[str]) -> None:
        self.letters = _letter_table()
        sets = [np.unique(grams(t, self.letters)[0]) for t in landmarks]
        self.keys = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
        slots = _slots(self.keys)
        self.table = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.table[slots] = np.arange(len(slots))
        self.shared = np.bincount(slots, minlength=1 << _SLOT_BITS) > 1
        rows = [self.presence(g) for g in sets]
        self.matrix = np.array(rows, np.float32).reshape(len(rows), len(self.keys))
        self.norms = np.sqrt(np.maximum(1, self.matrix.sum(axis=1)))
        self.holders = self.matrix.sum(axis=0)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's column of the matrix, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        slots = _slots(keys)
        at = self.table[slots].astype(np.int64)
        at[self.keys[np.maximum(at, 0)] != keys] = -1
        other = np.flatnonzero((at < 0) & self.shared[slots])
        place = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
        at[other] = np.where(self.keys[place] == keys[other], place, -1)
        return at

    def presence(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.keys), np.float32)
        at = self.places(keys)
        out[at[at >= 0]] = 1
        return out

    def overlap(self, keys: np.ndarray, holders: int = 1) -> tuple[int, int]:
        """How many n-grams with a letter there are, repeats included, and how many of them at least ``holders`` landmarks hold."""
        keys = keys[(keys != _BLANK[0]) & (keys != _BLANK[1]) & (keys != _BLANK[2])]
        at = self.places(keys)
        return len(keys), int((self.holders[at[at >= 0]] >= holders).sum())

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kernel values with the landmarks, whether a text has letters, and how many n-grams with a letter it has and shares."""
        step = max(1, _CELLS // max(1, len(self.keys)))
        parts = [self._some(texts[i : i + step]) for i in range(0, max(1, len(texts)), step)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows, counts = np.zeros((len(texts), len(self.keys)), np.float32), np.zeros((3, len(texts)), np.int64)
        letters = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            keys, letters[i] = grams(text, self.letters)
            at = self.places(keys)
            known = at >= 0
            rows[i, at[known]] = 1
            blank = (keys == _BLANK[0]) | (keys == _BLANK[1]) | (keys == _BLANK[2])
            counts[:, i] = len(keys) - blank.sum(), (known & ~blank).sum(), len(np.unique(keys[~known]))
        own = rows.sum(axis=1) + counts[2]  # distinct n-grams of the whole text, those that no landmark holds too
        return (rows @ self.matrix.T) / np.sqrt(np.maximum(1, own))[:, None] / self.norms, letters, counts[0], counts[1]


class Model:
    def __init__(self, sample: list[tuple[str, str]], training: Training) -> None:
        """``sample``: (language, text), each language's landmarks first."""
        self.languages = sorted({lang for lang, _ in sample})
        seen: dict[str, int] = {}
        marks = [t for lang, t in sample if seen.setdefault(lang, 0) < training.landmarks and not seen.update({lang: seen[lang] + 1})]
        self.kernel = Kernel(marks)
        if not sample:
            return
        self.strange = self._strange(sample, training)
        inner, _, _, _ = self.kernel.values(marks)
        values, vectors = np.linalg.eigh(inner.astype(np.float64))
        keep = values > 1e-8 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        cross, _, _, _ = self.kernel.values([t for _, t in sample])
        features = np.column_stack([cross @ root, np.ones(len(sample))])
        wanted = np.array([[1.0 if lang == own else -1.0 for own in self.languages] for lang, _ in sample])
        # languages weigh the same however many texts each has
        weight = np.array([1 / sum(x == lang for x, _ in sample) for lang, _ in sample])[:, None]
        left = features.T @ (weight * features) + training.ridge * np.diag([*[1.0] * root.shape[1], 0.0])
        solved = np.linalg.solve(left, features.T @ (weight * wanted))
        self.weights, self.bias = root @ solved[:-1], solved[-1]

    def _strange(self, sample: list[tuple[str, str]], training: Training) -> float:
        """The largest share of unknown n-grams that a text of a taught language may have: thrice what 99 % of the training texts stay within, 0.12 at least (keys, licences)."""
        seen: dict[str, int] = {}
        shares: dict[str, list[float]] = {}
        for lang, text in sample:
            seen[lang] = seen.get(lang, 0) + 1
            total, known = self.kernel.overlap(grams(text, self.kernel.letters)[0], 2 if seen[lang] <= training.landmarks else 1)
            if total:
                shares.setdefault(lang, []).append(1 - known / total)
        # once a language has texts besides its landmarks, these alone speak for it
        worst = [np.quantile(x[training.landmarks :] if len(x) >= 2 * training.landmarks else x, 0.99) for x in shares.values()]
        return float(np.clip(3 * max(worst, default=0), 0.12, 0.5))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of each text, and whether its n-grams are those of the taught languages.

        Two unknown n-grams are let pass in short texts, but at least half must be known.
        """
        if not self.languages:
            return [UNDECIDED] * len(texts), [0.0] * len(texts), [False] * len(texts)
        kernel, letters, total, known = self.kernel.values([t or "" for t in texts])
        shared = known > 0
        f = kernel @ self.weights + self.bias
        best = f.argmax(axis=1)
        score = np.where(shared, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1), 0.0)
        name = [self.languages[b if s else 0] if has else UNDECIDED for b, has, s in zip(best, letters, shared, strict=True)]
        usual = letters & (2 * known >= total) & (total - known <= self.strange * total + 2)
        return name, np.where(letters, score, 0.0).tolist(), usual.tolist()


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def sample(docs: DataFrame, training: Training = Training()) -> list[tuple[str, str]]:
    """Labelled texts for training, at most ``per_language`` for each language, in hash order.

    A share of the hash range holds twice as many candidates as wanted; only they are ranked, so no language is gathered in one task.
    """
    rows = docs.where(~held_out()).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= training.longest))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id").alias("h"))
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(training.languages)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return []
    share = {lang: min(1.0, (2 * training.per_language + 50) / n) for lang, n in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, float(s))]), F.col("lang"))
    some = rows.where(F.col("lang").isin(list(counts))).where(F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53) < limit)
    ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    return [(r["lang"], r["text"]) for r in ranked.where(F.col("k") <= training.per_language).orderBy("lang", "k").collect()]


def train(docs: DataFrame, training: Training = Training()) -> Model:
    return Model(sample(docs, training), training)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text is an input of the prediction."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some megabytes: landmarks by their n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                names, scores = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.25) -> DataFrame:
    """The rows of ``docs``, all columns, in a taught language by their n-grams, with a score of at least ``least``."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        out = [s if usual else -1.0 for i in range(0, len(text), 256) for _, s, usual in zip(*shared.value.judge(text.iloc[i : i + 256].tolist()), strict=True)]
        return pd.Series(out, index=text.index, dtype=float)

    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) >= least)
