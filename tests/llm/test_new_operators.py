"""License scan, periodic runs and resampling against brute force."""
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from roundscope.llm import license_scan, periodic_runs, segment_resampling

from .conftest import ODD

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def key(row):
    return tuple((x is not None, x) for x in row)


def brute_license(doc, text):
    words = WORD.findall(lowered(text))
    places = sorted((i, label) for label, phrase in BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)
    return (doc, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places})))


MIT = license_scan.TEXTS[0].text


def test_op11_base_places(make, spark):
    docs = [*ODD, (20, "MIT License, mit-license MIT license"), (21, "the GNU General Public License GNU general\npublic license"), (22, "cc by nc 4.0; CC-BY. ccby"), (23, "gnu general license"),
            (24, "mit license " * 5000), (25, "x " * 2047 + "apache license " + "y " * 2046 + "cc by"), (26, "ＭＩＴ license é mit\x00license"), (27, None)]
    some = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(r.doc_id, r.text) for r in some.collect()]
    for rows, frame in ((docs, make(docs)), (more, some)):
        got = license_scan.license_scan(frame).collect()
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute_license(d, t) for d, t in rows), key=key)
        for r in got:
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score == 1 if r.n_base else True)
    assert license_scan.license_scan(make([])).count() == 0


def test_op11_texts(make):
    words = MIT.split()
    edited = words[:12] + ["new", "words"] + words[12:25] + words[27:]
    docs = [(1, "before " * 9 + MIT + " after"), (2, " ".join(edited)), (3, " ".join(words[:10])), (4, "Free of charge, to any person " * 9), (5, " ".join(words) + " gap" * 30 + " " + " ".join(edited)),
            (6, "Released under CC BY-NC 4.0. All rights reserved."), (7, " ".join(reversed(words)))]
    spans = {}
    for r in license_scan.license_spans(make(docs)).collect():
        spans.setdefault(r.doc_id, []).append(r)
    n = len(WORD.findall(MIT))
    assert [(r.label, r.start, r.end, r.share) for r in spans[1]] == [("mit", 9, 9 + n, 1.0)]
    assert [(r.label, r.start, r.end) for r in spans[2]] == [("mit", 0, n)] and 0.6 <= spans[2][0].share < 1
    assert [r.label for r in spans[5]] == ["mit", "mit"] and {3, 4, 7}.isdisjoint(spans)
    got = {r.doc_id: r for r in license_scan.license_scan(make(docs)).collect()}
    assert (got[6].base_labels, got[6].labels) == ("cc-by", "all-rights-reserved,cc-by,cc-by-nc") and got[2].labels == "mit" and got[2].n_base == 0


def brute_runs(words):
    """Every maximal stretch of each period; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in found.items() if b - a >= 12)


def brute_described(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *four, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def strings(rng):
    """Strings that are rich in runs: binary, Fibonacci, Thue-Morse, powers of small words, copies with inserted letters, touching periodic regions."""
    fibonacci, last = [0], [0, 1]
    while len(last) < 300:
        fibonacci, last = last, last + fibonacci
    yield last
    yield [i.bit_count() % 2 for i in range(300)]
    yield [0] * 200
    yield ([0, 1] * 20 + [0]) * 3 + [1] + ([0, 1] * 20 + [0]) * 2
    for _ in range(12):
        yield rng.integers(0, 2, 200).tolist()
        grown = rng.integers(0, 3, 3).tolist()
        while len(grown) < 200:
            at = int(rng.integers(0, len(grown)))
            grown = grown * 2 if rng.random() < 0.5 else [*grown[:at], int(rng.integers(0, 3)), *grown[at:]]
        yield grown
        powers = []
        while len(powers) < 250:
            powers += rng.integers(0, 2, rng.integers(1, 5)).tolist() * int(rng.integers(1, 25))
        yield powers
        word = rng.integers(0, 2, rng.integers(2, 4)).tolist()
        yield [x for _ in range(5) for x in word * int(rng.integers(5, 30)) + word[: int(rng.integers(0, len(word)))]]


def test_runs_like_brute_force():
    texts = list(strings(np.random.default_rng(4)))
    seq, expected = [], []
    for k, some in enumerate(texts):
        expected += [(a + len(seq), b + len(seq), q) for a, b, q in brute_runs(some)]
        seq += [*some, -1 - k]
    got = periodic_runs.find_runs(np.array(seq), np.array([len(x) for x in texts]))
    assert [tuple(r) for r in got.tolist()] == sorted(expected) and len(expected) > 300


@pytest.mark.parametrize("together", [1 << 16, 1])
def test_op12_like_brute_force(make, together):
    rng = np.random.default_rng(6)
    docs = [*[r for r in ODD if r[0] != 8], (8, "word " * 900 + "end"), *[(1000 + k, " ".join(f"w{x}" for x in some)) for k, some in enumerate(strings(rng))],
            *[(2000 + k, " ".join(f"v{x}" for x in rng.integers(0, 90, 60))) for k in range(60)]]
    got = periodic_runs.periodic_runs(make(docs), periodic_runs.RunRule(together=together), plant=True).collect()
    expected = [brute_described(d, t) for d, t in docs]
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(expected, key=key)
    assert sum(e[1] > 0 for e in expected if (e[0] or 0) >= 2000) > 2
    assert periodic_runs.periodic_runs(make([])).count() == 0


def test_runs_of_a_very_long_text():
    rng = np.random.default_rng(8)
    block = rng.integers(0, 1000, 70_000)
    seq = np.concatenate([np.arange(5000, 6000), block, block, block[:500], np.zeros(300_000, np.int64), [-1]])
    got = periodic_runs.find_runs(seq, np.array([len(seq) - 1])).tolist()
    assert [1000, 1000 + 140_500, 70_000] in got and any(b - a >= 300_000 and q == 1 for a, b, q in got) and len(got) == 2


def brute_resample(docs, target):
    def features(text):
        w = WORD.findall(lowered(text))
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    def counts(texts):
        out = [0] * 10_000
        for t in texts:
            for f in features(t):
                out[zlib.crc32(f.encode()) % 10_000] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    out, able = [], []
    for doc, text in docs:
        f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10_000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None])
        if len(WORD.findall(lowered(text))) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r) for r in out]


@pytest.mark.parametrize("heavy", [1, 10_000])
def test_op13_like_brute_force(make, spark, monkeypatch, heavy):
    monkeypatch.setattr(segment_resampling, "HEAVY", heavy)  # 1: lines that make up less than all of the text are looked up by a shuffle
    long = "one two three four five six seven eight nine ten " * 3
    docs = [*ODD, (20, long + "\nshared line\n\n\r\nEnd.\nshared line"), (21, "shared line\n" * 30), (22, "shared line\n" * 30), (22, "shared line\n" * 30), (None, long), (23, "a\n" * 5000), (24, "é b" * 300 + "\x1c\nq")]
    target = ["Three four five.\nSix shared", None, "line seven"]
    got = segment_resampling.resample(make(docs), make(enumerate(target)).withColumnRenamed("doc_id", "item_id")).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_resample(docs, target), key=key)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = segment_resampling.resample(make(docs), make(enumerate(target)).withColumnRenamed("doc_id", "item_id")).collect()
    assert sorted(tuple(r) for r in got if r.rank) == sorted(r for r in brute_resample(docs, target) if r[4]) and len(got) == len(docs)
    assert segment_resampling.resample(make([]), make([(1, "x")]).withColumnRenamed("doc_id", "item_id")).count() == 0
