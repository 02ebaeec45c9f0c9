"""Near copies of the pipeline against brute force over five-word shingles."""
import numpy as np
import pytest

import corpus_pipeline
from roundscope.llm import bitsliced_simhash, shingle_dedup

from .conftest import ODD


def brute_sets(texts):
    out = []
    for text in texts:
        parts = (text or "").encode().lower().split()
        out.append({b" ".join(parts[i : i + 5]) for i in range(len(parts) - 4)} or {b" ".join(parts)})
    return out


def brute_groups(texts):
    """Smallest index of each text's component; candidates by an inverted index, so that no pair with a shingle in common is left out."""
    sets, parent, at = brute_sets(texts), list(range(len(texts))), {}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in at.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            at[x].append(i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def edits():
    """Copies of one text with a few words changed: most differ by 3 to 11 bits of SimHash."""
    rng, words = np.random.default_rng(3), [f"w{i}" for i in range(200)]
    out = []
    for k in range(1, 40):
        some = list(words)
        for i in rng.choice(200, k % 10, replace=False).tolist():
            some[i] = f"x{k}"
        out.append((100 + k, " ".join(some)))
    return out


def test_edited_copies_go(make, spark):
    docs = [(100, " ".join(f"w{i}" for i in range(200))), *edits(), *[(i, t) for i, t in ODD if i is not None]]
    groups = brute_groups([t for _, t in docs])
    least = {}
    for (doc, _), g in zip(docs, groups, strict=True):
        least[g] = min(doc, least.get(g, doc))
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, make(docs), "").collect()]
    assert sorted(got) == sorted(least.values()) and len(got) < len(docs) - 20
    assert corpus_pipeline.drop_near_copies(spark, make([]), "").count() == 0


@pytest.mark.parametrize("together", [512, 5])
def test_families_of_copies(make, together):
    """Families whose members are similar by 0.6 to 0.95: most buckets hold several components, and groups are cut where few sets go together."""
    rng, docs = np.random.default_rng(11), []
    for family in range(4):
        words = [f"f{family}w{i}" for i in range(120)]
        for _ in range(40):
            some = list(words)
            for i in rng.choice(120, int(rng.integers(0, 7)), replace=False).tolist():
                some[i] = f"x{int(rng.integers(0, 4))}"
            docs.append((len(docs), " ".join(some)))
            if rng.random() < 0.3:
                words = some
    groups = brute_groups([t for _, t in docs])
    rule = shingle_dedup.ShingleRule(together=together)
    assert sorted(r.doc_id for r in shingle_dedup.drop_similar(make(docs), rule).collect()) == sorted(set(groups))
    assert 8 < len(set(groups)) < 120


def test_null_and_repeated_ids(make):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(None, text), (7, text + " end"), (7, "quite another text of seven words here"), (None, "alone without an id or a copy"), (None, text + " end of it")]
    got = shingle_dedup.drop_similar(make(docs)).collect()
    assert sorted(r.text for r in got) == sorted(docs[i][1] for i in (1, 2, 3))


def test_like_brute_force_on_documents(spark):
    """Also a chain whose ends aren't similar: components of the whole table, not of buckets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = corpus_pipeline.drop_exact_copies(spark, docs, "")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    groups = brute_groups([t for _, t in rows])
    wanted = sorted(rows[i][0] for i in set(groups))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == wanted


def test_bucket_links_join_all_similar_sets():
    rng = np.random.default_rng(5)
    sets = []
    for i in range(300):
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64) if i % 50 == 0 else base
        base = np.concatenate([base[rng.integers(0, 4) :], rng.integers(0, 1 << 60, rng.integers(0, 5), dtype=np.uint64)])
        sets.append(np.unique(base))
    sets = [sets[i] for i in rng.permutation(len(sets))]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j], True))
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    links = shingle_dedup.similar_links(sets)
    root = {i: i for i in range(len(sets))} | dict(links)
    assert len({(root[i], top(i)) for i in range(len(sets))}) == len({top(i) for i in range(len(sets))}) == len(set(root.values()))
    assert 1 < len(set(root.values())) < len(sets)


def test_bit_sliced_simhash_proposes_copies(make):
    """Without MinHash bands, the copies within two bits of another one still go; a text within two bits that isn't similar stays."""
    rng, words = np.random.default_rng(7), [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join(words).upper(), None, " \n", "one two three", "one two three four"]
    for k in range(1, 30):
        some = list(words)
        for i in rng.choice(2000, k % 6, replace=False).tolist():
            some[i] = f"x{k}"
        texts.append(" ".join(some))
    line = " ".join(f"r{i}" for i in range(30))
    texts += [" ".join([line] * 200), " ".join([line] * 200 + [f"t{i}" for i in range(40)])]
    rule = shingle_dedup.ShingleRule(bands=0)
    near = bitsliced_simhash.NearRule(words=rule.words)
    prints, sets = [bitsliced_simhash.simhash(t, near) & (1 << 64) - 1 for t in texts], brute_sets(texts)
    bits = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    n = range(len(texts))

    def groups(links):
        top = list(n)
        for _ in n:
            top = [min(top[j] for j in n if links(i, j)) for i in n]
        return top

    close = groups(lambda i, j: bits(i, j) <= 2)
    wanted = groups(lambda i, j: close[i] == close[j] and alike(i, j))
    got = shingle_dedup.drop_similar(make(list(enumerate(texts))), rule).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(wanted))
    assert 1 < len(set(wanted)) < len(texts) - 10 and max(bits(0, i) for i in n if wanted[i] == 0) > 0
    assert bits(len(texts) - 2, len(texts) - 1) <= 2 and wanted[-1] != wanted[-2]
