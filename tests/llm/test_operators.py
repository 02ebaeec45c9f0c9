"""Each operator against a brute-force version on small documents with odd cases."""
import hashlib
import re
import sys
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from roundscope.llm import bitsliced_simhash, byte_bpe, chunk_dedup, cross_entropy, hash_ring, phrase_fingerprint, pii, pivotal_mix, string_kernel, token_blocks, word_encoder
from roundscope.llm.queries import BYTE_RANKS, ORACLES, QUERIES, WORD_VOCABULARY

from .conftest import ODD

SPACE = r"[\x20\x09-\x0D]+"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_block_payload_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1024, 3000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        ids[: n // 2] >>= 20
        data = token_blocks.write_blocks(ids)
        assert (token_blocks.read_blocks(data) == ids).all()
        assert (token_blocks.read_blocks(data, n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_op1_token_files(make):
    tok = Tokenizer.from_file(P.path(WORD_VOCABULARY))
    docs = [r for r in ODD if r[0] != 6] + [(11, "It's <|endoftext|> 3.14, ok."), (12, "“q”. É, Σς")]
    expected, start = [], 0
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    files = token_blocks.write_token_files(make(docs), P.path(WORD_VOCABULARY))
    assert rows(token_blocks.describe_token_files(files)) == expected
    assert rows(token_blocks.describe_token_files(token_blocks.write_token_files(make([]), P.path(WORD_VOCABULARY)))) == []


def test_op1_words_go_to_the_library_together():
    """New words don't cost a call of the library each, and their ids are those of whole texts."""
    rng = np.random.default_rng(4)
    letters, ends = [*"abcdeXYZ", "é", "Ö", "ß"], ["", "", ".", ",", "$$$", ".***", "!", "'s", "×", "\u0301", "=\u0338", "9", "日", "\x85"]
    texts = [" ".join("".join(rng.choice(letters, 9)) + ends[int(rng.integers(len(ends)))] + ends[int(rng.integers(len(ends)))] for _ in range(300)) for _ in range(20)]
    encoder, calls = word_encoder.WordEncoder(P.path(WORD_VOCABULARY)), []

    def seen(frame, event, arg):
        if event == "c_call" and type(getattr(arg, "__self__", None)).__module__.startswith("tokenizers"):
            calls.append(arg.__name__)

    sys.setprofile(seen)
    try:
        got = encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert [x.tolist() for x in got] == [e.ids for e in Tokenizer.from_file(P.path(WORD_VOCABULARY)).encode_batch(texts, add_special_tokens=False)]
    assert 0 < len(calls) < 20


def test_op2_ring(make):
    docs = make([*ODD, *[(i, str(i)) for i in range(100, 500)], *[(77, "again")] * 150])
    got = hash_ring.shard_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == docs.count() and len(by) == 24
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    one = next(r for r in got if r.doc_id == 7)
    text = dict(ODD[:9])[7].encode()
    assert (one.size, one.text_crc32) == (len(text) + 8, zlib.crc32(text))
    assert hash_ring.shard_documents(make([])).count() == 0
    home = hash_ring.assign(docs.select("doc_id"), "doc_id", hash_ring.Ring(shards=1))
    assert {r.shard for r in home.collect()} == {0}


@pytest.mark.parametrize("bits", [64, 4])
def test_op3_recipes(make, bits):
    norm = lambda t: re.sub(SPACE, " ", t or "")
    groups = {}
    for doc, text in ODD:
        groups.setdefault(norm(text), []).append(doc)
    expected, seen = [], set()
    for doc, text in ODD:
        ids = groups[norm(text)]
        keep = min((i for i in ids if i is not None), default=None)
        kept = doc == keep and (doc, norm(text)) not in seen
        seen.add((doc, norm(text)))
        expected.append((doc, keep, len(ids), kept, hashlib.sha256(norm(text).encode()).hexdigest()))
    rule = chunk_dedup.Chunking(id_bits=bits)
    assert rows(chunk_dedup.exact_duplicates(make(ODD), rule)) == sorted(expected, key=lambda r: tuple((x is not None, x) for x in r))
    kept = chunk_dedup.drop_exact_duplicates(make(ODD), rule)
    assert kept.count() == len(groups) and kept.columns == make([]).columns
    assert chunk_dedup.exact_duplicates(make([]), rule).count() == 0


def test_chunk_boundaries_follow_content():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 122, 60_000).astype(np.uint8).tobytes()
    rule = chunk_dedup.Chunking()
    ends, moved = chunk_dedup.boundaries(data, rule), chunk_dedup.boundaries(b"x" * 333 + data, rule)
    assert ends[-1] == len(data) and len(set(ends) & {e - 333 for e in moved}) > len(ends) // 2


def test_op4_mix(make):
    rng = np.random.default_rng(5)
    docs = [(i, "w " * int(rng.integers(0, 60)), None, s) for s, lo, n in (("a", 0, 300), ("b", 1000, 200), ("c", 2000, 100), (None, 3000, 40), ("tiny", 4000, 3)) for i in range(lo, lo + n)]
    docs += [(9000, "same words here", None, "b")] * 50 + [(9001, None, None, "a")]
    got = pivotal_mix.mix_documents(make(docs)).collect()
    assert len(got) == len(docs) and sorted(got) == sorted(pivotal_mix.mix_documents(make(docs)).collect())
    total, source = {}, {r[0]: r[3] for r in docs}
    for doc, text, _, s in docs:
        total[s] = total.get(s, 0) + len((text or "").split())
    weight = dict(zip(["a", "b", "c", "tiny", None], [5, 2, 1, 5, 2], strict=True))
    free, target, left = set(total), {}, float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * total[s] for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    taken = {}
    for r in got:
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.taken <= 3 * r.size and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 60 for s in total)
    assert pivotal_mix.mixed_rows(make(docs)).count() == sum(r.copies for r in got)
    assert pivotal_mix.mix_documents(make([])).count() == 0


def test_op5_paths_agree(make):
    docs = [r for r in ODD if r[0] not in (8, 9)]
    target = make([(1, ""), (7, "")])
    near = rows(cross_entropy.cross_entropy_difference(make(docs), target))
    far = rows(cross_entropy.cross_entropy_difference(make(docs), target, cross_entropy.Models(broadcast_rows=0)))
    assert [r[:2] for r in near] == [r[:2] for r in far] and len(near) == len(docs)
    assert all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-9) for a, b in zip(near, far, strict=True))
    score = {r[0]: r[2] for r in near}
    assert score[3] is None and score[5] is None and score[1] < score[10]
    assert all(r[2] is None for r in cross_entropy.cross_entropy_difference(make(docs), make([])).collect())
    assert cross_entropy.cross_entropy_difference(make([]), target).count() == 0


def test_op6_fingerprints(make):
    docs = sorted((r for r in ODD if r[0] not in (6, 8)), key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    got = {r.doc_id: r for r in phrase_fingerprint.fingerprints(make(docs)).collect()}
    maker = phrase_fingerprint.Fingerprinter()
    for k, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        new = phrase_fingerprint.edited(text, after)
        a, b, c = (maker.one(x.encode()) for x in (text, new, after))
        like = phrase_fingerprint.likeness
        assert tuple(got[doc]) == (doc, len(text), hashlib.sha256(new.encode()).hexdigest(), phrase_fingerprint.to_text(a), phrase_fingerprint.to_text(b), like(a, b), like(a, c))
    assert phrase_fingerprint.fingerprints(make([])).count() == 0
    assert phrase_fingerprint.fingerprints(make([(1, "alone")])).first().near_next == 1.0


def test_likeness_is_the_overlap_of_phrase_sets(monkeypatch):
    """Against the phrase sets themselves, with windows too; texts without a common phrase have no likeness by chance."""
    def phrases(data):
        ends = phrase_fingerprint.phrase_ends(data)
        return {data[a:b] for a, b in zip([0, *ends], ends)}

    rng = np.random.default_rng(9)
    maker = phrase_fingerprint.Fingerprinter()
    for window in (1 << 20, 5000):
        monkeypatch.setattr(phrase_fingerprint, "WINDOW", window)
        for share in (0.0, 0.3, 0.7, 1.0):
            one = rng.integers(97, 101, 20_000).astype(np.uint8).tobytes()
            two = one[: int(share * len(one))] + rng.integers(97, 101, 20_000 - int(share * len(one))).astype(np.uint8).tobytes()
            a, b = phrases(one), phrases(two)
            assert abs(phrase_fingerprint.likeness(maker.one(one), maker.one(two)) - len(a & b) / len(a | b)) < 0.16
    monkeypatch.setattr(phrase_fingerprint, "WINDOW", 1 << 20)
    one, two = (rng.integers(lo, lo + 100, 2_000_000).astype(np.uint8).tobytes() for lo in (0, 120))
    assert not phrases(one) & phrases(two) and phrase_fingerprint.likeness(maker.one(one), maker.one(two)) == 0


def test_lz_phrases():
    known, phrase, expected = set(), b"", []
    data = b"abracadabra abracadabra"
    for i in range(len(data)):
        phrase += data[i : i + 1]
        if phrase not in known:
            known.add(phrase)
            expected.append(i + 1)
            phrase = b""
    assert phrase_fingerprint.phrase_ends(data) == expected + ([len(data)] if phrase else [])


def brute_simhash(text):
    flat = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", flat)
    shingles = [" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or ([" ".join(parts)] if parts else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [2048, 2])
def test_op7_components(make, most):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    docs = [r for r in ODD if r[0] not in (None, 8)] + [(100 + i, " ".join([*words[:i], "changed", *words[i + 1 :]])) for i in rng.choice(400, 60, replace=False).tolist()]
    prints = {doc: brute_simhash(text) for doc, text in docs}
    parent = {d: d for d in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    expected = sorted((d, f"{prints[d]:016x}", top(d)) for d, _ in docs)
    rule = bitsliced_simhash.NearRule(bucket_rows=most)
    assert rows(bitsliced_simhash.near_duplicates(make(docs), rule)) == expected
    assert len({e[2] for e in expected}) < len(set(prints.values()))
    assert bitsliced_simhash.near_duplicates(make([]), rule).count() == 0


def test_op7_null_and_repeated_ids(make):
    """A row without doc_id links its neighbours, and rows that repeat a doc_id stay in the components of their own texts."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(0, 400, 2)] + ["one text", "another text of some words", "a third"]
    docs = [((None, 7, i)[i % 3] if i < 200 else 7, t) for i, t in enumerate(texts)]
    prints = [brute_simhash(t) for t in texts]
    group = list(range(len(docs)))
    for _ in docs:  # as far as a link reaches
        new = [min(group[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2) for p in prints]
        group, old = new, group
        if group == old:
            break
    least = {g: min((d for (d, _), x in zip(docs, group, strict=True) if x == g and d is not None), default=None) for g in set(group)}
    expected = [(d, f"{p:016x}", least[g]) for (d, _), p, g in zip(docs, prints, group, strict=True)]
    assert rows(bitsliced_simhash.near_duplicates(make(docs))) == sorted(expected, key=lambda r: tuple((x is not None, x) for x in r))
    nulls = {g for (d, _), g in zip(docs, group, strict=True) if d is None}
    assert len(set(group)) > 3 and any(group.count(g) > 2 and g in nulls for g in set(group))


def test_bit_slices():
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**63))
    values = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(300)], np.uint64))
    planes = bitsliced_simhash.bit_planes(values)
    for v in values[:40]:
        mask = np.unpackbits(bitsliced_simhash.within_two(planes, int(v)).view(np.uint8), bitorder="little")[: len(values)]
        assert (mask.astype(bool) == (np.bitwise_count(values ^ v) <= 2)).all()


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_op8_personal_data(make):
    docs = [r for r in ODD if r[0] != 6] + [
        (20, "a@b.cd@e.f _x@y.z a@b.c_foo@bar.com 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 00300.1.1.1"), (21, "é 4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111111 5500005555555559"),
        (22, "+1 (988) 555-2485 +49 30 123456789012345 +1-22-33(44)5566+12345678901"), (23, "IBAN DE89 3704 0044 0532 0130 00 but DE88 3704 0044 0532 0130 00"), (24, "ssn 123-45-6789"), (25, "no word near, 123-45-6789"),
        (26, "1" * 30_000 + " " + "a" * 30_000 + "@")]
    got = {r.doc_id: r for r in pii.personal_data(make(docs)).collect()}
    for doc, text in docs:
        base = base_spans(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        r = got[doc]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), doc
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in base) for k, _ in BASE]
    assert got[23].n_added == 1 and got[24].spans == "ssn:4:15" and got[25].spans == ""
    assert pii.personal_data(make([])).count() == 0


@pytest.mark.parametrize("text", [
    "mail a@b" + ".c" * 200_000 + " end", "".join(f"u{i}@h.org, " for i in range(20_000)), "é" * 70_000 + " +49 30 1234567 " * 3_000, "1.2.3.4 " * 10_000 + "x" * 100_000 + " 5500005555555559" * 2_000])
def test_op8_long_texts(make, text):
    """Many labels in one address and many matches in one text: time grows with the text, and Java's stack holds."""
    began = time.monotonic()
    r = pii.personal_data(make([(1, text)])).first()
    listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_spans(text))
    assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and time.monotonic() - began < 60


def test_op8_context(make):
    """Context is the text next to a span, whatever stands there: other spans too, and no further than it reaches."""
    docs = [(1, "ssn 123-45-6789, 987-65-4321"), (2, "ssn " + "x" * 35 + " 123-45-6789"), (3, "ssn " + "x" * 36 + " 123-45-6789"), (4, "123-45-6789 and 987-65-4321 are social security numbers"),
            (5, " ".join(f"{100 + i}-45-6789" for i in range(9)) + " ssn")]
    got = {r.doc_id: r.spans for r in pii.personal_data(make(docs)).collect()}
    for doc, text in docs:
        spans = [m.span() for m in re.finditer(r"\d{3}-\d{2}-\d{4}", text)]
        near = [s for s in spans if re.search("(?i)(?<![A-Za-z])(?:ssn|social security)", text[max(0, s[0] - 40) : s[0]] + " " + text[s[1] : s[1] + 40])]
        assert got[doc] == ",".join(f"ssn:{a}:{b}" for a, b in near), doc
    assert got[3] == "" and got[2] and got[5].count("ssn") == 4


def test_op9_like_tiktoken(make):
    docs = [r for r in ODD if r[0] != 6] + [(30, "a  b  c\n\n d\tf \x1cq I'll\r\n x"), (31, "  lead and trail  \n"), (32, "ababab " * 40), (33, "x   y, z.\n\nQ")]
    ranks = byte_bpe.read_ranks(P.path(BYTE_RANKS))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for doc, text in docs:
        ids = enc.encode_ordinary(text or "")
        expected.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows(byte_bpe.round_trip(make(docs), P.path(BYTE_RANKS), P.PATTERN)) == sorted(expected, key=lambda r: tuple((x is not None, x) for x in r))
    full = {r.doc_id: r for r in byte_bpe.token_ids(make(docs), P.path(BYTE_RANKS), P.PATTERN).collect()}
    text = dict(docs)[7]
    assert full[7].decoded == text and full[7].ends[-1] == len(text) and full[3].ids == []
    assert byte_bpe.round_trip(make([]), P.path(BYTE_RANKS), P.PATTERN).count() == 0


def test_op10_languages(make, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = string_kernel.predict(docs, string_kernel.train(docs)).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    model = string_kernel.train(docs)
    odd = {r.doc_id: r for r in string_kernel.predict(make(ODD), model).collect()}
    assert [odd[i].lang_pred for i in (3, 4, 5, 10)] == ["und"] * 4 and odd[3].score == 0 and all(0 <= r.score <= 1 for r in odd.values())
    assert string_kernel.keep_identified(make(ODD), model).where("doc_id in (3, 4, 5, 10)").count() == 0
    assert {r.lang_pred for r in string_kernel.predict(make(ODD), string_kernel.train(make(ODD))).collect()} == {"und"}
    assert string_kernel.predict(make([]), model).count() == 0


def brute_grams(text):
    """Letter n-grams of one to three places; what is no letter is a blank, and one stands at either end."""
    flat = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return {flat[i : i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1)}


@pytest.mark.parametrize("bits", [20, 3])
def test_presence_kernel(monkeypatch, bits):
    """Also with a table so small that most n-grams share a slot."""
    monkeypatch.setattr(string_kernel, "_SLOT_BITS", bits)
    monkeypatch.setattr(string_kernel, "_CELLS", 1)
    marks, texts = ["abc abd", "xyz", "Der Hund läuft schnell."], ["abq", "жж", "", "The hound, abc xyz!", "abc abd" * 50]
    expected = [[len(brute_grams(t) & brute_grams(m)) / np.sqrt(len(brute_grams(t)) * len(brute_grams(m))) for m in marks] for t in texts]
    assert np.allclose(string_kernel.Kernel(marks).values(texts)[0], expected, atol=1e-6)


def test_ridge_regression_in_the_landmarks_space():
    """The scores are those of kernel ridge regression with the kernel that the landmarks span, solved here in its dual form."""
    sample = [("de", t) for t in ("der hund und die katze", "ein haus am see", "wir gehen nach hause")] + [("en", t) for t in ("the dog and the cat", "a house by the lake", "we are going home")]
    training = string_kernel.Training(landmarks=2, ridge=0.1)
    model = string_kernel.Model(sample, training)
    texts = ["die katze geht", "the cat goes", "haus house"]
    kernel = lambda a, b: len(brute_grams(a) & brute_grams(b)) / np.sqrt(len(brute_grams(a)) * len(brute_grams(b)))
    marks = [t for i, (_, t) in enumerate(sample) if i % 3 < 2]
    inner = np.linalg.inv([[kernel(a, b) for b in marks] for a in marks])
    span = lambda a, b: np.array([kernel(a, m) for m in marks]) @ inner @ np.array([kernel(m, b) for m in marks])
    known = [t for _, t in sample]
    gram, n = np.array([[span(a, b) for b in known] for a in known]), len(sample)
    left = np.block([[gram + training.ridge * 3 * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])  # three texts a language: weight 1/3
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        f = {}
        for lang in ("de", "en"):
            solved = np.linalg.solve(left, [*[1.0 if own == lang else -1.0 for own, _ in sample], 0.0])
            f[lang] = np.array([span(text, k) for k in known]) @ solved[:-1] + solved[-1]
        best = max(f, key=f.get)
        assert name == best and abs(score - (f[best] + 1) / 2) < 1e-4


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLES) <= set(QUERIES)


def test_unit_lookup_is_exact(monkeypatch):
    """Units of one hash, among them the sequences that polynomial hashes of 64 bits can't tell apart, keep ids of their own."""
    from roundscope.llm import unit_memory

    a, b = b"a", b"b"
    for _ in range(12):
        a, b = a + b, b + a
    short = [bytes([97 + i % 26]) * (i % 90 + 1) + bytes([97 + i % 7]) for i in range(300)]
    texts = [a + b" x", b + b" x", b" ".join(short), b" ".join(reversed(short)), b"", b"tail\0 tail", b"\xc3\xa9" * 40]
    wanted = [[list(u) for u in t.split(b" ") if u] for t in texts]
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(unit_memory, "mixed", lambda h, word: h * np.uint64(0))
        memory = unit_memory.UnitMemory(unit_memory.words, lambda units: [[*u] for u in units], "<u4")
        for _ in range(3):
            got = memory.encode(texts)
            assert [g.tolist() for g in got] == [[c for u in w for c in u] for w in wanted]
        assert max(map(len, memory.at)) <= unit_memory.LONGEST and len(memory.ends) == len(memory.at) + 1
