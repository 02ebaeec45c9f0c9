"""The pipeline against the operators' brute-force meaning on a small fixture."""
import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from roundscope.llm import byte_bpe
from roundscope.llm.queries import BYTE_RANKS

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "exact_dedup":
            assert docs.count() == len({" ".join(t.split()) for t in before.values()})
    mixed = [(r.doc_id, r.text) for r in docs.collect()]
    assert mixed and all(before[i] == t for i, t in mixed) and max(mixed.count(x) for x in set(mixed)) <= 3
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(BYTE_RANKS)), special_tokens={})
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in mixed)
    for r in got:
        assert r.ids == enc.encode_ordinary(before[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
