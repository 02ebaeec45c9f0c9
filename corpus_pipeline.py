"""A training corpus from ``documents``: language ID, exact dedup, near dedup, mixing and byte-level BPE.

Stages take (spark, docs, sf_dir) and return a DataFrame.  All but the last return the columns of documents.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roundscope.llm import byte_bpe, chunk_dedup, pivotal_mix, shingle_dedup, string_kernel
from roundscope.llm.queries import BYTE_RANKS
from roundscope.llm.support import documents, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language that the labelled documents teach, go."""
    return string_kernel.keep_identified(docs, string_kernel.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays."""
    return chunk_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies, the document with the smallest doc_id stays.

    Bit-sliced SimHash proposes them, MinHash bands add those beyond its radius, and an exact check follows (five-word shingles, similarity 0.8 or more).
    """
    return shingle_dedup.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat as often as the mix takes their documents."""
    return pivotal_mix.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text, for every row of the mix."""
    return byte_bpe.token_ids(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, offsets=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("byte_bpe", encode),
]

#: Hashes, random rounding and byte-level BPE have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
