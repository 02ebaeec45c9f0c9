"""Registered queries of the operators and, where SQL can express one, its oracle."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bitsliced_simhash, byte_bpe, chunk_dedup, cross_entropy, hash_ring, license_scan, periodic_runs, phrase_fingerprint, pii, pivotal_mix
from . import segment_resampling, string_kernel, token_blocks
from .support import documents

WORD_VOCABULARY, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_blocks.write_token_files(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))
    return token_blocks.describe_token_files(files)


def op2_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_ring.shard_documents(documents(spark, sf_dir))


def op3_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_duplicates(documents(spark, sf_dir))


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix_documents(documents(spark, sf_dir))


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with quality 1 are the target, all documents the background."""
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return cross_entropy.cross_entropy_difference(documents(spark, sf_dir), target)


def op6_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprint.fingerprints(documents(spark, sf_dir))


def op7_bitsliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced_simhash.near_duplicates(documents(spark, sf_dir))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return string_kernel.predict(docs, string_kernel.train(docs))


def op11_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(documents(spark, sf_dir), plant=True)


def op13_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of ``benchmark`` are the target."""
    return segment_resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_blocks, op2_hash_ring, op3_chunk_recipes, op4_pivotal_mix, op5_cross_entropy, op6_phrase_fingerprint,
        op7_bitsliced_simhash, op8_personal_data, op9_byte_bpe, op10_string_kernel, op11_license_diagonals, op12_periodic_runs, op13_segment_resampling)
}

def _license_sql(rule: license_scan.ScanRule = license_scan.ScanRule()) -> str:
    """The scan with the words of k-grams instead of their hashes."""
    every = [*((t, rule.phrase_words, 0) for t in license_scan.PHRASES), *((t, rule.text_words, rule.slack) for t in license_scan.TEXTS)]
    rows = []
    for name, (t, k, slack) in enumerate(every):
        parts = [w.decode() for w in license_scan.words(t.text)]
        rows += [f"({name}, '{t.label}', {t.base}, {len(parts)}, {slack}, {k}, {j}, {((1 << k) - 1) << j}::BIGINT, '{' '.join(parts[j : j + k])}')" for j in range(len(parts) - k + 1)]
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
        WITH p(template, label, base, size, slack, k, place, mask, gram) AS (VALUES {', '.join(rows)}),
             d AS (SELECT row_number() OVER () AS node, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             g AS (SELECT node, i, k, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM (SELECT node, w, k, unnest(generate_series(0, len(w) - k)) AS i FROM d, (SELECT unnest([{rule.phrase_words}, {rule.text_words}]) AS k))),
             l AS (SELECT node, template, label, base, size, slack, i - place AS diagonal, bit_or(mask) AS mask, min(i) AS a FROM g JOIN p USING (k, gram) GROUP BY ALL),
             s AS (SELECT *, sum(new) OVER (PARTITION BY node, template ORDER BY diagonal) AS span FROM (
               SELECT *, CASE WHEN slack = 0 OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY node, template ORDER BY diagonal) > slack, TRUE) THEN 1 ELSE 0 END AS new FROM l)),
             v AS (SELECT * FROM (SELECT node, template, label, base, size, slack, span, bit_count(bit_or(mask)) AS held, min(a) AS a FROM s GROUP BY ALL) WHERE CASE WHEN slack = 0 THEN held = size ELSE held / size >= {rule.least} END)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word,
          coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
          coalesce(max(held / size), 0) AS score, count(v.node) AS n_spans FROM d LEFT JOIN v USING (node) GROUP BY node, doc_id, w"""


def _resampling_sql(rule: segment_resampling.Resampling = segment_resampling.Resampling()) -> str:
    """Whole texts without cutting them into lines; CRC-32 byte by byte, once for each distinct feature."""
    upper = "".join(map(chr, range(65, 91)))
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS steps),
             d AS (SELECT row_number() OVER () AS node, doc_id, {words} AS w FROM documents), b AS (SELECT {words} AS w FROM benchmark),
             fd AS (SELECT node, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
             fb AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
             e AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
             k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, y: xor(c >> 8, steps[(xor(c, y) & 255) + 1])), 4294967295) % {rule.buckets} AS bucket FROM e, t),
             s AS (SELECT bucket, count(*) AS s FROM fd JOIN k USING (f) GROUP BY 1), u AS (SELECT bucket, count(*) AS t FROM fb JOIN k USING (f) GROUP BY 1),
             n AS (SELECT (SELECT count(*) FROM fd) AS sn, (SELECT count(*) FROM fb) AS tn),
             g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sn + {rule.buckets}) / ((coalesce(s, 0) + 1)::DOUBLE * (tn + {rule.buckets})))) AS BIGINT) AS gain FROM s FULL JOIN u USING (bucket), n),
             v AS (SELECT node, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM fd JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
             r AS (SELECT node, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
               CAST('0x' || substr(sha256('{rule.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN v USING (node)),
             q AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, words >= {rule.least_words} AS able FROM r),
             o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id, node) AS place, count(*) FILTER (able) OVER () AS ables FROM q)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN able AND place <= {rule.percent} * ables // 100 THEN place END AS rank FROM o"""


ORACLES = {
    "op13_segment_resampling": _resampling_sql(),
    "op11_license_diagonals": _license_sql(),
    "op3_chunk_recipes": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             n AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n""",
}
