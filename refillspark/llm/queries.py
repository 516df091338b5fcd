"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, language_model, pii, quality, sharding, simhash, spelling, substring, tokens, topk, toxicity, whitening
from .common import spread, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(spread(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(spread(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(spread(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(spread(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(spread(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(spread(table(spark, sf_dir, "documents")), drop_every=199))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(spread(table(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality": op6_quality,
    "op7_balanced_shards": op7_balanced_shards,
    "op8_decontamination": op8_decontamination,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lm_scores": op12_lm_scores,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id,
                   list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.own <> c.own
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op10_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
        ), w AS (
            SELECT doc_id, unnest(range(1, len(words) - 18)) AS pos, words FROM d WHERE len(words) >= 20
        ), g AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(words[pos:pos + 19], ' ') ORDER BY doc_id, pos) AS n FROM w
        ), later AS (
            SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(pos, pos + 20)) AS p FROM g WHERE n > 1) GROUP BY doc_id
        ), k AS (
            SELECT d.doc_id, words, coalesce(gone, []) AS gone FROM d LEFT JOIN later USING (doc_id)
        ), kept AS (
            SELECT doc_id, len(words) AS n_words, len(gone) AS n_removed,
                   list_select(words, list_sort(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)))) AS stay
            FROM k
        )
        SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept
    """,
    # The crc32 is worked out byte by byte over its table; pairs meet by words with one code point left out or masked.
    "op11_spelling_variants": r"""
        WITH RECURSIVE forms0 AS MATERIALIZED (
            SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc FROM range(256) t(n)
        ), runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
        ), distinct_runs AS (
            SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
        ), hashed AS (
            SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(1, octet_length(encode(id || ':' || run)) + 1), lambda i: ('0x' || substring(hex(encode(id || ':' || run)), 2 * i - 1, 2))::BIGINT),
                lambda a, b: xor(a >> 8, crc[1 + xor(a % 256, b)])), 4294967295) AS h FROM distinct_runs, forms0
        ), words AS MATERIALIZED (
            SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), places AS MATERIALIZED (
            SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), pairs AS (
            SELECT a.word, b.word AS near, b.n FROM places a JOIN places b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
            UNION SELECT p.word, w.word, w.n FROM places p JOIN words w ON p.cut = w.word
            UNION SELECT w.word, p.word, p.n FROM places p JOIN words w ON p.cut = w.word
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
        ), formed AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= 5 * w.n THEN near END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
            FROM words w LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (word)
        ), walk AS (
            SELECT word, word AS root, form AS next FROM formed
            UNION ALL SELECT walk.word, walk.next, formed.form FROM walk JOIN formed ON walk.next = formed.word
        )
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON f.word = w.word AND w.next IS NULL
    """,
}
