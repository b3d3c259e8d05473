"""One query per operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dayzero.llm import (
    bpe,
    byte_bpe,
    filter_audit,
    html_extract,
    id_files,
    mixing,
    near_text,
    near_vectors,
    prefix_trie,
    quality,
    token_counts,
    toxicity,
    url_rules,
)
from dayzero.llm.common import read
from dayzero.llm.quality_sql import quality_sql

URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(read(spark, sf_dir, "pages"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(read(spark, sf_dir, "documents"), carried=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("row.doc_id", *counts, "base_failed", "kept")


def op6_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), carried=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.store_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    graded = toxicity.grade_documents(docs, model, carried=["doc_id"])
    return graded.select("row.doc_id", "severity", "grade", "p_toxic", "toxic")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    coded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), carried=["doc_id"])
    return coded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_documents(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, carried=["doc_id"])
    return coded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP2_SQL = r"""
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS nr, vec_id, embedding::DOUBLE[] AS v FROM embeddings
), good AS (
    SELECT nr, vec_id, v FROM rows
    WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.nr AS a_nr, a.vec_id AS a, b.vec_id AS b
    FROM good a JOIN good b ON a.nr <> b.nr AND list_cosine_similarity(a.v, b.v) >= 0.95
), counts AS (
    SELECT a_nr, count(*) AS n_links FROM links GROUP BY a_nr
), reached(vec_id, other) AS (
    SELECT vec_id, vec_id FROM rows
    UNION
    SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), smallest AS (
    SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
)
SELECT r.vec_id, coalesce(n_links, 0) AS n_links, component_id, r.vec_id = component_id AS kept
FROM rows r LEFT JOIN counts ON a_nr = nr JOIN smallest USING (vec_id)
"""

OP3_SQL = r"""
WITH rules(verdict, rule, r_host, r_path) AS (
    VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
           ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), bare AS (
    SELECT page_id, row_number() OVER () AS nr,
           CASE WHEN contains(url, '://')
                THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id, nr,
           translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
    FROM bare
), judged AS (
    SELECT p.*, r.rule, r.verdict,
           row_number() OVER (PARTITION BY nr ORDER BY length(r.rule) DESC) AS nth
    FROM parts p LEFT JOIN rules r
      ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE nth = 1
"""

OP6_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id,
           unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM texts
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 85 * (x.n + y.n - c)
), reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM texts
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), smallest AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM texts t LEFT JOIN sizes USING (doc_id) JOIN smallest USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_html_text,
        op2_near_vectors,
        op3_url_filter,
        op4_token_counts,
        op5_quality_rules,
        op6_near_text,
        op7_mix_sources,
        op8_id_files,
        op9_toxicity,
        op10_bpe,
        op11_prefix_trie,
        op12_byte_bpe,
        op13_filter_audit,
    ]
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_vectors": OP2_SQL,
        "op3_url_filter": OP3_SQL,
        "op5_quality_rules": quality_sql(),
        "op6_near_text": OP6_SQL,
        "op11_prefix_trie": prefix_trie.TRIE_SQL,
        "op13_filter_audit": filter_audit.AUDIT_SQL,
    }
