"""Queries of the numbered operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import (
    embedding_dedup,
    language_id,
    language_model,
    merkle,
    packing,
    quality_model,
    quality_rules,
    secrets,
    sentencepiece_scan,
    simhash,
    suffix_dedup,
    token_files,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode_and_decode(_documents(spark, sf_dir)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.crc32(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary")).alias("ids_crc32"),
        F.char_length("decoded").cast("long").alias("decoded_chars"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_documents(spark, sf_dir))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_documents(spark, sf_dir)).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir)).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_length",
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(_documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_to_files(_documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(_documents(spark, sf_dir))
    digests = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")]
    return rows.select("doc_id", *digests, F.sha2(F.lower(F.hex("path")), 256).alias("proof_sha256"), "verified")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find(_documents(spark, sf_dir))
    counts = [secrets.counted(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.KINDS]
    base = F.sha2(secrets.listed(F.col("spans"), base_only=True), 256)
    return rows.select("doc_id", *counts, base.alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(_documents(spark, sf_dir)))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        "kept",
        "failed_bits",
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t,
    list_filter(string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '),
                lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)),
                lambda x: trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '') AS ls
  FROM d
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(ls)::BIGINT AS n_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, (n_words < 50) AS r0, (100 * n_repeat_words > 50 * n_words) AS r1,
    (2 * n_symbols > n_words) AS r2, (word_chars < 2 * n_words) AS r3,
    (word_chars > 20 * n_words) AS r4, (2 * n_dup_lines > n_lines) AS r5
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (r0 OR r1) AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5) AS kept,
  (r0::BIGINT + 2 * r1::BIGINT + 4 * r2::BIGINT + 8 * r3::BIGINT + 16 * r4::BIGINT + 32 * r5::BIGINT)::BIGINT AS failed_bits
FROM f
"""


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
    list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT),
      lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(a, b)),
      4294967295) AS crc
  FROM documents
), f AS (
  SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'),
      coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
    CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS after
  FROM d
), g AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(after) || ':' || after, '-')) AS changed
  FROM f
), leaves AS (
  SELECT *, (dense_rank() OVER (ORDER BY source NULLS FIRST) - 1)::BIGINT AS tree,
    (row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS i
  FROM g
), nodes AS (
  SELECT tree, 0::BIGINT AS l, i, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, l + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM nodes) WHERE c > 1 GROUP BY tree, l, i // 3
), subroots AS (
  SELECT tree, arg_max(digest, l) AS subroot FROM nodes GROUP BY tree
), upper_ AS (
  SELECT 0::BIGINT AS l, tree AS i, subroot AS digest FROM subroots
  UNION ALL
  SELECT l + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS c FROM upper_) WHERE c > 1 GROUP BY l, i // 3
), every AS (
  SELECT tree, l, i, digest FROM nodes UNION ALL SELECT -1, l, i, digest FROM upper_
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY tree, l) AS size FROM every
), side AS (
  SELECT a.tree, a.l, a.i,
    coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lefts,
    coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rights
  FROM sized a JOIN sized b ON a.tree = b.tree AND a.l = b.l AND a.i // 3 = b.i // 3
  WHERE a.size > 1 GROUP BY a.tree, a.l, a.i
), way AS (
  SELECT doc_id, leaf, tree AS own, tree, 0::BIGINT AS l, i, changed AS digest, ''::VARCHAR AS path FROM leaves
  UNION ALL
  SELECT doc_id, leaf, own, tree, l + 1, i // 3, sha256(lefts || digest || rights), path || lefts || rights
  FROM way JOIN side USING (tree, l, i)
), under AS (
  SELECT w.* FROM way w LEFT JOIN side s USING (tree, l, i) WHERE s.i IS NULL
), over_ AS (
  SELECT doc_id, leaf, own, -1::BIGINT AS tree, 0::BIGINT AS l, own AS i, digest, path FROM under
  UNION ALL
  SELECT doc_id, leaf, own, tree, l + 1, i // 3, sha256(lefts || digest || rights), path || lefts || rights
  FROM over_ JOIN side USING (tree, l, i)
), done AS (
  SELECT o.* FROM over_ o LEFT JOIN side s USING (tree, l, i) WHERE s.i IS NULL
)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM done JOIN subroots ON done.own = subroots.tree CROSS JOIN (SELECT arg_max(digest, l) AS root FROM upper_)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_language_model": op3_language_model,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_packing": op6_packing,
        "op7_quality_rules": op7_quality_rules,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_language_id": op9_language_id,
        "op10_token_files": op10_token_files,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_secret_scan": op12_secret_scan,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": OP7_SQL, "op11_merkle_manifest": OP11_SQL}
