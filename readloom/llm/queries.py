"""Queries of the training-data operators, one for each, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import cuckoo_dedup, hypergeometric_shards, poisson_mix, quality_classifier, simhash, style_tree, toxicity, trie_bpe, warc, weak_supervision
from readloom.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_ref")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypergeometric_shards.shard_rows(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = trie_bpe.encode_decode(table(spark, sf_dir, "documents"), trie_bpe.tokenizer_path())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract_text(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_supervision.judge(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", "n_copies", "copy_no", "mix_key")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_dedup,
        op2_sharding,
        op3_bpe,
        op4_quality_classifier,
        op5_html_extraction,
        op6_quality_rules,
        op7_warc,
        op8_mixing,
        op9_simhash_near_dedup,
        op10_toxicity,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
        "op7_warc": f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= {warc.LEAST_SHARED} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {warc.LEAST_SHARED} AND page_id <> first_id THEN first_id END AS refers_to
FROM g""",
        "op8_mixing": poisson_mix.MIX_SQL,
    }
