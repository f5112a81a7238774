"""The corpus pipeline: documents in, token ids out.

run() applies the stages of STAGES in order. Each takes (spark, docs, sf_dir), works on all
that its predecessor kept, and calls one operator; all but the last return the columns of
documents. A stage's result is written as Parquet in the shared folder and read again, so a
lost executor costs no more than one stage.

All stages take null ids and texts, repeated rows and ids, empty and very long texts, empty tables and extra
columns; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import cuckoo_dedup, poisson_mix, quality_classifier, simhash, trie_bpe
from readloom.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null, empty and blank texts are rejected; each row counts by its own text, so null and repeated ids change nothing; rows
    of equal text go or stay together; without labels all documents with words stay; extra columns stay.
    """
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id.

    A null text equals the empty one; null ids lose against any id, and of rows that tie in text and id one stays;
    different texts under one id, or under null, all stay; extra columns stay.
    """
    return cuckoo_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the least id.

    Near copies are texts whose sets of five-word shingles have a similarity of about 0.8 or more: their SimHash
    fingerprints of 256 bits differ in 46 or fewer.

    Null ids lose against any id, and of rows that tie in id that of the least text digest stays; different components
    under one id, or under null, keep one row each; texts without words are one component; extra columns stay.
    """
    return simhash.drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights and shuffled.

    Null sources are a source of their own; rows of null or repeated ids are drawn by their texts, and rows that tie in both
    get the same number of copies; extra columns stay.
    """
    return poisson_mix.mix_sources(docs).select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to.

    A null or empty text has no tokens; each row has its own result, whatever its id; extra columns go.
    """
    coded = trie_bpe.encode_decode(docs, trie_bpe.tokenizer_path(), arrays=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: SQL can express neither the classifier nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
