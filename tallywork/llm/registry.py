"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import (
    alignment,
    bpe,
    chosen_path,
    chunking,
    likeness,
    minhash,
    packing,
    parity_join,
    pii,
    quality,
    suffix_dedup,
    toxicity,
    urls,
    whitening,
)
from tallywork.llm.tables import read


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoding_digests(read(spark, folder, "documents"),
                                public_tokenizers.path("word_bpe_49k.json"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(read(spark, folder, "documents"))


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return parity_join.joined(read(spark, folder, "documents"),
                              likeness.Likeness(size=3, per_cent=90))


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.fingerprints(read(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    entries = quality.judged(quality.ledger(read(spark, folder, "documents")))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                          "n_repeat_words", "base_failed", "kept", "failed")


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(read(spark, folder, "pages"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal_digests(read(spark, folder, "documents"))


def op8_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.deduplicated(read(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read(spark, folder, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment_counts(
        read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


def op12_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.joined(read(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whitened(read(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (
    op1_bpe, op2_pii, op3_ngram_jaccard, op4_minhash, op5_quality, op6_urls, op7_suffix_dedup,
    op8_chunk_dedup, op9_toxicity, op10_packing, op11_alignment,
    op12_near_dedup, op13_whitening)}
SQL: dict[str, str] = {}
