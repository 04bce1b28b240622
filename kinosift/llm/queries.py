"""Queries over the standard tables, one for each corpus operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinosift.llm import bpe, content_sort, language, order_minhash, packing, pii, quality, suffix_dedup, token_counts, toxicity
from kinosift.llm.runtime import new_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return packing.packed_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    return quality.scored(documents(spark, sf_dir))


ORACLES["op9_quality_rules"] = quality.SQL


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document; of equal texts the largest doc_id stays."""
    return content_sort.duplicates(documents(spark, sf_dir), keep_largest=True)


ORACLES["op5_exact_dedup"] = content_sort.SQL


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.spans_of(documents(spark, sf_dir)))


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes decoded from them."""
    return bpe.digest(bpe.encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; the cache starts empty."""
    counts = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def remainder(by: int):
    """crc32 of doc_id as text, modulo by; null for a null doc_id, which teaches nothing and isn't held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that aren't held out."""
    docs, held_out = documents(spark, sf_dir), remainder(4) == 2
    model = language.train(docs.filter(~held_out))
    return language.detected(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels that aren't held out."""
    docs, held_out = documents(spark, sf_dir), remainder(3) == 1
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out))
    return toxicity.scored(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return order_minhash.near_duplicates(documents(spark, sf_dir))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of 100 bytes that stand earlier."""
    return suffix_dedup.digest(suffix_dedup.without_repeats(documents(spark, sf_dir)))
