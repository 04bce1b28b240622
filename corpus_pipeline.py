"""Corpus pipeline: quality rules, exact dedup, near-dedup, masking of personal data, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's
docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinosift.llm import content_sort, order_minhash, packing, pii, quality
from kinosift.llm.runtime import discard, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row id, written so that the ids stay, and the name of its column; doc_ids can repeat or be null."""
    name = "_row"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _kept(docs: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """The rows of docs whose id is among rows."""
    ids = rows.select(F.col("row").alias(name))
    return docs.join(ids.hint("shuffle_hash"), name, "left_semi").drop(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the method's rules."""
    return quality.filtered(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, one row, of the smallest doc_id."""
    docs, row = _numbered(docs)
    return _kept(docs, row, content_sort.kept_rows(docs, row))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, of the smallest doc_id."""
    docs, row = _numbered(docs)
    return _kept(docs, row, order_minhash.near_duplicates(docs, row).filter("kept"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars counted anew."""
    masked = pii.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pii", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Order MinHash and the packing can't be told in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
