"""A training-data pipeline over ``documents``: quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. SQL can't express the stages;
tests/llm/test_pipeline.py holds them against brute-force versions.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.packing import pack, vocabulary
from quire.llm.quality import keep_good, train, training_labels
from quire.llm.runtime import shared_dir, table
from quire.llm.secrets import redact
from quire.llm.simhash import drop_near_duplicates

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go."""
    return keep_good(docs, train(docs, training_labels(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, stays of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows."""
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return pack(docs, tokenizer=vocabulary("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages documents are written to and read from the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
