"""Row-local operators on streams of documents.

Everything in ``quire.functions`` and the row-local operators work on one document at a time, so they run unchanged on a
streaming frame; nothing here keeps state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A stream of the Parquet documents that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def describe(docs: DataFrame) -> DataFrame:
    """Language, tokens and sentences of each document; the same on a batch and on a stream."""
    return docs.select("doc_id", t.language(F.col("text")).alias("language"), F.size(t.tokens(F.col("text"))).alias("n_tokens"), F.size(t.sentences(F.col("text"))).alias("n_sentences"))


def write_described(docs: DataFrame, path: str, checkpoint: str):
    """Describe a stream into Parquet files, once each, and stop when the input is used up."""
    return describe(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
