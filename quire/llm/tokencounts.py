"""Delta-maintained token rollups.

A batch of signed rows (+1 insert, -1 delete; a revised count is the old row deleted and the new one inserted) is summed
by source, language and tokenizer version and written below its batch id; totals are the sums over all committed batches.
A batch id is committed once: Spark's committer leaves ``_SUCCESS`` only when all of its files are there, a batch with
that mark is skipped, and one without it (a lost job) is written anew.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.runtime import checkpoint, map_arrow, shared_dir, table

KEYS = ("source", "lang", "tokenizer")
SUMS = ("documents", "tokens")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizers: dict[str, str], pattern: str) -> DataFrame:
    """(id, source, lang, tokenizer, n_tokens): one row a document and tokenizer version.

    ``tokenizers`` maps a version to a rank file, or to "" for words between white space. Null texts are empty and have
    no tokens; null sources and languages stay null and are groups of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        models = {}
        for version, path in tokenizers.items():
            if path:
                with open(path, "rb") as f:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                models[version] = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            for version in tokenizers:
                m = models.get(version)
                n = [len(m.encode_ordinary(t)) for t in texts] if m else [len(t.encode().split()) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["id", "source", "lang", "tokenizer", "n_tokens"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("text"))
    return map_arrow(src, run, "id long, source string, lang string, tokenizer string, n_tokens long")


class Rollup:
    """The totals below ``root``, a folder that all nodes share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        if not self._fs().exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path())]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and self._fs().exists(self._path(n, "_SUCCESS")))

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of (source, lang, tokenizer, n_tokens, sign) rows; False, and no change, if it is committed already.

        A null n_tokens counts as 0 tokens, a null sign as no row. Groups are pre-aggregated before their shuffle, so a
        hot source costs one row a task.
        """
        if not batch or "/" in batch:
            raise ValueError("a batch id is a file name")
        if self._fs().exists(self._path(f"batch={batch}", "_SUCCESS")):
            return False
        delta = signed.where("sign is not null").groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("documents"), F.sum(F.col("sign").cast("long") * F.coalesce("n_tokens", F.lit(0)).cast("long")).alias("tokens"))
        delta.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches, groups without documents left out."""
        done = self.batches()
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        if not done:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/batch={b}" for b in done))
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("documents <> 0 or tokens <> 0")


def op5_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits of one corpus: all inserted, every id divisible by 10 deleted, every id with remainder 1
    revised to another language tag, and the deletes sent a second time under the same batch id, which changes nothing."""
    import public_tokenizers

    versions = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.tiktoken"), "words": ""}
    counts = checkpoint(count_tokens(table(spark, sf_dir, "documents"), tokenizers=versions, pattern=public_tokenizers.PATTERN))
    plus, minus = F.lit(1).alias("sign"), F.lit(-1).alias("sign")
    gone, revised = counts.where("id % 10 = 0"), counts.where("id % 10 = 1")
    rollup = Rollup(spark, os.path.join(shared_dir(spark), f"rollup-{uuid.uuid4().hex}"))
    rollup.commit("1-insert", counts.select(*KEYS, "n_tokens", plus))
    rollup.commit("2-delete", gone.select(*KEYS, "n_tokens", minus))
    rollup.commit("3-revise", revised.select(*KEYS, "n_tokens", minus).union(revised.select("source", F.concat("lang", F.lit("-rev")).alias("lang"), "tokenizer", "n_tokens", plus)))
    rollup.commit("2-delete", gone.select(*KEYS, "n_tokens", minus))
    return rollup.totals()
