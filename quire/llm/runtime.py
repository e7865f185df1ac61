"""What the operators share: reading, checkpoints in the cluster's shared folder, Arrow batch sizes."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share; only a local master may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote; one that is not there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` as a checkpoint, to be broadcast if its rows are counted to be ``most`` at most, else to be shuffled."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= most else df


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and checkpoints that nothing refers to any more.

    It acts on the driver's garbage collections, which may be half an hour apart while executors' disks fill.
    """
    gc.collect()
    spark._jvm.System.gc()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow in batches of at most ``rows`` rows and about BATCH_BYTES bytes.

    The bound in bytes is the session's, as Spark reads it when the plan runs: one fixed value, unless the session names
    its own (``ship``). The rows are cut here, for each operator by itself.
    """
    ship(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(at, rows) for b in batches for at in range(0, max(1, b.num_rows), rows))

    return df.mapInArrow(cut, schema)


def crc_mod(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
