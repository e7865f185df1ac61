"""A session with the settings the operators expect."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What the JVM sends to a worker at a time. A batch ends with the row that passes it, so long texts come few at a time.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application: they may not find it where the driver does.

    The session's batches are bounded in bytes, unless it names a bound of its own.
    """
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(package):  # already inside an archive that was sent
        return
    with tempfile.TemporaryDirectory() as tmp:
        shutil.copytree(package, os.path.join(tmp, "tree", "quire"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire"), "zip", os.path.join(tmp, "tree")))


def session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """AQE with skew handling and Arrow transfer; the number of shuffle partitions is Spark's to coalesce."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.session.timeZone": "UTC",
    }
    spark = b.config(map=settings | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
    ship(spark)
    return spark


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
