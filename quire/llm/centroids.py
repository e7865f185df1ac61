"""Centroid clustering of quantised vectors, each distinct vector once.

Vectors become integers and identical ones are grouped with their multiplicity. A round of Lloyd reads the distinct vectors
once: tasks assign them in blocks and add up integer sums weighted by multiplicity, which Spark combines; only the sums
of the k centroids come to the driver. At the end the distinct vectors' assignments are joined back to the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.hot import join_by_size
from quire.llm.runtime import checkpoint, map_arrow, table
from quire.llm.vectors import matrices

#: Larger components count as this one, so that squared distances fit a long.
LARGEST = 1 << 26


def quantised(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the rows with ``dims`` finite components; v: floor(scale * component) as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in matrices(b.column(1)):
                if x.shape[1] == dims:
                    whole = np.clip(np.floor(np.clip(x, -LARGEST, LARGEST) * scale), -LARGEST, LARGEST).astype("<i4")
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in whole], pa.binary())], ["id", "v"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), run, "id long, v binary", rows=4096)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1).astype(np.int64)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; of equally near centres the one with the smaller number."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)
    near = d.argmin(1)
    return near, d[np.arange(len(x)), near]


def _sums(distinct: DataFrame, centres: np.ndarray) -> list:
    """(cluster, dim, s, n) of the non-empty clusters: sums of components and numbers of vectors."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), object), np.zeros(k, object)
        for b in batches:
            if b.num_rows:
                x, times = _matrix(b.column(0)), b.column(1).to_numpy()
                near, _ = nearest(x, centres)
                for c in np.unique(near).tolist():
                    mine = near == c
                    count[c] += int(times[mine].sum())
                    high, low = times[mine] >> 20, times[mine] & 0xFFFFF  # each product's sum fits a long
                    total[c] += (high @ x[mine]).astype(object) * (1 << 20) + (low @ x[mine]).astype(object)
        some = np.flatnonzero(count)
        c, d = np.repeat(some, dims), np.tile(np.arange(dims), len(some))
        values = [str(total[i, j]) for i, j in zip(c.tolist(), d.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(values, pa.string()), pa.array([int(count[i]) for i in c.tolist()], pa.int64())], ["cluster", "dim", "s", "n"])

    part = map_arrow(distinct.select("v", "mult"), run, "cluster int, dim int, s string, n long", rows=4096)
    return part.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()


def lloyd(distinct: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """The centres after ``rounds`` rounds over ``distinct`` (v, mult); an empty cluster's centre stays."""
    for _ in range(rounds):
        new = centres.copy()
        for r in _sums(distinct, centres):
            new[r.cluster, r.dim] = int(r.s) // int(r.n)
        centres = new
    return centres


def assigned(distinct: DataFrame, centres: np.ndarray) -> DataFrame:
    """``distinct`` with cluster and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, d = nearest(_matrix(b.column(0)), centres)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d)], ["v", "mult", "cluster", "distance"])

    return map_arrow(distinct.select("v", "mult"), run, "v binary, mult long, cluster int, distance long", rows=4096)


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors with ``dims`` finite components.

    Other vectors (null, of another length, with null or non-finite components) give no row. Centres start as the ``k``
    rows with the smallest SHA-256 of ``seed:id`` (null id: nothing behind the colon; ties: by components), or as many
    as there are; two equal centres leave the second empty. Repeated ids are rows of their own. Components beyond 2 ** 26
    after scaling count as 2 ** 26, and an inertia past a long as the largest long. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vector_col, dims, scale)
    distinct = checkpoint(rows.groupBy("v").agg(F.count(F.lit(1)).alias("mult")))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r.v for r in rows.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = lloyd(distinct, np.stack([np.frombuffer(v, "<i4") for v in first]).astype(np.int64), rounds)

    out = checkpoint(assigned(distinct, centres))
    spent = out.groupBy("cluster").agg(F.sum(F.col("mult").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("s")).collect()
    inertia, total = {r.cluster: int(r.s) for r in spent}, sum(int(r.s) for r in spent)
    most = (1 << 63) - 1
    facts = [(c, min(n, most), min(total, most), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, n in sorted(inertia.items())]
    per = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    back = join_by_size(rows, out, "v", "mult", "id").join(F.broadcast(per), "cluster")  # k rows at most
    return back.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of ``embeddings``; ``centroid_clusters`` has the cases."""
    return centroid_clusters(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
