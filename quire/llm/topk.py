"""Exact top-k inner product by Fagin's threshold algorithm.

Candidates are dealt evenly to slots. A slot keeps, for every dimension, its rows sorted by that component. A query walks all
of its lists from the good end (the large end for a positive weight, the small one for a negative) in step, scores every
row that it meets for the first time exactly, and stops when the sum of its weights times the lists' current components
cannot reach its k-th score: the bound of everything unseen. Every query meets every slot, which answers with k rows at
most; the k best of those are the result. The work is queries times slots by contract; queries stream through a slot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.runtime import checkpoint, map_arrow, table
from quire.llm.vectors import matrices

_LONG = np.iinfo(np.int64)


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64 or, where a component is too large for it, as Python integers: exact for all doubles."""
    if not x.size or np.abs(x).max() < 2.0**62 / scale:
        return np.floor(scale * x).astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 2.0**52 else math.floor(scale * v) for v in row] for row in x.tolist()], object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _best(places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype != object:
        return np.lexsort((places, -scores))[:k]
    return np.array(sorted(range(len(places)), key=lambda i: (-scores[i], places[i]))[:k], np.int64)


def _beyond(score: int) -> bytes:
    """What orders scores that a long can't hold among each other and behind or before those that it can."""
    size = (abs(score).bit_length() + 7) // 8
    raw = b"\x01" + size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    if _LONG.min <= score <= _LONG.max:
        return b"" if score >= 0 else b"\xff"
    return raw if score > 0 else bytes(255 - x for x in raw)


class Block:
    """Candidates with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # ties then go to the smaller id by place
        self.ids, self.vecs = ids[order], vecs[order]
        self.up = np.argsort(self.vecs, axis=0, kind="stable").T.astype(np.int32)  # dimension x depth, smallest first
        self.largest = _largest(vecs)

    def top(self, query: np.ndarray, own: int, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best, by score and then place; rows with the id ``own`` take no part."""
        vecs = self.vecs
        if _largest(query) * self.largest * len(query) >= 1 << 62:  # sums would leave 64 bits
            vecs, query = vecs.astype(object), query.astype(object)
        n = len(self.ids)
        dims = np.flatnonzero(query)
        if not len(dims):  # every score is zero: the smallest ids win
            places = np.flatnonzero(self.ids != own)[:k]
            return places, np.zeros(len(places), np.int64)
        w, lists = query[dims], self.up[dims]
        down = (w > 0).astype(bool)
        seen = self.ids == own
        places, scores = np.zeros(0, np.int64), np.zeros(0, vecs.dtype)
        depth = 0
        while depth < n:
            to = min(n, depth + step)
            step *= 2
            met = np.concatenate([lists[down, n - to : n - depth].ravel(), lists[~down, depth:to].ravel()])
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh = np.flatnonzero(fresh & ~seen)
            seen[fresh] = True
            places = np.concatenate([places, fresh])
            scores = np.concatenate([scores, vecs[fresh] @ query])
            if len(places) > k:
                best = _best(places, scores, k)
                places, scores = places[best], scores[best]
            depth = to
            if len(places) == k:
                edge = np.where(down, lists[:, n - to], lists[:, to - 1])
                if int(w @ vecs[edge, dims]) < scores.min():  # an equal score could still win by its id
                    break
        best = _best(places, scores, k)
        return places[best], scores[best]


def _rows(df: DataFrame) -> DataFrame:
    """(id, dim, v): the rows that hold a vector, its components' doubles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in matrices(b.column(1)):
                raw = pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], np.int32)), raw], ["id", "dim", "v"])

    return map_arrow(df.where("id is not null").select("id", "v"), run, "id long, dim int, v binary", rows=4096)


def threshold_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = 8192, query_block: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors(id, v)`` for every row of ``queries(id, v)``.

    Components are floor(scale * x) and scores are exact at any size; one that a long can't hold is shown as the nearest
    long. Ties go to the smaller id; a query's own id is no candidate. Vectors without a value (see ``vectors.matrices``)
    and null ids take no part; vectors of another length than the query's do not meet it. A repeated query id gives the k
    best for the rows together; candidates' repeated rows each count. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    number = F.monotonically_increasing_id()
    c, q = checkpoint(_rows(vectors).withColumn("at", number)), checkpoint(_rows(queries).withColumn("at", number))
    n, m = c.count(), q.count()
    slots = max(-(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    parts = max(1, -(-m // query_block))
    # Slots are numbered and dealt by number, so that no two meet in a task by a hash; ids and values don't decide.
    part, slot = (F.explode(F.sequence(F.lit(0), F.lit(size - 1)).cast("array<bigint>")) for size in (parts, slots))
    c = c.select(part.alias("p"), F.pmod(F.xxhash64("at"), F.lit(slots)).alias("s"), F.lit(0).alias("kind"), "dim", "id", "v")
    q = q.select(F.pmod(F.xxhash64("at"), F.lit(parts)).alias("p"), slot.alias("s"), F.lit(1).alias("kind"), "dim", "id", "v")
    both = c.union(q).withColumn("cell", F.col("p") * slots + F.col("s"))
    tasks = min(slots * parts, 10_000)
    dealt = both.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "kind", "dim", "id").select("cell", "kind", "dim", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, blocks = None, {}, {}
        for b in batches:
            cells, kinds, dims, ids = (b.column(i).to_numpy() for i in range(4))
            cut = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1]) | (dims[1:] != dims[:-1]))) if len(cells) else []
            out: list[tuple] = []
            for lo, hi in zip(cut, [*cut[1:], len(cells)], strict=True):
                if cells[lo] != now:
                    now, held, blocks = cells[lo], {}, {}
                dim = int(dims[lo])
                x = np.frombuffer(b"".join(b.column(4).slice(lo, hi - lo).to_pylist()), "<f8").reshape(-1, dim)
                if not kinds[lo]:
                    held.setdefault(dim, []).append((ids[lo:hi], x))
                    continue
                if dim in held:
                    got = held.pop(dim)
                    blocks[dim] = Block(np.concatenate([i for i, _ in got]), quantised(np.concatenate([v for _, v in got]), scale))
                if dim not in blocks:
                    continue
                for own, query in zip(ids[lo:hi].tolist(), quantised(x, scale), strict=True):
                    places, scores = blocks[dim].top(query, own, k)
                    beyond = [_beyond(int(s)) for s in scores]
                    if scores.dtype == object:
                        scores = np.array([min(max(s, _LONG.min), _LONG.max) for s in scores.tolist()], np.int64)
                    out.append((np.full(len(places), own), blocks[dim].ids[places], scores, np.array(beyond, object)))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:3]), pa.array(cols[3], pa.binary())], ["query_id", "vec_id", "score", "beyond"])

    near = map_arrow(dealt, run, "query_id long, vec_id long, score long, beyond binary", rows=256)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all ``embeddings`` for every row whose vec_id is divisible by 50; ``threshold_top_k`` has the cases."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    return threshold_top_k(v, v.where("id % 50 = 0"))
