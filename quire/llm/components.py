"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quire.llm.runtime import checkpoint, map_arrow


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes ascending, the smallest node each reaches): larger roots hook onto smaller ones, then edges move to roots."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack((b.column(0).to_numpy(), b.column(1).to_numpy())) for b in batches]
    node, root = smallest_reachable(*np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1))
    for at in range(0, len(node), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(node[at : at + (1 << 16)]), pa.array(root[at : at + (1 << 16)])], ["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60, together: int = 4_000_000) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node that can be reached.

    Edges of long ids that are counted to be ``together`` at most (64 MB of numbers) are joined in one task, which takes three stages
    instead of some ten a round. Beyond that the same result is reached in rounds, and nothing depends on the number:
    each round hooks the parents of an edge's ends onto the smaller grandparent and then halves the paths, so the
    rounds grow with the logarithm of the longest path. A round is joins and a map-side combined minimum; the parent
    table is checkpointed, and only a count comes to the driver. Self-loops and repeated or null edges do no harm;
    no edges give no rows.
    """
    edges = checkpoint(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    if all(f.dataType == LongType() for f in edges.schema) and edges.count() <= together:
        return checkpoint(map_arrow(edges.repartition(1), _together, "node long, root long", rows=1 << 16))
    both = checkpoint(edges.select(F.col("a").alias("s"), F.col("b").alias("t")).union(edges.select(F.col("b").alias("s"), F.col("a").alias("t"))).distinct())
    f = checkpoint(both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("s"), F.min("t")).alias("p")))
    for _ in range(max_rounds):
        up = f.select(F.col("node").alias("p"), F.col("p").alias("gp"))
        g = f.join(up, "p").select("node", "p", "gp")
        hooks = both.join(g.select(F.col("node").alias("s"), F.col("gp").alias("m")), "s").join(g.select(F.col("node").alias("t"), F.col("p").alias("pt"), F.col("gp").alias("gt")), "t").where("m < gt or m < pt")
        cand = hooks.select(F.col("t").alias("node"), "m").union(hooks.select(F.col("pt").alias("node"), "m")).union(g.select("node", F.col("gp").alias("m")))
        new = checkpoint(cand.groupBy("node").agg(F.min("m").alias("p")))
        moved = new.join(f.withColumnRenamed("p", "old"), "node").where("p <> old").limit(1).count()
        f = new
        if not moved:
            return f.select("node", F.col("p").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
