"""Embedding near-duplicates by product quantisation.

Coarse cells and, for residuals, subspace codes are fitted on a bounded sample; every vector is then indexed. Equal vectors
of a label collapse first. A vector is listed under its nearest cell and asks its own cell and every other one whose border
(the plane between the two centres) is at most half the radius away. Of two vectors within the radius in different cells
one is that close to the border, so the probes are sufficient for every link. In a list, asymmetric table look-ups give the
distance to each reconstructed vector; what lies within the radius plus that vector's own quantisation error is compared
exactly, by cosine in double precision. Long lists are dealt out in blocks. A block answers with numbers of links and with
a spanning forest, never with pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quire.llm.components import connected_components
from quire.llm.runtime import checkpoint, map_arrow, table
from quire.llm.vectors import matrices


#: Cells grow with the vectors, two for each block that they fill, up to this number; longer lists are then dealt in more blocks.
MOST_CELLS = 4096


#: Products of rows and centres that are held at a time.
_HELD = 1 << 21


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of the centres ``c`` for each row, in slices."""
    step, half = max(1, _HELD // max(len(c), 1)), (c**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[at : at + step] @ c.T - half).argmax(1) for at in range(0, len(x), step))])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class Codebook:
    coarse: np.ndarray  # cells x dimensions
    parts: list[np.ndarray]  # dimensions of each subspace
    books: list[np.ndarray]  # codes x dimensions of the subspace

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, subspaces: int, codes: int) -> Codebook:
        coarse = kmeans(x, cells)
        residual = x - coarse[_nearest(x, coarse)]
        parts = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
        return cls(coarse, parts, [kmeans(residual[:, p], codes) for p in parts])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the cells' centres."""
        return np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1))

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x subspaces) and quantisation errors."""
        residual, codes, left = x - self.coarse[cell], np.zeros((len(x), len(self.parts)), np.uint8), np.zeros(len(x))
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            r = residual[:, p]
            codes[:, m] = (r @ book.T - (book**2).sum(1) / 2).argmax(1)
            left += ((r - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def look_up(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances, queries x list."""
        residual, out = queries - self.coarse[cell], np.zeros((len(queries), len(codes)))
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            r = residual[:, p]
            tab = (r**2).sum(1)[:, None] - 2 * r @ book.T + (book**2).sum(1)
            out += tab[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(own cell, rows x cells of those whose border is at most half the radius away, the own among them)."""
        d = self.distances(x)
        own = d.argmin(1)
        used, at = np.unique(own, return_inverse=True)
        apart = np.sqrt(self.distances(self.coarse[used]))  # of the centres that these rows have only
        return own, d - d[np.arange(len(x)), own][:, None] <= (radius + 1e-6) * apart[at] + 1e-8


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as doubles of length one."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _usable(df: DataFrame, id_col: str, vector_col: str, label_col: str, kind: str) -> DataFrame:
    """(id, node, label, v): node names a label's distinct vector, null if the row links with nothing; v: its components' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, n = b.column(2).to_pylist(), b.num_rows
            node, vec = [None] * n, [None] * n
            for at, x in matrices(b.column(1)):
                for i, row in zip(at.tolist(), x.astype(kind), strict=True):
                    if row.any() and labels[i] is not None:
                        vec[i] = row.tobytes()
                        node[i] = f"{labels[i]}:{hashlib.blake2b(vec[i], digest_size=16).hexdigest()}"
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.string()), b.column(2), pa.array(vec, pa.binary())], ["id", "node", "label", "v"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    return map_arrow(src, run, "id long, node string, label string, v binary", rows=4096)


def pq_links(distinct: DataFrame, kind: str, cosine: float, cells: int, subspaces: int, codes: int, sample: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, n): links of each distinct vector, counted with multiplicity; (a, b): forest edges. ``distinct``: node, label, v, mult."""
    spark, radius = distinct.sparkSession, math.sqrt(max(0.0, 2 - 2 * cosine))
    n = distinct.count()
    cells = min(MOST_CELLS, max(cells, 1 << math.ceil(math.log2(max(n, 1) / block) + 1) if n > block else 1))
    sample = max(sample, 32 * cells)
    share = min(1.0, sample / max(n, 1))
    rows = distinct.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).select("node", "v").limit(2 * sample).toArrow().to_pylist()
    rows.sort(key=lambda r: r["node"])
    dims, width = {len(r["v"]) for r in rows}, np.dtype(kind).itemsize
    books = {d: Codebook.fit(_units([r["v"] for r in rows if len(r["v"]) == d], kind), cells, subspaces, codes) for d in dims}
    shared = spark.sparkContext.broadcast(books)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row under the own cell (ask 0) and one for each cell to ask (ask 1)."""
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                vec = part.column(2).to_pylist()
                for d in sorted({len(v) for v in vec}):
                    place = np.array([i for i, v in enumerate(vec) if len(v) == d])
                    book = shared.value.get(d)
                    if book is None:  # a length that the sample has not: one cell, no codes
                        book = Codebook(np.zeros((1, d // width)), [np.arange(d // width)], [np.zeros((1, d // width))])
                    x = _units([vec[i] for i in place], kind)
                    own, near = book.probes(x, radius)
                    code, error = book.encode(x, own)
                    asked = pa.array([m.tobytes() for m in np.packbits(near, axis=1, bitorder="little")], pa.binary())
                    r, c = np.nonzero(near)
                    ask = part.take(pa.array(place[r]))
                    keep = part.take(pa.array(place))
                    key = [f"{d}:{i}" for i in range(near.shape[1])]
                    m = pa.array([x.tobytes() for x in code], pa.binary())
                    yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1), keep.column(2), keep.column(3), pa.array([key[i] for i in own]), pa.array(np.zeros(len(own), np.int8)), pa.array(own.astype(np.int32)), m, asked, pa.array(error)], names)
                    yield pa.RecordBatch.from_arrays([ask.column(0), ask.column(1), ask.column(2), ask.column(3), pa.array([key[i] for i in c]), pa.array(np.ones(len(c), np.int8)), pa.array(own[r].astype(np.int32)), pa.nulls(len(c), pa.binary()), pa.nulls(len(c), pa.binary()), pa.array(np.zeros(len(c)))], names)

    names = ["node", "label", "v", "mult", "cell", "ask", "own", "code", "asked", "error"]
    lists = map_arrow(distinct.select("node", "label", "v", "mult"), listed, "node string, label string, v binary, mult long, cell string, ask tinyint, own int, code binary, asked binary, error double", rows=4096)
    long = lists.where("ask = 0").groupBy("label", "cell").count().where(F.col("count") > block).select("label", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    long = checkpoint(long)
    lists = lists.join(F.broadcast(long) if long.count() <= 100_000 else long, ["label", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    to = F.when(F.col("ask") == 0, F.array(F.pmod(F.hash("node"), "blocks"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    keyed = lists.withColumn("block", F.explode(to)).withColumn("key", F.xxhash64("label", "cell", "block"))
    dealt = keyed.repartition("key").sortWithinPartitions("key", "label", "cell", "block", "ask").select("key", "label", "cell", "ask", "node", "v", "mult", "own", "code", "asked", "error")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, listing = None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            heads = np.array([f"{k}\0{a}\0{c}" for k, a, c in zip(t["key"].to_pylist(), t["label"].to_pylist(), t["cell"].to_pylist(), strict=True)], object)
            asks = t["ask"].to_numpy()
            new = np.flatnonzero(np.append(True, (heads[1:] != heads[:-1]) | (asks[1:] != asks[:-1])))
            for lo, hi in zip(new, np.append(new[1:], len(heads)), strict=True):
                part = t.slice(lo, hi - lo)
                if heads[lo] != now:
                    if listing is not None:
                        yield listing.rows()
                    now, listing = heads[lo], None
                if not asks[lo]:  # the list, which may go on in the next batch
                    mine = (np.array(part["node"].to_pylist(), object), _units(part["v"].to_pylist(), kind), part["mult"].to_numpy(), _bytes(part["code"]), part["error"].to_numpy(), _bytes(part["asked"]))
                    listing = Listing(*mine) if listing is None else listing.longer(mine)
                    continue
                if listing is None:
                    continue
                dim, cell = heads[lo].rsplit("\0", 1)[1].split(":")
                q = _units(part["v"].to_pylist(), kind)
                q_node, q_mult, q_own = np.array(part["node"].to_pylist(), object), part["mult"].to_numpy(), part["own"].to_numpy()
                for at in range(0, len(q), 256):
                    s = slice(at, at + 256)
                    yield listing.ask(q_node[s], q[s], q_mult[s], q_own[s], shared.value.get(int(dim)), int(cell), radius, cosine)
        if listing is not None:
            yield listing.rows()

    out = checkpoint(map_arrow(dealt, compare, "node string, n long, to string", rows=4096))
    return out.where("to is null").groupBy("node").agg(F.sum("n").alias("n")), out.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _links(node: list, n: list, to: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(n, pa.int64()), pa.array(to, pa.string())], ["node", "n", "to"])


class Listing:
    """A list's vectors, with what its askers have joined: a number of links and a group for each, never the pairs."""

    def __init__(self, nodes: np.ndarray, vecs: np.ndarray, mult: np.ndarray, codes: np.ndarray, errors: np.ndarray, asked: np.ndarray) -> None:
        self.all = nodes, vecs, mult, codes, errors, asked
        self.nodes, self.vecs, self.mult, self.codes, self.errors, self.asked = self.all
        self.links, self.group = np.zeros(len(nodes), np.int64), np.arange(len(nodes))

    def longer(self, more: tuple) -> Listing:
        return Listing(*(np.concatenate(x) for x in zip(self.all, more, strict=True)))

    def near(self, q: np.ndarray, book: Codebook | None, cell: int, radius: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (asker, listed) of cosines that reach the bound: look-ups first, then the exact product."""
        if book is None:
            i, j = np.divmod(np.arange(len(q) * len(self.vecs)), len(self.vecs))
        else:
            i, j = np.nonzero(book.look_up(q, cell, self.codes) <= radius + self.errors + 1e-6)
        good = np.zeros(len(i), bool)
        for at in range(0, len(i), 65536):
            s = slice(at, at + 65536)
            good[s] = np.einsum("nd,nd->n", q[i[s]], self.vecs[j[s]]) >= cosine
        return i[good], j[good]

    def ask(self, node: np.ndarray, q: np.ndarray, mult: np.ndarray, own: np.ndarray, book: Codebook | None, cell: int, radius: float, cosine: float) -> pa.RecordBatch:
        """The askers' numbers of links and one edge of each to a group; the listed ones' numbers and groups stay here."""
        i, j = self.near(q, book, cell, radius, cosine)
        other = node[i] != self.nodes[j]
        i, j = i[other], j[other]
        number = np.bincount(i, self.mult[j], len(q)).astype(np.int64)
        back = (self.asked[j, own[i] >> 3] >> (own[i] & 7) & 1) == 0  # the listed one doesn't ask back
        np.add.at(self.links, j[back], mult[i[back]])
        some, start = np.unique(i, return_index=True)
        to = []
        for part in np.split(j, start[1:]) if len(i) else ():
            groups = np.unique(self.group[part])
            if len(groups) > 1:
                self.group[np.isin(self.group, groups)] = groups[0]
            to.append(self.nodes[groups[0]])
        return _links([*node[some], *node[some]], [*number[some].tolist(), *[0] * len(some)], [*[None] * len(some), *to])

    def rows(self) -> pa.RecordBatch:
        has, joined = np.flatnonzero(self.links), np.flatnonzero(self.group != np.arange(len(self.group)))
        return _links([*self.nodes[has], *self.nodes[joined]], [*self.links[has].tolist(), *[0] * len(joined)], [*[None] * len(has), *self.nodes[self.group[joined]]])


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, cosine: float = 0.98, cells: int = 64, subspaces: int = 8, codes: int = 128, sample: int = 8192, block: int = 4096) -> DataFrame:
    """(id, n_links, component_id) for every row: links join rows of one label whose cosine is ``cosine`` or more.

    A row whose label is null or whose vector is null, zero, or holds null or non-finite components has no links and is
    its own component. Equal vectors of a label are linked; repeated ids stay rows of their own; vectors of different
    lengths don't meet; an empty table gives no rows. Cells grow from ``cells`` to MOST_CELLS. Only the sample (about
    ``sample`` vectors or 32 a cell, drawn by hash) comes to the driver.
    """
    kind = "<f4" if df.schema[vector_col].dataType == ArrayType(FloatType()) else "<f8"
    rows = checkpoint(_usable(df, id_col, vector_col, label_col, kind))
    groups = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("mult"), F.min("id").alias("first"))
    groups = checkpoint(groups)
    links, edges = pq_links(groups.select("node", "label", "v", "mult"), kind, cosine, cells, subspaces, codes, sample, block)
    roots = connected_components(edges)
    of = groups.select("node", "mult", "first").join(links, "node", "left").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(least, "root").select("node", "n_links", "component_id")
    linked = rows.where("node is not null").select("id", "node").join(of, "node").select("id", "n_links", "component_id")
    alone = rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone)


def op10_pqdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept rows of ``embeddings``; ``embedding_components`` has the cases."""
    out = embedding_components(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
