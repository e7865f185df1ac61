"""Byte-level BPE by a segment tree over byte positions.

The leaves hold, for every live byte position, the key (rank, position) of its pair with the next live position; the root
then holds the leftmost pair of least rank. A merge changes three leaves (the merged position, the live neighbour to its
left and the removed one), each by a logarithmic point update. Pieces of up to 64 bytes go through trees of equal size side
by side in numpy, one merge of every piece a step; longer ones through one tree each. Distinct pieces are encoded once a
worker and kept in a cache of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.runtime import map_arrow, table

NONE = np.int64(1) << 62  # a leaf without a pair
_SHIFT = 32  # a key is rank << 32 | position


class Ranks:
    """A rank file's tokens, and the merged rank of every pair of tokens that some token splits into."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in rows}
        self.token = {b: a for a, b in self.rank.items()}
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[int(k)] for k in self.keys], np.int64)
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        n = max(self.token) + 1
        size = np.array([len(self.token.get(i, b"")) for i in range(n)], np.int64)
        self.size, self.start = size, size.cumsum() - size
        self.bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(n)), np.uint8)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ranks; NONE >> 32 where a pair doesn't merge."""
        k = a << 32 | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.values[i], NONE >> _SHIFT)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        return self.bytes[np.repeat(self.start[ids] - (n.cumsum() - n), n) + np.arange(int(n.sum()))].tobytes()


def encode_one(piece: bytes, ranks: Ranks) -> list[int]:
    """One piece, one tree."""
    n = len(piece)
    if n < 2:
        return [int(ranks.byte[c]) for c in piece]
    tok = ranks.byte[np.frombuffer(piece, np.uint8)]
    leaves = 1 << (n - 1).bit_length()
    none = int(NONE)
    level = np.full(leaves, none, np.int64)
    level[: n - 1] = ranks.lookup(tok[:-1], tok[1:]) << _SHIFT | np.arange(n - 1)
    level[level >= none] = none
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = np.concatenate([[none], *levels[::-1]]).tolist()  # the root at 1, leaf i at leaves + i
    tok, after, before, pairs = tok.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), ranks.pairs

    def put(i: int, key: int) -> None:
        i += leaves
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while tree[1] < none:
        i = tree[1] & 0xFFFFFFFF
        tok[i] = tree[1] >> _SHIFT
        j = after[i]
        k = after[i] = after[j]
        tok[j] = -1
        put(j, none)
        r = None
        if k < n:
            before[k] = i
            r = pairs.get(tok[i] << 32 | tok[k])
        put(i, none if r is None else r << _SHIFT | i)
        if (h := before[i]) >= 0:
            r = pairs.get(tok[h] << 32 | tok[i])
            put(h, none if r is None else r << _SHIFT | h)
    return [t for t in tok if t >= 0]


def encode_many(pieces: list[bytes], ranks: Ranks, most: int = 64, block: int = 8192) -> list[np.ndarray]:
    """The ids of every piece; those of at most ``most`` bytes in blocks, side by side."""
    out: list = [None] * len(pieces)
    by: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if len(p) < 2 or len(p) > most:
            out[i] = np.array(encode_one(p, ranks), np.int64)
        else:
            by.setdefault((len(p) - 1).bit_length(), []).append(i)
    for power, every in by.items():
        for at in range(0, len(every), block):
            part = every[at : at + block]
            for i, ids in zip(part, _side_by_side([pieces[i] for i in part], 1 << power, ranks), strict=True):
                out[i] = ids
    return out


def _side_by_side(pieces: list[bytes], leaves: int, ranks: Ranks) -> list[np.ndarray]:
    n = len(pieces)
    size = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
    place = np.arange(leaves)
    tok = np.where(place < size[:, None], ranks.byte[raw], -1)
    tree = np.full((n, 2 * leaves), NONE, np.int64)
    has = place[:-1] < size[:, None] - 1
    r, c = np.nonzero(has)
    got = ranks.lookup(tok[r, c], tok[r, c + 1])
    tree[r, leaves + c] = np.where(got < NONE >> _SHIFT, got << _SHIFT | c, NONE)
    w = leaves
    while w > 1:
        tree[:, w // 2 : w] = np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2])
        w //= 2
    after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))

    def put(row: np.ndarray, i: np.ndarray, key: np.ndarray) -> None:
        i = i + leaves
        tree[row, i] = key
        i = i >> 1
        while len(i) and i[0]:
            tree[row, i] = np.minimum(tree[row, 2 * i], tree[row, 2 * i + 1])
            i = i >> 1

    def pair(row: np.ndarray, a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> np.ndarray:
        key = np.full(len(row), NONE, np.int64)
        s = np.flatnonzero(ok)
        got = ranks.lookup(tok[row[s], a[s]], tok[row[s], b[s]])
        key[s] = np.where(got < NONE >> _SHIFT, got << _SHIFT | a[s], NONE)
        return key

    row = np.arange(n)
    while len(row := row[tree[row, 1] < NONE]):
        i = tree[row, 1] & 0xFFFFFFFF
        tok[row, i] = tree[row, 1] >> _SHIFT
        j = after[row, i]
        k = after[row, j]
        after[row, i] = k
        tok[row, j] = -1
        put(row, j, np.full(len(row), NONE))
        inside = k < size[row]
        before[row[inside], k[inside]] = i[inside]
        put(row, i, pair(row, i, np.minimum(k, leaves - 1), inside))
        left = before[row, i] >= 0
        rl, il = row[left], i[left]
        h = before[rl, il]
        put(rl, h, pair(rl, h, il, np.ones(len(rl), bool)))
    flat, ends = tok[tok >= 0], (tok >= 0).sum(axis=1).cumsum()
    return np.split(flat, ends[:-1])


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, with a cache that is emptied at ``limit`` pieces."""

    def __init__(self, ranks: Ranks, pattern: str, limit: int = 400_000) -> None:
        import regex

        self.ranks, self.find, self.limit, self.known = ranks, regex.compile(pattern).findall, limit, {}

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        new = set().union(*split) if split else set()
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
        fresh = [p for p in new if p not in self.known]
        for p, ids in zip(fresh, encode_many([p.encode() for p in fresh], self.ranks), strict=True):
            self.known[p] = ids.astype("<u4").tobytes()
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in split]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks_path: str, pattern: str) -> DataFrame:
    """(id, ids binary): little-endian uint32 ids of every whole text; null and empty texts have none.

    Repeated and null ids keep their rows; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or Encoder(_ranks(ranks_path), pattern)
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(enc.batch([t or "" for t in part.column(1).to_pylist()]), pa.binary())], ["id", "ids"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, ids binary")


def decode(encoded: DataFrame, *, ranks_path: str) -> DataFrame:
    """(id, ids, n_tokens, ids_text, decoded): ``encoded`` with the bytes that the ids stand for and the ids as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: list[str] = []
        for b in batches:
            ranks = _ranks(ranks_path)
            text = text or [str(i) for i in range(len(ranks.size))]
            ids = [np.frombuffer(x.as_buffer(), "<u4") for x in b.column(1)]
            cols = [b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([",".join([text[i] for i in x.tolist()]) for x in ids], pa.string()), pa.array([ranks.decode(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "n_tokens", "ids_text", "decoded"])

    return map_arrow(encoded, run, "id long, ids binary, n_tokens long, ids_text string, decoded binary", rows=128)


_LOADED: dict[str, Ranks] = {}


def _ranks(path: str) -> Ranks:
    """The rank file at ``path``, once a worker process."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Ranks(path)
    return _LOADED[path]


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), ranks_path=path, pattern=public_tokenizers.PATTERN), ranks_path=path)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
