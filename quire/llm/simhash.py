"""SimHash near-duplicate detection with BK-trees.

Every text becomes a fingerprint (majority vote of its shingles' XXH64 bits). Equal fingerprints collapse first. The
distinct ones are dealt to shards by pigeonhole keys, each shard grows a BK-tree (children keyed by their integer Hamming
distance to the parent) and is asked for every member's neighbours, following only edges within the radius. A shard emits a
spanning forest of its links, not its pairs; components are then found over all shards. Shard trees travel by shuffle: a
broadcast tree of all fingerprints would grow with the data.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.runtime import checkpoint, map_arrow, release, small, table, utf8

SEED = 42
_BLOCK = 1 << 16


def shingles(words: list[bytes], k: int) -> Iterator[bytes]:
    """k-word shingles with repeats; a shorter text is one shingle, an empty one has none."""
    if len(words) < k:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th further 64-bit hash of a shingle (splitmix64 steps); j = 0 is the hash itself."""
    if not j:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * j) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, k: int, words64: int = 1, unique: bool = False) -> np.ndarray:
    """The text's fingerprint as ``words64`` unsigned 64-bit words; ``unique`` counts each shingle once."""
    words = text.lower().split()
    seen = shingles(words, k)
    if unique:
        seen = iter(dict.fromkeys(seen))
    digest = xxhash.xxh64_intdigest
    return _vote((np.fromiter((digest(s, SEED) for s in islice(seen, _BLOCK)), np.uint64) for _ in count()), words64)


def _vote(blocks: Iterable[np.ndarray], words64: int) -> np.ndarray:
    """The majority of the hashes' bits; blocks end with one that is not full."""
    ones, n = np.zeros((words64, 64), np.int64), 0
    for h in blocks:
        n += len(h)
        for j in range(words64):
            ones[j] += np.unpackbits(_mixed(h, j).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if len(h) < _BLOCK:
            break
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view(np.uint64).ravel()


class BKTree:
    """Integers under Hamming distance; ``near`` lists the places of all members within ``radius``."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while new:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                return
            at = nxt

    def near(self, value: int, radius: int) -> list[int]:
        found, todo, values, children = [], [0] if self.values else [], self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if len(below) <= 2 * radius + 1:
                todo += [c for e, c in below.items() if -radius <= e - d <= radius]
            else:
                todo += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (place, place of its tree's first member) that connect what a chain of distances <= radius connects."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, v in enumerate(values):
        for j in tree.near(v, radius):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
        tree.add(v)
    return [(i, r) for i in range(len(values)) if (r := root(i)) != i]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, of input that is sorted by them; a run past ``most`` rows is cut there."""
    kept: list[pa.Table] = []  # the run that may go on

    def whole() -> pa.Table:
        return pa.concat_tables(kept).combine_chunks()

    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        cut = int(_starts(t, keys)[-2])
        goes_on = bool(kept) and all(kept[-1][k][-1].as_py() == t[k][0].as_py() for k in keys)
        if cut:
            kept.append(t.slice(0, cut))
        if kept and (cut or not goes_on):
            yield whole()
            kept = []
        kept.append(t.slice(cut))
        while most and sum(map(len, kept)) > most:
            t = whole()
            yield t.slice(0, most)
            kept = [t.slice(most)]
    if kept:
        yield whole()


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def _mask(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def pigeonhole_masks() -> list[int]:
    """Nine masks of 35 to 36 bits: two 64-bit values that differ in at most two bits agree under one of them at least.

    One of three blocks holds no difference; of the bits outside it, one of three parts holds none either.
    """
    out = []
    for lo, hi in ((0, 22), (22, 43), (43, 64)):
        rest = [i for i in range(64) if not lo <= i < hi]
        for part in np.array_split(rest, 3):
            out.append(_mask(lo, hi) | sum(1 << int(i) for i in part))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp) with the 64-bit fingerprint as a signed long; a null text counts as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [int(fingerprint(t, k)[0]) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "fp"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(src, run, "id long, fp long")


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Forest edges (a, b) over distinct ``fp`` values whose chains of distances <= radius (at most 2) connect them."""
    if not 0 <= radius <= 2:
        raise ValueError("the pigeonhole keys are exact up to radius 2")
    keys = [F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(pigeonhole_masks())]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.k", "x.v", "fp").repartition("k", "v").sortWithinPartitions("k", "v", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["k", "v"]):
            at, fp = _starts(t, ["k", "v"]), t["fp"].to_numpy()
            a, b = [], []
            for i in np.flatnonzero(np.diff(at) > 1):
                part = fp[at[i] : at[i + 1]]
                for x, y in forest(part.view(np.uint64).tolist(), radius):
                    a.append(part[y])
                    b.append(part[x])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_arrow(dealt, run, "a long, b long", rows=4096).distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over fingerprints at most ``radius`` bits apart.

    Null and empty texts have fingerprint zero and link like others; repeated ids stay as repeated rows; null ids keep
    their row and count as no id in the minimum; an empty table gives no rows. Other columns are ignored.
    """
    docs = checkpoint(fingerprints(df, id_col, text_col, k))
    distinct = checkpoint(docs.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(of, "fp").select("id", "fp", "component_id")


def band_places(bits: int, bands: int, width: int, seed: int = SEED) -> np.ndarray:
    """``bands`` rows of ``width`` bit places; every place is used about as often as any other."""
    rng = np.random.default_rng(seed)
    deals = [rng.permutation(bits)[: bits // width * width].reshape(-1, width) for _ in range(-(-bands * width // bits))]
    return np.concatenate(deals)[:bands]


def _nearest(values: list[int], radius: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(place, place before it, distance) for each value's ``most`` nearest ones within the radius among those before it."""
    tree = BKTree()
    for i, v in enumerate(values):
        for d, j in heapq.nsmallest(most, (((values[j] ^ v).bit_count(), j) for j in tree.near(v, radius))):
            yield i, j, d
        tree.add(v)


def hash_set(text: bytes, k: int) -> np.ndarray:
    """The distinct XXH64 hashes of the text's k-word shingles, ascending."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(text.lower().split(), k)), np.uint64))


def short(h: np.ndarray) -> bytes:
    """Ascending hashes by their upper six bytes, a compact form of a set. Two texts' unequal shingles agree in these about
    once in 10^9 pairs of texts of 500 shingles."""
    return (h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unshort(raw: pa.Buffer) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def common_hashes(src: DataFrame, k: int, docs: int = 50_000, most: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the shingles seen most in about ``docs`` rows of ``src(id, text)``.

    They only set the order of shingles in prefixes, which is right for any order: frequent ones come last. ``most`` bounds
    them, in steps of an eighth of a doubling of their counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["h", "n"])
            seen.clear()
            return rows

        for b in batches:
            for t in utf8(b.column(1)):
                seen.update(hash_set(t, k).view(np.int64).tolist())
                if len(seen) > 400_000:
                    yield out()
        yield out()

    sample = src.where(F.pmod(F.xxhash64("id"), F.lit(max(1, src.count() // docs))) == 0)
    counts = map_arrow(sample, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    counts, step, least, room = checkpoint(counts), F.floor(8 * F.log2("n")).cast("int"), 1 << 30, most
    for at, n in sorted(counts.groupBy(step.alias("s")).count().toLocalIterator(), reverse=True):
        room -= n
        if room < 0:
            break
        least = at
    rows = counts.where(step >= least).toArrow()  # Arrow batches: a top-k would hold every task's rows in the driver
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a set's hashes, rare ones first: two sets of that Jaccard similarity share one of these at least."""
    seen = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        seen = np.where(common[at] == h, counts[at], 0)
    most = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
    return h[np.lexsort((h, seen))[:most]]


def prefix_pairs(t: pa.Table, similarity: float, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """Arrays (pair, 5) of a, b, their roots and a bound of their overlap, for members of one hash ``h`` with different roots
    that can be alike by their sizes and places. ``t`` is sorted by (h, n).

    Members are compared at a distance of one place, of two, and so on, all hashes at once, as long as sizes allow.
    ``before`` is the hash before ``h`` in the member's prefix (``h`` itself if there is none): two members that have it in
    common have met there.
    """
    h, before, node, n, pos, root = (t[c].to_numpy() for c in ("h", "before", "node", "n", "pos", "root"))
    run = np.cumsum(np.append(0, np.diff(h) != 0))
    left, least = n - pos, np.ceil(similarity * n - 1e-9)
    k, apart, held = np.arange(len(n)), 0, []
    while len(k):
        apart += 1
        k = k[k + apart < len(n)]
        k = k[(run[k] == run[k + apart]) & (n[k] >= least[k + apart])]
        i, j = k, k + apart
        both = np.minimum(left[i], left[j])
        good = (root[i] != root[j]) & ((before[i] != before[j]) | (before[i] == h[i])) & (both >= np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9))
        i, j, both = i[good], j[good], both[good]
        if len(i):
            turn = node[i] > node[j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            held.append(np.stack((node[i], node[j], root[i], root[j], 1_000_000 * both // (n[i] + n[j])), axis=1))
            if sum(map(len, held)) > most:
                yield np.unique(np.concatenate(held), axis=0)
                held = []
    if held:
        yield np.unique(np.concatenate(held), axis=0)


def _likeliest(found: np.ndarray) -> np.ndarray:
    """Of each two roots the pair with the largest bound."""
    x, y = found[:, 2:4].min(axis=1), found[:, 2:4].max(axis=1)
    found = found[np.lexsort((found[:, 4], y, x))]
    x, y = found[:, 2:4].min(axis=1), found[:, 2:4].max(axis=1)
    return found[np.append((x[1:] != x[:-1]) | (y[1:] != y[:-1]), True)[: len(found)]]


def some_of(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = 28) -> DataFrame:
    """The rows whose ``key`` is one of ``keys``, and a few others: about one in 16 of them or fewer, up to 16 million keys.

    Keys are places in a map of at most 2 ** ``most_bits`` bits (32 MB), which all tasks get, so rows need no shuffle. The
    others go where the rows are joined.
    """
    bits = min(max(15, (16 * keys.count()).bit_length()), most_bits)
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    # Both functions count places from one.
    found = keys.groupBy(F.bitmap_bucket_number(place + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("map")).toArrow()
    on = np.zeros((1 << bits) // 8, np.uint8)
    for part, m in zip(found["part"].to_pylist(), found["map"].to_pylist(), strict=True):
        on[(part - 1) * len(m) : part * len(m)] = np.frombuffer(m, np.uint8)
    shared, columns = rows.sparkSession.sparkContext.broadcast(on), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            yield b.filter(pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)).select(columns)

    return map_arrow(rows.withColumn("__place", place), run, rows.schema.simpleString()[len("struct<") : -1])


def radius_of(similarity: float, bits: int) -> int:
    """The expected number of differing bits at that Jaccard similarity, and 2.5 deviations."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(bits * share + 2.5 * math.sqrt(bits * share * (1 - share)))


def _near_groups(df: DataFrame, id_col: str, text_col: str, k: int, similarity: float, words64: int, bands: int, width: int, nearest: int, shard: int) -> DataFrame:
    """(id, raw, digest, component_id, stays) for every row: raw is the text's MD5; ``near_duplicates`` says the rest.

    ``stays`` marks the rows of the group's smallest id, and of the smallest shingle set among those.
    """
    bits = 64 * words64
    radius = radius_of(similarity, bits)
    places = band_places(bits, bands, width)
    further = np.random.default_rng(SEED + 1).permutation(bits)[:32]

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = common.value
        for b in batches:
            raw, digest, fp, size, first = [], [], [], [], []
            for t in utf8(b.column(1)):
                h = hash_set(t, k)
                raw.append(hashlib.md5(t, usedforsecurity=False).digest()), digest.append(xxhash.xxh3_128_digest(h.tobytes())), size.append(len(h))
                fp.append(_vote((h[i : i + _BLOCK] for i in range(0, len(h) + 1, _BLOCK)), words64).tobytes())
                first.append(prefix(h, similarity, *order).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.binary()) for x in (raw, digest, fp)), pa.array(size, pa.int32()), pa.array(first, pa.binary())], ["id", "raw", "digest", "fp", "n", "prefix"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common = df.sparkSession.sparkContext.broadcast(common_hashes(src, k))
    whole = checkpoint(map_arrow(src, wide, "id long, raw binary, digest binary, fp binary, n int, prefix binary").withColumn("row", F.monotonically_increasing_id()))
    docs = checkpoint(whole.select("id", "raw", "digest"))
    # Equal shingle sets are one node from here on: the number of one of their rows.
    nodes = checkpoint(whole.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.min("row").alias("node"), F.first("fp").alias("fp"), F.first("raw").alias("raw")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, high = 1 << np.arange(width, dtype=np.int64), 1 << np.arange(len(further), dtype=np.int64)
        for b in batches:
            on = np.unpackbits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little")
            more = pa.array(on[:, further] @ high)
            for j, at in enumerate(places):
                yield pa.RecordBatch.from_arrays([pa.array((on[:, at] @ weight) * bands + j), more, b.column(1), b.column(0)], ["key", "more", "node", "fp"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["key", "part"], shard):
            at, node, a, b, d = _starts(t, ["key", "part"]), t["node"].to_numpy(), [], [], []
            for lo, hi in zip(at, at[1:], strict=False):
                if hi - lo > 1:
                    for x, y, apart in _nearest([int.from_bytes(v, "little") for v in t["fp"].slice(lo, hi - lo).to_pylist()], radius, nearest):
                        a.append(node[lo + y]), b.append(node[lo + x]), d.append(apart)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int32())], ["a", "b", "d"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for b in batches:
            keep = []
            for t, u in zip(utf8(b.column(2)), utf8(b.column(3)), strict=True):
                if t != last:
                    last, x = t, hash_set(t, k)
                y = hash_set(u, k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def links_of(pairs: DataFrame) -> DataFrame:
        """The pairs that are alike, by their whole shingle sets. Texts travel, which are smaller than their sets: each once
        to its digest and once for each of its pairs; those of no pair stay where they are."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        named = checkpoint(ends.join(nodes.select("node", "raw"), "node"))
        text = F.coalesce("text", F.lit(""))
        texts = some_of(src.select(F.unhex(F.md5(text.cast("binary"))).alias("raw"), text.alias("text")), named, "raw")
        of = texts.groupBy("raw").agg(F.first("text").alias("text"))
        raw_a, raw_b = (named.select(F.col("node").alias(c), F.col("raw").alias(f"raw_{c}")) for c in "ab")
        both = pairs.join(raw_a, "a").join(raw_b, "b").join(of.select(F.col("raw").alias("raw_b"), F.col("text").alias("y")), "raw_b")
        both = both.join(of.select(F.col("raw").alias("raw_a"), F.col("text").alias("x")), "raw_a")
        return checkpoint(map_arrow(both.select("a", "b", "x", "y"), alike, "a long, b long", rows=256))

    def by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
            size = [len(h) for h in held]
            cols = [np.repeat(b.column(i).to_numpy(), size) for i in range(3)]
            h, pos = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (held, map(np.arange, size)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, *cols, pos.astype(np.int32))], ["h", "node", "n", "root", "pos"])

    def sharing(likeliest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Pairs to be checked; of each two groups the likeliest one that a task meets, or all."""

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            found = _likeliest(np.concatenate([np.zeros((0, 5), np.int64), *held]))
            return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(5)], ["a", "b", "root_a", "root_b", "bound"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for t in _runs(batches, ["h"]):
                for found in prefix_pairs(t, similarity):
                    held.append(found)
                    if not likeliest:
                        yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(5)], ["a", "b", "root_a", "root_b", "bound"])
                        held = []
                    elif sum(map(len, held)) > 1 << 20:
                        held = [_likeliest(np.concatenate(held))]
                        if len(held[0]) > 1 << 19:
                            yield out(held)
                            held = []
            yield out(held)

        return run

    # First the texts of equal fingerprints, and each text's nearest ones of all its shards.
    alone = nodes.groupBy("fp").agg(F.min("node").alias("a"))
    same = nodes.join(alone, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    alone = checkpoint(alone)
    dealt = map_arrow(alone.select("fp", F.col("a").alias("node")), deal, "key long, more long, node long, fp binary", rows=4096)
    hot = small(dealt.groupBy("key").count().where(F.col("count") > shard).select("key", F.ceil(F.log2(F.col("count") / shard)).cast("int").alias("cut")), 100_000)
    dealt = dealt.join(hot, "key", "left").select("key", F.when(F.col("cut").isNull(), 0).otherwise(F.col("more").bitwiseAND(F.expr("shiftleft(1L, least(cut, 32)) - 1"))).alias("part"), "node", "fp")
    found = map_arrow(dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node"), candidates, "a long, b long, d int", rows=4096)
    best = found.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "a"))), 1, nearest).alias("x")).select(F.explode("x.a").alias("a"), "b")
    pairs = checkpoint(best.union(same))
    release(df.sparkSession)
    roots = connected_components(links_of(pairs))
    grouped = checkpoint(nodes.select("node", "digest", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    release(df.sparkSession)

    # Then, exactly, texts of different groups that share a hash of their prefixes.
    # Most rows are their own root; the others, and the rows that are no node (-1), are few.
    roots = grouped.select(F.col("node").alias("row"), "root")
    of = small(whole.select("row").join(roots, "row", "left").where("root is null or root <> row").select("row", F.coalesce("root", F.lit(-1)).alias("root")), 500_000)
    rooted = whole.join(of, "row", "left").withColumn("root", F.coalesce("root", "row")).where("root >= 0").select("row", "n", "root", "prefix")
    spread = map_arrow(rooted, by_hash, "h long, node long, n int, root long, pos int")
    of_h, before = Window.partitionBy("h"), F.lag("h").over(Window.partitionBy("node").orderBy("pos"))
    mixed = spread.withColumn("x", F.min("root").over(of_h)).withColumn("y", F.max("root").over(of_h)).where("x <> y").drop("x", "y")
    spread = checkpoint(mixed.withColumn("before", F.coalesce(before, "h")))
    del whole, of, rooted, mixed
    for likeliest in (True, False):
        release(df.sparkSession)
        ordered = spread.repartition("h").sortWithinPartitions("h", "n", "node").select("h", "before", "node", "n", "root", "pos")
        more = map_arrow(ordered, sharing(likeliest), "a long, b long, root_a long, root_b long, bound long", rows=10_000)
        if likeliest:
            ends = F.least("root_a", "root_b").alias("x"), F.greatest("root_a", "root_b").alias("y")
            more = more.groupBy(*ends).agg(F.max(F.struct("bound", "a", "b")).alias("p")).select("p.a", "p.b")
        else:
            more = more.select("a", "b").distinct()
        more = checkpoint(more.join(pairs, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        pairs, links = pairs.union(more), links_of(more)
        if links.isEmpty():
            continue
        of_a, of_b = (grouped.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        between = links.join(of_a, "a").join(of_b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        joined = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("to"))
        grouped, spread = (checkpoint(x.join(joined, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")) for x in (grouped, spread))

    least = grouped.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("least"))
    of = grouped.join(least, "root").select("digest", F.col("least.first").alias("component_id"), F.col("least.digest").alias("least"))
    out = docs.join(of, "digest", "left").select("id", "raw", "digest", "component_id", "least")
    return out.select("id", "raw", "digest", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"), ((F.col("id") == F.col("component_id")) & (F.col("digest") == F.col("least"))).alias("stays"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, similarity: float = 0.8, words64: int = 4, bands: int = 32, width: int = 16, nearest: int = 2, shard: int = 4096) -> DataFrame:
    """(id, component_id): groups of texts whose sets of k-word shingles have a Jaccard similarity of ``similarity`` or more.

    A similarity of 0.8 differs in about 15 % of SimHash bits, far past where pigeonhole keys help, so fingerprints are
    ``words64`` * 64 bits wide and a shard is the texts that agree on one of ``bands`` sets of ``width`` bits. A shard of
    more than ``shard`` texts is dealt on by further bits. Its BK-tree gives each text the ``nearest`` ones before it within
    the radius (``radius_of``), and of those of all its shards the ``nearest`` are checked on their whole shingle sets; texts
    of equal fingerprints are checked against the first of them. So candidates grow with texts and not with pairs. Links
    that hold make groups.

    What shards, radius and ``nearest`` leave out is taken exactly: two sets of that similarity share a hash of their
    prefixes (``prefix``). Of groups whose texts share such a hash the likeliest pair is checked, then, of those that are
    still apart, every pair whose sizes and places allow the similarity. So every
    pair of ``similarity`` or more is in one group: recall is 1 by construction, and no limit drops a link.

    Equal sets collapse first. Null and empty texts are alike; null ids keep their row, belong to no group and have a null
    component; repeated ids keep their rows; an empty table gives no rows; other columns are ignored.
    """
    return _near_groups(df, id_col, text_col, k, similarity, words64, bands, width, nearest, shard).select("id", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, similarity: float = 0.8, words64: int = 4, bands: int = 32, width: int = 16, nearest: int = 2, shard: int = 4096) -> DataFrame:
    """The rows of ``df``, all columns, with one row of each group of ``near_duplicates`` left: the smallest id's.

    Of rows that repeat an id each counts with its own text: of a group's rows with the smallest id one stays, and no row
    goes because another row of its id does. A row without an id can't be told from others and stays.
    """
    groups = checkpoint(_near_groups(df, id_col, text_col, k, similarity, words64, bands, width, nearest, shard).where("id is not null"))
    again = groups.groupBy("id").count().where("count > 1").select(F.col("id").alias("__id"))
    gone = groups.where("not stays").select(F.col("id").alias("__id")).distinct()
    rows = df.withColumn("__id", F.col(id_col).cast("long"))
    once = rows.join(gone.union(again).distinct(), "__id", "left_anti")
    left = groups.where("stays").join(again.withColumnRenamed("__id", "id"), "id", "left_semi").groupBy("id", "digest").agg(F.min("raw").alias("raw")).select(F.col("id").alias("__id"), F.col("raw").alias("__raw"))
    several = rows.withColumn("__raw", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))).join(left, ["__id", "__raw"], "left_semi").dropDuplicates(["__id", "__raw"])
    return once.select(df.columns).unionByName(several.select(df.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
