"""Sum-of-squares online packing of token sequences.

A document's ids fill whole windows first; what remains goes to the fill level h that gives the smallest sum of squared
counts N(h)^2 of partly filled windows, N being the level array. A partition packs on its own, so packing needs no shuffle;
a task that runs again makes the same sequences from the same rows. While ``max_open`` windows are open no new one is
opened: the same rule picks among the open levels, and a piece that fits nowhere is cut to fill a window of the level whose
loss lowers the sum most, its rest being placed in turn. At a partition's end open windows are poured together, cutting
pieces, and the last one is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.runtime import map_arrow, table

END_ID = 1
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: a printable Latin-1 sign for itself, the others in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def _ranges(kind: str) -> str:
    """What a ``regex`` class matches of U+0000 to U+FFFF, as ranges that ``re`` understands."""
    import regex

    every = [*range(0xD800), *range(0xE000, 0x10000)]
    on = [ord(c) for c in regex.findall(kind, "".join(map(chr, every)))]
    first = [c for c, before in zip(on, [-2, *on], strict=False) if c != before + 1]
    last = [c for c, after in zip(on, [*on[1:], -2], strict=True) if c + 1 != after]
    return "".join(rf"\u{a:04x}-\u{z:04x}" for a, z in zip(first, last, strict=True))


def matcher(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a split pattern in a text.

    ``re`` takes less than half the time of ``regex`` but has no Unicode classes: in GPT-2's pattern they are written out,
    as ``regex`` has them, for texts without signs past U+FFFF. Others, and other patterns, go through ``regex``.
    """
    import regex

    whole = regex.compile(pattern).findall
    if pattern != GPT2_PATTERN:
        return whole
    letter, number, space = map(_ranges, (r"\p{L}", r"\p{N}", r"\s"))
    plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    past = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: plain(text) if text.isascii() or not past(text) else whole(text)


class CachedTokenizer:
    """Ids of a byte-level tokenizers file as little-endian uint32 bytes; each distinct match of its split pattern is encoded once.

    Matches go straight to the file's model. A text that holds the string of one of the file's added tokens goes through
    the library's own ``encode``, which gives that token's id. The cache is emptied at ``limit`` entries.
    """

    def __init__(self, path: str, pattern: str, limit: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenize, self.letters = self.whole.model.tokenize, byte_letters()
        self.find, self.limit, self.known = matcher(pattern), limit, _Known(self)

    def one(self, piece: str) -> bytes:
        return self._bytes([t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))])

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        ids = array("I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.known) > self.limit:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.find(text)))


class _Known(dict):
    def __init__(self, owner: CachedTokenizer) -> None:
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        out = self.owner.one(piece)
        if len(piece) < 64:
            self[piece] = out
        return out


_LOADED: dict[tuple[str, str], CachedTokenizer] = {}


def tokenizer_of(path: str, pattern: str) -> CachedTokenizer:
    """The tokenizer and its cache, once a worker process and not once a task."""
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = CachedTokenizer(path, pattern)
    return _LOADED[path, pattern]


class SumOfSquares:
    """Packs pieces (doc_id, start, ids, doc_tokens) and hands out rows (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int = 0, max_open: int = 2048) -> None:
        self.capacity, self.next, self.max_open = capacity, first_sequence, max_open
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # level -> windows; a window is a list of pieces
        self.n_open, self.rows = 0, []

    def close(self, window: list) -> None:
        at = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, ids, total, self.next, at))
            at += len(ids) // 4
        self.next += 1

    def best(self, size: int) -> int:
        """The level, 0 for a new window, whose choice makes the sum of squares smallest; ties go to the fullest.

        At the bound of open windows a level that has no room for the whole piece, if none has.
        """
        n, cap = self.levels, self.capacity
        full = self.n_open >= self.max_open
        low = np.flatnonzero(n[1 : cap - size + 1]) + 1
        if not len(low):
            return cap - int(n[::-1].argmax()) if full else 0
        after = n[low + size] * 2 + 1
        after[low + size == cap] = 0
        change = after - (2 * n[low] - 1)
        i = len(low) - 1 - int(change[::-1].argmin())
        return int(low[i]) if full or change[i] <= 2 * n[size] + 1 else 0

    def put(self, piece: tuple) -> None:
        while piece:
            doc, start, ids, total = piece
            size = len(ids) // 4
            h = self.best(size)
            if h:
                window = self.open[h].pop()
                self.levels[h] -= 1
                self.n_open -= 1
            else:
                window = []
            room = min(size, self.capacity - h)
            window.append((doc, start, ids[: 4 * room], total))
            if h + room == self.capacity:
                self.close(window)
            else:
                self.open.setdefault(h + room, []).append(window)
                self.levels[h + room] += 1
                self.n_open += 1
            piece = (doc, start + room, ids[4 * room :], total) if room < size else None

    def add(self, doc: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity * 4
        for at in range(0, len(ids), step):
            piece = (doc, at // 4, ids[at : at + step], total)
            if len(piece[2]) == step:
                self.close([piece])
            else:
                self.put(piece)

    def flush(self) -> None:
        """Pour the open windows together, emptiest into fullest; at most one is left, which is cut into powers of two."""
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        fill = [sum(len(p[2]) // 4 for p in w) for w in windows]
        lo, hi = 0, len(windows) - 1
        while lo < hi:
            gap = self.capacity - fill[lo]
            if not gap:
                self.close(windows[lo])
                lo += 1
            elif not windows[hi]:
                hi -= 1
            else:
                doc, start, ids, total = windows[hi].pop()
                cut = min(gap, len(ids) // 4)
                windows[lo].append((doc, start, ids[: 4 * cut], total))
                fill[lo] += cut
                fill[hi] -= cut
                if 4 * cut < len(ids):
                    windows[hi].append((doc, start + cut, ids[4 * cut :], total))
        if lo == hi and windows[lo]:
            self._powers(windows[lo])

    def _powers(self, window: list) -> None:
        left = sum(len(p[2]) // 4 for p in window)
        pieces = window[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left, part = left - room, []
            while room:
                doc, start, ids, total = pieces.pop()
                cut = min(room, len(ids) // 4)
                part.append((doc, start, ids[: 4 * cut], total))
                room -= cut
                if 4 * cut < len(ids):
                    pieces.append((doc, start + cut, ids[4 * cut :], total))
            self.close(part)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str, pattern: str, capacity: int = 2048, end_id: int = END_ID, max_open: int = 2048) -> DataFrame:
    """Pieces of all documents, packed: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated and null ids are packed as separate documents. An empty table
    gives no rows; other columns are ignored. Memory: ``max_open`` windows and one Arrow batch.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        model, packer = tokenizer_of(tokenizer, pattern), SumOfSquares(capacity, part << 36, max_open)

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            doc, start, ids, total, seq, at = zip(*rows, strict=True) if rows else ((),) * 6
            n = [len(x) // 4 for x in ids]
            cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(at, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc, model.ids(text.as_py() or "") + end)
                if len(packer.rows) >= 2000:
                    yield out()
        packer.flush()
        yield out()

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, SCHEMA)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document's ids and where it lies; ``pack`` has the cases."""
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), tokenizer=vocabulary("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
