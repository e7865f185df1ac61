"""Secret scan: Aho-Corasick keyword prefilter, anchored regular expressions only at hits, embedded checksums.

Base kinds are ``assign``, ``access`` and ``hex``; the method adds tokens that carry their own checksum (``github``,
``npm``: thirty base-62 characters and then their CRC32 as six base-62 digits), kept only if the checksum is right.
The hex kind has no keyword; its prefilter searches a class-mapped copy of the text (every hex digit as one letter) for a
run of the least length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.runtime import map_arrow, table

#: In the order in which spans of equal starts are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
_HEXMAP = bytes(ord("h") if c in b"0123456789abcdef" else ord(".") for c in range(256))


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def checksum_ok(token: bytes) -> bool:
    """Whether the last six of a token's characters are the CRC32 of the thirty before them, in base 62."""
    body, crc = token[-36:-6], zlib.crc32(token[-36:-6])
    digits = bytearray()
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits.append(BASE62[d])
    return len(body) == 30 and bytes(digits[::-1]) == token[-6:]


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all secrets, by start and kind; code points, ends exclusive.

    Per kind the leftmost matches that don't overlap; a match that fails its least length or checksum is dropped but
    still covers its characters.
    """
    flat = text.encode("latin-1", "replace")  # one byte a code point; all patterns are ASCII
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in automaton().iter(flat.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end - n + 1)
    found = []
    for kind, starts in hits.items():
        done = -1
        for at in starts:
            if at < done:
                continue
            if kind == "assign":
                if m := _ASSIGN.match(flat, at):
                    done, good = m.end(), len(m[2]) >= ASSIGN_LEAST
            elif kind == "access":
                if m := _ACCESS.match(flat, at):
                    done, good = m.end(), m.end() - at >= ACCESS_LEAST
            elif m := (_GITHUB if kind == "github" else _NPM).match(flat, at):
                done, good = m.end(), checksum_ok(m[0])
            if m and good:
                found.append((at, KINDS.index(kind), m.end()))
    mapped, at, need = flat.translate(_HEXMAP), 0, b"h" * HEX_LEAST
    while (at := mapped.find(need, at)) >= 0:
        end = _HEX.match(flat, at).end()
        found.append((at, KINDS.index("hex"), end))
        at = end
    return sorted(found)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, stop>>) for every row; null and empty texts have no spans.

    Repeated and null ids keep their rows, other columns are ignored, an empty table gives no rows.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in scan(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, span)], ["id", "spans"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(src, run, "id long, spans array<struct<kind string, start long, stop long>>")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same columns with every secret of the text column replaced by ``mask``; overlapping spans become one. Null stays null."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at, spans = [], 0, []
        for s, _, e in scan(text):
            if spans and s < spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        for s, e in spans:
            out += [text[at:s], mask]
            at = e
        return "".join([*out, text[at:]]) if spans else text

    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            cols[place] = pa.array([clean(t.as_py()) for t in b.column(place)], b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_arrow(df, run, df.schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, base = find_secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    own = F.filter("spans", lambda x: x["kind"].isin(*base))
    return out.select(F.col("id").alias("doc_id"), *map(of, base), F.sha2(_listed(own), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
