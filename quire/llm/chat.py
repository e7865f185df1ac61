"""Chat formatting by columnar byte assembly.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn, its closing mark under the loss mask of nobody: the mask
covers exactly the assistant texts. Control strings inside roles and texts are escaped reversibly: ``<``, any number of
backslashes and ``|`` get one backslash more, so no ``<|`` is left in them; a role's backslashes and line ends are escaped
as well. Segments of a batch are laid out with numpy: lengths, cumulative offsets, scatter indices, and one preallocated
buffer that becomes an Arrow binary column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.runtime import map_arrow, table

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
SCHEMA = "conv_id long, part long, n_turns long, formatted binary, loss array<struct<start long, stop long>>"
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(rb"<(\\*)\\\|")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    out = pc.replace_substring(roles, "\\", "\\\\")
    return escape(pc.replace_substring(out, "\n", "\\n"))


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text)


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role))


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a string array without nulls."""
    a = a.cast(pa.large_binary())
    at = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at[:-1], np.diff(at)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns formatted; the turns' offsets in it (one more than turns); the texts' places in it."""
    n = len(roles)
    fixed = [np.frombuffer(x, np.uint8) for x in (START, MIDDLE, END)]
    r_data, r_at, r_len = _bytes_of(roles)
    t_data, t_at, t_len = _bytes_of(texts)
    lens = np.empty((n, 5), np.int64)
    lens[:, 0], lens[:, 1], lens[:, 2], lens[:, 3], lens[:, 4] = len(START), r_len, len(MIDDLE), t_len, len(END)
    ends = lens.ravel().cumsum()
    at = np.append(0, ends[:-1]).reshape(n, 5) if n else np.zeros((0, 5), np.int64)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for j, src in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[at[:, j, None] + np.arange(len(src))] = src
    for j, data, src, length in ((1, r_data, r_at, r_len), (3, t_data, t_at, t_len)):
        step = np.arange(int(length.sum())) - np.repeat(length.cumsum() - length, length)
        out[np.repeat(at[:, j], length) + step] = data[np.repeat(src, length) + step]
    return out, np.append(at[:, 0], len(out)) if n else np.zeros(1, np.int64), at[:, 3]


def format_conversations(df: DataFrame, max_part_bytes: int = 1 << 20) -> DataFrame:
    """Parts of formatted conversations in order: conv_id, part, n_turns, formatted, loss (code points within the part).

    Rows go to one task per conversation and are sorted there by (turn, role, text), nulls first, which also settles
    ties and repeats. A task streams; a part ends after ``max_part_bytes`` or with an Arrow batch, so a conversation of
    any length needs little memory. Null roles and texts are empty; a null conv_id is a conversation of its own; an empty
    table gives no rows; other columns are ignored.
    """
    src = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            roles, texts = escape_role(b.column(1)), escape(b.column(2))
            ids = b.column(0).to_pylist()
            asst = pc.equal(b.column(1), "assistant").to_numpy(zero_copy_only=False)
            chars, r_chars = pc.utf8_length(texts).to_numpy(), pc.utf8_length(roles).to_numpy()
            size = pc.binary_length(texts).to_numpy()
            cut, run_bytes = [0], 0
            for i in range(1, b.num_rows):
                run_bytes += int(size[i - 1])
                if ids[i] != ids[i - 1] or run_bytes > max_part_bytes:
                    cut.append(i)
                    run_bytes = 0
            cut.append(b.num_rows)
            head, tail = len(START) + len(MIDDLE), len(END)
            rows = {k: [] for k in ("conv_id", "part", "n_turns", "formatted", "loss")}
            first = 0
            while first < len(cut) - 1:  # blocks of parts, each laid out in one buffer
                stop = first + 1
                while stop < len(cut) - 1 and int(size[cut[first] : cut[stop + 1]].sum()) <= 4 * max_part_bytes:
                    stop += 1
                lo, hi = cut[first], cut[stop]
                buf, at, _ = assemble(roles.slice(lo, hi - lo), texts.slice(lo, hi - lo))
                whole = memoryview(buf)
                for p in range(first, stop):
                    i, j = cut[p], cut[p + 1]
                    part = part + 1 if ids[i] == last else 0
                    last = ids[i]
                    ends = np.cumsum(head + r_chars[i:j] + chars[i:j] + tail)
                    t_end = ends - tail
                    rows["conv_id"].append(ids[i])
                    rows["part"].append(part)
                    rows["n_turns"].append(j - i)
                    rows["formatted"].append(bytes(whole[at[i - lo] : at[j - lo]]))
                    rows["loss"].append([{"start": int(e - c), "stop": int(e)} for e, c, a in zip(t_end, chars[i:j], asst[i:j], strict=True) if a])
                first = stop
            yield pa.RecordBatch.from_arrays([pa.array(rows["conv_id"], pa.int64()), pa.array(rows["part"], pa.int64()), pa.array(rows["n_turns"], pa.int64()), pa.array(rows["formatted"], pa.binary()), pa.array(rows["loss"], loss_type)], list(rows))

    return map_arrow(src, run, SCHEMA, rows=1000)


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of every turn, unescaped."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at byte {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digest_conversations(parts: DataFrame) -> DataFrame:
    """What op4 reports, read back from the parts as ``format_conversations`` left them: streaming, part after part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows: list[list] = []
        now: list | None = None

        def done() -> None:
            if now is not None:
                rows.append([now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]])

        for b in batches:
            for conv, part, data, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4), strict=True):
                if part == 0:
                    done()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = data.as_py()
                for role, text in read_turns(raw):
                    now[1] += 1
                    now[2].update(role + b"\n" + text + b"\n")
                whole = raw.decode()
                now[5] += len(whole)
                for s in loss.as_py():
                    masked = unescape(whole[s["start"] : s["stop"]].encode())
                    now[3] += len(masked.decode())
                    now[4].update(masked)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
            rows.clear()
        done()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return map_arrow(parts, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", rows=1000)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digest_conversations(format_conversations(turns.union(added)))
