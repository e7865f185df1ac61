"""The queries against brute force, on documents with odd rows and clashing columns beside ordinary ones."""

import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from quire.llm import bpe, packing, quality, secrets, simhash, tokencounts

D = "/root/testdata/sf0.001"
ODD = [
    None, "", " \t\n\x0b\x0c\r", "one", "one", "Two Words", "two\x1fwords", "<|endoftext|>", "a <|endoftext|> b <|endoftext|>", "é \U0001f600 ſ naïve", "\x00nul",
    "password = hunter2hunter2 and AKIA" + "A1B2C3D4E5F6G7H8" + " and " + "0123456789abcdef" * 3, "Secret: 'short' token=abc.def/ghi+jkl=", "word " * 40_000, "x" * 200_000, "same text as before in full", "same text as before in full",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    t = pq.read_table(f"{D}/documents.parquet").slice(0, 100)
    more = pa.table({"doc_id": pa.array([*range(100_000, 100_000 + len(ODD) - 1), None], pa.int64()), "text": ODD, "lang": ["en", None] * (len(ODD) // 2) + ["en"] * (len(ODD) % 2), "source": [None] * len(ODD), "n_chars": pa.array([len(x or "") for x in ODD], pa.int64())}).select(t.column_names).cast(t.schema)
    t = pa.concat_tables([t, more])
    for name in ("id", "score", "fp", "h", "n", "kind", "spans", "ids", "tokens", "row", "sequence_id"):
        t = t.append_column(name, pa.array(["clash"] * t.num_rows))
    pq.write_table(t, at / "documents.parquet")
    for f in os.listdir(D):
        if f != "documents.parquet":
            os.symlink(f"{D}/{f}", at / f)
    return str(at), list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["source"].to_pylist(), t["lang"].to_pylist(), strict=True))


def key(x):
    return repr(x)


def test_op1(spark, odd):
    where, rows = odd
    out = quality.op1_quality(spark, where)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows)
    for i, *_ in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    same = [got[i].score for i, t, *_ in rows if t in (None, "")]
    assert len(set(same)) == 1
    real = {r.doc_id: r for r in quality.op1_quality(spark, D).collect()}
    held = [(real[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{D}/labels.parquet").collect() if r.quality is not None and r.doc_id in real and real[r.doc_id].held_out]
    assert len(held) > 5 and sum(a == b for a, b in held) >= 0.95 * len(held)


def slow_base(text):
    kinds = (
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))
    return [f"{kinds[k][0]}:{s}:{e}" for s, k, e in found]


def test_op2(spark, odd):
    where, rows = odd
    got = {r.doc_id: r for r in secrets.op2_secrets(spark, where).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        base = slow_base(text or "")
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == base


def test_op3(spark, odd):
    where, rows = odd
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    pieces, fill = {}, {}
    for r in packing.op3_packing(spark, where).collect():
        assert len(ids[r.doc_id]) == r.doc_tokens and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, of in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(of)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_op5_by_the_library(spark):
    import base64

    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    model = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in spark.read.parquet(f"{D}/documents.parquet").collect():
        if r.doc_id % 10:
            k = (r.source, r.lang + "-rev" if r.doc_id % 10 == 1 else r.lang)
            a, b = want.get(k, (0, 0))
            want[k] = (a + 1, b + len(model.encode_ordinary(r.text)))
    assert {(r.source, r.lang): (r.documents, r.tokens) for r in tokencounts.op5_tokencounts(spark, D).where("tokenizer = 'byte_bpe_50k'").collect()} == want


def test_op6(spark, odd):
    import base64

    import tiktoken

    where, rows = odd
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    model = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.op6_bpe(spark, where).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = [x for m in re_matches(text or "") for x in model.encode_ordinary(m)]
        r = got[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def re_matches(text):
    import regex

    return regex.findall(P.PATTERN, text)


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_op9(spark, odd):
    where, rows = odd
    fp = [slow_fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    want = [(doc, f"{f:016x}", least.get(root(i))) for i, ((doc, *_), f) in enumerate(zip(rows, fp, strict=True))]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, where).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
