"""Quality, secrets, BPE and token counts."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, quality, secrets, tokencounts

WIDE = "doc_id long, text string, spans string, score double, id long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0.5, 7) for i, t in texts], WIDE)


def slow_base(text):
    """The base kinds as plain regular expressions over the whole text."""
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m)]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(found)]


def test_secrets_against_plain_expressions():
    rnd = random.Random(4)
    parts = ["password", "PassWd", "token", "api_key", "apikey", "secret", "AKIA", "akia", "=", ":", " ", "  ", "\n", "'", '"', "é", "ſecret", "🙂", "ghp_", "x" * 7, "deadbeef" * 3, "0123456789abcdef", "ABCDEFGHIJKLMNOP", "-", ".", "ab12"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert [(secrets.KINDS[k], s, e) for s, k, e in secrets.scan(text) if k < 3] == slow_base(text), text


def token(prefix, body):
    crc, digits = zlib.crc32(body), b""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = secrets.BASE62[d : d + 1] + digits
    return (prefix + body + digits).decode()


def test_checksummed_tokens():
    good = token(b"ghp_", b"A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5")
    spans = secrets.scan(f"é {good} {good[:-1]}_ npm_{good[4:]} x{good[:-1]}Z")
    assert [(secrets.KINDS[k], e - s) for s, k, e in spans] == [("github", 40), ("npm", 40)]
    assert spans[0][0] == 2


def test_secret_rows_and_redaction(spark):
    df = frame(spark, [(1, "my password: hunter22 ok"), (1, "my password: hunter22 ok"), (2, None), (3, ""), (None, "token=" + "a1" * 20), (4, "clean " * 50_000)])
    rows = secrets.find_secrets(df).collect()
    assert sorted((r.id or 0, len(r.spans)) for r in rows) == [(0, 2), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0)]
    out = secrets.redact(df)
    assert out.columns == df.columns
    assert sorted(str(r.text)[:40] for r in out.collect()) == sorted(["my [SECRET] ok", "my [SECRET] ok", "None", "", "[SECRET]", ("clean " * 50_000)[:40]])
    assert secrets.find_secrets(df.limit(0)).count() == 0 == secrets.redact(df.limit(0)).count()


def test_quality_ranks_and_generalises(spark):
    rnd = random.Random(2)

    def doc(good):
        words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(5, 200))]
        return " ".join(words) if good else rnd.choice(("!! ".join(words).upper(), " ".join([words[0]] * 60), "*** ".join(words)))

    rows = [(i, doc(i % 3 > 0)) for i in range(900)]
    extra = [(900, None), (901, ""), (None, "a b c"), (902, "word " * 200_000)]
    df = frame(spark, rows + extra)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (5, None), (7, 9)], "id long, label int")
    model = quality.train(df, labels)
    out = {r.id: r.score for r in quality.score_quality(df, model).collect()}
    assert len(out) == 904 and all(0 <= s <= 1 for s in out.values())
    right = [(out[i] >= quality.CUT) == (i % 3 > 0) for i in range(600, 900)]
    assert sum(right) >= 0.97 * 300
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns
    assert kept.count() == sum(s >= quality.CUT for s in out.values())


@pytest.mark.parametrize("labels", ([], [(1, 1)], [(1, 0), (2, 0)]))
def test_quality_without_pairs(spark, labels):
    df = frame(spark, [(1, "one two"), (2, "three")])
    model = quality.train(df, spark.createDataFrame(labels, "id long, label int"))
    assert [round(r.score, 9) for r in quality.score_quality(df, model).collect()] == [0.3, 0.3]
    assert quality.score_quality(df.limit(0), model).count() == 0


def test_more_labels_than_the_bound(spark):
    df = frame(spark, [(i, "word " * (i + 1)) for i in range(300)])
    labels = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("label"))
    assert any(quality.train(df, labels, max_labels=60).weights)


def slow_bpe(piece, rank):
    parts = [bytes([c]) for c in piece]
    while True:
        best = min(((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return [rank[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_trees_against_repeated_scans(ranks):
    rnd = random.Random(6)
    pieces = [b"", b"a"] + [bytes(rnd.choice(b"thean irx") for _ in range(rnd.randrange(1, 90))) for _ in range(400)] + ["éüß中🙂".encode() * 9] + [bytes(rnd.randrange(256) for _ in range(30)) for _ in range(50)]
    for p, ids in zip(pieces, bpe.encode_many(pieces, ranks), strict=True):
        assert ids.tolist() == slow_bpe(p, ranks.rank) == bpe.encode_one(p, ranks)


def test_bpe_like_tiktoken_and_back(spark, ranks):
    import tiktoken

    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    texts = [(1, None), (2, ""), (3, "Hello  wörld\n\n <|endoftext|> 中文 🙂"), (3, "again"), (None, "x"), (4, "ab" * 20_000), (5, " \t \n  x")]
    df = frame(spark, texts)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.decode(bpe.encode(df, ranks_path=path, pattern=P.PATTERN), ranks_path=path).collect()
    want = sorted((t or "", i or 0) for i, t in texts)
    assert sorted((bytes(r.decoded).decode(), r.id or 0) for r in rows) == want
    for r in rows:
        ids = model.encode_ordinary(bytes(r.decoded).decode())
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.ids_text == ",".join(map(str, ids))
    assert bpe.encode(df.limit(0), ranks_path=path, pattern=P.PATTERN).count() == 0


def test_op6_digests(spark):
    row = bpe.op6_bpe(spark, "/root/testdata/sf0.001").where("doc_id = 3").collect()[0]
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 3").collect()[0].text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_rollup_commits_once(spark, tmp_path):
    counts = spark.createDataFrame([("a", "en", "v1", 5), ("a", "en", "v1", 7), ("b", None, "v1", None), (None, "en", "v1", 2)], "source string, lang string, tokenizer string, n_tokens long")
    r = tokencounts.Rollup(spark, f"file://{tmp_path}/rollup")
    assert r.totals().count() == 0 and r.batches() == []
    signed = lambda s: counts.withColumn("sign", F.lit(s))
    assert r.commit("1", signed(1)) and not r.commit("1", signed(1))
    total = lambda: {(x.source, x.lang): (x.documents, x.tokens) for x in r.totals().collect()}
    assert total() == {("a", "en"): (2, 12), ("b", None): (1, 0), (None, "en"): (1, 2)}
    assert r.commit("2", signed(-1).where("source = 'a' and n_tokens = 5"))
    assert r.commit("3", signed(-1).where("source is null").union(signed(1).where("source is null").withColumn("n_tokens", F.lit(9).cast("long"))))
    assert total() == {("a", "en"): (1, 7), ("b", None): (1, 0), (None, "en"): (1, 9)}
    (tmp_path / "rollup" / "batch=4").mkdir()  # a lost job's remains
    assert r.batches() == ["1", "2", "3"] and r.commit("4", signed(1).limit(0)) and len(r.batches()) == 4
    assert total()["a", "en"] == (1, 7)
    with pytest.raises(ValueError):
        r.commit("a/b", signed(1))


def test_op5_like_a_recount(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = {}
    for r in docs:
        if r.doc_id % 10:
            key = (r.source, r.lang + "-rev" if r.doc_id % 10 == 1 else r.lang)
            a, b = want.get(key, (0, 0))
            want[key] = (a + 1, b + len(r.text.encode().split()))
    got = {(r.source, r.lang): (r.documents, r.tokens) for r in tokencounts.op5_tokencounts(spark, d).where("tokenizer = 'words'").collect()}
    assert got == want


def test_letters():
    assert set(string.ascii_letters + string.digits) == set(secrets.BASE62.decode())
