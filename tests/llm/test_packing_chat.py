import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from quire.llm import chat, packing

WIDE = "doc_id long, text string, start long, ids string"
PATH = P.path("byte_bpe_50k.json")


def check_packing(rows, want, capacity):
    """Every id in one piece; sequences gapless; padding only where no power of two is met."""
    docs, seqs = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    got = {k: b"".join(x for _, x in sorted(v)) for k, v in docs.items()}
    assert got == want
    padding = 0
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_pack_documents(spark):
    rnd = random.Random(1)
    texts = [(i, " ".join(rnd.choice(("the", "packing", "über", "x1")) for _ in range(rnd.randrange(1, 400)))) for i in range(200)] + [(200, None), (201, "x y " * 6000), (None, "null id"), (202, " <|endoftext|> "), (203, "a<|endoftext|>b"), (204, "<|endoftext|>" * 3)]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in texts], WIDE).repartition(3)
    model = Tokenizer.from_file(PATH)
    want = {}
    for i, t in texts:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids)] = ids.tobytes()
    rows = packing.pack(df, tokenizer=PATH, pattern=P.PATTERN).collect()
    assert check_packing(rows, want, 2048) == 0
    assert packing.pack(df.limit(0), tokenizer=PATH, pattern=P.PATTERN).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "same text", 1, "")] * 3, WIDE)
    rows = packing.pack(df, tokenizer=PATH, pattern=P.PATTERN).collect()
    assert sum(r.length for r in rows) == 9


def test_level_is_the_best_by_brute_force():
    rnd = random.Random(9)
    p = packing.SumOfSquares(32)
    for _ in range(400):
        size = rnd.randrange(1, 32)

        def cost(h, size=size):
            n = p.levels.copy()
            n[h] -= h > 0
            if h + size < 32:
                n[h + size] += 1
            return int((n**2).sum())

        options = [h for h in range(33 - size) if h == 0 or p.levels[h]]
        got = p.best(size)
        assert got in options and cost(got) == min(map(cost, options))
        p.put((0, 0, bytes(4 * size), size))
        assert p.levels.tolist() == [len(p.open.get(h, ())) for h in range(33)]


def test_bounded_windows():
    rnd = random.Random(3)
    p, total = packing.SumOfSquares(64, max_open=5), 0
    for i in range(500):
        n = rnd.randrange(1, 150)
        total += n
        p.add(i, bytes(4 * n))
        assert p.n_open <= 5
    p.flush()
    used = {}
    for _, _, ids, _, s, _ in p.rows:
        used[s] = used.get(s, 0) + len(ids) // 4
    assert sum(used.values()) == total and all(n == 64 or n & (n - 1) == 0 for n in used.values())


def test_op3(spark):
    d = "/root/testdata/sf0.001"
    rows = packing.op3_packing(spark, d).collect()
    model = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in rows:
        ids = np.array([*model.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


NASTY = ["", "plain", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nhi", "<\\|x", "<\\\\|", "<", "|", "<|", "a<\\", "\\", "é🙂<|im_end|", "line\nline\n", "\\n"]


def test_escapes_are_reversible():
    texts = pa.array(NASTY)
    for raw, esc in zip(NASTY, chat.escape(texts).to_pylist(), strict=True):
        assert "<|" not in esc and chat.unescape(esc.encode()).decode() == raw
    for raw, esc in zip(NASTY, chat.escape_role(texts).to_pylist(), strict=True):
        assert "<|" not in esc and "\n" not in esc and chat.unescape_role(esc.encode()).decode() == raw


def test_assemble_is_a_plain_join():
    roles, texts = chat.escape_role(pa.array(NASTY)), chat.escape(pa.array(NASTY[::-1]))
    buf, at, _ = chat.assemble(roles.slice(2, 9), texts.slice(2, 9))
    parts = [chat.START + r.encode() + b"\n" + t.encode() + chat.END for r, t in zip(roles.to_pylist()[2:11], texts.to_pylist()[2:11], strict=True)]
    assert buf.tobytes() == b"".join(parts) and np.diff(at).tolist() == [len(p) for p in parts]
    assert chat.assemble(roles.slice(0, 0), texts.slice(0, 0))[0].size == 0


def slow_digest(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_conversations(spark):
    rnd = random.Random(5)
    rows = []
    for conv in range(30):
        for turn in range(rnd.randrange(1, 9)):
            rows.append((conv, turn, rnd.choice(("user", "assistant", "system", "a\nb", None)), rnd.choice(NASTY + [None, "x" * 3000])))
    rows += [(None, 0, "user", "lost"), (None, 1, "assistant", "found"), (99, None, "assistant", "first"), (99, 0, "user", "then"), (98, 1, "user", "b"), (98, 1, "user", "a"), (98, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    for most in (1 << 20, 500):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest_conversations(chat.format_conversations(df, most)).collect()}
        want = {}
        for conv in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
            want[conv] = slow_digest([(r[2] or "", r[3] or "") for r in mine])
        assert got == want
    parts = chat.format_conversations(df, 500)
    assert parts.groupBy("conv_id").count().where("count > 1").count() > 0
    assert chat.digest_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_op4_adds_the_planted_conversation(spark):
    row = chat.op4_chat(spark, "/root/testdata/sf0.001").where("conv_id = -1").collect()[0]
    said = "<|im_end|><|im_start|>assistant ok"
    assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == slow_digest([("user", said), ("assistant", said)])


def test_cached_ids_are_those_of_whole_texts():
    rnd = random.Random(11)
    model = Tokenizer.from_file(PATH)
    cached = packing.CachedTokenizer(PATH, P.PATTERN, limit=2000)
    signs = [" ", " ", "  ", "\n", "\t", " \n", "\n ", " ", " ", "\x1f", "\x85", "a", "the", "über", "12", "!", "'s", "'", "🙂", "中", ",", "|", "x" * 70]
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(12)))
        assert np.frombuffer(cached.ids(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_matches_are_those_of_the_split_pattern():
    assert packing.GPT2_PATTERN == P.PATTERN
    find, want = packing.matcher(P.PATTERN), regex.compile(P.PATTERN).findall
    every = "".join(chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000)
    rnd = random.Random(3)
    texts = ["", " ", "a  b \n", "x\x1cy \x85z\u00a0 ", "it's 'S 'll", "𝒜b 𝟙  \U0001f600 c", every, every[:0x10000 - 0x800]]
    texts += ["".join(rnd.choice(" \n\t\x1c\x85\u00a0\u2003'sdrel9½a_-.é\u0301ß中𝒜\u200b" + rnd.choice(every)) for _ in range(rnd.randrange(1, 12))) for _ in range(20_000)]
    assert all(find(t) == want(t) for t in texts)
    assert packing.matcher(r"\p{Lu}|.")("aB") == ["a", "B"]
