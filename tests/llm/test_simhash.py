import random

import numpy as np
import pytest
import xxhash

from quire.llm import simhash as sh

DOCS = "doc_id long, text string, fp string, component_id int"


def slow_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    s = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_masks_cover_every_pair_of_flips():
    masks = sh.pigeonhole_masks()
    assert len(masks) == 9 and min(m.bit_count() for m in masks) >= 35
    for i in range(64):
        for j in range(64):
            assert any(not m & ((1 << i) | (1 << j)) for m in masks)


def test_bk_tree_finds_what_a_scan_finds():
    rnd = random.Random(3)
    values = [rnd.getrandbits(64) for _ in range(200)]
    values += [v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for v in values]
    tree = sh.BKTree()
    assert tree.near(1, 2) == []
    for v in values:
        tree.add(v)
    for v in values[:100]:
        for r in (0, 1, 2, 9):
            assert sorted(tree.near(v, r)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= r]


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(1000)).encode()
    whole = sh.fingerprint(text, 3, 2)
    monkeypatch.setattr(sh, "_BLOCK", 7)
    assert (sh.fingerprint(text, 3, 2) == whole).all()


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "a b c"), (8, "A B C"), (8, "a b c"), (None, "a b c"), (9, "ÄÖ ä x")]
    base = [f"w{rnd.randrange(90)}" for _ in range(400)]
    for i in range(10, 60):
        words = list(base)
        for _ in range(rnd.choice((0, 1, 1, 2, 40))):
            words[rnd.randrange(400)] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows.append((60, "x" * 100_000 + " y" * 50_000))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)
    got = sorted(((r.id is None, r.id or 0, r.fp & (2**64 - 1), r.component_id) for r in sh.simhash_components(df).collect()))
    fps = [slow_fingerprint(t, 3) for _, t in rows[:-1]] + [int(sh.fingerprint(rows[-1][1].encode(), 3)[0])]
    of = slow_components(fps, 2)
    least = {c: min((i for (i, _), d in zip(rows, of, strict=True) if d == c and i is not None), default=None) for c in of}
    assert got == sorted((i is None, i or 0, f, least[c]) for (i, _), f, c in zip(rows, fps, of, strict=True))
    assert len({c for *_, c in got}) < len(rows) - 10


def test_a_chain_is_one_component(spark):
    fps = [(1 << (2 * i)) - 1 for i in range(32)]
    links = sh.links(spark.createDataFrame([(sh._signed(f),) for f in fps], "fp long"))
    roots = sh.connected_components(links).collect()
    assert len(roots) == 32 and len({r.root for r in roots}) == 1
    with pytest.raises(ValueError):
        sh.links(links, 3)


@pytest.mark.parametrize("together", [4_000_000, 0])
def test_components_in_one_task_and_in_rounds(spark, together):
    """Both ways against a search, with loops, repeats, nulls, negative and large ids, a long path; no edges, no rows."""
    rnd = random.Random(5)
    edges = [(rnd.randrange(120) - 20, rnd.randrange(120) - 20) for _ in range(70)] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(2**62, 7), (2**62, 7), (7, 2**62), (500, 500), (None, 3), (3, None)]
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            at = todo.pop()
            if at not in want:
                want[at] = start
                todo += near[at]
    df = spark.createDataFrame(edges, "a long, b long")
    got = sh.connected_components(df, together=together).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert sh.connected_components(df.where("a = 500"), together=together).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert sh.simhash_components(df).count() == 0
    assert sh.near_duplicates(df).count() == 0
    assert sh.drop_near_duplicates(df).columns == df.columns


def jaccard(a, b, k=5):
    s = [set(sh.shingles(t.encode().lower().split(), k)) for t in (a, b)]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def test_near_duplicates_hold_and_are_found(spark):
    rnd = random.Random(8)
    rows, n = [], 0
    for g in range(40):
        base = [f"g{g}w{rnd.randrange(200)}" for _ in range(rnd.choice((60, 300)))]
        for edits in (0, 0, 1, 2, 4, 60):
            words = list(base)
            for _ in range(edits):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
            rows.append((n, " ".join(words), "x", 0))
            n += 1
    got = {r.id: r.component_id for r in sh.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    links = hit = 0
    near = {i: {i} for i in got}
    for i, a, *_ in rows:
        for j, b, *_ in rows[i - i % 6 : i]:
            if jaccard(a, b) >= 0.8:
                near[i].add(j), near[j].add(i)
                links += 1
                hit += got[i] == got[j]
    assert hit == links and links > 100
    for i, c in got.items():  # nothing is joined without a chain of links
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        assert c in seen


def test_drop_keeps_one_and_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 1), (1, text, "a", 1), (2, text, "b", 2), (3, text + " x", "c", 3), (4, "other", "d", 4), (None, text, "e", 5), (5, None, "f", 6), (6, "", "g", 7)]
    out = sh.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 4, 5]


def test_band_places():
    p = sh.band_places(256, 40, 16)
    assert p.shape == (40, 16) and all(len(set(x)) == 16 for x in p.tolist())
    assert np.bincount(p.ravel(), minlength=256).min() >= 2


@pytest.mark.parametrize(("nearest", "shard"), ((1, 4096), (2, 4096), (2, 8)))
def test_the_number_of_candidates_is_no_cap(spark, nearest, shard):
    """Two large groups that look alike to every shard, but are one only through a single pair."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 300, 12)]
    rows += [" ".join(base[: 255 - i] + [f"y{rnd.randrange(10**6)}" for _ in range(45 + i)]) for i in range(0, 14, 2)]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(rows)], DOCS)
    got = {r.id: r.component_id for r in sh.near_duplicates(df, nearest=nearest, shard=shard).collect()}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i], rows[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in range(len(rows))}


def test_prefixes_of_alike_sets_meet():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.choice((1, 4, 5, 12, 60, 300))
        a = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.append(a[rnd.randrange(n // 6 + 1) :], np.array([rnd.getrandbits(64) for _ in range(rnd.randrange(n // 6 + 2))], np.uint64)))
        common = a[::2]
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(*(sh.prefix(x, 0.8, common, np.arange(len(common)) + 3) for x in (a, b))))


def test_every_pair_at_the_bound_is_found(spark):
    """Four of five shingles, 12 of 15, and 120 of 150: similarity 0.8, where the bands and the radius miss many."""
    rows = []
    for n, changed in ((9, 1), (19, 3), (154, 30)):
        for g in range(150 if n < 100 else 60):
            words = [f"g{n}.{g}.{i}" for i in range(n)]
            rows += [" ".join(words), " ".join(words[: n - changed])]
    assert all(jaccard(rows[i], rows[i + 1]) >= 0.8 - 1e-9 for i in range(0, len(rows), 2))
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(rows)], DOCS)
    got = {r.id: r.component_id for r in sh.near_duplicates(df).collect()}
    assert got == {i: i - i % 2 for i in got} and len(got) == len(rows)


def test_runs_are_whole_or_cut():
    import pyarrow as pa

    keys = [1] * 3 + [2] * 7 + [3] + [4] * 2 + [5]
    for size in (1, 2, 3, 5, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64())], ["k"]) for i in range(0, len(keys), size)]
        got = [t["k"].to_pylist() for t in sh._runs(iter(batches), ["k"])]
        assert sum(got, []) == keys and all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False))
        got = [t["k"].to_pylist() for t in sh._runs(iter(batches), ["k"], 4)]
        assert sum(got, []) == keys


def test_repeated_ids_lose_no_other_text(spark):
    """Id 7 has two texts: one is a copy of id 1's and goes, the other stays. Of id 1's rows of one group one stays."""
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text, "a", 1), (1, text.upper(), "a", 1), (1, text + " x", "b", 1), (7, text, "c", 2), (7, other, "d", 3), (9, other + " y", "e", 4)]
    out = sh.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.fp) for r in out)[1:] == [(7, "d")] and len(out) == 2 and out[0].doc_id in (1, 7)


def test_prefix_pairs_against_all_pairs():
    import pyarrow as pa

    rnd = random.Random(12)
    rows = sorted((rnd.randrange(8), rnd.randrange(1, 40), i, rnd.randrange(3), rnd.randrange(5)) for i in range(150))
    h, n, node, root, pos = zip(*rows, strict=True)
    t = pa.table({"h": h, "before": h, "node": node, "n": pa.array(n, pa.int32()), "root": root, "pos": pa.array(pos, pa.int32())})
    want = set()
    for i, (x, a, u, r, p) in enumerate(rows):
        for y, b, w, q, o in rows[:i]:
            if x == y and r != q and min(a, b) >= 0.8 * max(a, b) - 1e-9 and min(a - p, b - o) >= 0.8 / 1.8 * (a + b) - 1e-9:
                want.add((min(u, w), max(u, w)))
    for most in (1 << 21, 10):
        got = np.concatenate(list(sh.prefix_pairs(t, 0.8, most)))
        assert {tuple(x) for x in got[:, :2].tolist()} == want and len(want) > 20
        of = dict(zip(node, root, strict=True))
        assert all(of[a] == x and of[b] == y for a, b, x, y, _ in got.tolist())


def test_short_sets_keep_their_size():
    h = np.unique(np.array([random.Random(1).getrandbits(64) for _ in range(1000)] + [0, 2**64 - 1], np.uint64))
    import pyarrow as pa

    assert (sh.unshort(pa.py_buffer(sh.short(h))) == h >> np.uint64(16)).all() and sh.short(h[:0]) == b""


def test_pairs_meet_once_where_their_prefixes_run_together():
    import pyarrow as pa

    rows = [(7, 7, 1), (7, 7, 2), (8, 7, 1), (8, 7, 2), (9, 8, 1), (9, 5, 2)]  # hash, the one before it, node
    h, before, node = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
    t = pa.table({"h": h, "before": before, "node": node, "n": pa.array([9] * 6, pa.int32()), "root": node, "pos": pa.array([0] * 6, pa.int32())})
    runs = [t.slice(i, 2) for i in (0, 2, 4)]
    assert [len(list(sh.prefix_pairs(x, 0.8))) for x in runs] == [1, 0, 1]
    found = np.array([[1, 2, 5, 6, 10], [3, 4, 6, 5, 30], [5, 6, 7, 8, 1], [8, 9, 5, 6, 20]])
    assert sh._likeliest(found).tolist() == [[3, 4, 6, 5, 30], [5, 6, 7, 8, 1]] and sh._likeliest(found[:0]).shape == (0, 5)


def test_some_of_loses_no_key(spark):
    keys = spark.range(3000).selectExpr("unhex(md5(string(id))) as raw", "'clash' as text")
    rows = spark.range(40_000).selectExpr("unhex(md5(string(id))) as raw", "string(id) as text")
    for bits, most in ((28, 0.1), (15, 0.3)):
        some = sh.some_of(rows, keys, "raw", bits)
        assert some.columns == ["raw", "text"]
        got = {int(r.text) for r in some.select("text").collect()}
        assert set(range(3000)) <= got and len(got) - 3000 < most * 37_000
    assert sh.some_of(rows, keys.limit(0), "raw").isEmpty() and sh.some_of(rows.limit(0), keys, "raw").isEmpty()


def test_texts_without_a_likeness_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(sh, "small", lambda df, most: sh.checkpoint(df))  # as past the bounds of broadcasts
    rnd = random.Random(4)
    rows = [(i, " ".join("%0100x" % rnd.getrandbits(400) for _ in range(100))) for i in range(300)]
    rows += [(1000 + i, t + " end") for i, t in rows[:15]]
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    got = {r.id: r.component_id for r in sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 if i >= 1000 else i for i, _ in rows}
    assert written() - before < 0.8 * sum(len(t) for _, t in rows)
