import math

import numpy as np
import pytest

from quire.llm import pqdedup, topk

TOP = "id long, v array<float>, score string"
DUP = "vec_id long, embedding array<float>, label int, node string, v int"


def slow_top(rows, queries, k):
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    out = []
    for i in queries:
        s = sorted((-sum(a * b for a, b in zip(q[i], v, strict=True)), j) for j, v in q.items() if j != i)
        out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", (3, 1000))
def test_top_k_with_ties(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 6) / 64).tolist()) for i in range(150)] + [(i, [0.0] * 6) for i in range(150, 155)]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [math.inf] * 6), (904, []), (905, [1.0]), (None, [9.0] * 6)]
    v = spark.createDataFrame([(i, x, "clash") for i, x in rows + odd], TOP)
    got = topk.threshold_top_k(v, v.where("id % 10 = 0"), block=block, query_block=4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == slow_top(rows, [i for i, _ in rows if i % 10 == 0], 5)


def test_threshold_stops_early_and_right():
    rng = np.random.default_rng(2)
    vecs = (rng.standard_normal((5000, 4)) ** 3 * 100).astype(np.int64)
    b = topk.Block(np.arange(5000), vecs)
    for q in vecs[:40]:
        places, scores = b.top(q, -1, 5)
        s = vecs @ q
        best = np.lexsort((np.arange(5000), -s))[:5]
        assert places.tolist() == best.tolist() and scores.tolist() == s[best].tolist()


def test_top_k_small_tables(spark):
    v = spark.createDataFrame([(50, [1.0, 2.0], ""), (51, [1.0, 0.0], "")], TOP)
    assert [tuple(r) for r in topk.threshold_top_k(v, v.where("id = 50")).collect()] == [(50, 1, 51, 65536)]
    assert topk.threshold_top_k(v.limit(0), v).count() == 0 == topk.threshold_top_k(v, v.limit(0)).count()


def slow_components(rows, cosine):
    n = len(rows)
    unit, links, parent = [], [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, v, label in rows:
        ok = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[root(i)]) for i in range(n))


@pytest.mark.parametrize("block", (7, 4096))
def test_components_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (centre + rng.standard_normal(16) * 0.05 * rng.random()).astype(np.float32).astype(float).tolist(), int(g % 3)))
    copy = rows[5][1]
    rows += [(1000 + i, copy, rows[5][2]) for i in range(30)] + [(1100, copy, 9), (1101, [x * 2 for x in copy], rows[5][2])]
    rows += [(1200, None, 1), (1201, [0.0] * 16, 1), (1202, [math.nan] * 16, 1), (1203, [None] + [1.0] * 15, 1), (1204, copy, None), (1205, [], 1)]
    rng.shuffle(rows)
    rows = [(int(i), v, None if x is None else int(x)) for i, v, x in rows]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DUP)
    got = pqdedup.embedding_components(df, cells=8, codes=16, block=block).collect()
    assert sorted(tuple(r) for r in got) == slow_components(rows, 0.98)


def test_few_sampled_rows_lose_nothing(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[150:] = x[:150] * 1.5 + rng.standard_normal((150, 8)).astype(np.float32) * 0.02
    rows = [(i, v.astype(float).tolist(), 1) for i, v in enumerate(x)]
    got = pqdedup.embedding_components(spark.createDataFrame([(*r, "", 1) for r in rows], DUP), sample=20, cells=4, codes=8).collect()
    assert sorted(tuple(r) for r in got) == slow_components(rows, 0.98)


def test_empty(spark):
    assert pqdedup.embedding_components(spark.createDataFrame([], DUP)).count() == 0


def test_queries_on_tables(spark):
    d = "/root/testdata/sf0.001"
    raw = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = topk.op8_topk(spark, d).collect()
    assert sorted(tuple(r) for r in got) == slow_top([r[:2] for r in raw], [r[0] for r in raw if r[0] % 50 == 0], 5)
    got = pqdedup.op10_pqdedup(spark, d).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == slow_components(raw, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_mixed_lengths_in_one_batch(spark):
    """Each length meets its own, whatever lengths share the batch."""
    rows = [(i, [1.0, float(i)]) for i in range(5)] + [(10 + i, [1.0, 2.0, float(i)]) for i in range(2)] + [(20, [3.0])]
    v = spark.createDataFrame([(i, x, "") for i, x in rows], TOP).coalesce(1)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.threshold_top_k(v, v, k=2).collect())
    want = []
    for n in (2, 3, 1):
        some = [r for r in rows if len(r[1]) == n]
        want += slow_top(some, [i for i, _ in some], 2)
    assert got == sorted(want)
    same = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [5.0, 0.0, 0.0], 1), (5, [1.0], 1)]
    got = pqdedup.embedding_components(spark.createDataFrame([(*r, "", 1) for r in same], DUP).coalesce(1)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 2), (5, 0, 5)]


def test_large_components_are_exact(spark):
    """Past 2^20 a quantised component is past 2^28, past 2^54 the scores need more than 64 bits: the ranks stay exact."""
    rows = [(50, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [1e7, -1.0]), (3, [1e7 + 1 / 256, -1.0]), (4, [-1e7, 9.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.threshold_top_k(v, v.where("id = 50")).collect())
    assert got == slow_top(rows, [50], 5)
    rows = [(50, [1e30, 1.0]), (1, [1e-30, 0.0]), (2, [2.0**60, 0.0]), (3, [2.0**60 + 2.0**10, 0.0]), (4, [-1e300, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = topk.threshold_top_k(v, v.where("id = 50")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 2, 1, 4] and got[0].score == 2**63 - 1 and got[3].score == -(2**63)


def test_probes_and_fitting_are_bounded():
    """2,048 cells: a batch's probes and the fitting of the centres stay under 200 MB."""
    import tracemalloc

    rng = np.random.default_rng(7)
    centres = rng.standard_normal((2048, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = centres[rng.integers(0, 2048, 512)] + 0.05 * rng.standard_normal((512, 64))
    book = pqdedup.Codebook(centres, [np.arange(64)], [np.zeros((1, 64))])
    tracemalloc.start()
    own, near = book.probes(rows, 0.2)
    probes = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    pqdedup.kmeans(rng.standard_normal((20_000, 64)), 2048, rounds=1)
    fitting = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(probes, fitting) < 200 << 20
    d = ((rows[:, None] - centres[None]) ** 2).sum(2)
    assert (own == d.argmin(1)).all()
    apart = np.sqrt(((centres[own][:, None] - centres[None]) ** 2).sum(2))
    must = d - d.min(1)[:, None] <= 0.2 * apart
    assert not (must & ~near).any() and near.sum() < must.sum() + len(rows)
