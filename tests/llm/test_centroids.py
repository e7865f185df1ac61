import hashlib
import math

import numpy as np
import pytest

from quire.llm import centroids

VEC = "id string, vec_id long, embedding array<float>, v int, mult string, cluster string"


def slow(rows, k, rounds, dims, big=1 << 26):
    kept = [(i, [max(-big, min(big, math.floor(256 * max(-big, min(big, float(np.float32(x))))))) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centres = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            group = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            if group:
                centres[j] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    cost = {j: sum(d for _, c, d in got if c == j) for j in range(len(centres))}
    return sorted(((i, c, d, cost[c], sum(cost.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in got), key=repr)


def table(spark, rows):
    return spark.createDataFrame([("clash", i, v, 1, "", "") for i, v in rows], VEC).repartition(5)


ODD = [(900, None), (901, [1.0, None, 0.0]), (902, [math.nan] * 3), (903, [math.inf] * 3), (904, []), (905, [1.0]), (906, [1.0] * 4)]


@pytest.mark.parametrize("k", (1, 4, 9, 500))
def test_brute_force(spark, k):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-4, 5, 3) / 8).tolist()) for i in range(200)] + [(i, [0.25, -0.5, 0.125]) for i in range(200, 320)]
    rows += [(None, [0.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (5, [0.0, 1.0, 0.0]), (5, [0.5, 1.0, 0.0])]
    got = centroids.centroid_clusters(table(spark, rows + ODD), k=k, rounds=3, dims=3)
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow(rows, k, 3, 3)


def test_huge_components(spark):
    rows = [(1, [1e38, 0.0, -1e38]), (2, [3e5, 1.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, [-3e5, 1.0, 1.0])]
    got = centroids.centroid_clusters(table(spark, rows), k=2, rounds=2, dims=3)
    assert sorted(map(tuple, got.collect()), key=repr) == slow(rows, 2, 2, 3)


def test_multiplicities_are_exact(spark):
    big = (1 << 39) + 12345
    rows = [(np.array([(1 << 26), -7], "<i4").tobytes(), big), (np.array([-(1 << 26), 5], "<i4").tobytes(), big + 1)]
    got = centroids.lloyd(spark.createDataFrame([(bytearray(v), m) for v, m in rows], "v binary, mult long"), np.array([[0, 0]]), 1)
    assert got.tolist() == [[(big * (1 << 26) - (big + 1) * (1 << 26)) // (2 * big + 1), (-7 * big + 5 * (big + 1)) // (2 * big + 1)]]


def test_empty_table(spark):
    assert centroids.centroid_clusters(table(spark, ODD), dims=3).count() == 0
    assert centroids.centroid_clusters(spark.createDataFrame([], VEC)).count() == 0
