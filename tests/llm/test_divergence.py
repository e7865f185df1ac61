import re
from collections import Counter, defaultdict

import pytest

from quire.llm import divergence

DOC = "doc_id long, lang string, source string, text string, term int, n string, p string, q string, rank string, salt int"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def slow(rows, least=3, top=200, scale=10**9):
    docs = [(a or "", b or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or "")))) for a, b, t in rows]
    groups, out = defaultdict(Counter), []
    held = defaultdict(Counter)
    for a, b, c in docs:
        groups[a, b] += c
        held[a].update(set(c))
    for lang in {a for a, _ in groups}:
        kept = {t for t, n in held[lang].items() if n >= least}
        mine = {b: {t: n for t, n in c.items() if t in kept} for (a, b), c in groups.items() if a == lang}
        whole = Counter()
        for c in mine.values():
            whole.update(c)

        def share(c, t, v=len(kept)):
            return 1 + scale * (c.get(t, 0) + 1) // (sum(c.values()) + v)

        p = {b: {t: share(c, t) for t in kept} for b, c in mine.items()}
        q = {t: share(whole, t) for t in kept}
        for b in mine:
            pairs = [(-sum((p[b][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in mine if o != b]
            terms = [(-((p[b][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in mine[b] if p[b][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, b, part, x, -v, r) for r, (v, _, x) in enumerate(found, 1)]
    return sorted(out)


WORDS = "Alpha beta GAMMA été ÉTÉ naïve 数据 \U0001f600 a's x-y z_w Ünï don’t".split()
ROWS = [
    *((lang, f"s{i % 5}", " ".join(WORDS[(i * j) % len(WORDS)] for j in range(1, 3 + i % 11))) for lang in ("en", "vi") for i in range(60)),
    *(("en", "hot", "beta beta gamma 12 !!") for _ in range(300)),
    ("en", "bare", None), ("en", "bare", ""), (None, None, "alpha alpha"), (None, "", "ALPHA"), ("", "x", "alpha\x00alpha"), ("none", "a", "rare"), ("none", "b", "words"), ("alone", "a", "same same"), ("alone", "a", "same"), ("alone", "a", "same"),
    ("en", "long", "beta " * 50_000 + "w" * 100_000),
]


@pytest.mark.parametrize("top, salts", ((200, 64), (2, 1)))
def test_brute_force(spark, top, salts):
    docs = spark.createDataFrame([(i, *r, 1, "", "", "", "", 3) for i, r in enumerate(ROWS)], DOC).repartition(6)
    got = divergence.divergence(docs, top=top, salts=salts)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow(ROWS, top=top)


def test_large_counts_stay_exact(spark):
    rows = [(n, t, v) for n in (0, 5, 4_600_000_000, 10**10, 10**15) for t, v in ((n + 7, 3), (10**16, 10**6))]
    got = spark.createDataFrame(rows, "n long, total long, v long").selectExpr("n", "total", "v", divergence._share("n", "total", 10**9) + " AS p")
    assert all(r.p == 1 + 10**9 * (r.n + 1) // (r.total + r.v) for r in got.collect())


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOC)).count() == 0
