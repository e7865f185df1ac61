import math
import random
import zlib
from collections import Counter

import numpy as np

from quire.llm import lm

SCHEMA = "doc_id long, text string, row long, word string, base_score int"


def slow_base(texts, train):
    count = Counter()
    for t in train:
        count.update(lm.words_of((t or "").encode()))
    n, v = sum(count.values()), len(count)
    out = []
    for t in texts:
        ws = lm.words_of((t or "").encode())
        out.append((len(ws), sum(w in count for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)))
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    sets = [[f"{a}{i}" for i in range(60)] for a in ("der", "the", "le")]
    out = []
    for i in range(n):
        words = sets[i % 3]
        out.append(" ".join(words[min(59, int(rnd.expovariate(0.1)))] if rnd.random() < 0.95 else f"Rare{rnd.randrange(10**6)}," for _ in range(rnd.randrange(1, 120))))
    return out


def class_of(model, word):
    at = model.places[word]
    return int(model.of[at if at >= 0 else len(model.places) - 1 - at])


def slow_scores(model, counts, texts):
    """The model's definition, token by token."""
    out = []
    for t in texts:
        before, s = class_of(model, lm.END), 0.0
        for w in lm.words_of((t or "").encode()):
            g = class_of(model, w)
            s += float(model.transition[before, g]) + float(model.emission(np.array([counts[w]]), np.array([g]))[0])
            before = g
        out.append(s)
    return out


def test_scores_against_the_definition(spark):
    texts = corpus(1, 120) + [None, "", "  ", "UNSEEN Word", "x" * 100_000, corpus(1, 1)[0]]
    train_texts = texts[:90] + [None]
    df = spark.createDataFrame([(i if i % 50 else None, t, 1, "clash", 2) for i, t in enumerate(texts)], SCHEMA)
    train = spark.createDataFrame([(t,) for t in train_texts], "text string")
    how = {"n_words": 40, "classes": 6, "n_table": 60, "discount": 0.75, "alpha": 0.1}
    got = lm.score_texts(df, train, **how).orderBy("row").collect()
    want = slow_base(texts, train_texts)
    counts = Counter()
    for t in train_texts:
        counts.update(lm.words_of((t or "").encode()))
    model = lm.train_model(train, lm.word_counts(train), 40, 6, 60, 0.75, 0.1)
    assert 40 < len(model.places) < len(counts)  # some words are joined, some get their class by their contexts
    scores = slow_scores(model, counts, texts)
    assert len(got) == len(texts)
    for r, w, s in zip(got, want, scores, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, s, rel_tol=1e-9, abs_tol=1e-9)
    held = range(90, 120)
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_probabilities_add_up(spark):
    texts = corpus(2, 60)
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = Counter()
    for t in texts:
        counts.update(lm.words_of(t.encode()))
    model = lm.train_model(train, lm.word_counts(train), 30, 5, 50, 0.75, 0.1)
    assert np.allclose((10**model.transition).sum(1), 1)
    for g in range(len(model.tokens)):
        c = np.array([counts[w] for w in counts if class_of(model, w) == g] + [0])
        assert math.isclose((10 ** model.emission(c, np.full(len(c), g))).sum(), 1, abs_tol=1e-9)
    assert model.total == sum(counts.values()) and model.distinct == len(counts)


def likelihood(n, of):
    k = of.max() + 1
    hot = np.eye(k)[of]
    big = hot.T @ n @ hot
    return lm._xlogx(big).sum() - lm._xlogx(big.sum(0)).sum() - lm._xlogx(big.sum(1)).sum()


def test_exchange_finds_a_local_optimum():
    rng = np.random.default_rng(4)
    n = rng.poisson(0.3, (40, 40)).astype(float)
    n[1:20, 20:] += rng.poisson(4, (19, 20))
    of = lm.exchange(n, 5, rounds=60)
    best = likelihood(n, of)
    assert of[0] == 0 and (of[1:] > 0).all() and of.max() < 5
    for w in range(1, 40):
        for g in range(1, 5):
            other = of.copy()
            other[w] = g
            if set(other) == set(of):
                assert likelihood(n, other) <= best + 1e-6


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", 1, "", 0)], SCHEMA)
    none = spark.createDataFrame([], "text string")
    row = lm.score_texts(df, none).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)
    assert lm.score_texts(df.limit(0), df.select("text")).count() == 0


def test_op7(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    train = [r.text for r in docs if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    want = dict(zip([r.doc_id for r in docs], slow_base([r.text for r in docs], train), strict=True))
    got = lm.op7_lm(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_contexts_find_the_best_class(spark):
    """The step for the table's further words, word by word: the class of the largest first-order gain."""
    texts = corpus(7, 200)
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = Counter()
    for t in texts:
        counts.update(lm.words_of(t.encode()))
    words = [w for w, _ in counts.most_common() if w][:150]
    places = lm.Places({w: i for i, w in enumerate([lm.END, *words])})
    rng = np.random.default_rng(1)
    of = np.append(0, rng.integers(1, 7, len(words) + lm._TAILS))
    ids = lm.encoded(train, places)
    bigrams = lm.pair_counts(ids, of)
    want = np.zeros_like(bigrams)
    sides = {}
    for t in texts:
        ws = lm.words_of(t.encode())
        g = [int(of[places[w] if places[w] >= 0 else len(places) - 1 - places[w]]) for w in ws]
        for i, w in enumerate(ws):
            before = g[i - 1] if i else 0
            want[before, g[i]] += 1
            if places[w] >= 50:
                sides.setdefault(places[w], []).append((before, g[i + 1]))
    assert (bigrams == want).all()
    got = lm.exchange_by_contexts(ids, of, bigrams, 50, 0.0)
    assert (lm.exchange_by_contexts(ids, of, bigrams, 50, 1e9) == of).all()
    assert (got[:50] == of[:50]).all() and (got[len(places) :] == of[len(places) :]).all()
    for at, pairs in sides.items():
        gain = [sum(math.log(want[a, h] + 0.5) + math.log(want[h, b] + 0.5) - 2 * math.log(want[:, h].sum() + 0.5 * len(want)) for a, b in pairs) for h in range(1, len(want))]
        assert math.isclose(gain[got[at] - 1], max(gain), rel_tol=1e-9)


def test_ties_do_not_empty_the_table(spark):
    """Thirty words of equal counts and room for twenty: some of them, not none; with room for all of them, all."""
    rows = [(b"w%02d" % i, 1) for i in range(3000)] + [(b"", 9), (b"often", 4)]
    counts = spark.createDataFrame(rows, "word binary, c long")
    words, cs = lm.frequent_words(counts, 2000)
    assert words[0] == b"often" and 1500 < len(words) <= 2000 and set(cs[1:]) == {1} and words[1:] == sorted(words[1:])
    assert len(lm.frequent_words(counts, 3001)[0]) == 3001 and lm.frequent_words(counts, 1)[0] == [b"often"]
    assert lm.frequent_words(counts.limit(0), 5) == ([], [])


def test_classes_grow_with_the_tokens():
    assert [lm.classes_for(n) for n in (0, 300_000, 3_300_000, 23_000_000, 10**12)] == [8, 16, 64, 128, lm.MOST_CLASSES]


def test_a_word_is_compared_with_one_step(spark):
    steps = [(s, 10) for s in range(200)]
    assert str(lm._wanted(steps, 995)).count("(s, ") == 2  # one comparison for each of the hundred steps before
    words = spark.createDataFrame([(b"%d.%d" % s, s[0]) for s in ((i, j) for i in range(200) for j in range(10))], "word binary, s int")
    got = Counter(r.s for r in words.where(lm._wanted(steps, 995)).collect())
    assert all(got[s] == 10 for s in range(101, 200)) and max(got) == 199 and got[100] <= 5 and not any(got[s] for s in range(100))
    assert words.where(lm._wanted(steps, 2000)).count() == 2000
