"""Work and memory that must not grow faster than the input."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import arrow
from quire.functions import kernels as k
from quire.functions import text as t
from quire.operators import rank


def _dense(sents):
    """PageRank over the whole matrix of cosines."""
    import math
    from collections import Counter

    docs = [Counter(k.content(s)) for s in sents]
    n, df = len(docs), Counter(w for d in docs for w in d)
    place = {w: i for i, w in enumerate(df)}
    m = np.zeros((n, len(place)))
    for i, d in enumerate(docs):
        for w, c in d.items():
            m[i, place[w]] = c * (math.log((1 + n) / (1 + df[w])) + 1)
    size = np.sqrt((m**2).sum(1))
    m /= np.where(size > 0, size, 1)[:, None]
    near = m @ m.T
    np.fill_diagonal(near, 0)
    step = near / np.where(near.sum(1) > 0, near.sum(1), 1)[:, None]
    rank = np.full(n, 1 / n)
    for _ in range(100):
        after = 0.15 / n + 0.85 * (rank @ step)
        moved, rank = np.abs(after - rank).sum(), after
        if moved < 1e-6:
            break
    return rank


def _many(n):
    r = np.random.default_rng(3)
    return [" ".join(f"w{x}" for x in r.zipf(1.3, 9) % 4000) + "." for _ in range(n)]


def test_textrank_needs_no_matrix_of_pairs():
    import tracemalloc

    few = [*_many(60), "alone stands this one here.", "the the of of and."]
    assert k.sentence_scores(few)[0] == pytest.approx(_dense(few), abs=1e-12)
    tracemalloc.start()
    k.sentence_scores(_many(2000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6  # the pairs alone were 32 MB, and their words 60 MB


def _late(n=2100):
    """A long text whose only sentences that are like others come last."""
    word = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(n)]
    return " ".join(f"Q{w}a q{w}b q{w}c q{w}d." for w in word) + " Weather report says rain. Weather report says snow. Weather report says hail."


def test_textrank_ranks_every_sentence(spark):
    assert k.textrank(_late(), 3) == [2100, 2101, 2102]
    assert k.summary(_late(), 3) == "Weather report says rain. Weather report says snow. Weather report says hail."
    docs = spark.createDataFrame([(1, _late(), ["hail"])], "doc_id long, text string, terms array<string>")
    assert [r.pos for r in rank.textrank(docs, 3).collect()] == [2100, 2101, 2102]
    assert [r.pos for r in rank.textrank(docs, 1, "terms").collect()] == [2102]


def test_whole_runs_summarize_whole_texts(spark):
    from quire.operators import domain
    from quire.plans import pipeline

    lex = domain.lexicon(spark, {"D": ["weather"]})
    text = _late() + " Weather report says wind."
    files = spark.createDataFrame([(1, [text])], "doc_id long, paragraphs array<string>")
    assert "Weather report says rain." in pipeline.summarize(files, lex).first().baseline
    cases = spark.createDataFrame([("a", [_late()], "Weather report says rain. Weather report says snow. Weather report says hail.")], "stem string, paragraphs array<string>, reference string")
    assert {r.rouge1 for r in pipeline.benchmark(cases, lex)[0].collect()} == {1.0}


def test_term_hits_odd_letters(spark):
    terms = ["AI", "straße", "ſet", "a b", "µm", "naıve", "ci/cd", "K"]
    sents = ["ai Ai aI.", "STRASSE Straße STRAßE", "set SET ſet", "A b a b", "μm µM", "NAIVE naıve", "CI/CD, ci/cdx", "K k", "aib"]
    assert k.term_hits(sents, terms) == [1, 1, 2, 1, 2, 1, 1, 2, 0] or k.term_hits(sents, terms) == [len({m[1].lower() for x in terms for m in k._places_of(x).finditer(s)}) for s in sents]


def test_first_by_is_not_quadratic(spark):
    rows = spark.createDataFrame([(["b", "A", "a", "B", "c"],), ([],), (None,), (["x", None, None, "X"],)], "a array<string>")
    got = [r.x for r in rows.select(t.first_by(F.col("a"), F.lower).alias("x")).collect()]
    assert got == [["b", "A", "c"], [], None, ["x", None, None]]
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(12000)), lambda i: F.concat(F.lit("Sentence "), i.cast("string"))).alias("a"))
    began = time.time()
    assert long.select(F.size(t.first_by(F.col("a"), F.lower))).first()[0] == 12000
    assert time.time() - began < 20


def test_kernels_see_few_rows_at_a_time(spark):
    whole = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["x"])
    parts = list(arrow.slices([whole, whole.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= arrow.ROWS and sum(p.num_rows for p in parts) == 1000 and parts[-1].num_rows == 0
    df = spark.range(1000).coalesce(1).select(arrow.rowwise(lambda x: None if x % 7 == 0 else f"v{x}", "string")(F.col("id")).alias("y"), "id")
    assert all(r.y == (None if r.id % 7 == 0 else f"v{r.id}") for r in df.collect())
    assert df.sparkSession.range(0).select(arrow.rowwise(str, "string")(F.col("id"))).count() == 0


def test_sentence_words_are_not_shuffled(spark):
    text = "Alpha beta gamma delta. Alpha beta gamma zeta. Kappa lambda mu nu. "
    d = spark.createDataFrame([(1, text), (2, None), (3, "Short one."), (4, text), (4, text + "Alpha omega psi chi."), (None, text)], "doc_id int, text string")
    for made in (rank.sentence_tfidf(d), rank.similarity_edges(d)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 1 and "hashpartitioning(doc_id" in plan and "hashpartitioning(doc_id#" in plan.replace("token", "!") and "SortMergeJoin" not in plan
    n = {r.doc_id: r.n for r in rank.sentence_tfidf(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {1: 12, 4: 28, None: 12}
    edges = {(r.doc_id, r.i, r.j): r.w for r in rank.similarity_edges(d).collect()}
    assert {x for x in edges if x[0] == 1} == {(1, 0, 1)} and not any(x[0] is None for x in edges)
    assert edges[1, 0, 1] == pytest.approx(k.np.sum(k._shared_weights([k.Counter(k.content(s)) for s in k.sentences(text)])[2][:3] ** 2))


def test_sweep_joins_texts_once(spark):
    from quire.operators import ml

    seen = []

    def model(rows, fits):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return rows.withColumn("fit", F.lit(0)).withColumn("pred", F.col("label"))

    d = spark.createDataFrame([(i, "ab"[i % 2], "x y " * (i + 1)) for i in range(8)], "grp long, label string, text string")
    got = ml.sweep(d, [5, 9], [0, 1], lambda text, size: F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size))), 2, model=model).collect()
    assert seen[0].count("Join Inner") == 1  # a join for each size and seed before
    assert [(r.n_docs, r.doc_accuracy) for r in got] == [(8, 1.0)]


def test_terms_of_a_row_are_counted_there(spark, monkeypatch):
    from quire.operators import sparse

    plans, kept = [], sparse.checkpoint
    monkeypatch.setattr(sparse, "checkpoint", lambda df: (plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), kept(df))[1])
    rows = spark.createDataFrame([("a", "one two one two"), ("b", None)], "label string, text string")
    data = sparse.Sparse(rows, [sparse.Fit("true", "true")], ["a", "b"])
    assert "Exchange" not in next(p for c, p in plans if c == ["_id", "_t", "term", "tf"])
    assert sorted((r.df, round(r.w, 4)) for r in data.entries.collect()) == [(1, 1.0), (1, 1.6931), (1, 1.6931), (1, 1.6931)]


def test_both_summaries_are_of_one_ranking(monkeypatch):
    calls, scores = [], k.sentence_scores
    monkeypatch.setattr(k, "sentence_scores", lambda sents: calls.append(1) or scores(sents))
    text = " ".join(_many(40))
    got = k.summaries(text, 3, (None, ["w7", "w9"]))
    assert len(calls) == 1 and got == [k.summary(text, 3), k.summary(text, 3, ["w7", "w9"])]
    assert k.summaries(" x ", 3, (None, [])) == ["x", "x"]


def test_a_source_is_laid_out_once_for_its_summaries():
    text, other = " ".join(_many(40)), "Alpha beta gamma delta. Alpha beta gamma zeta."
    claims = ["w1 w2 w3 w4 strange.", "", "the of and to.", k.sentences(text)[5]]
    before = k._text_windows.cache_info().misses
    assert k.text_grounding(claims, text) == k.text_grounding(claims, text) == k.grounding(claims, k.sentences(text))
    assert k._text_windows.cache_info().misses == before + 1
    assert k.text_grounding(["alpha beta."], other) == k.grounding(["alpha beta."], k.sentences(other)) != [1.0]
    assert k.text_grounding(["a b"], "short") is None and k.text_grounding(["a b"], None) is None and k.grounding(["a b"], []) == [0.0]


def test_paragraphs_are_normalised_in_one_kernel(spark):
    odd = ["é  a\tb ", None, "a\n\n\n\nb\x00\x1c", " x ", "가", "", "Å", "豈", " \x1f ", "İ \u0085"]
    rows = spark.createDataFrame([(odd,), (["豈", " plain "],), ([],), (None,), ([None],)], "p array<string>")
    one = rows.select(F.col("p"), arrow.normalize_all(F.col("p")).alias("n")).collect()
    nfc = spark.createDataFrame([([k.nfc(x) for x in odd],)], "p array<string>").select(F.transform("p", t.squeeze)).first()[0]
    assert [r.n for r in one] == [nfc, ["豈", "plain"], [], None, [""]]
