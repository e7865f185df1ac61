"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import duckdb
import pytest

from quire.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, D)
    res = duck.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in res.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*sorted(names)).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, D)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["sentence_tfidf", "similarity_edges"])
def test_every_sentence_counts(spark, tmp_path, name):
    """A document of more sentences than TextRank takes: neither the query nor its SQL stops there."""
    word = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) + "um" for i in range(2101)]
    text = " ".join(f"{a.capitalize()} {b} sundry{a} other{a}." for a, b in zip(word, word[1:], strict=False))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, text), (2, "Alpha beta gamma delta. Beta gamma zeta eta."), (3, None)], "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    res = con.execute(SQL[name])
    names = [x[0] for x in res.description]
    want = sorted(res.fetchall())
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*names).collect())
    assert got == want and got[0][1] > (8000 if name == "sentence_tfidf" else 2000)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_golden_sentences():
    """The rank and overlap kernels on a text whose values were worked out by hand-checked definitions."""
    from quire.functions import kernels as k

    text = "Alpha beta gamma delta. Alpha beta gamma zeta. Alpha eta theta iota. Kappa lambda mu nu."
    rank, rounds = k.sentence_scores(k.sentences(text))
    assert rounds < 100 and rank[3] == pytest.approx(0.15 / 4) and rank[0] == pytest.approx(rank[1]) and rank[0] > rank[2]


def test_registered_statistics_are_uncut(spark, monkeypatch):
    from quire.plans import queries as q

    calls = {}
    monkeypatch.setattr(q.ml, "cross_validate", lambda rows, n=5, seed=0, kind="logreg", one_out=False, vocabulary=None: calls.update({kind: (n, vocabulary)}))
    monkeypatch.setattr(q.stats, "accuracy", lambda p: p)
    monkeypatch.setattr(q.stats, "bootstrap", lambda p, classes, rounds=1000, seed=0: calls.update(bootstrap=rounds))
    for name in ("classifier_logreg", "classifier_nb", "bootstrap_ci"):
        QUERIES[name](spark, D)
    assert calls == {"logreg": (5, None), "nb": (5, None), "bootstrap": 1000}
