"""Queries with SQL give the same rows as DuckDB; all are registered."""

import duckdb
import pytest

import __spark_entry__ as entry
from quire.llm.registry import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, res = QUERIES[name](spark, D), con.execute(ORACLE_SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in res.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*sorted(names)).collect()) == want


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
