import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import exact

DOC = "id string, doc_id long, text string, digest int, kept string, group_size string"


def slow(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm])
        out.append((i, best[3], len(groups[norm]), (-len(t or ""), i is None, i or 0, i) == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    *((i, "one text\twith a lot of copies" + " " * (i % 7)) for i in range(400)),
    (1000, None), (1001, ""), (1002, " \t\n\r\x0b\x0c"), (-5, " \t\n\r\x0b\x0c"),
    (2000, "a b"), (2001, "ab"), (2002, "a b"), (2003, "A b"), (2004, "a\x1cb"), (2005, "\U0001f600 x"), (2006, "\U0001f600x "), (2007, "é"), (2008, "é"),
    (3000, "long " * 200_000), (3001, "long" * 200_000), (None, "ab"), (None, "only here"), (-(1 << 63), "edge"), ((1 << 63) - 1, "edge"), (7, "twice"), (7, "twice"),
]


@pytest.mark.parametrize("digest", (exact.sha256, lambda x: F.substring(F.sha2(x, 256), 1, 1), lambda x: F.lit("same")))
def test_brute_force_and_colliding_digests(spark, digest):
    docs = spark.createDataFrame([("clash", i, t, 1, "clash", None) for i, t in ROWS], DOC).repartition(7)
    got = exact.exact_duplicates(docs, digest=digest)
    assert got.columns == ["id", "digest", "keep_id", "group_size", "kept"]
    want = [r[:4] for r in slow(ROWS)]
    assert sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_query_against_brute_force(spark, tmp_path):
    spark.createDataFrame([("clash", i, t, 1, "clash", None) for i, t in ROWS], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = exact.op12_exact(spark, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == slow(ROWS)


def test_empty_table(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([("", 1, "a", 1, "", "")], DOC)
    plan = exact.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "CartesianProduct" not in plan
