import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from quire.llm import quality, secrets, simhash

D = "/root/testdata/sf0.001"


def shingle_set(text):
    return set(simhash.shingles((text or "").encode().lower().split(), 5))


def test_stages_in_order_and_effect(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    all_rows = {r.doc_id: r.text for r in docs.collect()}

    good = cp.quality(spark, docs, D)
    assert good.columns == columns
    model = quality.train(docs, quality.training_labels(spark, D))
    want = {i for i, t in all_rows.items() if model.scores([t.encode()])[0] >= 0.3}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert set(kept) == want and 0 < len(want) < len(all_rows)

    single = cp.near_dedup(spark, good, D)
    assert single.columns == columns
    left = {r.doc_id for r in single.collect()}
    sets = {i: shingle_set(t) for i, t in kept.items()}
    parent = {i: i for i in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(kept)
    for a in ids:
        for b in ids:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    want = {i for i in ids if root(i) == i}
    assert want == left and len(left) < len(ids)

    clean = cp.secret_scan(spark, single, D)
    assert clean.columns == columns
    rows = clean.collect()
    assert {r.doc_id for r in rows} == left and not any(secrets.scan(r.text) for r in rows)
    assert all(r.n_chars == len(r.text) and (r.text == kept[r.doc_id] or secrets.scan(kept[r.doc_id])) for r in rows)

    pieces = {}
    for r in cp.packing(spark, clean, D).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == {r.doc_id: np.array([*model.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes() for r in rows}


def test_run(spark):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "secret_scan", "packing"]
    assert cp.run(spark, D).count() > 0
