"""Sentence tables, TF-IDF and similarity as relations; ranking itself works document by document (``arrow.textrank``)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions import arrow
from quire.functions import text as t
from quire.functions.arrow import slices
from quire.session import ship

#: Rows that a worker hands over at a time.
BLOCK = 1 << 15


def sentence_table(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence)."""
    return docs.select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "sentence"))


def _by_document(docs: DataFrame, kernel: Callable[[list[list[list[str]]]], Iterator[tuple[np.ndarray, ...]]], names: list[str], kinds: str) -> DataFrame:
    """Rows (doc_id, ...) of a kernel of one document's texts, each the words of its sentences.

    The rows of a doc_id are brought together as texts, whose words are then counted and compared in place: neither
    words nor pairs of sentences are shuffled.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    words = F.transform(t.sentences(F.col("text")), t.content_tokens)
    rows = docs.select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", words.alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groupby(((i, s) for b in slices(batches) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), key=lambda x: x[0]):
            for columns in kernel([s or [] for _, s in group]):
                ids = pa.array([key] * len(columns[0]), kind)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["doc_id", *names])

    ship(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {id_type}, {kinds}")


def _weights(texts: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(sentence, word's number, weight, words) of a document: count * (ln((1 + n) / (1 + df)) + 1), n its text's sentences.

    Repeats of a document with as many sentences count as one text, sentence by sentence.
    """
    tf = Counter((len(s), pos, w) for s in texts for pos, x in enumerate(s) for w in x)
    df = Counter(w for _, _, w in tf)
    number = {w: i for i, w in enumerate(df)}
    n, pos = (np.fromiter((key[i] for key in tf), np.int64, len(tf)) for i in (0, 1))
    word = np.fromiter((number[w] for _, _, w in tf), np.int64, len(tf))
    found = np.fromiter(df.values(), np.int64, len(df))[word]
    times = np.fromiter(tf.values(), np.int64, len(tf))
    return pos, word, times * (np.log((1.0 + n) / (1.0 + found)) + 1), list(df)


def sentence_tfidf(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token, w): count * (ln((1 + n) / (1 + df)) + 1), n the document's sentences."""

    def kernel(texts: list[list[list[str]]]) -> Iterator[tuple]:
        pos, word, w, names = _weights(texts)
        for at in range(0, len(w), BLOCK):
            part = slice(at, at + BLOCK)
            yield pos[part].astype(np.int32), [names[i] for i in word[part]], w[part]

    return _by_document(docs, kernel, ["pos", "token", "w"], "pos int, token string, w double")


def similarity_edges(docs: DataFrame) -> DataFrame:
    """(doc_id, i, j, w): cosines of sentence pairs i < j that share a token.

    A sentence meets those behind it through its words' lists, so the work is that of the pairs and no matrix is laid out.
    """

    def kernel(texts: list[list[list[str]]]) -> Iterator[tuple]:
        pos, word, w, _ = _weights(texts)
        n = int(pos.max(initial=-1)) + 1
        unit = w / np.sqrt(np.bincount(pos, w * w, n))[pos]
        order = np.lexsort((pos, word))
        of, at, u = word[order], pos[order], unit[order]
        ends = np.searchsorted(of, of, "right")
        mine = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[mine], np.arange(n + 1))
        held: list[tuple[np.ndarray, ...]] = []
        for i in range(n):
            k = mine[bounds[i] : bounds[i + 1]]  # places of the sentence's words in their lists
            size = ends[k] - k
            steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            other = np.repeat(k, size) + steps
            other, own = other[at[other] > i], np.repeat(u[k], size)[at[other] > i]
            total = np.bincount(at[other], own * u[other], n).astype(float)  # of nothing they are whole numbers
            j = np.flatnonzero(np.bincount(at[other], minlength=n))
            held.append((np.full(len(j), i, np.int32), j.astype(np.int32), total[j]))
            if sum(len(x[0]) for x in held) > BLOCK or i == n - 1:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []

    return _by_document(docs.where("doc_id is not null"), kernel, ["i", "j", "w"], "i int, j int, w double")


def textrank(docs: DataFrame, n: int = 5, terms: str | None = None, boost: float = 0.15) -> DataFrame:
    """(doc_id, rank, pos, sentence) of the best sentences in the text's order; ``terms`` names a column of terms to boost."""
    best = docs.select("doc_id", t.sentences(F.col("text")).alias("s"), arrow.textrank(F.col("text"), n, F.col(terms) if terms else None, boost).alias("p"))
    return best.select("doc_id", "s", F.posexplode("p").alias("rank", "pos")).select("doc_id", (F.col("rank") + 1).alias("rank"), "pos", F.get("s", F.col("pos")).alias("sentence"))


def grounding(pairs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence, score) for the sentences of ``summary`` against ``source``."""
    s = t.sentences(F.col("summary"))
    rows = pairs.select("doc_id", s.alias("s"), arrow.grounding(s, t.sentences(F.col("source"))).alias("g"))
    return rows.select("doc_id", F.posexplode(F.arrays_zip("s", "g")).alias("pos", "x")).select("doc_id", "pos", F.col("x.s").alias("sentence"), F.col("x.g").alias("score"))
