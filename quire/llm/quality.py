"""Quality classifier: Bradley-Terry pairwise ranking.

Every text gets surface features. A labelled pair (good, bad) is a preference; the weights minimise the logistic loss of
the weighted feature difference, so a document's utility is linear in its features. The threshold is a quantile of the
utilities of the labelled training documents, chosen there for the best balanced accuracy, and utilities are mapped to
(0, 1) by a logistic curve that passes 0.3 at the threshold.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.runtime import crc_mod, map_arrow, table, utf8

FEATURES = ("length", "word_length", "distinct", "repeats", "line_repeats", "upper", "digit", "symbol", "bar", "end_mark", "stop", "long_words", "shout", "marked", "entropy", "tail")
#: The score at the threshold.
CUT = 0.3
_UPPER, _DIGIT, _END = bytes(range(65, 91)), b"0123456789", b".!?"
_SYMBOL = b"!#$%&*+/<=>@\\^_`{|}~[]"
_PUNCT = b".,;:!?'\"()-"


def features(text: bytes) -> list[float]:
    """The numbers of FEATURES, each finite; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    low = [w.strip(_PUNCT) for w in text.lower().split()]
    kinds: dict[bytes, int] = {}
    for w in low:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    window = math.sqrt(n)
    counts = np.fromiter(kinds.values(), float, len(kinds)) / n
    return [
        math.log1p(n),
        size / n,
        len(kinds) / window,
        sum(map(operator.eq, low, low[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        share(_UPPER),
        share(_DIGIT),
        share(_SYMBOL),
        text.count(b"|") / n,
        share(_END) * size / n,
        sum(len(w) <= 3 for w in low) / n,
        sum(len(w) > 14 for w in low) / n,
        sum(w.isupper() for w in words) / n,
        sum(w[-1:] in b"*#$%&!|" for w in words) / n,
        float(-(counts * np.log(counts)).sum()) / math.log(n + 1),
        math.log1p(max(kinds.values())) / math.log1p(n),
    ]


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    slope: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ np.array(self.weights)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        u = self.utility(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))
        return 1 / (1 + np.exp(-np.clip(self.slope * (u - self.threshold) + math.log(CUT / (1 - CUT)), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 200_000, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Bradley-Terry weights of features ``x`` from up to ``pairs`` drawn preferences of rows with y = 1 over rows with y = 0.

    With no row or a single label there are no preferences: all weights are zero and every score is CUT.
    """
    k = len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(k), np.ones(k))
    scale = np.where(scale > 1e-9, scale, 1.0)
    as_floats = lambda a: tuple(map(float, a))
    if not len(good) or not len(bad):
        return Model(as_floats(mean), as_floats(scale), (0.0,) * k, 0.0, 1.0)
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(k)
    for _ in range(30):  # Newton steps on the mean logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(k), d.T @ p / pairs - ridge * w)
        w += step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    u = z @ w
    cuts = np.unique(np.quantile(u, np.linspace(0, 1, 1001)))
    kept, dropped = np.sort(u[good]), np.sort(u[bad])
    right = 1 - np.searchsorted(kept, cuts) / len(kept) + np.searchsorted(dropped, cuts) / len(dropped)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    threshold = cuts[best[len(best) // 2]]
    below = cuts[best[len(best) // 2] - 1] if best[len(best) // 2] else threshold
    return Model(as_floats(mean), as_floats(scale), as_floats(w), float((threshold + below) / 2), 1.0)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 20_000) -> Model:
    """Fit on a bounded sample of the labelled rows of ``df``: about ``max_labels`` of ``labels(id, label)``, by the hash of the id.

    Labels other than 0 and 1 and null ids teach nothing; a repeated id counts as often as it is labelled. The sample is
    small by its bound, so it is broadcast and only the texts it names are looked at.
    """
    labels = labels.where("id is not null and label in (0, 1)").select("id", "label")
    share = min(1.0, max_labels / max(1, labels.count()))
    sample = labels.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).limit(2 * max_labels)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([features(t) for t in utf8(b.column(2))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), pa.array(list(f), pa.list_(pa.float64()))], ["id", "label", "f"])

    rows = map_arrow(texts, run, "id long, label long, f array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["label"], r["f"]))
    return fit(np.array([r["f"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows], int))


def score_quality(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``df``, in one pass.

    Texts that are null or empty have all-zero features and a score like any other; repeated and null ids keep their
    rows; an empty table gives no rows. Other columns never enter a score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(utf8(b.column(1))))], ["id", "score"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, score double")


def keep_good(df: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``cut``."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(utf8(b.column(place))) >= cut))

    return map_arrow(df, run, df.schema)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label) of the quality labels that may be learnt from: those whose crc32(id) mod 5 is not 0."""
    return table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, train(docs, training_labels(spark, sf_dir)))
    return out.select(F.col("id").alias("doc_id"), (crc_mod("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
