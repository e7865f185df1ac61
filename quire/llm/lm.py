"""Brown class-based bigram scores.

Every word belongs to one class, P(text) is the product of P(class | class before) * P(word | class), and a text ends with
an end token. Counts of all words come from the whole training corpus. Words get their classes in two steps:

* Exchange clustering moves the ``n_words`` most frequent words, and the shared *tails* of all others (a hash of a word's
  ending and shape), between classes, one at a time, as long as the bigram likelihood of the classes rises. It works on a
  count matrix of bounded size that is summed over the whole training corpus.
* Every other word of the ``n_table`` most frequent ones is then exchanged by its own contexts: it goes where its counts of
  classes before and after raise that likelihood most, if that is ``STAY`` nats more than in its tail's class, all words
  side by side, their contexts summed over the whole corpus.

Words past the table, seen or not, have their tail's class. Class bigrams, class sizes and numbers of types are counted anew
with these classes. Emission probabilities need a word's own count: the table's counts travel with the model, the others
are joined by word, after a document's repeats are added up.

Smoothing: transitions add ``alpha``; a word that its class has seen c times gets (c - d) / T, the unknown word of a class
gets d * V / T (T: the class's tokens, V: its distinct words, d: the discount), so the known words and the unknown one of
every class add up to 1; an empty class gives its unknown word 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.runtime import checkpoint, crc_mod, map_arrow, table, utf8
from quire.llm.simhash import _runs, _starts

#: The end token. Words are never empty.
END = b""
N_WORDS, N_TABLE, DISCOUNT, ALPHA, STAY = 2000, 200_000, 0.75, 0.1, 4.0
#: More classes cost the driver time by the square.
MOST_CLASSES = 128
_TAILS = 256
_FLUSH = 400_000


def words_of(text: bytes) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space, then the end token."""
    out = text.lower().split()
    out.append(END)
    return out


def tail_key(word: bytes) -> int:
    """The shared key of words that are not frequent: a hash of the last letters and of whether there are other signs."""
    core = word.rstrip(b".,;:!?\"')")
    return (int.from_bytes(core[-3:], "big") * 2654435761 + 97 * (len(core) != len(word)) + 31 * (not word[:1].isalpha())) % 4294967291 % _TAILS


class Places(dict):
    """Words to their places in a table; any other word gives -1 - its tail."""

    def __missing__(self, word: bytes) -> int:
        return -1 - tail_key(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, c) over all rows' texts, the end token included. Repeats are added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return rows

        for b in batches:
            for t in utf8(b.column(0)):
                seen.update(words_of(t))
                if len(seen) > _FLUSH:
                    yield out()
        yield out()

    return map_arrow(train.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def encoded(train: DataFrame, places: Places) -> DataFrame:
    """(ids): each text's places as int32, tails behind the table, the end last. Training reads these and splits texts once."""
    shared = train.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            ids = [_shifted(at.of(words_of(t)), len(at)).astype(np.int32).tobytes() for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return checkpoint(map_arrow(train.select("text"), run, "ids binary"))


def _joined(column: pa.Array) -> np.ndarray:
    """The places of a batch of texts, one behind the other, after an end."""
    return np.frombuffer(b"".join([b"\0\0\0\0", *column.to_pylist()]), np.int32)


def pair_counts(train: DataFrame, of: np.ndarray) -> np.ndarray:
    """The counts of pairs (before, after) of the groups ``of`` over all texts of ``encoded``; each begins after an end.

    ``of`` has the groups of the table's places (the end is the first), then of the tails. Each task adds up a matrix of its
    own, and the driver gets as many sums as the matrix has places at most.
    """
    size, shared = int(of.max()) + 1, train.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, group = np.zeros(size**2, np.int64), shared.value
        for b in batches:
            g = group[_joined(b.column(0))]
            np.add.at(m, g[:-1] * size + g[1:], 1)
        some = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(m[some])], ["pair", "n"])

    rows = map_arrow(train, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size**2)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def _shifted(at: np.ndarray, size: int) -> np.ndarray:
    """Places with the tails behind the table: -1 becomes ``size``."""
    return np.where(at >= 0, at, size - 1 - at)


def exchange_by_contexts(train: DataFrame, of: np.ndarray, bigrams: np.ndarray, fixed: int, stay: float = STAY) -> np.ndarray:
    """The classes ``of`` places, those of the table's words from place ``fixed`` on exchanged, all at once, by their own contexts.

    ``bigrams`` are the class pairs under ``of``. A word of n tokens goes to the class h with the largest sum of
    log N(g, h) and log N(h, g) over the classes g before and after its tokens, less 2 n log N(h): the first-order change
    of the likelihood that ``exchange`` raises. Its present class has ``stay`` nats ahead, so that a few contexts don't
    outweigh the ending. Ties go to the lowest class; the end's class is left out.
    """
    classes, known = len(bigrams), len(of) - _TAILS
    size = np.log(bigrams.sum(0) + 0.5 * classes)
    weight = np.concatenate([np.log(bigrams + 0.5), np.log(bigrams.T + 0.5)]) - size
    weight[:, 0] = -np.inf
    shared, sides = train.sparkSession.sparkContext.broadcast(of), 2 * classes

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, n = shared.value, [], 0

        def out() -> pa.RecordBatch:
            code, times = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(times.astype(np.int32))], ["code", "n"])

        for b in batches:
            w = _joined(b.column(0))
            g, own = group[w], np.flatnonzero((w >= fixed) & (w < known))  # an end goes before and comes behind each
            code = w[own].astype(np.int64) * sides
            held += [code + g[own - 1], code + classes + g[own + 1]]
            n += 2 * len(own)
            if n > 4 * _FLUSH:
                yield out()
                n = 0
        yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["word"]):
            start = _starts(t, ["word"])[:-1]
            word, side = t["word"].to_numpy()[start], t["code"].to_numpy() % sides
            gain = np.concatenate([np.add.reduceat(weight[at] * n[:, None], first) for at, n, first in _pieces(side, t["n"].to_numpy(), start)])
            gain[np.arange(len(word)), of[word]] += stay
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(gain.argmax(1))], ["word", "g"])

    # Gains add up row by row, so the contexts of a word need no sum of their own, only its rows in one place.
    found = map_arrow(train, contexts, "code long, n int").withColumn("word", F.expr(f"code div {sides}"))
    rows = map_arrow(found.repartition("word").sortWithinPartitions("word"), choose, "word long, g long", rows=10_000).toArrow()
    out = of.copy()
    out[rows["word"].to_numpy()] = rows["g"].to_numpy()
    return out


def _pieces(side: np.ndarray, n: np.ndarray, start: np.ndarray, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs in groups of about ``most`` rows or one run, so that their weights take little memory."""
    ends = np.append(start[1:], len(side))
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(ends, start[lo] + most, "right")))
        a, z = start[lo], ends[hi - 1]
        yield side[a:z], n[a:z], start[lo:hi] - a
        lo = hi


def _xlogx(a: np.ndarray) -> np.ndarray:
    return np.where(a > 0, a * np.log(np.maximum(a, 1e-300)), 0.0)


def exchange(n: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Classes of keys 0 .. len(n) - 1 by exchange clustering of bigram counts n[before, after].

    Key 0 (the end) keeps class 0 for itself. Others start in classes by falling count in turn; a round takes every key
    out of its class and puts it where sum N(g, h) log N(g, h) - sum N(g) log N(g) (left and right) is largest, ties to
    the lowest class. Ends after a round without moves.
    """
    size = len(n)
    classes = max(2, min(classes, size))
    order = np.argsort(-(n.sum(0) + n.sum(1)), kind="stable")
    order = order[order != 0]
    of = np.zeros(size, np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    hot = np.zeros((size, classes))
    hot[np.arange(size), of] = 1
    right, left = n @ hot, n.T @ hot  # key x class: counts to the classes after it, from the classes before it
    big = hot.T @ right
    for _ in range(rounds):
        moved = 0
        for w in order:
            g, self_n = of[w], n[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[g] -= self_n
            c[g] -= self_n
            big[g, :] -= r
            big[:, g] -= c
            big[g, g] -= self_n
            # gain of joining class h: row h gets r, column h gets c, the corner both and the key's own pair
            rows = _xlogx(big + r[None, :]) - _xlogx(big)
            cols = _xlogx(big + c[:, None]) - _xlogx(big)
            corner = np.diagonal(big)
            gain = rows.sum(1) + cols.sum(0) - np.diagonal(rows) - np.diagonal(cols) + _xlogx(corner + r + c + self_n) - _xlogx(corner)
            out_n, in_n = big.sum(1) + c, big.sum(0) + r
            dr, dc = r.sum() + self_n, c.sum() + self_n
            gain -= _xlogx(out_n + dr) - _xlogx(out_n) + _xlogx(in_n + dc) - _xlogx(in_n)
            gain[0] = -np.inf
            h = int(gain.argmax())
            if gain[h] <= gain[g] + 1e-9:
                h = g
            big[h, :] += r
            big[:, h] += c
            big[h, h] += self_n
            if h != g:
                of[w] = h
                moved += 1
                right[:, g] -= n[:, w]
                right[:, h] += n[:, w]
                left[:, g] -= n[w, :]
                left[:, h] += n[w, :]
        if not moved:
            break
    return of


class ClassModel:
    """What scoring needs besides the counts of words that are not in the table. ``of``: classes of places, then tails."""

    def __init__(self, places: Places, of: np.ndarray, counts: np.ndarray, bigrams: np.ndarray, types: np.ndarray, total: int, distinct: int, discount: float, alpha: float) -> None:
        self.places, self.of, self.counts, self.total, self.distinct, self.discount = places, of, counts, total, distinct, discount
        self.transition = np.log10((bigrams + alpha) / (bigrams.sum(1, keepdims=True) + alpha * len(bigrams)))
        self.tokens, self.types = bigrams.sum(0), types
        self.table_emission, self.table_base = self.emission(counts, of[: len(counts)]), self.base(counts)

    def emission(self, c: np.ndarray, g: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words of class g that were seen c times."""
        t, v, d = self.tokens[g], self.types[g], self.discount
        p = np.where(c > 0, (c - d) / np.maximum(t, 1), np.where(t > 0, d * v / np.maximum(t, 1), 1.0))
        return np.log10(p)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.distinct + 1))


def frequent_words(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """About the ``most`` most frequent words, no more, and their counts, by falling count and then by word.

    All words come from the lowest count on, in steps of an eighth of a doubling, that stays within the bound; of the
    step that passes it, words are drawn by hash.
    """
    words = counts.where(F.length("word") > 0).withColumn("s", F.floor(8 * F.log2("c")).cast("int"))
    wanted = _wanted([(r["s"], r["count"]) for r in words.groupBy("s").count().toLocalIterator()], most)
    rows = words.where(wanted).select("word", "c").toArrow()
    both = sorted(zip(rows["word"].to_pylist(), rows["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))[:most]
    return [w for w, _ in both], [c for _, c in both]


def _wanted(steps: list[tuple[int, int]], most: int) -> Column:
    """Whether a word of step ``s`` is taken, from the steps' numbers of words. Each row is compared once, not with every step."""
    room = most
    for s, n in sorted(steps, reverse=True):
        if n > room:  # two deviations fewer than there is room for
            share = max(0.0, (room - 4 * math.sqrt(room)) / n)
            drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
            return (F.col("s") > s) | ((F.col("s") == s) & drawn)
        room -= n
    return F.lit(True)


def classes_for(tokens: int) -> int:
    """The number of classes grows with the square root of the training tokens: 16 at 300,000, 64 at 3 million, MOST_CLASSES at most."""
    return min(MOST_CLASSES, 1 << max(3, round(math.log2(max(tokens, 1)) / 2 - 5)))


def train_model(train: DataFrame, counts: DataFrame, n_words: int, classes: int | None, n_table: int, discount: float, alpha: float) -> ClassModel:
    spark = train.sparkSession
    words, cs = frequent_words(counts, n_table)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    places = Places({w: i for i, w in enumerate([END, *words])})
    texts, fixed = encoded(train, places), min(len(places), n_words + 1)
    tails = np.arange(_TAILS)
    key = np.concatenate([np.arange(fixed), fixed + np.array([tail_key(w) for w in words[n_words:]], np.int64), fixed + tails])
    pairs = pair_counts(texts, key)
    key_of = exchange(pairs, classes or classes_for(total))
    of = key_of[key]
    if fixed < len(places):
        hot = np.eye(int(key_of.max()) + 1)[key_of]
        of = exchange_by_contexts(texts, of, hot.T @ pairs @ hot, fixed)
    bigrams = pair_counts(texts, of)
    known, size, shared = len(places), len(bigrams), spark.sparkContext.broadcast((places, of))

    def class_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (at, group) = np.zeros(size, np.int64), shared.value
        for b in batches:
            v += np.bincount(group[_shifted(at.of(b.column(0).to_pylist()), known)], minlength=size)
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(v[some])], ["k", "v"])

    rows = map_arrow(counts.select("word"), class_types, "k long, v long", rows=4096).groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    by = dict(zip(rows["k"].to_pylist(), rows["v"].to_pylist(), strict=True))
    types = np.array([by.get(k, 0) for k in range(size)], float)
    return ClassModel(places, of, np.array([int(bigrams[:, 0].sum()), *cs], np.int64), bigrams, types, int(total), int(distinct), discount, alpha)


def score_texts(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n_words: int = N_WORDS, classes: int | None = None, n_table: int = N_TABLE, discount: float = DISCOUNT, alpha: float = ALPHA) -> DataFrame:
    """(row, id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``; log10 probabilities.

    ``train`` has a column ``text``. Null texts are empty and are their end token alone; with no training text every
    token is unknown. Words of equal counts at the table's edge are drawn by hash. Repeated and null ids keep their rows; an empty table gives no rows; other columns are ignored.
    ``base_score`` is the add-one unigram score. ``classes`` is by default ``classes_for`` the training tokens.
    """
    spark = df.sparkSession
    counts = checkpoint(word_counts(train))
    model = spark.sparkContext.broadcast(train_model(train, counts, n_words, classes, n_table, discount, alpha))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document (n = 0, and a word with a space in it, which no text has), and one for each of its distinct
        words that the table has not."""
        m = model.value
        places, of, table = m.places, m.of, len(m.counts)
        for b in batches:
            row, ids, word, n, g, size, known, base, score = [], [], [], [], [], [], [], [], []
            for r, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
                ws = words_of(t)
                at = places.of(ws)
                ks = of[_shifted(at, table)]
                here = at[at >= 0]
                s = float(m.transition[np.append(of[0], ks[:-1]), ks].sum()) + float(m.table_emission[here].sum())
                row.append(r), ids.append(i), word.append(b" %d" % r), n.append(0), g.append(0), size.append(len(ws))
                known.append(int((m.counts[here] > 0).sum())), base.append(float(m.table_base[here].sum())), score.append(s)
                rare = np.flatnonzero(at < 0).tolist()
                where = dict(zip((ws[j] for j in rare), rare, strict=True))
                for w, k in Counter([ws[j] for j in rare]).items():
                    row.append(r), ids.append(None), word.append(w), n.append(k), g.append(int(ks[where[w]]))
                    size.append(0), known.append(0), base.append(0.0), score.append(0.0)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(ids, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int64()), pa.array(g, pa.int32()), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], ["row", "id", "word", "n", "g", "size", "known", "base", "score"])

    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    part = map_arrow(docs, parts, "row long, id long, word binary, n long, g int, size long, known long, base double, score double", rows=256)
    joined = part.join(counts, "word", "left")
    c, m = F.coalesce("c", F.lit(0)), model.value
    tokens, types = (F.array(*map(F.lit, map(float, x))) for x in (m.tokens, m.types))
    t, v = F.greatest(tokens[F.col("g")], F.lit(1.0)), types[F.col("g")]
    emission = F.when(c > 0, (c - discount) / t).when(tokens[F.col("g")] > 0, discount * v / t).otherwise(1.0)
    zero = F.col("n") == 0
    summed = joined.groupBy("row").agg(
        F.max("id").alias("id"),
        F.sum("size").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(zero, 0.0).otherwise(F.col("n") * F.log10((c + 1) / F.lit(float(m.total + m.distinct + 1))))).alias("base_score"),
        F.sum(F.col("score") + F.when(zero, 0.0).otherwise(F.col("n") * F.log10(emission))).alias("score"),
    )
    return summed.select("row", "id", "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of those outside the held-out fold; ``score_texts`` has the cases."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, docs.where(crc_mod("doc_id", 7) != 2))
    return out.select(F.col("id").alias("doc_id"), (crc_mod("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
