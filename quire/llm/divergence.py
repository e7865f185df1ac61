"""How far the sources of a language diverge from each other and from their language, as plain relations.

Terms are exploded and counted by language, source and term; a language keeps the terms of enough documents. Its groups
are joined with that vocabulary, so that missing counts are zeros there, and smoothed whole-number shares are compared:
group with group by a self-join on the language's term, group with language term by term.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.runtime import checkpoint, small, table

#: What is no term; terms are the matches between.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 1 + floor(scale * (count + 1) / (total + kept terms)); decimals where a count times the scale may pass a long.
SHARE = (
    "1L + if({n} < {least}L, (({n} + 1L) * {scale}L) div ({total} + v),"
    " ((cast({n} as decimal(20,0)) + 1) * {scale}L) div (cast({total} as decimal(20,0)) + v))"
)
FAR = "((p - q) * (p - q)) div q"


def _share(n: str, total: str, scale: int) -> str:
    return SHARE.format(n=n, total=total, scale=scale, least=(1 << 62) // scale)


def numbered_groups(docs: DataFrame) -> DataFrame:
    """(lang, source, lid, gid): the groups that occur, with hashes for them and their languages that are held to be distinct."""
    names = checkpoint(docs.select("lang", "source").distinct())
    for seed in count():
        groups = names.withColumns({"lid": F.xxhash64(F.lit(seed), "lang"), "gid": F.xxhash64(F.lit(seed), "lang", "source"), "seed": F.lit(seed)})
        n = groups.agg(F.count_distinct("lang") - F.count_distinct("lid"), F.count(F.lit(1)) - F.count_distinct("gid")).first()
        if not any(n):
            return groups
    raise AssertionError


def term_counts(docs: DataFrame, seed: int, least_docs: int) -> DataFrame:
    """(lid, gid, tid, term, n, n_lang) of the kept terms: occurrences in the group and in the language; tid numbers the language's term.

    A document's terms are sorted, so that each one's first place counts the document; nothing is shuffled by document.
    """
    ascii_only = F.octet_length("text") == F.length("text")
    low = F.when(ascii_only, F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    rows = docs.select(F.xxhash64(F.lit(seed), "lang").alias("lid"), F.xxhash64(F.lit(seed), "lang", "source").alias("gid"), F.sort_array(F.split(low, GAP)).alias("terms"))
    before = F.concat(F.array(F.lit("")), "terms").alias("before")
    seen = rows.select("lid", "gid", F.inline(F.arrays_zip("terms", before))).where("terms <> ''")
    new = (F.col("terms") != F.col("before")).cast("long")
    counts = seen.groupBy("lid", "gid", F.col("terms").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.sum(new).alias("docs"))
    # Rows are numbered where a language's term has met, so the least number of its rows is its own.
    met = counts.repartition("lid", "term").withColumn("tid", F.monotonically_increasing_id())
    over = Window.partitionBy("lid", "term")
    met = met.withColumns({"tid": F.min("tid").over(over), "n_lang": F.sum("n").over(over), "docs": F.sum("docs").over(over)})
    return met.where(F.col("docs") >= least_docs).drop("docs")


def divergence(df: DataFrame, *, least_docs: int = 3, scale: int = 1_000_000_000, top: int = 200, salts: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``df`` (lang, source, text), as op11 defines them.

    Null language, source and text are ''. A group without terms has shares like any other; where a language keeps no
    term, its pairs have value 0 and there are no term rows. A language of one source has no pairs. Repeated rows are
    documents of their own; other columns are not read; an empty table gives no rows. Ties are settled by item in UTF-8
    order. A language's vocabulary is dealt by ``salts`` hashes of its terms, so that no task holds a language.
    """
    docs = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    named = numbered_groups(docs)
    seed = named.select("seed").first()
    use = checkpoint(term_counts(docs, seed.seed if seed else 0, least_docs))
    vocab = use.groupBy("tid").agg(F.first("lid").alias("lid"), F.first("n_lang").alias("n_lang"))
    langs = vocab.groupBy("lid").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    sizes = use.groupBy("gid").agg(F.sum("n").alias("total"))
    groups = named.drop("seed").join(sizes, "gid", "left").join(langs, "lid", "left").na.fill(0, ["v", "total", "total_lang"])
    groups = small(groups, 100_000)

    # Every group with every term of its language, a zero for those that it has not; one shuffle, by term.
    dealt = groups.where("v > 0").select("lid", "gid", "total", "v", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = vocab.select("tid", "lid", F.pmod(F.xxhash64("tid"), F.lit(salts)).cast("int").alias("salt"))
    zeros = salted.join(dealt, ["lid", "salt"]).select("tid", "gid", F.lit(0).cast("long").alias("n"), "total", "v")
    counts = use.select("tid", "gid", "n", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("v"))
    every = zeros.union(counts).repartition("tid").groupBy("tid", "gid").agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.max("v").alias("v"))
    shares = every.select("tid", "gid", F.expr(_share("n", "total", scale)).alias("p"))
    other = shares.select("tid", F.col("gid").alias("other"), F.col("p").alias("q"))
    far = shares.join(other, "tid").where("gid <> other").groupBy("gid", "other").agg(F.sum(F.expr(FAR)).alias("value"))
    item = groups.select(F.col("gid").alias("other"), F.col("source").alias("item"))
    far = far.join(groups.select("gid", "lang", "source"), "gid").join(item, "other").select("lang", "source", "item", "value")
    bare = groups.where("v = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))

    p, q = F.expr(_share("n", "total", scale)).alias("p"), F.expr(_share("n_lang", "total_lang", scale)).alias("q")
    more = use.join(groups.drop("lid"), "gid").select("lang", "source", F.col("term").alias("item"), p, q).where("p > q")
    terms = more.select("lang", "source", "item", F.expr(FAR).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pair_rows = far.union(none).withColumn("rank", place)
    term_rows = terms.withColumn("rank", place).where(F.col("rank") <= top)
    ranked = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pair_rows), ("term", term_rows))]
    return ranked[0].union(ranked[1])


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of ``documents``; ``divergence`` has the cases."""
    return divergence(table(spark, sf_dir, "documents"))
