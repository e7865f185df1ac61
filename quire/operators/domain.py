"""Subject domains by keywords.

A lexicon is data: a frame ``(domain_ord, domain, kw_ord, keyword[, parent])`` with lower-case keywords. Its keywords make a
trie that goes to the workers; a text's words are indexed once and counted, judged and written out from that index, row by
row, so that neither texts nor words are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import arrow
from quire.functions import text as t
from quire.functions import values as v
from quire.functions.occurrences import Keywords

#: A lexicon of more rows than this can't go to the workers.
MOST_KEYWORDS = 1_000_000
BROADCAST_ROWS = 100_000


def lexicon(spark: SparkSession, domains: dict[str, list[str]], parents: dict[str, str] | None = None) -> DataFrame:
    rows = [(i, d, j, k, (parents or {}).get(d, d)) for i, (d, ks) in enumerate(domains.items()) for j, k in enumerate(ks)]
    return spark.createDataFrame(rows, "domain_ord int, domain string, kw_ord int, keyword string, parent string")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with the columns of a lexicon."""
    return spark.read.csv(path, header=True, schema="domain_ord int, domain string, kw_ord int, keyword string, parent string")


def _small(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _entries(lex: DataFrame) -> tuple[Keywords, list[tuple[int, str, list[int]]]]:
    """The keywords, and each domain (place, name) with its keywords' places, in order."""
    rows = lex.select("domain_ord", "domain", "kw_ord", "keyword").where("keyword <> ''").limit(MOST_KEYWORDS + 1).collect()
    if len(rows) > MOST_KEYWORDS:
        raise ValueError(f"a lexicon has {MOST_KEYWORDS} keywords at most")
    rows.sort(key=lambda r: (r.domain_ord, r.kw_ord))
    keywords = Keywords(r.keyword for r in rows)
    place = {k: i for i, k in enumerate(keywords.names)}
    domains: dict[tuple[int, str], dict[int, None]] = {}
    for r in rows:
        domains.setdefault((r.domain_ord, r.domain), {})[place[r.keyword]] = None
    return keywords, [(*d, list(of)) for d, of in domains.items()]


def keyword_counts(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """(doc_id, domain_ord, domain, keyword, n) for the keywords that occur; keywords inside others count for both."""
    keywords, domains = _entries(lex)
    rows = [(i, d, name, keywords.names[i]) for d, name, of in domains for i in of]
    found = docs.select("doc_id", F.explode(arrow.keyword_counts(F.col("text"), keywords)).alias("c")).select("doc_id", "c.i", "c.n")
    names = docs.sparkSession.createDataFrame(rows, "i int, domain_ord int, domain string, keyword string")
    names = F.broadcast(names) if len(rows) <= BROADCAST_ROWS else names
    return found.join(names, "i").select("doc_id", "domain_ord", "domain", "keyword", "n")


def score_domains(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """(doc_id, domain_ord, domain, score) of domains with a score."""
    return keyword_counts(docs, lex).groupBy("doc_id", "domain_ord", "domain").agg(F.sum("n").alias("score"))


def detect_domain(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """(doc_id, domain, confidence): the best domain, ties to the first declared, and its share in per cent."""
    best = score_domains(docs, lex).groupBy("doc_id").agg(F.max_by("domain", F.struct("score", -F.col("domain_ord"))).alias("domain"), F.max("score").alias("top"), F.sum("score").alias("total"))
    blank = t.strip(t.filled(F.col("text"))) == ""
    rows = docs.select("doc_id", blank.alias("blank")).join(best, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("blank"), v.UNKNOWN).otherwise(F.coalesce("domain", F.lit(v.GENERAL))).alias("domain"), F.when(F.col("total").isNull(), 0.0).otherwise(F.round(F.col("top") / F.col("total") * 100, 2)).alias("confidence"))


def alternatives(scores: DataFrame) -> DataFrame:
    """(doc_id, rank, domain): the second and third domains by score and then name, both falling."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("domain"))
    return scores.withColumn("rank", F.row_number().over(order)).where("rank in (2, 3)").select("doc_id", "rank", "domain")


def terms_in(text: Column, lex: DataFrame, share: float = 0.25) -> Column:
    """A column of the lexicon's terms in ``text``, as ``lexicon_terms`` has them."""
    keywords, domains = _entries(lex)
    return arrow.lexicon_terms(text, keywords, [of for _, _, of in domains], share)


def all_terms(terms: Column, text: Column, lex: DataFrame, share: float = 0.25, least: int = 2, most_words: int = 4, stop: tuple[str, ...] = v.TERM_STOP) -> Column:
    """A text's ``terms``, cleaned, and the lexicon's in it, as ``text.clean_terms``, ``terms_in`` and ``text.merge_terms`` have them."""
    keywords, domains = _entries(lex)
    return arrow.all_terms(terms, text, keywords, [of for _, _, of in domains], share, least, most_words, stop)


def lexicon_terms(docs: DataFrame, lex: DataFrame, share: float = 0.25) -> DataFrame:
    """(doc_id, terms): the keywords present, of domains that score at least ``share`` of the best, as the text writes them."""
    return docs.select("doc_id", terms_in(F.col("text"), lex, share).alias("terms"))


def scores_in(text: Column, lex: DataFrame) -> Column:
    """A column of the domains with a score in ``text``: (domain_ord, domain, score)."""
    return arrow.domain_scores(text, *_entries(lex))


def best_of(scores: Column, text: Column) -> tuple[Column, Column]:
    """(domain, confidence) of a row's own scores, as ``detect_domain`` has them."""
    best = F.array_max(F.transform(scores, lambda s: F.struct(s["score"].alias("score"), (-s["domain_ord"]).alias("o"), s["domain"].alias("domain"))))
    total = F.aggregate(scores, F.lit(0).cast("long"), lambda a, s: a + s["score"])
    name = F.when(t.strip(t.filled(text)) == "", v.UNKNOWN).otherwise(F.coalesce(best["domain"], F.lit(v.GENERAL)))
    return name, F.when(best.isNull(), 0.0).otherwise(F.round(best["score"] / total * 100, 2))


def profile(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """The domain profile of documents that have columns terms, abbreviations, formulas and units. A row's domains are its own
    text's; only the parents are joined."""
    x = F.col("text")
    out = docs.withColumns({"_scores": scores_in(x, lex), "_concepts": t.top_concepts(x, F.col("terms"))})
    name, confidence = best_of(F.col("_scores"), x)
    ranked = F.sort_array(F.transform("_scores", lambda s: F.struct(s["score"].alias("score"), s["domain"].alias("domain"))), asc=False)
    out = out.withColumns({"subdomain": name, "confidence": confidence, "alternatives": F.transform(F.slice(ranked, 2, 2), lambda s: s["domain"])})
    parents = _small(lex.groupBy(F.col("domain").alias("subdomain")).agg(F.first("parent").alias("parent"))) if "parent" in lex.columns else None
    out = out.join(parents, "subdomain", "left") if parents is not None else out.withColumn("parent", F.lit(None).cast("string"))
    return out.select("doc_id", F.coalesce("parent", "subdomain").alias("domain"), "subdomain", "confidence", "alternatives", t.language(x).alias("language"), F.col("terms").alias("technical_terms"), "abbreviations", F.col("_concepts").alias("important_concepts"), "formulas", "units")
