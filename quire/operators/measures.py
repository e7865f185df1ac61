"""Preservation measures and summary validation, as columns. Undefined measures are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import arrow
from quire.functions import text as t


def _rate(kept: Column, total: Column) -> Column:
    return F.try_divide(kept.cast("double"), total)


def term_preservation(summary: Column, terms: Column) -> Column:
    """struct(rate, kept, total): terms that the summary contains anywhere, case aside; repeats count."""
    all_terms = F.filter(terms, lambda x: t.strip(t.filled(x)) != "")
    kept = t.let(F.lower(t.filled(summary)), lambda low: F.size(F.filter(all_terms, lambda x: low.contains(F.lower(x)))))
    return F.when(F.size(all_terms) > 0, F.struct(_rate(kept, F.size(all_terms)).alias("rate"), kept.alias("kept"), F.size(all_terms).alias("total")))


def number_preservation(summary: Column, source: Column) -> Column:
    """struct(rate, total, unsupported): the summary's numbers that the source has; the rate counts repeats."""
    mine = t.numbers(summary)
    bad = t.let(t.numbers(source), lambda known: F.filter(mine, lambda x: ~F.array_contains(known, x)))
    return F.when(F.size(mine) > 0, F.struct(_rate(F.size(mine) - F.size(bad), F.size(mine)).alias("rate"), F.size(mine).alias("total"), F.array_sort(F.array_distinct(bad)).alias("unsupported")))


def unit_preservation(summary: Column, source: Column) -> Column:
    """struct(rate, total, unsupported): distinct numbers with units, in order."""
    mine = t.units(summary)
    bad = F.array_except(mine, t.units(source))
    return F.when(F.size(mine) > 0, F.struct(_rate(F.size(mine) - F.size(bad), F.size(mine)).alias("rate"), F.size(mine).alias("total"), bad.alias("unsupported")))


def formula_preservation(summary: Column, formulas: Column) -> Column:
    """struct(rate, kept, total): formulas that the summary contains, white space aside."""
    every = F.filter(formulas, lambda x: t.strip(t.filled(x)) != "")
    kept = t.let(t.squash(summary), lambda body: F.size(F.filter(every, lambda x: body.contains(t.squash(x)))))
    return F.when(F.size(every) > 0, F.struct(_rate(kept, F.size(every)).alias("rate"), kept.alias("kept"), F.size(every).alias("total")))


def compression(summary: Column, source: Column) -> Column:
    return _rate(F.size(t.tokens(summary)), F.nullif(F.size(t.tokens(source)), F.lit(0)))


def evaluate(pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a (doc_id, method) of ``pairs``: summary, source, terms, formulas; ``keep`` names columns that stay."""
    s, src = F.col("summary"), F.col("source")
    return pairs.select("doc_id", "method", term_preservation(s, F.col("terms"))["rate"].alias("tpr"), number_preservation(s, src)["rate"].alias("npr"), unit_preservation(s, src)["rate"].alias("upr"), formula_preservation(s, F.col("formulas"))["rate"].alias("fpr"), compression(s, src).alias("compression"), t.average_sentence_length(s).alias("avg_sentence_words"), *keep)


def validate(pairs: DataFrame, threshold: float = 0.12, keep: tuple[str, ...] = ()) -> DataFrame:
    """A validation report for each row of ``pairs``: doc_id, summary, source, abbreviations (of the source); ``keep`` names
    columns that stay."""
    s, src = F.col("summary"), F.col("source")
    sents = t.sentences(s)
    none = F.array().cast("array<string>")
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    rows = pairs.select(
        "doc_id",
        *kept,
        F.coalesce(number_preservation(s, src)["unsupported"], none).alias("unsupported_numbers"),
        F.coalesce(unit_preservation(s, src)["unsupported"], none).alias("unsupported_units"),
        arrow.conflicts(arrow.abbreviations(s), F.col("abbreviations")).alias("abbreviation_conflicts"),
        sents.alias("_s"),
        arrow.text_grounding(sents, src).alias("_g"),
    )
    scored = F.when((F.size("_s") > 0) & F.col("_g").isNotNull(), F.arrays_zip(F.col("_s").alias("sentence"), F.col("_g").alias("score")))
    low = F.transform(F.filter(scored, lambda x: x["score"] < threshold), lambda x: F.struct(x["sentence"].alias("sentence"), F.round(x["score"], 3).alias("score")))
    rows = rows.withColumn("ungrounded_sentences", F.coalesce(low, F.array().cast("array<struct<sentence:string,score:double>>")))
    mean = F.when(scored.isNotNull(), F.aggregate("_g", F.lit(0.0), lambda a, x: a + x) / F.size("_g"))
    some = lambda c: F.size(c) > 0
    issues = F.concat(
        F.when(some("unsupported_numbers"), F.array(F.concat(F.lit("Số không có trong tài liệu gốc: "), F.array_join("unsupported_numbers", ", ")))).otherwise(none),
        F.when(some("unsupported_units"), F.array(F.concat(F.lit("Số kèm đơn vị không có trong tài liệu gốc: "), F.array_join("unsupported_units", ", ")))).otherwise(none),
        F.transform("abbreviation_conflicts", lambda c: F.concat(F.lit("Từ viết tắt "), c["abbr"], F.lit(" bị định nghĩa khác gốc: '"), c["summary"], F.lit("' (gốc: '"), c["source"], F.lit("')"))),
        F.when(some("ungrounded_sentences"), F.array(F.concat(F.size("ungrounded_sentences").cast("string"), F.lit(" câu ít bám vào nội dung gốc (có thể là diễn đạt lại, cần đối chiếu)")))).otherwise(none),
    )
    return rows.select("doc_id", "unsupported_numbers", "unsupported_units", "abbreviation_conflicts", "ungrounded_sentences", F.size("_s").alias("n_sentences"), F.round(mean, 3).alias("grounding_mean"), F.lit(threshold).alias("threshold"), (F.size(issues) > 0).alias("needs_review"), issues.alias("issues"), *(F.col(f"_keep_{c}").alias(c) for c in keep))


def score_methods(pairs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """``evaluate``, grounding and, where a reference (doc_id, reference) is there, ROUGE; 4 decimals.

    All is worked out in the pair's own row; only the short summaries meet the references.
    """
    rows = evaluate(pairs, ("summary", "source")).withColumn("abbreviations", F.array().cast("array<struct<abbr:string,long:string>>"))
    mine = [c for c in rows.columns if c not in ("doc_id", "source", "abbreviations")]
    out = validate(rows, keep=tuple(mine)).select("doc_id", *mine, "grounding_mean", F.size("ungrounded_sentences").alias("n_ungrounded"), "needs_review")
    if references is not None:
        s, r = F.col("summary"), F.col("reference")
        rouge = {"rouge1": arrow.rouge_n(s, r, 1), "rouge2": arrow.rouge_n(s, r, 2), "rougeL": arrow.rouge_l(s, r)}
        out = out.join(references.select("doc_id", "reference", F.lit(True).alias("_there")), "doc_id", "left").withColumns(rouge)
        out = out.withColumns({c: F.when(F.col("_there"), F.col(c)["f1"]) for c in rouge}).drop("reference", "_there")
    out = out.drop("summary")
    return out.select(*(F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


def summarize_rows(scores: DataFrame) -> DataFrame:
    """Per method: n_docs, and of each measure the mean of what is defined and how often it is."""
    measures = [c for c, kind in scores.dtypes if kind == "double"]
    return scores.groupBy("method").agg(F.count_distinct("doc_id").alias("n_docs"), *(F.avg(c).alias(c) for c in measures), *(F.count(c).alias(f"{c}_n") for c in measures))


def reading_integrity(pairs: DataFrame) -> DataFrame:
    """What a reading text (summary) keeps of its source: words, terms, numbers."""
    s, src = F.col("summary"), F.col("source")
    return pairs.select("doc_id", compression(s, src).alias("word_ratio"), term_preservation(s, F.col("terms"))["rate"].alias("tpr"), number_preservation(s, src)["rate"].alias("npr"))
