"""The three ways through the engine: summary, full reading, batch benchmark. Frames of documents in, frames of results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import arrow
from quire.functions import text as t
from quire.functions import values as v
from quire.operators import domain, measures, models

QUICK, DETAIL = 4, 10
MOST_MODEL_BLOCKS = 25


def normalized(files: DataFrame, drop_page_numbers: bool = False) -> DataFrame:
    """(doc_id, paragraphs): normalised paragraphs that aren't blank, row by row. ``files``: doc_id, paragraphs."""
    squeezed = files.select("doc_id", F.filter(arrow.normalize_all(F.col("paragraphs")), lambda p: p != "").alias("paragraphs")).where(F.size("paragraphs") > 0)
    return squeezed.withColumn("paragraphs", t.drop_page_numbers(F.col("paragraphs"))) if drop_page_numbers else squeezed


def analyze(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """``docs(doc_id, text, paragraphs)`` with terms, raw_terms, abbreviations, formulas, units and undefined abbreviations."""
    x = F.col("text")
    rows = docs.withColumn("raw_terms", t.terminology(x))
    # One step, so that one worker a task has all kernels.
    rows = rows.withColumns({"terms": domain.all_terms(F.col("raw_terms"), x, lex), "abbreviations": arrow.abbreviations(x), "formulas": arrow.formulas(F.col("paragraphs"))})
    rows = rows.withColumn("units", t.units(x))
    return rows.withColumn("undefined_abbreviations", t.undefined_abbreviations(x, F.transform("abbreviations", lambda p: p["abbr"])))


def summarize(files: DataFrame, lex: DataFrame, make_call: Callable[[], models.Caller] | None = None, detail: str = "quick", prompts: models.Prompts = models.Prompts()) -> DataFrame:
    """Summary mode: per document its analysis, two extractive summaries, a model's summary and its plan, and the report on it."""
    docs = normalized(files).withColumn("text", F.array_join("paragraphs", " "))
    n = QUICK if detail == "quick" else DETAIL
    rows = analyze(docs, lex)
    rows = rows.withColumns({"_both": arrow.summaries(F.col("text"), n, F.col("terms")), "_scores": domain.scores_in(F.col("text"), lex)})
    name, confidence = domain.best_of(F.col("_scores"), F.col("text"))
    rows = rows.withColumns({"baseline": F.col("_both")["plain"], "baseline_terms": F.col("_both")["terms"], "domain": name, "confidence": confidence}).drop("_scores", "_both")
    rows = rows.withColumn("guide", t.glossary_guide(F.col("terms"), F.col("abbreviations"), F.col("formulas")))
    if make_call is None:
        rows = rows.withColumn("summary", F.col("baseline_terms")).withColumn("plan", F.lit(None).cast("string"))
    else:
        asked = rows.select(F.col("doc_id"), F.to_json(F.struct("text", "guide")).alias("text"))

        def work(call: models.Caller, packed: str) -> tuple[str | None, dict]:
            import json

            got = json.loads(packed)
            return models.map_reduce(call.guided(got.get("guide", "")), got.get("text"), detail, prompts)

        made = models.on_documents(asked, make_call, work).select("doc_id", F.col("result").alias("summary"), F.col("report").alias("plan"))
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("string")).join(made, "doc_id")
    rows = rows.drop("guide", "paragraphs")
    mine = tuple(c for c in rows.columns if c != "doc_id")
    report = measures.validate(rows.withColumn("source", F.col("text")), keep=mine)
    found = [F.col(c) for c in report.columns[: -len(mine)] if c != "doc_id"]
    good = ~F.coalesce("summary", F.lit("")).startswith(v.ERROR_PREFIX)
    return report.select("doc_id", *mine, F.when(good, F.struct(*found)).alias("validation"))


def read_aloud(files: DataFrame, lex: DataFrame, make_call: Callable[[], models.Caller] | None = None, size: int = 6000, prompts: models.Prompts = models.Prompts()) -> DataFrame:
    """Full reading: whole texts without page numbers, copied by a model part by part where they have few enough parts, else by rule."""
    docs = normalized(files, True).withColumn("text", t.strip(F.array_join("paragraphs", "\n\n")))
    rows = analyze(docs.where("text <> ''"), lex).withColumn("n_blocks", F.size(arrow.paragraph_chunks(F.col("paragraphs"), size)))
    rule = rows.withColumn("reading", t.clean_for_speech(F.col("text"))).withColumn("report", F.lit(None).cast("string"))
    if make_call is None:
        return rule.drop("paragraphs")
    few = F.col("n_blocks") <= MOST_MODEL_BLOCKS
    made = models.on_documents(rows.where(few), make_call, lambda call, x: models.reading_text(call, x, prompts, size))
    failed = (F.get_json_object("report", "$.ai").cast("int") + F.get_json_object("report", "$.dropped").cast("int") == 0) & F.get_json_object("report", "$.errors[0]").isNotNull()
    made = made.select("doc_id", F.when(failed, F.concat(F.lit(v.ERROR_PREFIX + ": "), F.get_json_object("report", "$.errors[0]"))).otherwise(F.col("result")).alias("reading"), "report")
    by_model = rows.where(few).withColumn("doc_id", F.col("doc_id").cast("string")).join(made, "doc_id")
    return by_model.unionByName(rule.where(~few).withColumn("doc_id", F.col("doc_id").cast("string"))).drop("paragraphs")


def benchmark(cases: DataFrame, lex: DataFrame, n: int = 3, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of the plain and the term-boosted extractive method, and of further summaries (doc_id, method, summary).

    ``cases``: stem, paragraphs, reference or null.
    """
    docs = normalized(cases.select(F.col("stem").alias("doc_id"), "paragraphs")).withColumn("text", F.array_join("paragraphs", " "))
    rows = analyze(docs, lex)
    made = rows.withColumn("_both", arrow.summaries(F.col("text"), n, F.col("terms")))
    both = F.create_map(F.lit("TextRank"), F.col("_both")["plain"], F.lit("TextRank + terms"), F.col("_both")["terms"])
    methods = made.select("doc_id", F.col("text").alias("source"), "terms", "formulas", F.explode(both).alias("method", "summary"))
    if extra is not None:
        given = extra.select("doc_id", "method", F.array_join(F.slice(t.sentences(F.col("summary")), 1, n), " ").alias("summary"))
        methods = methods.unionByName(rows.select("doc_id", F.col("text").alias("source"), "terms", "formulas").join(given, "doc_id"))
    scores = measures.score_methods(methods, cases.where("reference is not null").select(F.col("stem").alias("doc_id"), "reference"))
    return scores, measures.summarize_rows(scores)
