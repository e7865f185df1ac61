"""Page furniture, broken paragraphs and merged files.

Blocks are rows (doc_id, page_no, page_h, block_pos, x0, y0, x1, y1, text, block_type); page lines are rows
(doc_id, page_no, line_no, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions import values as v
from quire.session import checkpoint


def repeated(edges: DataFrame, pages: DataFrame, least: int = 3, share: float = 0.4, longest: int = 120) -> DataFrame:
    """(doc_id, sig) of signatures on enough pages. ``edges``: doc_id, page_no, sig; ``pages``: doc_id, n_pages."""
    counts = edges.where((F.col("sig") != "") & (F.length("sig") <= longest)).dropDuplicates(["doc_id", "page_no", "sig"]).groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(least), F.ceil(F.col("n_pages") * share))
    return counts.join(pages, "doc_id").where((F.col("n_pages") >= least) & (F.col("n") >= need)).select("doc_id", "sig")


def filter_furniture(blocks: DataFrame, margin: float = 0.09, least: int = 3, share: float = 0.4, pages: DataFrame | None = None) -> DataFrame:
    """Text blocks without page numbers and repeated headers and footers in the margins.

    ``pages`` (doc_id, n_pages) counts pages without blocks too; else those that have some are counted.
    """
    edge = (F.col("page_h") > 0) & ((F.col("y1") <= F.col("page_h") * margin) | (F.col("y0") >= F.col("page_h") * (1 - margin)))
    rows = blocks.withColumn("_edge", edge & (t.strip(t.filled(F.col("text"))) != "")).withColumn("_sig", t.signature(F.col("text")))
    if pages is None:
        pages = blocks.groupBy("doc_id").agg(F.count_distinct("page_no").alias("n_pages"))
    words = rows.where(F.coalesce("block_type", F.lit(0)) == 0)
    gone = repeated(words.where("_edge").select("doc_id", "page_no", F.col("_sig").alias("sig")), pages, least, share)
    kept = words.where(~(F.col("_edge") & t.is_page_number(F.col("text"))))
    kept = kept.join(gone.select("doc_id", F.col("sig").alias("_sig"), F.lit(True).alias("_edge")), ["doc_id", "_sig", "_edge"], "left_anti")
    return kept.select(blocks.columns)


def edge_lines(lines: DataFrame, n: int = 2) -> DataFrame:
    """``lines`` with edge: among the first or last ``n`` lines of their page that are not blank; sig: the line's signature."""
    full = t.strip(t.filled(F.col("text"))) != ""
    page = Window.partitionBy("doc_id", "page_no")
    up, down = (F.sum(full.cast("int")).over(page.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("line_no"), F.desc("line_no")))
    return lines.withColumn("edge", full & ((up <= n) | (down <= n))).withColumn("sig", t.signature(F.col("text")))


def strip_page_lines(lines: DataFrame, n: int = 2, least: int = 3, share: float = 0.4) -> DataFrame:
    """(doc_id, page_no, text): pages without page numbers and repeated lines at their edges.

    Lines come together as pages in one shuffle; only lines at edges are compared across pages. A line that counts as repeated
    is on a share of the pages, so a document has a few of them at most.
    """
    pages = lines.groupBy("doc_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]).alias("lines"))
    full = F.filter(F.transform("lines", lambda x, i: F.when(t.strip(t.filled(x)) != "", i)), lambda i: i.isNotNull())
    pages = pages.withColumn("full", full).withColumn("edge", F.array_distinct(F.concat(F.slice("full", 1, n), F.slice("full", F.greatest(F.size("full") - (n - 1), F.lit(1)), F.lit(n))))).drop("full")
    sigs = pages.select("doc_id", "page_no", F.explode(F.transform("edge", lambda i: t.signature(F.get("lines", i)))).alias("sig"))
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    gone = checkpoint(repeated(sigs, counted, least, share).groupBy("doc_id").agg(F.collect_set("sig").alias("gone")))
    gone = F.broadcast(gone) if gone.count() <= 100_000 else gone
    rows = pages.join(gone, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    out = lambda x, i: F.array_contains("edge", i) & (t.is_page_number(x) | F.array_contains("gone", t.signature(x)))
    return rows.select("doc_id", "page_no", t.strip(F.array_join(F.filter("lines", lambda x, i: ~out(x, i)), "\n")).alias("text"))


def ends_paragraph(text: Column) -> Column:
    return text.rlike(r"""[.:?!]['")]*$""")


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, para_pos, text): blocks (doc_id, pos, text) joined until one ends a sentence, closing quotes and brackets aside."""
    rows = blocks.select("doc_id", "pos", F.regexp_replace(t.strip(t.filled(F.col("text"))), r"(?U)\s+", " ").alias("text")).where("text <> ''")
    doc = Window.partitionBy("doc_id").orderBy("pos")
    starts = F.coalesce(F.lag(ends_paragraph(F.col("text"))).over(doc), F.lit(False)).cast("int")
    island = rows.withColumn("starts", starts).withColumn("para_pos", F.sum("starts").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), " ")
    return island.groupBy("doc_id", "para_pos").agg(text.alias("text"))


def drop_copies(files: DataFrame) -> DataFrame:
    """``files`` (batch_id, pos, name, paragraphs, ...) with digest, and without those whose paragraphs an earlier file of the batch has."""
    rows = files.withColumn("digest", F.sha1(F.array_join("paragraphs", "\n")))
    first = rows.groupBy("batch_id", "digest").agg(F.min("pos").alias("pos"))  # map-side combined: no text is shuffled for it
    return rows.join(first, ["batch_id", "digest", "pos"], "left_semi")


def merge_files(files: DataFrame, most: int = 10, headings: bool = True) -> DataFrame:
    """One document a batch of files (batch_id, pos, name, paragraphs, source_type, pages, used_ocr, warnings, error).

    Files with an error, and copies, become warnings; a batch of more than ``most`` files, or without a readable one, has an
    error of its own. With several files each one's paragraphs follow a heading line.
    """
    size = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_files"))
    fitting = files.join(size.where(F.col("n_files") <= most).select("batch_id"), "batch_id", "left_semi")  # no text of another is moved
    bad = fitting.where("error is not null").select("batch_id", "pos", F.format_string(v.MERGE_SKIPPED, "name", "error").alias("w"))
    good = fitting.where("error is null")
    kept = drop_copies(good)
    digests = good.withColumn("digest", F.sha1(F.array_join("paragraphs", "\n"))).select("batch_id", "digest", "pos", "name")
    first = digests.groupBy("batch_id", "digest").agg(F.min_by(F.struct("pos", "name"), "pos").alias("first"))
    copies = digests.join(first, ["batch_id", "digest"]).where("pos <> first.pos")
    bad = bad.union(copies.select("batch_id", "pos", F.format_string(v.MERGE_COPY, "name", "first.name")))
    problems = bad.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda r: r["w"]).alias("problems"))
    info = F.struct(F.col("name"), F.col("source_type").alias("type"), F.col("pages"), F.size("paragraphs").alias("paragraphs"), F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.length(p)).alias("chars"))
    whole = kept.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "paragraphs", "source_type", "pages", "used_ocr", "warnings", info.alias("info")))).alias("f"))
    many = F.size("f") > 1
    heads = F.transform("f", lambda x, i: F.concat(F.when(many & F.lit(headings), F.array(F.format_string(v.MERGE_HEADING, i + 1, t.stem(x["name"])))).otherwise(F.array().cast("array<string>")), x["paragraphs"]))
    warned = F.flatten(F.transform("f", lambda x: F.transform(F.coalesce(x["warnings"], F.array().cast("array<string>")), lambda w: F.when(many, F.concat(F.lit("["), x["name"], F.lit("] "), w)).otherwise(w))))
    pages = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["pages"].cast("long"), F.lit(0).cast("long")))
    none = F.array().cast("array<string>")
    out = size.join(whole, "batch_id", "left").join(problems, "batch_id", "left")
    error = F.when(F.col("n_files") > most, F.format_string(v.MERGE_MANY.format(most=most), "n_files")).when(F.col("f").isNull(), F.format_string(v.MERGE_NONE, F.array_join(F.coalesce("problems", none), " ")))
    return out.select(
        "batch_id",
        F.when(error.isNull(), F.flatten(heads)).alias("paragraphs"),
        F.when(many, F.format_string(v.MERGE_TYPE, F.size("f"))).otherwise(F.get("f", F.lit(0))["source_type"]).alias("source_type"),
        F.when(many, F.nullif(pages, F.lit(0))).otherwise(F.get("f", F.lit(0))["pages"].cast("long")).alias("pages"),
        F.coalesce(F.exists("f", lambda x: F.coalesce(x["used_ocr"], F.lit(False))), F.lit(False)).alias("used_ocr"),
        F.concat(F.coalesce(warned, none), F.coalesce("problems", none)).alias("warnings"),
        F.transform("f", lambda x: x["info"]).alias("sources"),
        error.alias("error"),
    )
