"""Exact duplicates by skew-safe combining, in DataFrame functions only.

Texts are compared without white space. A task first combines its own equal texts (the partial aggregation), then the
tasks of a salt combine theirs, then the salts' winners are combined: a text with any number of copies reaches a reducer
at most once a task, and the last one at most once a salt. All three stages group by digest and whole text, so equal
digests of different texts stay apart. What goes back to the documents is the digest with its winner; a digest found to
stand for several texts takes its texts along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.hot import join_by_size
from quire.llm.runtime import checkpoint, table

#: Lengths are counted in steps of this; ids, moved to 0 and up, and the null id lie below it.
STEP = 1 << 65


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _whole(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(20,0)")


def _place() -> Column:
    """One number for (length, id): more code points are larger, then smaller ids; a null id comes last."""
    moved = F.col("id").cast("decimal(20,0)") + _whole(1 << 63)
    return F.col("chars").cast("decimal(10,0)") * _whole(STEP) - F.coalesce(moved, _whole(1 << 64))


def _id_of(place: Column) -> Column:
    moved = F.pmod(-place, _whole(STEP))
    return F.when(moved < _whole(1 << 64), (moved - _whole(1 << 63)).cast("long"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """(id, digest, keep_id, group_size, kept) for every row of ``df``.

    Texts are equal if they are identical after every character of [\\x20\\x09-\\x0D] is deleted; null is the empty text, and
    texts of white space alone equal it. The row with the most code points in its original text stays, then the one of
    the smallest id (a null id comes last). Rows that share length and id are one document: all of them are marked as
    kept or none. An empty table gives no rows; other columns are not read. ``digest`` gives bytes or strings of one length.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = source.select("id", F.length("text").alias("chars"), F.regexp_replace("text", r"[\x20\x09-\x0D]+", "").alias("norm"))
    rows = rows.select("id", "norm", digest(F.col("norm")).alias("digest"), _place().alias("place"))

    salted = rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "salt", "norm").agg(F.max("place").alias("best"), F.count(F.lit(1)).alias("group_size"))
    merged = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))
    groups = merged.groupBy("digest").agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    groups = checkpoint(groups.where("group_size > 1"))  # neither texts nor rows that are alone

    one = groups.where("texts = 1").drop("texts")
    marked = join_by_size(rows.drop("norm"), one, "digest", "group_size", "id")
    several = groups.where("texts > 1").select("digest")
    if several.limit(1).count():
        by_text = rows.join(several, "digest", "left_semi").join(merged.join(several, "digest", "left_semi"), ["digest", "norm"])
        marked = marked.join(several, "digest", "left_anti").unionByName(by_text.select(*marked.columns))
    return marked.select(
        "id", "digest", F.when(F.col("best").isNull(), F.col("id")).otherwise(_id_of(F.col("best"))).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("place") == F.col("best"), F.lit(True)).alias("kept"),
    )


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for it; ``exact_duplicates`` has the cases."""
    out = exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
