"""An incremental collection of articles from an outside client.

A client has ``pages()``, ``titles(page)`` giving (label, title) pairs, and ``fetch(title)`` giving (real title, text) or
None. Its listing is a data source with a partition a page; what the collection knows is taken off by an anti join, and the
rest is fetched in tasks, as many calls at a time as partitions. Nothing here reaches a network by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.functions import arrow
from quire.functions import text as t
from quire.functions import values as v
from quire.session import checkpoint, ship
from quire.sources.readers import new_only

SCHEMA = "file string, label string, title string, real string, status string, words int, date date, text string"
OK, MISSING, SHORT, FAILED = "ok", "missing", "short", "failed"


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class Listing(DataSource):
    """(label, title) of what a client lists; a subclass names the client."""

    make_client: Callable[[], object]

    @classmethod
    def name(cls) -> str:
        return "article_listing"

    def schema(self) -> str:
        return "label string, title string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(type(self).make_client)


class ListingReader(DataSourceReader):
    def __init__(self, make_client: Callable[[], object]) -> None:
        self.make_client = make_client

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(self.make_client().pages())]

    def read(self, partition: Page) -> Iterator[tuple[str, str]]:
        yield from self.make_client().titles(partition.number)


def listing(spark: SparkSession, make_client: Callable[[], object]) -> DataFrame:
    """(file, label, title): each title of a label once, by the name of its file."""
    ship(spark)
    spark.dataSource.register(type("ClientListing", (Listing,), {"make_client": staticmethod(make_client)}))
    rows = spark.read.format(Listing.name()).load()
    file = F.concat(F.col("label"), F.lit("/wiki_"), arrow.slug(F.col("title")), F.lit(".txt"))
    return rows.withColumn("file", file).groupBy("file", "label").agg(F.min("title").alias("title"))


def fetched(todo: DataFrame, make_client: Callable[[], object], calls: int = 2) -> DataFrame:
    """``todo`` (file, label, title) with real, extract and error; ``calls`` tasks ask at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for b in batches:
            got = []
            for title in b.column("title").to_pylist():
                try:
                    got.append((*(client.fetch(title) or (None, None)), None))
                except Exception as e:  # one article's failure is its row's
                    got.append((None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([g[i] for g in got], pa.string()) for i in range(3))], [*b.schema.names, "real", "extract", "error"])

    ship(todo.sparkSession)
    return todo.select("file", "label", "title").repartition(calls).mapInArrow(run, "file string, label string, title string, real string, extract string, error string")


def collection(spark: SparkSession, root: str) -> DataFrame:
    """The articles below ``root`` and the notes of those that were missing or short; the newest row of a file."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)
    newest = rows.groupBy("file").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "file")), F.struct((F.col("status") == OK).cast("int"), "date")).alias("r"))
    return newest.select("file", "r.*").select(*rows.columns)


def fetch_new(spark: SparkSession, root: str, make_client: Callable[[], object], least_words: int = v.LEAST_WORDS, calls: int = 2, again: bool = False) -> DataFrame:
    """(label, status, n) of one run: what the client lists and ``root`` doesn't know is fetched, cleaned and added.

    Known are articles, and, unless ``again``, titles that were missing or short; failed ones are asked for every time.
    """
    known = collection(spark, root)
    known = known.where(F.col("status") == OK) if again else known
    rows = fetched(new_only(listing(spark, make_client), known, "file"), make_client, calls)
    body = arrow.article_text(F.col("extract"))
    words = F.size(t.words(F.col("body")))
    status = F.when(F.col("error").isNotNull(), FAILED).when(F.col("extract").isNull(), MISSING).when(words < least_words, SHORT).otherwise(OK)
    text = F.concat("real", F.lit(v.SOURCE_LINE), "body", F.lit("\n"))
    done = rows.withColumn("body", body).withColumn("status", status)
    done = done.select("file", "label", "title", "real", "status", F.when(F.col("extract").isNotNull(), words).alias("words"), F.current_date().alias("date"), F.when(F.col("status") == OK, text).alias("text"))
    done = checkpoint(done)  # each title is asked for once
    done.where(F.col("status") != FAILED).write.mode("append").parquet(root)
    return done.groupBy("label", "status").agg(F.count(F.lit(1)).alias("n"))


def attribution(articles: DataFrame, base: str = v.ARTICLE_BASE) -> DataFrame:
    """(file, title, url, date) of the articles, as their licence asks."""
    page = F.replace(F.url_encode(F.replace("real", F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/"))
    return articles.where(F.col("status") == OK).select("file", F.col("real").alias("title"), F.concat(F.lit(base), page).alias("url"), "date")
