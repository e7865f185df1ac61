"""Joins of rows to facts about their keys, where one key may hold a great share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_size(rows: DataFrame, facts: DataFrame, key: str, size: str, by: str, most: int = 1000) -> DataFrame:
    """``rows`` left joined with ``facts`` (one row a key, ``size``: its number of rows) on ``key``.

    A key of more than one ``most``-th of all sizes is one of fewer than ``most`` keys: those facts are broadcast, and
    their rows are then spread over the shuffle of the others by a hash of the column ``by``. So no task gets more
    than one ``most``-th of the rows for one key. Keys are strings or bytes of one length each, so a key with a hash
    behind it is nobody's key. Rows of a null key find nothing.
    """
    columns = [c for c in facts.columns if c != key]
    total = facts.agg(F.sum(F.col(size).cast("decimal(38,0)"))).first()[0] or 0
    is_hot = F.col(size) * F.lit(most) > F.lit(total)
    hot = facts.where(is_hot).select(F.col(key).alias("_key"), F.struct(*columns).alias("_hot"))
    cold = facts.where(~is_hot).select(F.col(key).alias("_cold_key"), F.struct(*columns).alias("_cold"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    apart = F.concat(F.col(key), F.hex(F.xxhash64(by)).cast(rows.schema[key].dataType))
    spread = found.withColumn("_to", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(apart))
    both = spread.join(cold, F.col("_to") == F.col("_cold_key"), "left")
    return both.select(*rows.columns, *(F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in columns))
