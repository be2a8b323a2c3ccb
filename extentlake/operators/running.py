"""Running sums and maxima over a group in two steps, so that no task holds a group: over buckets of the order, then within a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps of an integer order in one bucket.
EVERY = 1 << 16


def bucket_of(rows: DataFrame, column: str, every: int = EVERY) -> Column:
    """Buckets that follow the order of an integer column; one bucket for other types, whose order isn't known."""
    whole = isinstance(rows.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.floor(F.col(column) / every).cast("long") if whole else F.lit(0).cast("long")


def before(rows: DataFrame, group: list[str], order: list[str | Column], bucket: Column, value: Column, out: str, fold: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Adds the fold (sum or max) of a value over the rows before in the group; NULL for the first.

    bucket: a column that never falls along the order; NULL comes first.  A group and a bucket may be NULL.
    """
    rows = rows.withColumns({"_bucket": bucket, "_value": value})
    parts = rows.groupBy(*group, "_bucket").agg(fold("_value").alias("_part"))
    ahead = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_bucket").alias("_b"), fold("_part").over(ahead).alias("_ahead"))
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(parts, on).withColumn("_here", fold("_value").over(within))
    both = F.greatest("_ahead", "_here") if fold is F.max else F.when(F.col("_ahead").isNotNull() | F.col("_here").isNotNull(), F.coalesce("_ahead", F.lit(0)) + F.coalesce("_here", F.lit(0)))
    return met.withColumn(out, both).drop("_bucket", "_value", "_b", "_ahead", "_here", *(f"_g{i}" for i in range(len(group))))


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], bucket: Column, out: str) -> DataFrame:
    """Adds the number of rows before in the group, from 0."""
    one = before(rows, group, order, bucket, F.lit(1).cast("long"), out)
    return one.withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))
