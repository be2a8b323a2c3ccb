"""Pages: by key, by offset, and by a budget of bytes and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import before, bucket_of


def after(rows: DataFrame, keys: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The next rows in key order, strictly after the cursor (a tuple compared from the left)."""
    if cursor is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*(F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, cursor, strict=True))))
    return rows.orderBy(*keys).limit(limit)


def offset_page(rows: DataFrame, order: list[str], skip: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)


def within(rows: DataFrame, limit: int) -> DataFrame:
    """The rows, or an error where there are more than a report may have; never fewer."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"RESOURCE_LIMIT: more than {limit} rows")
    return rows


def packed(rows: DataFrame, group: list[str], order: list[str], size: str, page_bytes: int) -> DataFrame:
    """Rows with page: a row lies on the page on which its first byte falls, so pages follow from a running sum."""
    summed = before(rows, group, order, bucket_of(rows, order[0]), F.col(size), "_ahead_bytes")
    return summed.withColumn("page", F.floor(F.coalesce("_ahead_bytes", F.lit(0)) / page_bytes).cast("long")).drop("_ahead_bytes")


def bounded_column(rows: DataFrame, column: str, most: int) -> DataFrame:
    """A column's value only where it is within the policy, and its state."""
    ok = F.octet_length(column) <= most
    return rows.withColumn(f"{column}_state", F.when(F.col(column).isNull(), "NULL").when(ok, "READ").otherwise("RESOURCE_BOUND")).withColumn(column, F.when(ok, F.col(column)))


#: Parts of an allocation's text in order.
PHASES = ("ALLOCATION", "HEADER", "ELEMENT", "RAW_ELEMENT", "PADDING", "TRAILER")


def phases(alloc: DataFrame, typed: str) -> DataFrame:
    """(id, phase, element, offset, bytes) of allocations (id, size, vector, element_size, element_stride, element_count, array_header_size).

    A record for the metadata, the header, each element (raw where `typed` doesn't hold), the padding after each but the last, and the
    trailer; their bytes add up to the allocation's.
    """
    a = alloc.withColumn("_body", F.expr("array_header_size + element_count * element_size + greatest(element_count - 1, 0) * (element_stride - element_size)"))
    one = lambda phase, element, offset, size: F.struct(F.lit(phase).alias("phase"), element.cast("long").alias("element"), offset.cast("long").alias("offset"), size.cast("long").alias("bytes"))
    none, zero = F.lit(None).cast("long"), F.lit(0)
    places = F.when(F.col("element_count") > 0, F.sequence(zero.cast("long"), F.col("element_count") - 1)).otherwise(F.array().cast("array<bigint>"))
    at = lambda i: F.col("array_header_size") + i * F.col("element_stride")
    element = F.transform(places, lambda i: F.when(F.expr(typed), one("ELEMENT", i, at(i), F.col("element_size"))).otherwise(one("RAW_ELEMENT", i, at(i), F.col("element_size"))))
    padding = F.transform(places, lambda i: F.when((i < F.col("element_count") - 1) & (F.col("element_stride") > F.col("element_size")), one("PADDING", i, at(i) + F.col("element_size"), F.col("element_stride") - F.col("element_size"))))
    ends = F.array(one("ALLOCATION", none, zero, zero), F.when(F.col("array_header_size") > 0, one("HEADER", none, zero, F.col("array_header_size"))), F.when(F.col("size") > F.col("_body"), one("TRAILER", none, F.col("_body"), F.col("size") - F.col("_body"))))
    return a.select("id", F.explode(F.array_compact(F.concat(ends, element, padding))).alias("r")).select("id", "r.*")
