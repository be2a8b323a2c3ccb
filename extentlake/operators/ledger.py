"""The payload census as a ledger: what is known of every value, and checks that a ledger closes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binding_states(bindings: DataFrame) -> DataFrame:
    """Bindings with their state: what the one unconditional slot of the source says, or why none does.

    Columns: declared (slots that begin there), conditional, crosses_allocation, crosses_element, raw_equal, slot_width, width, status, view, compatibility.
    """
    state = (
        F.when(F.col("declared") == 0, "RECORDED_BINDING_WITHOUT_SOURCE_DECLARATION")
        .when((F.col("declared") > 1) | F.col("conditional"), "CONDITIONAL_OR_AMBIGUOUS_SOURCE_SLOT")
        .when(F.col("crosses_allocation"), "SOURCE_SLOT_CROSSES_ALLOCATION")
        .when(F.col("crosses_element"), "SOURCE_SLOT_CROSSES_ELEMENT")
        .when(~F.col("raw_equal"), "SOURCE_SLOT_RAW_MISMATCH")
        .when(F.col("slot_width") != F.col("width"), "SOURCE_SLOT_WIDTH_MISMATCH")
        .when(F.col("status") == "NULL", "NULL_SOURCE_FIELD")
        .when(F.col("status") == "UNRESOLVED", "UNRESOLVED_SOURCE_FIELD")
        .when(~F.col("view").isin("EXACT_ELEMENT_START", "EXACT_BASE_SUBOBJECT_VIEW"), F.col("view"))
        .when(F.col("compatibility").isin("POINTEE_TYPE_MISMATCH", "POINTEE_TYPE_UNESTABLISHED"), F.col("compatibility"))
        .otherwise("SOURCE_DECLARED_FIELD_TARGET")
    )
    return bindings.withColumn("state", state)


def value_states(values: DataFrame) -> DataFrame:
    """Values (.., primitive_block, known_type, bounded, admitted, resolved) with the status of their decoding."""
    status = (
        F.when(F.col("primitive_block"), "NATIVE_PRIMITIVE_BLOCK_CHECKED")
        .when(~F.col("known_type"), "UNKNOWN_NATIVE_TYPE")
        .when(F.col("bounded"), "VALUE_DECODE_RESOURCE_BOUND")
        .when(~F.col("admitted"), "VALUE_DECODE_ADMISSION_UNESTABLISHED")
        .when(~F.col("resolved"), "VALUE_DECODE_UNRESOLVED")
        .otherwise("DECODED")
    )
    return values.withColumn("status", status)


def violations(ranges: DataFrame, allocations: DataFrame) -> DataFrame:
    """(check_name, allocation_id) for what keeps a ledger from closing: value ranges (allocation_id, first, last) of each allocation (id,
    element_count) begin at 0, leave no gap, don't overlap, end at its count, and belong to an allocation; each has some."""
    w = Window.partitionBy("allocation_id").orderBy("first", "last")
    swept = ranges.withColumn("_before", F.coalesce(F.lag("last").over(w), F.lit(0)))
    known = allocations.select(F.col("id").alias("allocation_id"), "element_count")
    ends = ranges.groupBy("allocation_id").agg(F.max("last").alias("_end"))
    fault = lambda df, name: df.select(F.lit(name).alias("check_name"), "allocation_id")
    met = known.join(ends, "allocation_id", "left")
    out = [
        fault(swept.where("first > _before"), "ranges.gap"),
        fault(swept.where("first < _before"), "ranges.overlap"),
        fault(swept.where("first >= last"), "ranges.empty"),
        fault(ranges.select("allocation_id").distinct().join(known, "allocation_id", "left_anti"), "ranges.allocation"),
        fault(met.where("_end IS NULL AND element_count > 0"), "ranges.missing"),
        fault(met.where("_end != element_count"), "ranges.end"),
    ]
    return reduce(DataFrame.union, out)
