"""Declared links between payloads: the proof of each reference, the walk along them, and what roots reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import reachable


def proven(slots: DataFrame, pointers: DataFrame) -> DataFrame:
    """Slots (.., segment, cluster, offset, width, raw as read) with the state of their reference.

    A reference is proven when a binding lies at the slot's address and its width and bytes are those of the slot.
    """
    p = pointers.select("segment", "cluster", F.col("logical_offset").alias("offset"), F.col("width").alias("p_width"), F.col("raw").alias("p_raw"), F.col("status").alias("p_status"), "target_segment", "target_cluster", "target_offset")
    j = slots.join(p, ["segment", "cluster", "offset"], "left")
    state = (
        F.when(F.col("p_status").isNull(), "BINDING_NOT_RECORDED")
        .when(F.col("p_width") != F.col("width"), "SOURCE_SLOT_WIDTH_MISMATCH")
        .when(F.col("p_raw") != F.col("raw"), "SOURCE_SLOT_RAW_MISMATCH")
        .when(F.col("p_status") == "NULL", "NULL_SOURCE_FIELD")
        .when(F.col("p_status") == "UNRESOLVED", "UNRESOLVED_SOURCE_FIELD")
        .otherwise("PROVEN")
    )
    return j.withColumn("reference", state).drop("p_width", "p_raw", "p_status")


def accepted(links: DataFrame) -> DataFrame:
    """Links that are proven, aim at a canonical view, and whose declared type fits."""
    canonical = F.col("view").isin("EXACT_ELEMENT_START", "EXACT_BASE_SUBOBJECT_VIEW")
    return links.where((F.col("reference") == "PROVEN") & canonical & ~F.col("compatibility").isin("POINTEE_TYPE_MISMATCH", "POINTEE_TYPE_UNESTABLISHED"))


def storage_class(targets: DataFrame) -> DataFrame:
    """What a link leads to; entities and collections end a walk."""
    c = (
        F.when(F.col("target_type") == "char", "TEXT_STORAGE")
        .when(F.col("admitted") & F.col("collection"), "COLLECTION_MEMBERSHIP_REQUIRES_ADAPTER")
        .when(F.col("admitted") & F.col("entity"), "OTHER_ENTITY")
        .when(F.col("vector"), "ARRAY_ALLOCATION")
        .when(F.col("class_"), "SOURCE_DECLARED_STRUCTURAL_RECORD")
        .otherwise("NATIVE_OR_UNKNOWN_STORAGE")
    )
    return targets.withColumn("storage", c)


def payload(links: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth, status) that seeds reach over links (source, target, storage), not beyond what ends a walk.

    The walk goes to its end; where a depth ends it, nodes with links that go on are RESOURCE_BOUND.
    """
    from ..sources.store import written

    ends = links.where(F.col("storage").isin("OTHER_ENTITY", "COLLECTION_MEMBERSHIP_REQUIRES_ADAPTER")).select(F.col("target").alias("end")).distinct()
    through = links.join(ends, links["source"] == ends["end"], "left_anti")
    first = links.join(seeds.select(F.col("node").alias("source")), "source", "left_semi")
    steps = through.select("source", "target").union(first.select("source", "target"))
    found = reachable(steps, seeds, depth, written)
    onward = steps.join(found.select(F.col("node").alias("target")), "target", "left_anti").select(F.col("source").alias("node"), F.lit("RESOURCE_BOUND").alias("status")).distinct()
    return found.join(onward, "node", "left").withColumn("status", F.coalesce("status", F.lit("REACHED")))
