"""Checks of an archive's tables: each gives rows (check_name, key) for what is wrong, none for a sound archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CODECS, KEYS, NODE_TYPES, POINTER_STATUS
from .intervals import with_previous_end

SPACE = ["segment", "cluster"]


def _fault(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return rows.select(F.lit(name).alias("check_name"), F.concat_ws(":", *(F.col(k).cast("string") for k in keys)).alias("key"))


def _row_faults(rows: DataFrame, keys: list[str], wrong: dict[str, Column]) -> DataFrame:
    """The faults that a row shows by itself, all in one pass: by name, when each is there; unknown counts as there."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in wrong.items())))
    return rows.select(F.explode(names).alias("check_name"), F.concat_ws(":", *(F.col(k).cast("string") for k in keys)).alias("key"))


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """All faults of a set of tables (see model.TABLES)."""
    out = []
    for name, keys in KEYS.items():
        if name in t:
            out.append(_fault(t[name].groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), f"{name}.unique", keys))
    clusters = t["clusters"].select(*SPACE, "allocated_bytes")
    for name, start, size, key in (("allocations", "logical_offset", "size", ["id"]), ("extents", "logical_start", "length", ["id"]), ("chunks", "logical_start", "length", [*SPACE, "logical_start"])):
        # one pass and one window: against the interval before, and against the cluster
        swept = with_previous_end(t[name], start, size).join(clusters, SPACE, "left")
        wrong = {
            f"{name}.positive": (F.col(size) <= 0) | (F.col(start) < 0),
            f"{name}.disjoint": F.coalesce(F.col(start) < F.col("previous_end"), F.lit(False)),
            f"{name}.within_cluster": F.col(start) + F.col(size) > F.col("allocated_bytes"),
        }
        if name == "chunks":
            wrong["chunks.gapless"] = F.col(start) != F.coalesce("previous_end", F.lit(0))
        out.append(_row_faults(swept, key, wrong))
    p = t["pointers"]
    aimed = F.col("target_segment").isNotNull() & F.col("target_cluster").isNotNull() & F.col("target_offset").isNotNull()
    none = F.col("target_segment").isNull() & F.col("target_cluster").isNull() & F.col("target_offset").isNull()
    ok = {"pointers.target": F.when(F.col("status") == "RESOLVED", aimed).otherwise(none), "pointers.status": F.col("status").isin(*POINTER_STATUS), "pointers.raw": F.col("width").isin(4, 8) & (F.octet_length("raw") == F.col("width"))}
    out.append(_row_faults(p, KEYS["pointers"], {n: ~c for n, c in ok.items()}))
    blobs = t["blobs"]
    out.append(_row_faults(blobs, ["sha256"], {"blobs.codec": ~(F.col("codec").isin(*CODECS) & (F.col("raw_length") >= 0)), "blobs.digest": F.coalesce((F.col("codec") == "raw") & (F.sha2("data", 256) != F.col("sha256")), F.lit(False))}))
    known = blobs.select(F.col("sha256").alias("blob_sha256"))
    out.append(_fault(t["chunks"].join(known, "blob_sha256", "left_anti"), "chunks.blob", [*SPACE, "logical_start"]))
    out.append(_fault(t["documents"].join(known, "blob_sha256", "left_anti"), "documents.blob", KEYS["documents"]))
    out.append(_fault(t["allocations"].join(t["names"].select(F.col("id").alias("name_id")), "name_id", "left_anti"), "allocations.name", ["id"]))
    out += tree_violations(t["document_nodes"])
    return reduce(DataFrame.union, out)


def tree_violations(nodes: DataFrame) -> list[DataFrame]:
    """Of a document's index: unknown kinds, nodes without a parent, wrong counts of children, and sequences whose members aren't 0, 1, 2.."""
    key = ["kind", "name", "path"]
    up = nodes.select("kind", "name", F.col("path").alias("parent"), F.col("node_type").alias("parent_type"))
    child = nodes.where(F.col("parent").isNotNull())
    met = child.join(up, ["kind", "name", "parent"], "left")
    orphans = met.where(F.col("parent_type").isNull() | (F.col("parent_type") == "leaf"))
    n = child.groupBy("kind", "name", F.col("parent").alias("path")).agg(F.count("*").alias("_children"))
    counts = nodes.join(n, key, "left").where(F.coalesce("_children", F.lit(0)) != F.coalesce("child_count", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("kind", "name", "parent").orderBy("ordinal")) - 1
    order = met.withColumn("_place", place).where((F.col("ordinal") != F.col("_place")) | ((F.col("parent_type") == "sequence") & ~F.col("member").eqNullSafe(F.col("ordinal").cast("string"))))
    return [
        _fault(nodes.where(~F.coalesce(F.col("node_type").isin(*NODE_TYPES), F.lit(False))), "document_nodes.type", key),
        _fault(orphans, "document_nodes.parent", key),
        _fault(counts, "document_nodes.children", key),
        _fault(order, "document_nodes.order", key),
    ]


def bytes_differ(pointers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pointers whose recorded bytes aren't those at their address: a check of its own, apart from the archive's."""
    from .intervals import logical_read

    r = pointers.withColumn("request_id", F.concat_ws(":", *SPACE, "logical_offset")).select("request_id", *SPACE, F.col("logical_offset").alias("offset"), F.col("width").cast("long").alias("size"), "raw")
    got = logical_read(r.drop("raw"), chunks).select("request_id", "data", F.col("status").alias("read"))
    return r.join(got, "request_id").where((F.col("read") != "READ") | (F.col("data") != F.col("raw"))).select(F.lit("pointers.bytes").alias("check_name"), F.col("request_id").alias("key"))


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a digest of a table that doesn't depend on order or tasks.

    Row digests are added up by their 32-bit parts, so nothing is gathered or sorted; equal tables have equal digests.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    h = F.sha2(text, 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(8)]
    g = rows.agg(F.count("*").alias("rows"), *parts)
    return g.select("rows", F.sha2(F.concat_ws(",", *(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(8))), 256).alias("digest"))
