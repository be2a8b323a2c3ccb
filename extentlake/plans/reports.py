"""Verification, digests and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decode, verify
from .fixture import Archive
from .registry import registry

QUERIES, SQL, query = registry()


@query("""SELECT count(*) AS rows, sha256(concat_ws(',', """ + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS HUGEINT)) AS VARCHAR)" for i in range(8)) + """)) AS digest
FROM (SELECT sha256(concat_ws(chr(31), CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, CAST(p_size AS VARCHAR))) AS h FROM part)""")
def q42_table_digest(a: Archive) -> DataFrame:
    return verify.table_digest(a.table("part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


@query()
def q75_row_proof(a: Archive) -> DataFrame:
    """The running digest over the framed rows of nation in order."""
    return decode.framed(a.table("nation"), ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])


@query("""SELECT 'allocations.disjoint' AS check_name, CAST(id AS VARCHAR) AS key FROM (SELECT id, logical_offset, max(logical_offset + size) OVER (PARTITION BY segment, cluster ORDER BY logical_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (SELECT id, segment, cluster, size, logical_offset - 20 * (CASE WHEN id % 50 = 49 THEN 1 ELSE 0 END) AS logical_offset FROM alloc)) WHERE logical_offset < e
UNION ALL SELECT 'allocations.positive', CAST(id AS VARCHAR) FROM alloc WHERE logical_offset - 20 * (CASE WHEN id % 50 = 49 THEN 1 ELSE 0 END) < 0
UNION ALL SELECT 'pointers.target', concat(segment, ':', cluster, ':', logical_offset) FROM ptr WHERE status = 'RESOLVED' AND width = 8 AND logical_offset % 101 = 0
UNION ALL SELECT 'allocations.name', CAST(id AS VARCHAR) FROM alloc WHERE type_name = 'T6'""")
def q76_verification(a: Archive) -> DataFrame:
    """The archive with some rows broken: allocations moved back, targets removed, a name missing."""
    from ..model import TABLES

    spark = a.spark
    names = spark.createDataFrame([(i, f"T{i}") for i in range(6)], "id long, name string")
    alloc = a.alloc.selectExpr("id", "segment", "cluster", "logical_offset - 20 * (CASE WHEN id % 50 = 49 THEN 1 ELSE 0 END) AS logical_offset", "size", "CAST(substring(type_name, 2, 9) AS BIGINT) AS name_id")
    gone = F.expr("status = 'RESOLVED' AND width = 8 AND logical_offset % 101 = 0")
    ptr = a.ptr.withColumn("target_offset", F.when(~gone, F.col("target_offset"))).withColumn("raw", F.unhex(F.repeat(F.lit("00"), F.col("width"))))
    tables = {n: spark.createDataFrame([], s) for n, s in TABLES.items() if n != "manifest"}
    tables |= {"clusters": a.clus, "allocations": alloc, "pointers": ptr, "names": names}
    return verify.violations(tables)


@query("""SELECT count(*) AS pointers, count(*) FILTER (s_id IS NULL) AS source_bindings_without_allocation, count(*) FILTER (status = 'RESOLVED' AND t_id IS NULL) AS resolved_targets_without_allocation, count(DISTINCT s_id) AS sources, count(DISTINCT t_id) AS targets FROM edge""")
def q77_graph_accounting(a: Archive) -> DataFrame:
    return a.edge.agg(
        F.count("*").alias("pointers"), F.count_if(F.col("s_id").isNull()).alias("source_bindings_without_allocation"), F.count_if((F.col("status") == "RESOLVED") & F.col("t_id").isNull()).alias("resolved_targets_without_allocation"),
        F.count_distinct("s_id").alias("sources"), F.count_distinct("t_id").alias("targets"),
    )


@query("""SELECT type_name, CASE WHEN type_name = 'T0' THEN 'ENTITY_DATASET' WHEN vector = 1 AND type_name NOT IN ('T2', 'T3') THEN 'ARRAY_METADATA_ONLY' WHEN element_count > 400 THEN 'SCHEMA_INSPECTION_BOUND' WHEN type_name IN ('T2', 'T3') THEN 'DATASET_CANDIDATE' ELSE 'CURRENT_OBJECT' END AS classification, count(*) AS n FROM alloc GROUP BY 1, 2""")
def q78_object_classes(a: Archive) -> DataFrame:
    from ..operators import discovery

    o = a.alloc.selectExpr("type_name", "type_name = 'T0' AS entity", "type_name IN ('T0', 'T2', 'T3') AS admitted", "vector = 1 AS is_vector", "element_count > 400 AS bounded", "false AS partial", "type_name IN ('T2', 'T3') AS reasons")
    return discovery.classified(o).groupBy("type_name", "classification").agg(F.count("*").alias("n"))


@query("""SELECT r.name, e.id, e.type_name FROM (SELECT p_name AS name, 1 + p_partkey % 4 AS segment, 1 + p_partkey % 3 AS cluster, p_partkey * 37 AS offset FROM part) r ASOF LEFT JOIN alloc e ON e.segment = r.segment AND e.cluster = r.cluster AND e.logical_offset <= r.offset WHERE r.offset < e.logical_offset + e.size""")
def q79_root_bindings(a: Archive) -> DataFrame:
    from ..operators import discovery

    roots = a.table("part").selectExpr("p_name AS name", "1 + p_partkey % 4 AS segment", "1 + p_partkey % 3 AS cluster", "p_partkey * 37 AS offset")
    return discovery.bound_roots(roots, a.alloc).where("id IS NOT NULL").select("name", "id", "type_name")


@query("""SELECT status, count(*) AS ranges, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
  SELECT 'NATIVE_PRIMITIVE_BLOCK_CHECKED' AS status, size AS bytes FROM alloc WHERE vector = 1 UNION ALL SELECT 'RAW_LOGICAL_BYTES_VERIFIED', size FROM alloc WHERE vector = 0
  UNION ALL SELECT 'RAW_UNINDEXED', last - first FROM (SELECT segment, cluster, logical_offset AS last, CAST(coalesce(max(logical_offset + size) OVER (PARTITION BY segment, cluster ORDER BY logical_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
  FROM (SELECT segment, cluster, logical_offset, size FROM alloc UNION ALL SELECT segment, cluster, allocated_bytes, 0 FROM clus)) WHERE first < last) GROUP BY 1""")
def q80_payload_census(a: Archive) -> DataFrame:
    from ..operators import discovery

    return discovery.payload_census(a.alloc, a.clus)
