"""The catalog, admission by cost, proofs of references, and duplicates across pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decode, discovery, links
from ..operators.graph import closure, paths
from ..sources.store import written
from .fixture import Archive
from .registry import registry

QUERIES, SQL, query = registry()


@query("""SELECT l_suppkey AS place, min(l_orderkey) AS page, count(*) AS seen, CASE WHEN count(DISTINCT (l_returnflag, l_linestatus)) > 1 THEN 'SIGNATURE_CONFLICT' ELSE 'CURRENT' END AS status FROM lineitem GROUP BY 1""")
def q81_cross_page_duplicates(a: Archive) -> DataFrame:
    """What several pages record at one place counts once, if all say the same of it."""
    return discovery.deduplicated_pages(a.table("lineitem"), ["l_suppkey"], "l_orderkey", ["l_returnflag", "l_linestatus"]).withColumnsRenamed({"l_suppkey": "place"})


@query("""SELECT type_name, CAST(sum(least(t, 1000001)) AS BIGINT) AS leaves, sum(least(t, 1000001)) <= 100000 AND sum(least(t, 1000001) * greatest(d, 1)) <= 1000000 AS admitted
FROM (SELECT p_brand AS type_name, p_size * (1 + p_partkey % 9) AS t, p_partkey % 5 AS d FROM part) GROUP BY 1""")
def q82_expansion_cost(a: Archive) -> DataFrame:
    s = a.table("part").selectExpr("p_brand AS type_name", "array(CAST(p_size AS BIGINT), 1 + p_partkey % 9) AS counts", "CAST(p_partkey % 5 AS INT) AS depth")
    return decode.expansion_cost(s).select("type_name", "leaves", "admitted")


@query("""SELECT concat(p_brand, '/', p_type, '/', p_size) AS name, p_partkey AS id FROM part WHERE concat(p_brand, '/', p_type, '/', p_size) IN (SELECT concat(p_brand, '/', p_type, '/', p_size) FROM part GROUP BY 1 HAVING count(*) = 1)""")
def q83_unambiguous_names(a: Archive) -> DataFrame:
    return discovery.unambiguous(a.table("part").selectExpr("concat(p_brand, '/', p_type, '/', p_size) AS name", "p_partkey AS id"), "name")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'triangles' WHEN s_suppkey % 4 = 1 THEN 'lines' ELSE 'unsupported_shape_type' END AS render_class,
  CASE WHEN s_nationkey < 20 THEN 'root/g' || s_nationkey END AS path, CASE WHEN s_suppkey % 10 = 0 THEN 'NO_SHAPE' WHEN s_nationkey >= 20 THEN 'GROUP_NOT_FOUND' ELSE 'CATALOGUED' END AS diagnostic FROM supplier""")
def q84_catalog(a: Archive) -> DataFrame:
    spark, s = a.spark, a.table("supplier")
    inherits = spark.createDataFrame([("Mesh", "TriSurface"), ("Track", "LineString"), ("Other", "Shape")], "t string, b string")
    shapes = s.selectExpr("s_suppkey AS id", "CASE s_suppkey % 4 WHEN 0 THEN 'Mesh' WHEN 1 THEN 'Track' ELSE 'Other' END AS type_name")
    ents = s.selectExpr("s_suppkey AS id", "s_name AS name", "CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey END AS shape_id", "concat('g', s_nationkey) AS group_id")
    groups = a.table("nation").where("n_nationkey < 20").selectExpr("concat('g', n_nationkey) AS child", "'root' AS parent").union(spark.createDataFrame([("root", None)], "child string, parent string"))
    tree = paths(groups.withColumn("label", F.col("child")), "child", "parent", "label", written)
    return discovery.catalog(ents, shapes, closure(inherits, "t", "b", written), tree).select("id", "render_class", "path", "diagnostic")


@query("""SELECT segment, cluster, logical_offset AS offset, CASE WHEN logical_offset % 7 = 0 THEN 'BINDING_NOT_RECORDED' WHEN width <> 4 THEN 'SOURCE_SLOT_WIDTH_MISMATCH' WHEN logical_offset % 5 = 0 THEN 'SOURCE_SLOT_RAW_MISMATCH' WHEN status = 'NULL' THEN 'NULL_SOURCE_FIELD' WHEN status = 'UNRESOLVED' THEN 'UNRESOLVED_SOURCE_FIELD' ELSE 'PROVEN' END AS reference FROM ptr""")
def q85_reference_proofs(a: Archive) -> DataFrame:
    slots = a.ptr.selectExpr("segment", "cluster", "logical_offset AS offset", "4 AS width", "encode(CASE WHEN logical_offset % 5 = 0 THEN 'zzzz' ELSE 'abcd' END, 'UTF-8') AS raw")
    recorded = a.ptr.where("logical_offset % 7 != 0").withColumn("raw", F.encode(F.lit("abcd"), "UTF-8"))
    return links.proven(slots, recorded).select("segment", "cluster", "offset", "reference")


@query("""SELECT p_partkey AS external_index, CAST(p_size AS BIGINT) AS x, CAST(p_partkey % 50 AS BIGINT) AS y, CASE WHEN p_partkey % 9 = 0 THEN 'INDEX_MAP_CONFLICT' ELSE 'DECODED' END AS status FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT NULL, CAST(p_size AS BIGINT), CAST(p_partkey % 50 AS BIGINT), 'UNMAPPED' FROM part WHERE p_partkey % 4 = 0""")
def q86_packed_points(a: Archive) -> DataFrame:
    from ..functions.binary import morton_interleave

    p = a.table("part")
    points = p.select((F.col("p_partkey") * 3).alias("internal_index"), morton_interleave(F.col("p_size"), F.col("p_partkey") % 50, F.lit(1)).alias("code"))
    once = p.where("p_partkey % 4 != 0").selectExpr("p_partkey * 3 AS internal_index", "p_partkey AS external_index")
    again = p.where("p_partkey % 4 != 0 AND p_partkey % 9 = 0").selectExpr("p_partkey * 3 AS internal_index", "p_partkey + 1 AS external_index")
    return decode.packed_points(points, once.union(again)).select("external_index", "x", "y", "status")


@query("""SELECT storage, count(*) AS n FROM (SELECT CASE WHEN p_type LIKE '%A%' THEN 'ARRAY_ALLOCATION' WHEN p_size > 40 THEN 'SOURCE_DECLARED_STRUCTURAL_RECORD' ELSE 'NATIVE_OR_UNKNOWN_STORAGE' END AS storage FROM part) GROUP BY 1""")
def q87_storage_classes(a: Archive) -> DataFrame:
    t = a.table("part").selectExpr("p_brand AS target_type", "false AS admitted", "true AS collection", "true AS entity", "p_type LIKE '%A%' AS vector", "p_size > 40 AS class_")
    return links.storage_class(t).groupBy("storage").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, quality, sha256(text) AS digest FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL""")
def q88_documents_with_blobs(a: Archive) -> DataFrame:
    d = a.table("documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.join(a.table("labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", "digest")
