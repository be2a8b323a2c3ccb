"""Scalar functions over stored values, geometry, and typed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import binary
from ..operators import decode
from .fixture import Archive
from .registry import registry

QUERIES, SQL, query = registry()


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.v') AS v FROM events")
def q34_json_extract_stride(a: Archive) -> DataFrame:
    return a.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.v").alias("v"))


@query("""SELECT l_orderkey, l_linenumber, (w >> 3) & 31 AS field, CASE WHEN (w >> 3) & 31 >= 16 THEN ((w >> 3) & 31) - 32 ELSE (w >> 3) & 31 END AS signed_field
FROM (SELECT l_orderkey, l_linenumber, l_partkey * 31 + l_suppkey AS w FROM lineitem)""")
def q35_bitfield_extract(a: Archive) -> DataFrame:
    f = binary.bit_field(F.expr("l_partkey * 31 + l_suppkey"), 3, 5)
    return a.table("lineitem").select("l_orderkey", "l_linenumber", f.alias("field"), binary.signed_bits(f, 5).alias("signed_field"))


@query("""SELECT p_partkey, CAST(list_sum(list_transform(range(21), lambda i: ((p_partkey >> i) & 1) << (3 * i))) AS BIGINT) AS code, p_partkey AS x, CAST(p_size AS BIGINT) AS y FROM part""")
def q36_morton_roundtrip(a: Archive) -> DataFrame:
    z = F.lit(0).cast("long")
    code = binary.morton_interleave(F.col("p_partkey"), F.col("p_size"), z)
    p = a.table("part").select("p_partkey", code.alias("c"), binary.morton_interleave(F.col("p_partkey"), z, z).alias("code"))
    return p.select("p_partkey", "code", binary.morton_part(F.col("c"), 0).alias("x"), binary.morton_part(F.col("c"), 1).alias("y"))


@query("""SELECT x, y, CAST(arg_max(vec_id, (z, vec_id)) AS BIGINT) AS vec_id, CAST(max(z) AS DOUBLE) AS depth FROM (SELECT vec_id, CAST(floor(embedding[1]::DOUBLE * 8) AS BIGINT) AS x, CAST(floor(embedding[2]::DOUBLE * 8) AS BIGINT) AS y, embedding[3]::DOUBLE AS z FROM embeddings) GROUP BY 1, 2""")
def q43_zbuffer_raster(a: Archive) -> DataFrame:
    e = a.table("embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")))
    return decode.raster(e, 8, 8).select("x", "y", "vec_id", "depth")


@query("""SELECT axis, count(*) AS n, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high, count(*) FILTER (NOT isfinite(v)) AS not_finite, count(*) FILTER (v = 0) AS marked
FROM (SELECT unnest(range(len(embedding))) AS axis, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY axis""")
def q44_bounds_stats(a: Archive) -> DataFrame:
    e = a.table("embeddings").select(F.posexplode("embedding").alias("axis", "v"))
    return decode.bounds(e.select(F.col("axis").cast("long").alias("axis"), F.col("v").cast("double").alias("v")), ["axis"], "v", 0.0)


@query("""SELECT id, element, CAST(x AS BIGINT) AS value, hex(part) AS raw_hex FROM (SELECT id, element, part, ascii(decode(part[1:1])) + 256 * ascii(decode(part[2:2])) + 65536 * ascii(decode(part[3:3])) + 16777216 * ascii(decode(part[4:4])) AS x
FROM (SELECT id, element, encode(substr(t, 4 * element + 1, 4)) AS part FROM (SELECT doc_id AS id, regexp_replace(text, '[^\\x01-\\x7F]', '', 'g') AS t, unnest(range(length(regexp_replace(text, '[^\\x01-\\x7F]', '', 'g')) // 4)) AS element FROM documents)))""")
def q62_typed_words(a: Archive) -> DataFrame:
    t = F.regexp_replace("text", "[^\\x01-\\x7F]", "")
    d = a.table("documents").select(F.col("doc_id").alias("id"), t.cast("binary").alias("data")).where("length(data) >= 4")
    # a text's words are cut out at once, so that no row carries the whole text
    part = F.transform(F.expr("sequence(0, length(data) div 4 - 1)"), lambda i: F.substring("data", i * 4 + 1, F.lit(4)))
    e = d.select("id", F.posexplode(part).alias("element", "part")).withColumn("element", F.col("element").cast("long"))
    return e.select("id", "element", binary.le_unsigned(F.col("part"), F.lit(0), 4).alias("value"), F.hex("part").alias("raw_hex"))


@query("""SELECT id, printf('s%d_c%d_o%x', segment, cluster, logical_offset) AS address, segment AS s, logical_offset AS o FROM alloc""")
def q63_address_text(a: Archive) -> DataFrame:
    text = binary.address_text(F.col("segment"), F.col("cluster"), F.col("logical_offset"))
    back = binary.parsed_address(F.concat_ws(":", "segment", "cluster", F.concat(F.lit("0x"), F.lower(F.hex("logical_offset")))))
    return a.alloc.select("id", text.alias("address"), back["segment"].alias("s"), back["offset"].alias("o"))


@query("""SELECT p, (p << 5) + 16 AS tags, (p << 5) + 17 AS huge, (p << 5) + 18 AS pointers, ((p & ~15) << 5) + 1 AS group_, ((p % 7) << 22) | (p * 4096 & 4194303) AS target, (p + 3) // 4 * 4 AS aligned FROM (SELECT l_partkey AS p FROM lineitem GROUP BY 1)""")
def q64_key_algebra(a: Archive) -> DataFrame:
    p = F.col("p")
    keys = [binary.metadata_key(p, k).alias(n) for k, n in (("tags", "tags"), ("huge", "huge"), ("pointers", "pointers"), ("group", "group_"))]
    return a.table("lineitem").select(F.col("l_partkey").alias("p")).distinct().select("p", *keys, binary.pointer_offset(p % 7, p * 4096).alias("target"), binary.align_up(p).alias("aligned"))


_SLOTS = "(VALUES ('T0', 'a', 0, 4), ('T0', 'b', 4, 4), ('T2', 'x', 0, 8), ('T2', 'y', 8, 4), ('T3', 'p', 0, 8), ('T4', 'q', 4, 8))"


@query(f"""SELECT e.segment, e.cluster, e.logical_offset, e.s_type AS type_name, count(s.path) AS declared, CASE WHEN count(s.path) = 0 THEN 'RECORDED_BINDING_WITHOUT_SOURCE_DECLARATION' WHEN count(s.path) > 1 THEN 'CONDITIONAL_OR_AMBIGUOUS_SOURCE_SLOT' WHEN min(s.size) <> max(e.width) THEN 'SOURCE_SLOT_WIDTH_MISMATCH'
  WHEN max(e.status) = 'NULL' THEN 'NULL_SOURCE_FIELD' WHEN max(e.status) = 'UNRESOLVED' THEN 'UNRESOLVED_SOURCE_FIELD' ELSE 'SOURCE_DECLARED_FIELD_TARGET' END AS binding
FROM edge e LEFT JOIN {_SLOTS} s(type_name, path, place, size) ON s.type_name = e.s_type AND s.place = e.displacement WHERE e.s_id IS NOT NULL GROUP BY 1, 2, 3, 4""")
def q65_declared_slots(a: Archive) -> DataFrame:
    rows = [("T0", "a", 0, 4), ("T0", "b", 4, 4), ("T2", "x", 0, 8), ("T2", "y", 8, 4), ("T3", "p", 0, 8), ("T4", "q", 4, 8)]
    slots = a.spark.createDataFrame(rows, "type_name string, path string, at long, slot_size int")
    return decode.declared_bindings(a.edge.where("s_id IS NOT NULL"), slots)


@query("""SELECT id, r.name, greatest(r.first, a.f) AS first, least(r.last, a.l) AS last FROM (SELECT id, 3 * (id % 4) AS f, size AS l FROM alloc) a JOIN (VALUES ('filler', 0, 4), ('runtime', 4, 12), ('reference', 12, 20), ('payload', 20, 1000000)) r(name, first, last) ON r.first < a.l AND a.f < r.last""")
def q66_region_overlay(a: Archive) -> DataFrame:
    regions = a.spark.createDataFrame([("filler", 0, 4), ("runtime", 4, 12), ("reference", 12, 20), ("payload", 20, 1000000)], "name string, first long, last long")
    return decode.overlay(a.alloc.selectExpr("id", "3 * (id % 4) AS f", "size AS l"), regions)


@query("""SELECT s.type_name, CASE WHEN max(s.size_) <> max(n.size_) THEN 'SOURCE_COMPACT_STORAGE_MISMATCH' WHEN bool_and(n.type_name IS NOT NULL) THEN 'STRUCTURALLY_CORROBORATED_SOURCE_LAYOUT' ELSE 'SOURCE_COMPACT_STORAGE_MISMATCH' END AS admission
FROM (VALUES ('T0', 0, 4, 'int', 8), ('T0', 4, 4, 'ptr', 8), ('T2', 0, 8, 'ptr', 12), ('T2', 8, 4, 'int', 12), ('T3', 0, 8, 'f64', 8)) s(type_name, place, size, category, size_)
LEFT JOIN (VALUES ('T0', 0, 4, 'int', 8), ('T0', 4, 4, 'ptr', 8), ('T2', 0, 8, 'ptr', 12), ('T2', 8, 4, 'f32', 12), ('T3', 0, 8, 'f64', 8)) n(type_name, place, size, category, size_) ON s.type_name = n.type_name AND s.place = n.place AND s.size = n.size AND s.category = n.category GROUP BY 1""")
def q67_schema_admission(a: Archive) -> DataFrame:
    names = "type_name string, at long, size long, category string, type_size long"
    source = a.spark.createDataFrame([("T0", 0, 4, "int", 8), ("T0", 4, 4, "ptr", 8), ("T2", 0, 8, "ptr", 12), ("T2", 8, 4, "int", 12), ("T3", 0, 8, "f64", 8)], names)
    native = a.spark.createDataFrame([("T0", 0, 4, "int", 8), ("T0", 4, 4, "ptr", 8), ("T2", 0, 8, "ptr", 12), ("T2", 8, 4, "f32", 12), ("T3", 0, 8, "f64", 8)], names)
    return decode.admitted(source, native)
