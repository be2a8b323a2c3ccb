"""Layouts as rows, ledgers, phases, pages of objects, owners, and bounded texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import binary
from ..operators import census, discovery, intervals, ledger, paging, schema
from ..sources.store import written
from .fixture import Archive
from .registry import registry

QUERIES, SQL, query = registry()

_MEMBERS = """SELECT 'N' || s_nationkey AS type_name, 's' || s_suppkey AS member, 8 * (s_suppkey % 16) AS off, ['pointer', 'int', 'f32'][1 + s_suppkey % 3] AS kind, CASE s_suppkey % 3 WHEN 0 THEN 8 ELSE 4 END AS size, 'R0' AS target,
  CASE WHEN s_suppkey % 5 = 0 THEN 3 END AS n, CASE WHEN s_suppkey % 5 = 0 THEN 128 END AS stride FROM supplier
UNION ALL SELECT 'N' || n_nationkey, NULL, 1024, 'base', 64, 'R' || n_regionkey, NULL, NULL FROM nation
UNION ALL SELECT 'R' || r_regionkey, 'a', 0, 'int', 4, NULL, NULL, NULL FROM region UNION ALL SELECT 'R' || r_regionkey, 'u', 8, 'union', 8, 'U', NULL, NULL FROM region
UNION ALL SELECT 'U', 'x', 0, 'int', 4, NULL, NULL, NULL UNION ALL SELECT 'U', 'y', 0, 'f32', 4, NULL, NULL, NULL"""
_LEAVES = f"""SELECT type_name, path, off, kind, size, target, n, stride, cond FROM (WITH RECURSIVE m AS ({_MEMBERS}), s AS (
  SELECT type_name, CASE WHEN kind = 'base' THEN '::<' || target || '>' ELSE member END AS path, CAST(off AS BIGINT) AS off, kind, CAST(size AS BIGINT) AS size, target, n, stride, kind = 'union' AS cond FROM m
  UNION ALL SELECT s.type_name, s.path || '.' || CASE WHEN m.kind = 'base' THEN '::<' || m.target || '>' ELSE m.member END, s.off + m.off, m.kind, m.size, m.target, m.n, m.stride, s.cond OR m.kind = 'union'
  FROM s JOIN m ON m.type_name = s.target WHERE s.kind IN ('base', 'class', 'union')) SELECT * FROM s WHERE kind NOT IN ('base', 'class', 'union'))"""


def _members(a: Archive) -> DataFrame:
    """Nations as classes: their suppliers are members, their region a base with a union."""
    names = "type_name string, member string, offset long, kind string, size long, target string, count long, stride long"
    s = a.table("supplier").selectExpr(
        "concat('N', s_nationkey) AS type_name", "concat('s', s_suppkey) AS member", "8 * (s_suppkey % 16) AS offset", "element_at(array('pointer', 'int', 'f32'), CAST(1 + s_suppkey % 3 AS INT)) AS kind",
        "CASE s_suppkey % 3 WHEN 0 THEN 8L ELSE 4L END AS size", "'R0' AS target", "CASE WHEN s_suppkey % 5 = 0 THEN 3L END AS count", "CASE WHEN s_suppkey % 5 = 0 THEN 128L END AS stride",
    )
    none = "CAST(NULL AS BIGINT)"
    n = a.table("nation").selectExpr("concat('N', n_nationkey)", "CAST(NULL AS STRING)", "1024L", "'base'", "64L", "concat('R', n_regionkey)", none, none)
    r = a.table("region")
    low = r.selectExpr("concat('R', r_regionkey)", "'a'", "0L", "'int'", "4L", "CAST(NULL AS STRING)", none, none)
    union = r.selectExpr("concat('R', r_regionkey)", "'u'", "8L", "'union'", "8L", "'U'", none, none)
    return s.union(n).union(low).union(union).union(a.spark.createDataFrame([("U", "x", 0, "int", 4, None, None, None), ("U", "y", 0, "f32", 4, None, None, None)], names))


@query(f"SELECT type_name, path, off AS offset, kind, size, CAST(coalesce(n, 1) AS BIGINT) AS elements, cond AS conditional_union FROM ({_LEAVES})")
def q89_layout_slots(a: Archive) -> DataFrame:
    s = schema.slots(_members(a), written)
    elements = F.aggregate("arrays", F.lit(1).cast("long"), lambda x, y: x * y["count"])
    return s.select("type_name", "path", "offset", "kind", "size", elements.alias("elements"), "conditional_union")


@query(f"""SELECT p_partkey, path, CASE WHEN path IS NOT NULL THEN coalesce(CASE WHEN n IS NOT NULL THEN CAST(i AS VARCHAR) END, '') END AS indices FROM part LEFT JOIN (
  SELECT type_name, path, off + i * coalesce(stride, 0) AS spot, i, n FROM (SELECT *, unnest(range(coalesce(n, 1))) AS i FROM ({_LEAVES}))) ON type_name = 'N' || (p_partkey % 25) AND spot = (p_partkey * 4) % 1100""")
def q90_slot_at_displacement(a: Archive) -> DataFrame:
    places = a.table("part").selectExpr("p_partkey", "concat('N', p_partkey % 25) AS type_name", "(p_partkey * 4) % 1100 AS displacement")
    return schema.at_displacement(places, schema.slots(_members(a), written)).select("p_partkey", "path", F.array_join("indices", ",").alias("indices"))


@query(f"""SELECT 'N' || n_nationkey AS type_name, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CAST(1100 - coalesce(covered, 0) AS BIGINT) AS uncovered, CAST(coalesce(overlapping, 0) AS BIGINT) AS overlapping FROM nation LEFT JOIN (
  SELECT type_name, count(*) AS covered, count(*) FILTER (k > 1) AS overlapping FROM (SELECT type_name, byte_, count(*) AS k FROM (SELECT type_name, unnest(range(spot, spot + size)) AS byte_ FROM (
    SELECT type_name, off + i * coalesce(stride, 0) AS spot, size FROM (SELECT *, unnest(range(coalesce(n, 1))) AS i FROM ({_LEAVES}) WHERE NOT cond))) GROUP BY 1, 2) GROUP BY 1) c ON c.type_name = 'N' || n_nationkey""")
def q91_slot_coverage(a: Archive) -> DataFrame:
    sizes = a.table("nation").selectExpr("concat('N', n_nationkey) AS type_name", "1100L AS size")
    return schema.coverage(schema.slots(_members(a), written), sizes).select("type_name", "covered", "uncovered", "overlapping")


@query(f"SELECT type_name, path || CASE WHEN n IS NOT NULL THEN '[' || i || ']' ELSE '' END AS path, off + i * coalesce(stride, 0) AS offset, cond AS conditional_union FROM (SELECT *, unnest(range(coalesce(n, 1))) AS i FROM ({_LEAVES}))")
def q92_record_slots(a: Archive) -> DataFrame:
    return schema.record_slots(schema.slots(_members(a), written)).select("type_name", "path", "offset", "conditional_union")


_TYPES = "SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey = 0 THEN 'class' WHEN p_partkey % 4 < 2 THEN 'alias' WHEN p_partkey % 8 = 2 THEN 'const' ELSE 'class' END AS kind, CASE WHEN p_partkey % 16 = 1 THEN 'lost' ELSE 'p' || (p_partkey // 2) END AS target FROM part"


@query(f"""SELECT name, CASE WHEN k IS NOT NULL THEN cur END AS resolved, k AS kind, consts AS qualifiers, CASE WHEN k IS NULL THEN 'UNKNOWN_TARGET' ELSE 'RESOLVED' END AS status FROM (
  SELECT c.name, arg_max(cur, d) AS cur, CASE WHEN max(const) > 0 THEN 'const' ELSE '' END AS consts FROM (WITH RECURSIVE t AS ({_TYPES}), c(name, cur, d, const) AS (
    SELECT name, name, 0, 0 FROM t UNION ALL SELECT c.name, t.target, d + 1, greatest(const, CAST(t.kind = 'const' AS INT)) FROM c JOIN t ON t.name = c.cur WHERE t.kind IN ('alias', 'const')) SELECT * FROM c) c GROUP BY 1) x LEFT JOIN (SELECT name AS n, kind AS k FROM ({_TYPES})) y ON y.n = x.cur""")
def q93_resolved_types(a: Archive) -> DataFrame:
    types = a.table("part").selectExpr("concat('p', p_partkey) AS name", "CASE WHEN p_partkey = 0 THEN 'class' WHEN p_partkey % 4 < 2 THEN 'alias' WHEN p_partkey % 8 = 2 THEN 'const' ELSE 'class' END AS kind", "CASE WHEN p_partkey % 16 = 1 THEN 'lost' ELSE concat('p', p_partkey div 2) END AS target")
    return schema.resolved_types(types, written).select("name", "resolved", "kind", F.array_join("qualifiers", ",").alias("qualifiers"), "status")


_STORED = "SELECT id, size, array_header_size AS h, element_count AS n, CASE vector WHEN 1 THEN element_stride ELSE size END AS st, CASE vector WHEN 1 THEN element_stride - id % 3 ELSE size END AS es FROM alloc WHERE element_count > 0"


@query(f"""SELECT id, phase, CAST(k AS BIGINT) AS records, CAST(b AS BIGINT) AS bytes FROM (SELECT id, unnest(['ALLOCATION', 'HEADER', CASE WHEN id % 2 = 0 THEN 'ELEMENT' ELSE 'RAW_ELEMENT' END, 'PADDING', 'TRAILER']) AS phase, unnest([1, CAST(h > 0 AS INT), n, CASE WHEN st > es THEN n - 1 ELSE 0 END, CAST(size > h + n * es + (n - 1) * (st - es) AS INT)]) AS k,
  unnest([0, h, n * es, (n - 1) * (st - es), size - h - n * es - (n - 1) * (st - es)]) AS b FROM ({_STORED})) WHERE k > 0""")
def q94_text_phases(a: Archive) -> DataFrame:
    rows = a.alloc.where("element_count > 0").selectExpr("id", "size", "array_header_size", "element_count", "CASE vector WHEN 1 THEN element_stride ELSE size END AS element_stride", "CASE vector WHEN 1 THEN element_stride - id % 3 ELSE size END AS element_size")
    p = paging.phases(rows, "id % 2 = 0")
    return p.groupBy("id", "phase").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"))


@query("""SELECT 'ranges.gap' AS check_name, id AS allocation_id FROM alloc WHERE element_count > 3 AND id % 37 = 0 UNION ALL SELECT 'ranges.overlap', id FROM alloc WHERE element_count > 3 AND id % 41 = 0 AND id % 37 <> 0
UNION ALL SELECT 'ranges.missing', id FROM alloc WHERE element_count BETWEEN 1 AND 3 UNION ALL SELECT 'ranges.end', id FROM alloc WHERE element_count > 3 AND id % 43 = 0""")
def q95_ledger_closes(a: Archive) -> DataFrame:
    """Two value ranges for each allocation of over three elements, some of them wrong."""
    w = a.alloc.where("element_count > 3")
    first = w.selectExpr("id AS allocation_id", "0L AS first", "element_count div 2 AS last")
    second = w.selectExpr("id AS allocation_id", "element_count div 2 + CASE WHEN id % 37 = 0 THEN 1 WHEN id % 41 = 0 THEN -1 ELSE 0 END AS first", "element_count + CASE WHEN id % 43 = 0 THEN 5 ELSE 0 END AS last")
    return ledger.violations(first.union(second), a.alloc.where("element_count > 0"))


@query("""SELECT type_name, id, 0::BIGINT AS element, rank FROM (SELECT type_name, id, CASE WHEN type_name = 'T0' THEN 0 WHEN type_name = 'T2' THEN 1 WHEN type_name IN ('T3', 'T4') THEN 2 ELSE 3 END AS rank FROM alloc) WHERE (rank, type_name, id, 0) > (1, 'T2', 30, 0) ORDER BY rank, type_name, id LIMIT 40""")
def q96_object_page(a: Archive) -> DataFrame:
    o = a.alloc.selectExpr("type_name", "id", "0L AS element", "type_name = 'T0' AS entity", "type_name = 'T2' AS text", "type_name IN ('T3', 'T4') AS class_")
    return discovery.page(discovery.census_rank(o), (1, "T2", 30, 0), 40).select("type_name", "id", "element", "rank")


@query("""SELECT database, segment, cluster, place AS "offset", CASE WHEN database = 'a' THEN id END AS id, times, CASE WHEN database <> 'a' THEN 'EXTERNAL_DATABASE' WHEN id IS NULL THEN 'NO_ALLOCATION_STARTS_HERE' ELSE 'SELECTED' END AS status FROM (
  SELECT CASE WHEN id % 10 = 3 THEN 'b' ELSE 'a' END AS database, segment, cluster, logical_offset + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS place, CASE WHEN id % 6 = 0 THEN 2 ELSE 1 END::BIGINT AS times FROM alloc) r LEFT JOIN (SELECT id, segment, cluster, logical_offset AS place FROM alloc) s USING (segment, cluster, place)""")
def q97_exact_selection(a: Archive) -> DataFrame:
    r = a.alloc.selectExpr("CASE WHEN id % 10 = 3 THEN 'b' ELSE 'a' END AS database", "segment", "cluster", "logical_offset + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS offset", "explode(sequence(1, CASE WHEN id % 6 = 0 THEN 2 ELSE 1 END)) AS k").drop("k")
    return discovery.selected(r, a.alloc, "a")


@query("""SELECT g AS geometry, o AS owner, CAST(d AS BIGINT) AS distance FROM (SELECT 'n' || n_nationkey AS g, s_suppkey AS o, 0 AS d FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 > 0) ON s_nationkey = n_nationkey)
UNION ALL SELECT 'r' || r_regionkey, o, CASE WHEN o IS NOT NULL THEN 1 END FROM region LEFT JOIN (SELECT s_suppkey AS o, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 > 0) ON n_regionkey = r_regionkey""".replace("0 AS d FROM nation", "CASE WHEN s_suppkey IS NOT NULL THEN 0 END AS d FROM nation"))
def q98_geometry_owners(a: Archive) -> DataFrame:
    nation = a.table("nation")
    ents = a.table("supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 3 > 0 THEN concat('n', s_nationkey) END AS shape")
    geometries = nation.selectExpr("concat('n', n_nationkey) AS geometry").union(a.table("region").selectExpr("concat('r', r_regionkey)"))
    return discovery.owners(ents, nation.selectExpr("concat('n', n_nationkey) AS parent", "concat('r', n_regionkey) AS child"), geometries, written)


@query("""SELECT reason, n, samples FROM (SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1) JOIN (SELECT event_type AS reason, array_to_string(list(x ORDER BY x), ',') AS samples FROM (SELECT event_type, user_id AS x, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS k FROM (SELECT DISTINCT event_type, user_id FROM events)) WHERE k <= 4 GROUP BY 1) USING (reason)""")
def q99_sampled_reasons(a: Archive) -> DataFrame:
    s = census.sampled_reasons(a.table("events"), "event_type", "user_id")
    return s.select("reason", "n", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query("SELECT l_suppkey, string_agg(k || '=' || n, ',' ORDER BY k) AS counters FROM (SELECT l_suppkey, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def q100_map_counters(a: Archive) -> DataFrame:
    c = census.counters(a.table("lineitem"), ["l_suppkey"], "l_returnflag")
    return c.select("l_suppkey", F.array_join(F.transform(F.map_entries("counters"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counters"))


@query("""SELECT n_nationkey, CASE WHEN octet_length(encode(j)) <= 55 THEN j END AS json, CAST(octet_length(encode(j)) AS BIGINT) AS bytes, CASE WHEN octet_length(encode(j)) <= 55 THEN 'WRITTEN' ELSE 'RESOURCE_BOUND' END AS status FROM (SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS j FROM nation)""")
def q101_bounded_json(a: Archive) -> DataFrame:
    n = a.table("nation")
    made = n.select("n_nationkey", F.to_json(F.struct("n_regionkey", "n_name", "n_nationkey")).alias("text"))
    return made.select("n_nationkey", binary.bounded_json(F.col("text"), 55).alias("x")).select("n_nationkey", "x.*")


@query("SELECT p_partkey, CASE WHEN p_size * 2 <= 64 THEN CAST(p_size * 2 AS INT) END AS depth, CASE WHEN p_size * 2 <= 64 THEN 'READ' ELSE 'RESOURCE_BOUND' END AS status FROM part")
def q102_json_depth(a: Archive) -> DataFrame:
    text = F.concat(F.expr("""repeat('[{"a":', p_size)"""), F.lit("1"), F.expr("repeat('}]', p_size)"))
    return a.table("part").select("p_partkey", binary.depth_of_json(text).alias("x")).select("p_partkey", "x.*")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def q103_utc_text(a: Archive) -> DataFrame:
    return a.table("events").select("event_id", binary.utc_text(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)).alias("utc"))


@query("SELECT l_partkey AS part, l_returnflag AS status, first, last, previous_last FROM (SELECT *, lag(last) OVER (PARTITION BY l_partkey, l_returnflag ORDER BY first, last) AS previous_last FROM (SELECT DISTINCT l_partkey, l_returnflag, l_orderkey AS first, l_orderkey + 2000 * l_linenumber AS last FROM lineitem)) WHERE first < previous_last")
def q104_overlap_by_status(a: Archive) -> DataFrame:
    r = a.table("lineitem").selectExpr("l_partkey AS part", "l_returnflag AS status", "l_orderkey AS first", "l_orderkey + 2000 * l_linenumber AS last").distinct()
    return intervals.overlaps_of(r, ["part", "status"], "first", "last")


@query("SELECT conv_id, i AS index, expected FROM (SELECT conv_id, turn + CASE WHEN conv_id % 4 = 0 AND turn > 1 THEN 1 ELSE 0 END AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS expected FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)) WHERE i <> expected")
def q105_index_continuity(a: Archive) -> DataFrame:
    t = a.table("conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    return intervals.discontinuous(t.selectExpr("conv_id", "turn + CASE WHEN conv_id % 4 = 0 AND turn > 1 THEN 1 ELSE 0 END AS index"), ["conv_id"], "index")


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'RECORDED_BINDING_WITHOUT_SOURCE_DECLARATION' WHEN l_linenumber = 6 OR l_partkey % 17 = 0 THEN 'CONDITIONAL_OR_AMBIGUOUS_SOURCE_SLOT' WHEN l_partkey % 13 = 0 THEN 'SOURCE_SLOT_CROSSES_ALLOCATION' WHEN l_partkey % 11 = 0 THEN 'SOURCE_SLOT_CROSSES_ELEMENT' WHEN l_partkey % 7 = 0 THEN 'SOURCE_SLOT_RAW_MISMATCH'
  WHEN l_linenumber % 2 = 0 THEN 'SOURCE_SLOT_WIDTH_MISMATCH' WHEN l_returnflag = 'A' THEN 'NULL_SOURCE_FIELD' WHEN l_returnflag = 'N' THEN 'UNRESOLVED_SOURCE_FIELD' WHEN l_suppkey % 5 = 0 THEN 'INTERIOR' WHEN l_suppkey % 3 = 0 THEN 'POINTEE_TYPE_MISMATCH' ELSE 'SOURCE_DECLARED_FIELD_TARGET' END AS state FROM lineitem) GROUP BY 1""")
def q106_binding_states(a: Archive) -> DataFrame:
    b = a.table("lineitem").selectExpr(
        "CASE l_linenumber WHEN 7 THEN 0 WHEN 6 THEN 2 ELSE 1 END AS declared", "l_partkey % 17 = 0 AS conditional", "l_partkey % 13 = 0 AS crosses_allocation", "l_partkey % 11 = 0 AS crosses_element", "l_partkey % 7 != 0 AS raw_equal", "4 AS slot_width",
        "CASE WHEN l_linenumber % 2 = 0 THEN 8 ELSE 4 END AS width", "CASE l_returnflag WHEN 'R' THEN 'RESOLVED' WHEN 'A' THEN 'NULL' ELSE 'UNRESOLVED' END AS status", "CASE WHEN l_suppkey % 5 = 0 THEN 'INTERIOR' ELSE 'EXACT_ELEMENT_START' END AS view", "CASE WHEN l_suppkey % 3 = 0 THEN 'POINTEE_TYPE_MISMATCH' ELSE 'POINTEE_TYPE_COMPATIBLE' END AS compatibility",
    )
    return ledger.binding_states(b).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT check_name, l AS left, r AS right, l = r AS equal FROM (SELECT 'pointers' AS check_name, (SELECT count(*) FROM ptr) AS l, (SELECT count(*) FROM edge) AS r UNION ALL SELECT 'bytes', (SELECT CAST(sum(size) AS BIGINT) FROM alloc), (SELECT CAST(sum(allocated_bytes) AS BIGINT) FROM clus))")
def q107_complete_accounting(a: Archive) -> DataFrame:
    n = lambda df: df.agg(F.count("*"))
    return discovery.accounting([("pointers", n(a.ptr), n(a.edge)), ("bytes", a.alloc.agg(F.sum("size")), a.clus.agg(F.sum("allocated_bytes")))])


@query("SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def q108_file_information(a: Archive) -> DataFrame:
    return discovery.file_information({n: a.table(n) for n in ("region", "nation", "customer")})


@query("""SELECT name, CASE WHEN id IS NULL THEN 'ROOT_WITHOUT_ALLOCATION' WHEN place <> start THEN 'ROOT_INSIDE_ALLOCATION' ELSE 'ADMITTED' END AS admission FROM (SELECT r.name, r.place, e.logical_offset AS start, CASE WHEN r.place < e.logical_offset + e.size THEN e.id END AS id
FROM (SELECT 'a' || id AS name, segment, cluster, logical_offset + CASE id % 5 WHEN 0 THEN size + 3 WHEN 1 THEN 2 ELSE 0 END AS place FROM alloc) r ASOF LEFT JOIN alloc e ON e.segment = r.segment AND e.cluster = r.cluster AND e.logical_offset <= r.place)""")
def q109_admitted_roots(a: Archive) -> DataFrame:
    roots = a.alloc.selectExpr("concat('a', id) AS name", "segment", "cluster", "logical_offset + CASE id % 5 WHEN 0 THEN size + 3 WHEN 1 THEN 2 ELSE 0 END AS offset")
    return discovery.admitted_roots(roots, a.alloc).select("name", "admission")


@query("""SELECT s_suppkey AS id, CAST(count(name) AS BIGINT) AS n, CAST(count(DISTINCT name) FILTER (k > 1) AS BIGINT) AS ambiguous, coalesce(string_agg(name || '=' || v, ',' ORDER BY name) FILTER (k = 1), '') AS attributes FROM supplier LEFT JOIN (SELECT l_suppkey, 'a' || (l_partkey % 50) AS name, min(l_orderkey) OVER w AS v, count(*) OVER w AS k FROM lineitem WHERE l_linenumber = 1 WINDOW w AS (PARTITION BY l_suppkey, l_partkey % 50)) ON l_suppkey = s_suppkey GROUP BY 1""")
def q110_entity_attributes(a: Archive) -> DataFrame:
    values = a.table("lineitem").where("l_linenumber = 1").selectExpr("l_suppkey AS id", "concat('a', l_partkey % 50) AS name", "CAST(l_orderkey AS STRING) AS value", "l_orderkey")
    values = values.withColumn("value", F.lpad("value", 12, "0"))
    out = discovery.attributes(a.table("supplier").selectExpr("s_suppkey AS id"), values)
    text = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))), ",")
    return out.select("id", "n", "ambiguous", F.coalesce(text, F.lit("")).alias("attributes"))
