"""Scans, censuses, joins of the pointer graph, and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import census, graph, intervals, membership, paging
from .fixture import Archive
from .registry import registry

QUERIES, SQL, query = registry()


@query("SELECT type_name, count(*) AS allocations, CAST(sum(element_count) AS BIGINT) AS elements, CAST(sum(size) AS BIGINT) AS bytes FROM alloc GROUP BY type_name")
def q01_type_census(a: Archive) -> DataFrame:
    return census.type_census(a.alloc)


@query("""SELECT type_name, element_stride, count(*) AS allocations, CAST(sum(vector) AS BIGINT) AS vectors, min(id) AS first_id, max(id) AS last_id, CAST(sum(size) AS BIGINT) AS bytes
FROM alloc GROUP BY type_name, element_stride""")
def q02_allocation_groups(a: Archive) -> DataFrame:
    return census.allocation_groups(a.alloc, ["type_name", "element_stride"])


@query("""SELECT count(*) AS allocations, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(CASE WHEN vector = 1 THEN element_count ELSE 1 END), 0) AS BIGINT) AS elements,
CAST(coalesce(sum(vector), 0) AS BIGINT) AS vectors FROM alloc""")
def q03_global_accounting(a: Archive) -> DataFrame:
    return census.accounting(a.alloc)


@query("""SELECT p.segment, p.cluster, p.logical_offset, CASE WHEN p.logical_offset < a.logical_offset + a.size THEN a.id END AS id
FROM ptr p ASOF LEFT JOIN alloc a ON a.segment = p.segment AND a.cluster = p.cluster AND a.logical_offset <= p.logical_offset""")
def q04_containing_lookup(a: Archive) -> DataFrame:
    held = a.alloc.select("segment", "cluster", "id", F.col("logical_offset").alias("start"), "size")
    return intervals.containing(a.ptr, held, "logical_offset", "start", "size").select("segment", "cluster", "logical_offset", "id")


@query("SELECT segment, cluster, logical_offset, width, s_id FROM held")
def q05_source_slot_fit(a: Archive) -> DataFrame:
    held = a.alloc.select("segment", "cluster", F.col("id").alias("s_id"), F.col("logical_offset").alias("start"), "size")
    return intervals.containing(a.ptr, held, "logical_offset", "start", "size", F.col("width")).select("segment", "cluster", "logical_offset", "width", "s_id")


@query("""SELECT s_type AS source_type, t_type AS target_type, status, displacement % 64 AS displacement, width, count(*) AS n
FROM edge GROUP BY 1, 2, 3, 4, 5""")
def q06_reference_shapes(a: Archive) -> DataFrame:
    return census.reference_shapes(a.edge, 64)


@query("SELECT segment, cluster, logical_offset, status, s_id, t_id, displacement FROM edge")
def q07_edges_build(a: Archive) -> DataFrame:
    return a.edge.select("segment", "cluster", "logical_offset", "status", "s_id", "t_id", "displacement")


@query("""SELECT coalesce(o.type_name, i.type_name) AS type_name, coalesce(outgoing, 0) AS outgoing, CAST(coalesce(outgoing_links, 0) AS BIGINT) AS outgoing_links, coalesce(incoming, 0) AS incoming, CAST(coalesce(incoming_links, 0) AS BIGINT) AS incoming_links
FROM (SELECT s_type AS type_name, count(*) AS outgoing, count(*) FILTER (status = 'RESOLVED' AND t_id IS NOT NULL) AS outgoing_links FROM edge WHERE s_type IS NOT NULL GROUP BY 1) o
FULL JOIN (SELECT t_type AS type_name, count(*) AS incoming, count(*) FILTER (status = 'RESOLVED') AS incoming_links FROM edge WHERE t_type IS NOT NULL GROUP BY 1) i ON o.type_name = i.type_name""")
def q08_degree_by_type(a: Archive) -> DataFrame:
    return census.degrees(a.edge)


@query("SELECT segment, cluster, logical_offset, t_id FROM edge WHERE s_id = 7 AND (segment, cluster, logical_offset) > (1, 1, 100) ORDER BY 1, 2, 3 LIMIT 20")
def q09_neighbours_page(a: Archive) -> DataFrame:
    return graph.neighbours(a.edge, 7, "out", (1, 1, 100), 20).select("segment", "cluster", "logical_offset", "t_id")


@query("""SELECT node, min(depth) AS depth FROM (SELECT 7::BIGINT AS node, 0 AS depth UNION ALL SELECT t_id, 1 FROM edge WHERE s_id = 7 AND t_id IS NOT NULL
  UNION ALL SELECT b.t_id, 2 FROM edge a JOIN edge b ON b.s_id = a.t_id WHERE a.s_id = 7 AND b.t_id IS NOT NULL) GROUP BY node""")
def q10_bounded_reachability(a: Archive) -> DataFrame:
    links = a.edge.where("s_id IS NOT NULL AND t_id IS NOT NULL").selectExpr("s_id AS source", "t_id AS target")
    seeds = a.spark.range(7, 8).toDF("node")
    return graph.reachable(links, seeds, 2)


@query("SELECT i AS side, segment, cluster, logical_offset FROM (SELECT 'left' AS i, * FROM (SELECT segment, cluster, logical_offset FROM ptr WHERE width = 8 EXCEPT SELECT segment, cluster, logical_offset FROM held WHERE s_id IS NOT NULL)) UNION ALL SELECT 'right', * FROM (SELECT segment, cluster, logical_offset FROM held WHERE s_id IS NOT NULL EXCEPT SELECT segment, cluster, logical_offset FROM ptr WHERE width = 8)")
def q15_except_both(a: Archive) -> DataFrame:
    left = a.ptr.where("width = 8").select("segment", "cluster", "logical_offset")
    return membership.differences(left, a.edge.where("s_id IS NOT NULL").select("segment", "cluster", "logical_offset"))


@query("""SELECT count(*) FILTER (l AND r) AS both, count(*) FILTER (l AND NOT r) AS only_left, count(*) FILTER (r AND NOT l) AS only_right FROM (
  SELECT id, bool_or(s) AS l, bool_or(NOT s) AS r FROM (SELECT s_id AS id, true AS s FROM edge WHERE s_id IS NOT NULL UNION ALL SELECT t_id, false FROM edge WHERE t_id IS NOT NULL) GROUP BY id)""")
def q16_address_set_reconcile(a: Archive) -> DataFrame:
    e = a.edge
    return membership.reconciled(e.where("s_id IS NOT NULL").selectExpr("s_id AS id"), e.where("t_id IS NOT NULL").selectExpr("t_id AS id"), ["id"])


@query("SELECT l_partkey AS part, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem) GROUP BY 1 HAVING count(*) > 1")
def q17_conflicting_contexts(a: Archive) -> DataFrame:
    return membership.conflicting(a.table("lineitem"), "l_partkey", "l_returnflag").withColumnRenamed("l_partkey", "part")


@query("SELECT t_id AS id, count(DISTINCT s_id) AS sources, count(*) AS references_ FROM edge WHERE t_id IS NOT NULL GROUP BY 1")
def q18_distinct_incoming(a: Archive) -> DataFrame:
    return a.edge.where("t_id IS NOT NULL").groupBy(F.col("t_id").alias("id")).agg(F.count_distinct("s_id").alias("sources"), F.count("*").alias("references_"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q19_orphan_documents(a: Archive) -> DataFrame:
    return a.table("documents").select("doc_id").join(a.table("labels"), "doc_id", "left_anti")


@query("SELECT segment, cluster, type_name, size, id FROM alloc WHERE (segment, cluster, id) > (1, 2, 100) ORDER BY segment, cluster, id LIMIT 50")
def q22_tuple_keyset_page(a: Archive) -> DataFrame:
    return paging.after(a.alloc.select("segment", "cluster", "type_name", "size", "id"), ["segment", "cluster", "id"], (1, 2, 100), 50)


@query("SELECT id, i AS element_index, logical_offset + array_header_size + i * element_stride AS offset FROM (SELECT *, unnest(range(element_count)) AS i FROM alloc WHERE element_count > 0)")
def q23_element_expand(a: Archive) -> DataFrame:
    rows = a.alloc.where("element_count > 0").withColumn("element_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("element_count") - 1)))
    return rows.select("id", "element_index", F.expr("logical_offset + array_header_size + element_index * element_stride").alias("offset"))


@query("""SELECT segment, cluster, logical_offset, CASE WHEN vector = 1 AND d < 0 THEN 'ARRAY_HEADER' WHEN d // element_stride >= element_count THEN 'TERMINAL_PADDING' WHEN d % element_stride = 0 THEN 'ELEMENT_START'
  WHEN d % element_stride < element_stride - 3 THEN 'ELEMENT_INTERIOR' ELSE 'INTER_ELEMENT' END AS region
FROM (SELECT h.segment, h.cluster, h.logical_offset, a.vector, a.element_stride, a.element_count, h.logical_offset - a.logical_offset - a.array_header_size AS d FROM held h JOIN alloc a ON a.id = h.s_id)""")
def q24_region_classify(a: Archive) -> DataFrame:
    e = a.edge.where("s_id IS NOT NULL").select("segment", "cluster", "logical_offset", "s_id", (F.col("logical_offset") - F.col("s_start")).alias("delta"))
    own = a.alloc.select(F.col("id").alias("s_id"), "vector", "element_stride", "element_count", "array_header_size", (F.col("element_stride") - 3).alias("element_size"))
    return e.join(own, "s_id").select("segment", "cluster", "logical_offset", census.region().alias("region"))


@query("""SELECT t.type_name, n, CASE WHEN t.type_name = 'T0' THEN 'ESTABLISHED_ENTITY_FAMILY' WHEN t.type_name = 'T1' THEN 'COLLECTION_STORAGE' WHEN vectors = n AND t.type_name <> 'T2' THEN 'ARRAY_PAYLOAD_STORAGE' WHEN t.type_name IN ('T2', 'T3', 'T4') THEN 'STRUCTURAL_RECORD' ELSE 'UNKNOWN_STORAGE' END AS role, coalesce(links, 0) AS incoming_links
FROM (SELECT type_name, count(*) AS n, sum(vector) AS vectors FROM alloc GROUP BY 1) t LEFT JOIN (SELECT t_type, count(*) AS links FROM edge WHERE t_type IS NOT NULL GROUP BY 1) l ON l.t_type = t.type_name""")
def q25_role_inventory(a: Archive) -> DataFrame:
    types = a.alloc.groupBy("type_name").agg(F.count("*").alias("n"), F.sum("vector").alias("n_vectors"))
    links = a.edge.where("t_type IS NOT NULL").groupBy(F.col("t_type").alias("type_name")).agg(F.count("*").alias("incoming_links"))
    t = types.join(links, "type_name", "left").withColumn("incoming_links", F.coalesce("incoming_links", F.lit(0)))
    t = t.withColumns({"entity": F.col("type_name") == "T0", "collection": F.col("type_name") == "T1", "class_": F.col("type_name").isin("T2", "T3", "T4"), "text": F.col("type_name") == "T2", "array_links": F.col("incoming_links")})
    return census.roles(t).select("type_name", "n", "role", "incoming_links")


@query("""SELECT p_brand, p_type, digest, row_number() OVER (ORDER BY digest) AS id FROM (SELECT DISTINCT p_brand, p_type, sha256(concat(coalesce(p_brand, ''), '|', coalesce(p_type, ''))) AS digest FROM part)""")
def q26_interning(a: Archive) -> DataFrame:
    return census.interned(a.table("part"), ["p_brand", "p_type"])


@query("""SELECT type_name, id FROM (SELECT *, row_number() OVER (PARTITION BY type_name ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY type_name) AS n FROM alloc)
WHERE list_contains(CASE WHEN n <= 5 THEN range(5) ELSE list_transform(range(5), lambda k: k * (n - 1) // 4) END, i)""")
def q27_stratified_spread(a: Archive) -> DataFrame:
    return census.spread(a.alloc.select("type_name", "id"), "type_name", "id", 5)


@query("SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_id, CAST(max(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS raw_length FROM documents GROUP BY 1")
def q29_content_hash_dedup(a: Archive) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return a.table("documents").groupBy(F.sha2(t, 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max(F.octet_length(t)).cast("long").alias("raw_length"))


@query("SELECT id, segment, cluster, type_name, p_brand, n_name FROM alloc JOIN part ON p_partkey = 1 + id % 20 JOIN nation ON n_nationkey = id % 25")
def q45_star_restore(a: Archive) -> DataFrame:
    part, nation = a.table("part").select("p_partkey", "p_brand"), a.table("nation").select("n_nationkey", "n_name")
    return a.alloc.join(part, F.expr("p_partkey = 1 + id % 20")).join(nation, F.expr("n_nationkey = id % 25")).select("id", "segment", "cluster", "type_name", "p_brand", "n_name")


@query("SELECT type_name, vector AS tag, element_stride AS template, count(*) AS allocations, CAST(sum(element_count) AS BIGINT) AS elements FROM alloc GROUP BY 1, 2, 3")
def q46_sub_census(a: Archive) -> DataFrame:
    return census.sub_census(a.alloc, "vector", "element_stride").withColumnsRenamed({"vector": "tag", "element_stride": "template"})


@query("SELECT status, width, count(*) AS n FROM ptr GROUP BY 1, 2")
def q47_status_histogram(a: Archive) -> DataFrame:
    return a.ptr.groupBy("status", "width").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS status, CAST(sum(l_linenumber * n) AS BIGINT) AS weighted FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def q48_weighted_sum(a: Archive) -> DataFrame:
    g = a.table("lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    return g.groupBy(F.col("l_returnflag").alias("status")).agg(F.sum(F.col("l_linenumber") * F.col("n")).alias("weighted"))


@query("SELECT segment, cluster, max(logical_offset + size) AS last FROM alloc GROUP BY 1, 2")
def q49_last_by_cluster(a: Archive) -> DataFrame:
    return a.alloc.groupBy("segment", "cluster").agg(F.max(F.col("logical_offset") + F.col("size")).alias("last"))


@query("SELECT count(*) AS groups_, CAST(sum(n) AS BIGINT) AS members, max(n) AS largest FROM (SELECT type_name, cluster, count(*) AS n FROM alloc GROUP BY 1, 2)")
def q50_nested_totals(a: Archive) -> DataFrame:
    g = a.alloc.groupBy("type_name", "cluster").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups_"), F.sum("n").alias("members"), F.max("n").alias("largest"))


@query("""SELECT CASE WHEN r <= 8 THEN label ELSE '__OTHER__' END AS label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS r
FROM (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1)) GROUP BY 1""")
def q51_capped_histogram(a: Archive) -> DataFrame:
    return census.capped_histogram(a.table("part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n")), "label", "n", 8)


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'NULL' WHEN octet_length(encode(text)) <= 2000 THEN 'READ' ELSE 'RESOURCE_BOUND' END AS text_state, CASE WHEN octet_length(encode(text)) <= 2000 THEN md5(text) END AS digest FROM documents")
def q52_bounded_column(a: Archive) -> DataFrame:
    return paging.bounded_column(a.table("documents").select("doc_id", "text"), "text", 2000).select("doc_id", "text_state", F.md5("text").alias("digest"))


@query("SELECT segment, cluster, allocated_bytes FROM clus WHERE segment = 2 ORDER BY cluster")
def q53_clusters_of_segment(a: Archive) -> DataFrame:
    return a.clus.where("segment = 2").orderBy("cluster")


@query("SELECT id, type_name, segment, cluster, logical_offset FROM alloc WHERE type_name IN ('T1', 'T4') AND segment = 1")
def q54_allocations_by_names(a: Archive) -> DataFrame:
    return a.alloc.where(F.col("type_name").isin("T1", "T4") & (F.col("segment") == 1)).select("id", "type_name", "segment", "cluster", "logical_offset")


@query("SELECT id, logical_offset, size FROM alloc WHERE segment = 1 AND cluster = 2 AND logical_offset <= 5000 AND 5000 < logical_offset + size")
def q55_point_lookup(a: Archive) -> DataFrame:
    return a.alloc.where("segment = 1 AND cluster = 2 AND logical_offset <= 5000 AND 5000 < logical_offset + size").select("id", "logical_offset", "size")


@query("SELECT priority, type_name, n FROM (SELECT CASE WHEN type_name = 'T0' THEN 0 WHEN type_name = 'T2' THEN 1 WHEN type_name IN ('T3', 'T4') THEN 2 ELSE 3 END AS priority, type_name, count(*) AS n FROM alloc GROUP BY 1, 2) ORDER BY 1, 2")
def q56_priority_order(a: Archive) -> DataFrame:
    p = F.when(F.col("type_name") == "T0", 0).when(F.col("type_name") == "T2", 1).when(F.col("type_name").isin("T3", "T4"), 2).otherwise(3)
    return a.alloc.groupBy(p.alias("priority"), "type_name").agg(F.count("*").alias("n")).orderBy("priority", "type_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 30 OFFSET 60")
def q57_offset_page(a: Archive) -> DataFrame:
    return paging.offset_page(a.table("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], 60, 30).select("l_orderkey", "l_linenumber")


@query("SELECT type_name, id FROM (SELECT type_name, min(id) AS id FROM alloc GROUP BY type_name)")
def q58_earliest_task(a: Archive) -> DataFrame:
    return a.alloc.groupBy("type_name").agg(F.min("id").alias("id"))
