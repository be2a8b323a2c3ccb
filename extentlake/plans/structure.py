"""Collections, closures, trees and views of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decode, graph, membership
from .fixture import Archive
from .registry import registry

QUERIES, SQL, query = registry()


def _cut(df: DataFrame) -> DataFrame:
    from ..sources.store import written

    return written(df)


@query("""SELECT conv_id AS coll_id, CAST(count(*) + (CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS declared, CAST(count(*) FILTER (turn < gap) AS BIGINT) AS observed, CAST(count(*) FILTER (turn < gap) AS BIGINT) AS n_blocks,
  CASE WHEN count(*) + (CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END) = count(*) FILTER (turn < gap) THEN 'VERIFIED_CARDINALITY' ELSE 'CARDINALITY_MISMATCH' END AS status
FROM (SELECT *, coalesce(min(CASE WHEN turn <> r THEN r END) OVER (PARTITION BY conv_id), 1000000) AS gap FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL))) GROUP BY conv_id""")
def q38_list_membership(a: Archive) -> DataFrame:
    """Turns of a conversation as the blocks of a list, each linked to the next turn, from turn 0 on."""
    turns = a.table("conversations").select("conv_id", "turn").where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
    blocks = turns.selectExpr("conv_id AS coll_id", "turn AS node_id", "turn + 1 AS next_node_id", "turn = 0 AS is_root", "1 AS local_card")
    declared = turns.groupBy(F.col("conv_id").alias("coll_id")).agg(F.count("*").alias("n")).select("coll_id", (F.col("n") + F.when(F.col("coll_id") % 5 == 0, 1).otherwise(0)).alias("declared"))
    return membership.list_membership(declared, blocks, membership.list_chains(blocks, cut=_cut))


@query("""SELECT o_custkey AS coll_id, count(*) + (CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END) AS n_entries, count(*) AS members,
  CASE WHEN count(*) <> count(DISTINCT o_orderdate) THEN 'DUPLICATE_SET_REFERENCE' WHEN o_custkey % 7 = 0 THEN 'CARDINALITY_MISMATCH' ELSE 'VERIFIED_CARDINALITY' END AS status FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1""")
def q39_set_membership(a: Archive) -> DataFrame:
    """Orders of a customer as the slots of a set, with the day as target; a sentinel is added, and some counters are wrong."""
    o = a.table("orders").where("o_custkey IS NOT NULL").selectExpr("o_custkey AS coll_id", "o_orderkey AS slot_index", "-unix_micros(CAST(o_orderdate AS TIMESTAMP)) - 1 AS target_id")
    n = o.groupBy("coll_id").agg(F.count("*").alias("n"))
    sets = n.selectExpr("coll_id", "n + CASE WHEN coll_id % 7 = 0 THEN 1 ELSE 0 END AS n_entries", "n + CASE WHEN coll_id % 7 = 0 THEN 1 ELSE 0 END AS n_keys", "n + 2 AS n_slots")
    sentinel = n.selectExpr("coll_id", "-1L AS slot_index", "coll_id AS target_id")
    return membership.set_membership(sets, o.unionByName(sentinel))


@query("""SELECT vec_id AS coll_id, CASE WHEN vec_id % 6 > 0 THEN 'VERIFIED_CARDINALITY' ELSE 'CARDINALITY_MISMATCH' END AS status, CAST(i AS INT) AS slot, v AS value, i < vec_id % 5 AS active
FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)""")
def q40_array_window(a: Archive) -> DataFrame:
    e = a.table("embeddings").selectExpr("vec_id AS coll_id", "vec_id * 1000 AS start", "embedding", "vec_id % 5 AS entries")
    tail = F.when(F.col("entries") > 0, F.col("start") + (F.col("entries") - 1) * 4)
    e = e.withColumn("tail", F.when(F.col("coll_id") % 6 > 0, tail).otherwise(F.lit(-1)))
    return membership.array_window(e, "embedding", "entries", "tail").select("coll_id", "status", "slot", "value", "active")


_TREE = """SELECT 'r' || r_regionkey AS child, 'world' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"""


def _tree(a: Archive) -> DataFrame:
    r = a.table("region").selectExpr("concat('r', r_regionkey) AS child", "'world' AS parent")
    n = a.table("nation").selectExpr("concat('n', n_nationkey) AS child", "concat('r', n_regionkey) AS parent")
    s = a.table("supplier").selectExpr("concat('s', s_suppkey) AS child", "concat('n', s_nationkey) AS parent")
    return r.union(n).union(s).union(a.table("customer").selectExpr("concat('c', c_custkey) AS child", "concat('n', c_nationkey) AS parent"))


@query(f"""SELECT node, ancestor, min(distance) AS distance FROM (WITH RECURSIVE t AS ({_TREE}), c(node, ancestor, distance) AS (
  SELECT x, x, 0::BIGINT FROM (SELECT child AS x FROM t UNION SELECT parent FROM t) UNION SELECT c.node, t.parent, c.distance + 1 FROM c JOIN t ON t.child = c.ancestor) SELECT * FROM c) GROUP BY 1, 2""")
def q41_inheritance_closure(a: Archive) -> DataFrame:
    return graph.closure(_tree(a), "child", "parent", cut=_cut)


@query(f"""SELECT 's' || s_suppkey AS node, 'world/r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey AS path, 'COMPLETE' AS status FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def q68_navigation_paths(a: Archive) -> DataFrame:
    t = _tree(a).union(a.spark.createDataFrame([("world", None)], "child string, parent string"))
    return graph.paths(t.withColumn("label", F.col("child")), "child", "parent", "label", _cut).where("node LIKE 's%'")


@query(f"""SELECT parent, count(*) AS children, count(*) FILTER (parent NOT IN (SELECT child FROM ({_TREE}))) AS orphans FROM ({_TREE}) GROUP BY 1""")
def q69_tree_children(a: Archive) -> DataFrame:
    t = _tree(a)
    known = t.select(F.col("child").alias("known"))
    return t.join(known, t["parent"] == known["known"], "left").groupBy("parent").agg(F.count("*").alias("children"), F.count_if(F.col("known").isNull()).alias("orphans"))


@query("""SELECT segment, cluster, logical_offset, CASE WHEN delta < 0 OR stride <= 0 THEN 'HEADER_OR_UNKNOWN' WHEN delta // stride >= element_count THEN 'PADDING_OR_OUTSIDE' WHEN type_name = 'T0' AND delta % stride IN (0, 4) THEN 'EXACT_BASE_SUBOBJECT_VIEW' WHEN delta % stride = 0 THEN 'EXACT_ELEMENT_START' ELSE 'INTERIOR' END AS view,
  CASE WHEN delta >= 0 AND delta // stride < element_count AND type_name = 'T0' THEN CASE delta % stride WHEN 0 THEN 'T0' WHEN 4 THEN 'Base' END END AS base_name
FROM (SELECT e.segment, e.cluster, e.logical_offset, e.target_offset - a.logical_offset - a.array_header_size AS delta, a.element_stride AS stride, a.element_count, a.type_name FROM aimed e JOIN alloc a ON a.id = e.t_id)""")
def q70_target_views(a: Archive) -> DataFrame:
    own = a.alloc.select(F.col("id").alias("t_id"), "type_name", "element_count", F.col("element_stride").alias("stride"), F.col("array_header_size").alias("header"))
    e = a.edge.where("t_id IS NOT NULL").select("segment", "cluster", "logical_offset", "t_id", "target_offset", "t_start").join(own, "t_id")
    e = e.withColumns({"delta": F.expr("target_offset - t_start - header"), "admitted": F.col("type_name") == "T0"})
    bases = a.spark.createDataFrame([("T0", 0, "T0"), ("T0", 4, "Base")], "type_name string, base_offset long, base_name string")
    return graph.target_view(F.broadcast(bases), e).select("segment", "cluster", "logical_offset", "view", "base_name")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN b IS NULL AND raw = 0 AND complete THEN 'NULL_IMPLICIT' WHEN b IS NULL THEN 'MISSING' WHEN bw <> 4 THEN 'WIDTH_MISMATCH' WHEN l_linenumber = 3 THEN 'RAW_MISMATCH' WHEN b = 'NULL' THEN 'NULL_EXPLICIT' ELSE b END AS state
FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS raw, l_orderkey % 2 = 0 AS complete, CASE l_returnflag WHEN 'R' THEN 'RESOLVED' WHEN 'A' THEN 'NULL' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'UNRESOLVED' END END AS b, CASE WHEN l_linenumber = 2 THEN 8 ELSE 4 END AS bw FROM lineitem)""")
def q71_pointer_resolve(a: Archive) -> DataFrame:
    l = a.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "unhex(lpad(hex(l_suppkey % 4), 8, '0')) AS raw", "unhex(lpad(hex(CASE WHEN l_linenumber = 3 THEN 9 ELSE l_suppkey % 4 END), 8, '0')) AS b_raw", "4 AS width", "CASE WHEN l_linenumber = 2 THEN 8 ELSE 4 END AS b_width",
        "l_orderkey % 2 = 0 AS complete", "CASE l_returnflag WHEN 'R' THEN 'RESOLVED' WHEN 'A' THEN 'NULL' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'UNRESOLVED' END END AS b_status",
    )
    return graph.resolved(l).select("l_orderkey", "l_linenumber", "state")


@query("""SELECT kind, reason, count(*) AS n FROM (SELECT event_type AS kind, CASE WHEN event_id % 11 = 0 THEN 'EXCLUDED_NULL_TARGET' WHEN event_id % 3 = 0 THEN 'EXCLUDED_CONDITIONAL_UNION' WHEN NOT (user_id % 4 > 0) THEN 'EXCLUDED_UNADMITTED' ELSE 'ELIGIBLE' END AS reason FROM events) GROUP BY 1, 2""")
def q72_membership_population(a: Archive) -> DataFrame:
    e = a.table("events").selectExpr("event_type AS kind", "event_id % 3 = 0 AS conditional", "user_id % 4 > 0 AS admitted", "CASE WHEN event_id % 11 > 0 THEN event_id END AS target_id")
    return membership.population(e)


@query("""SELECT type_name, id, truncated FROM (SELECT *, sum(size) OVER (PARTITION BY type_name ORDER BY id ROWS UNBOUNDED PRECEDING) AS s, sum(size) OVER (PARTITION BY type_name) > 60000 AS truncated FROM alloc) WHERE s <= 60000""")
def q73_budgeted_rows(a: Archive) -> DataFrame:
    return graph.budgeted(a.alloc.select("type_name", "id", "size"), ["type_name"], ["id"], "size", 60000).select("type_name", "id", "truncated")


@query("""SELECT compatibility, count(*) AS n FROM (SELECT CASE WHEN k = 'void' THEN 'TYPE_ERASED' WHEN k = 'class' AND NOT adm THEN 'POINTEE_TYPE_UNESTABLISHED' WHEN k IN ('class', 'primitive') THEN CASE WHEN p = t THEN 'POINTEE_TYPE_COMPATIBLE' ELSE 'POINTEE_TYPE_MISMATCH' END ELSE 'POINTEE_TYPE_UNESTABLISHED' END AS compatibility
FROM (SELECT ['void', 'class', 'primitive', 'pointer'][1 + p_partkey % 4] AS k, p_brand AS p, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS t, p_size % 2 = 0 AS adm FROM part)) GROUP BY 1""")
def q74_link_compatibility(a: Archive) -> DataFrame:
    p = a.table("part").selectExpr("element_at(array('void', 'class', 'primitive', 'pointer'), CAST(1 + p_partkey % 4 AS INT)) AS pointee_kind", "p_brand AS pointee", "CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS target_type", "'EXACT_ELEMENT_START' AS view", "CAST(NULL AS STRING) AS base_name", "p_size % 2 = 0 AS admitted")
    return decode.compatible(p).groupBy("compatibility").agg(F.count("*").alias("n"))
