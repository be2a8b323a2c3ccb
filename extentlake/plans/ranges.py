"""Sweeps over intervals, reads of bytes, and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals, paging
from .fixture import Archive
from .registry import registry

QUERIES, SQL, query = registry()
_WIDE = "SELECT segment, cluster, logical_offset, size + (id % 40) AS size FROM alloc"


@query(f"""SELECT segment, cluster, logical_offset, previous_end FROM (SELECT *, CAST(max(logical_offset + size) OVER (PARTITION BY segment, cluster ORDER BY logical_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS previous_end
FROM ({_WIDE})) WHERE logical_offset < previous_end""")
def q11_overlap_check(a: Archive) -> DataFrame:
    wide = a.alloc.selectExpr("segment", "cluster", "logical_offset", "size + (id % 40) AS size")
    return intervals.overlaps(wide, "logical_offset", "size").select("segment", "cluster", "logical_offset", "previous_end")


@query("""SELECT part, first, last, expected FROM (SELECT *, coalesce(lag(last) OVER (PARTITION BY part ORDER BY first, last), 0) AS expected
FROM (SELECT l_partkey AS part, l_orderkey AS first, l_orderkey + l_linenumber AS last FROM lineitem)) WHERE first <> expected""")
def q12_contiguity_check(a: Archive) -> DataFrame:
    r = a.table("lineitem").selectExpr("l_partkey AS part", "l_orderkey AS first", "l_orderkey + l_linenumber AS last")
    return intervals.breaks(r, "part", "first", "last").select("part", "first", "last", "expected")


_STEPS = "SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS first, CAST(l_linenumber + 1 AS BIGINT) AS last, l_returnflag AS status FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)"


@query(f"""SELECT o, status, min(first) AS first, max(last) AS last, count(*) AS n_rows FROM (SELECT *, sum(n) OVER (PARTITION BY o ORDER BY first, status ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN lag(status) OVER w IS NOT DISTINCT FROM status AND lag(last) OVER w IS NOT DISTINCT FROM first THEN 0 ELSE 1 END AS n FROM ({_STEPS}) WINDOW w AS (PARTITION BY o ORDER BY first, status)))
GROUP BY o, status, island""")
def q13_coalesce_ranges(a: Archive) -> DataFrame:
    r = a.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    r = r.selectExpr("l_orderkey AS o", "CAST(l_linenumber AS BIGINT) AS first", "CAST(l_linenumber + 1 AS BIGINT) AS last", "l_returnflag AS status")
    r = r.withColumn("at", F.struct("first", "status"))
    return intervals.coalesced(r, ["o"], "at", ["status"], "first", "last").select("o", "status", "first", "last", "n_rows")


@query("""SELECT segment, cluster, first, last FROM (SELECT segment, cluster, logical_offset AS last, CAST(coalesce(max(logical_offset + size) OVER (PARTITION BY segment, cluster ORDER BY logical_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
FROM (SELECT segment, cluster, logical_offset, size FROM alloc UNION ALL SELECT segment, cluster, allocated_bytes, 0 FROM clus)) WHERE first < last""")
def q14_unindexed_gaps(a: Archive) -> DataFrame:
    return intervals.gaps(a.alloc, a.clus, "logical_offset", "size", "allocated_bytes")


@query("""SELECT segment, cluster, logical_offset, size FROM alloc a WHERE EXISTS (SELECT 1 FROM ptr p WHERE p.segment = a.segment AND p.cluster = a.cluster AND p.width = 8 AND p.logical_offset < a.logical_offset + a.size AND a.logical_offset < p.logical_offset + p.width)""")
def q20_overlap_exists(a: Archive) -> DataFrame:
    p = a.ptr.where("width = 8").selectExpr("segment", "cluster", "logical_offset", "CAST(width AS BIGINT) AS width")
    return intervals.overlapping(a.alloc.select("segment", "cluster", "logical_offset", "size"), p, "left_semi", "logical_offset", "size", "logical_offset", "width")


@query("""SELECT segment, cluster, logical_offset, width FROM ptr p WHERE NOT EXISTS (SELECT 1 FROM alloc a WHERE p.segment = a.segment AND p.cluster = a.cluster AND a.logical_offset <= p.logical_offset AND p.logical_offset + p.width <= a.logical_offset + a.size)""")
def q21_not_exists_containment(a: Archive) -> DataFrame:
    al = a.alloc.select("segment", "cluster", "logical_offset", "size")
    return intervals.covered_by(a.ptr.select("segment", "cluster", "logical_offset", "width"), al, "left_anti", "logical_offset", "width", "logical_offset", "size")


_REQUESTS = "SELECT id AS request_id, segment, cluster, logical_offset + id % 7 AS offset, 40 + (id % 3) * 5000 AS size FROM alloc"


@query(f"""SELECT r.request_id, CASE WHEN octet_length(c.data) >= r.offset - c.logical_start + r.size THEN 'READ' ELSE 'INCOMPLETE' END AS status,
  CASE WHEN octet_length(c.data) >= r.offset - c.logical_start + r.size THEN substr(hex(c.data), 2 * (r.offset - c.logical_start) + 1, 2 * r.size) END AS bytes
FROM ({_REQUESTS}) r LEFT JOIN chunk c ON c.id = r.request_id""")
def q28_logical_read(a: Archive) -> DataFrame:
    # an allocation's bytes may run over it, as its size counts characters: each has an address space of its own
    r = a.alloc.selectExpr("id AS request_id", "segment", "id AS cluster", "logical_offset + id % 7 AS offset", "40 + (id % 3) * 5000 AS size")
    # chunks of 1,000 bytes, so that requests cross them
    c = a.chunk.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / 1000).cast("int"))))
    c = c.selectExpr("segment", "id AS cluster", "logical_start + k * 1000 AS logical_start", "least(1000, length - k * 1000) AS length", "substring(data, CAST(k * 1000 + 1 AS INT), 1000) AS data")
    return intervals.logical_read(r, c).select("request_id", "status", F.hex("data").alias("bytes"))


@query("""SELECT request_id, e.first AS logical_start, e.physical + e.first - e.base AS physical_start, e.last - e.first AS length FROM (
  SELECT r.request_id, greatest(r.offset, x.base) AS first, least(r.offset + r.size, x.base + x.len) AS last, x.base, x.physical FROM (SELECT id AS request_id, segment, cluster, logical_offset AS offset, size FROM alloc) r
  JOIN (SELECT segment, cluster, k * 4096 AS base, 4096 AS len, 512 + segment * 1000000007 + cluster * 100000007 + (k * 7919 % 1000003) * 4096 AS physical FROM (SELECT segment, cluster, unnest(range(1 + allocated_bytes // 4096)) AS k FROM clus)) x
  ON x.segment = r.segment AND x.cluster = r.cluster AND x.base < r.offset + r.size AND r.offset < x.base + x.len) e""")
def q59_physical_spans(a: Archive) -> DataFrame:
    pages = a.clus.withColumn("k", F.explode(F.expr("sequence(0L, allocated_bytes div 4096)")))
    ext = pages.selectExpr("segment", "cluster", "k * 4096 AS logical_start", "4096L AS length", "512 + segment * 1000000007 + cluster * 100000007 + (k * 7919 % 1000003) * 4096 AS physical_start")
    r = a.alloc.selectExpr("id AS request_id", "segment", "cluster", "logical_offset AS offset", "size")
    return intervals.physical_spans(r, ext)


@query("""SELECT g.segment, g.cluster, c.start AS chunk_start, greatest(g.first, c.start) AS first, least(g.last, c.start + 10000) AS last FROM (
  SELECT segment, cluster, last - 16 AS first, last FROM (SELECT segment, cluster, logical_offset + size + 16 AS last FROM alloc)) g
JOIN (SELECT segment, cluster, unnest(range(1 + allocated_bytes // 10000)) * 10000 AS start FROM clus) c ON c.segment = g.segment AND c.cluster = g.cluster AND c.start < g.last AND g.first < c.start + 10000""")
def q60_gaps_by_chunk(a: Archive) -> DataFrame:
    gap = intervals.gaps(a.alloc, a.clus, "logical_offset", "size", "allocated_bytes")
    c = a.clus.withColumn("k", F.explode(F.expr("sequence(0L, allocated_bytes div 10000)"))).selectExpr("segment", "cluster", "k * 10000 AS logical_start", "10000L AS length")
    return intervals.clipped_gaps(gap, c)


@query("""SELECT page, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, segment FROM (SELECT *, CAST(floor(coalesce(sum(size) OVER (PARTITION BY segment ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 32768) AS BIGINT) AS page FROM alloc) GROUP BY segment, page""")
def q37_page_packing(a: Archive) -> DataFrame:
    p = paging.packed(a.alloc, ["segment"], ["id"], "size", 32768)
    return p.groupBy("segment", "page").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
