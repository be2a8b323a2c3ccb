"""An archive derived from the given tables, in Spark and, with the same values, as common table expressions for DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.census import edges, element_count

CTES = {
    "alloc0": """SELECT id, segment, cluster, size, type_name, vector, element_stride, array_header_size,
  CAST(coalesce(sum(size + 16) OVER (PARTITION BY segment, cluster ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical_offset
FROM (SELECT doc_id AS id, CAST(dense_rank() OVER (ORDER BY lang) AS BIGINT) AS segment, CAST(1 + doc_id % 3 AS BIGINT) AS cluster,
  CAST(greatest(n_chars, 4) AS BIGINT) AS size, concat('T', CAST(doc_id % 7 AS VARCHAR)) AS type_name, CAST(doc_id % 2 AS INT) AS vector,
  CAST(4 * (1 + doc_id % 5) AS BIGINT) AS element_stride, CAST(16 * (doc_id % 2) AS BIGINT) AS array_header_size FROM documents)""",
    "alloc": "SELECT *, CASE vector WHEN 1 THEN (size - array_header_size) // element_stride ELSE 1 END AS element_count FROM alloc0",
    "clus": "SELECT segment, cluster, CAST(max(logical_offset + size) + 16 AS BIGINT) AS allocated_bytes FROM alloc GROUP BY 1, 2",
    "ptr0": """SELECT l.segment, l.cluster, l.so % c.allocated_bytes AS logical_offset, max(l.width) AS width, max(l.status) AS status, max(l.ta % c.allocated_bytes) AS target_offset
FROM (SELECT 1 + l_orderkey % 4 AS segment, 1 + l_partkey % 3 AS cluster, l_partkey * 7919 + l_orderkey * 13 + l_linenumber * 104729 AS so,
  l_suppkey * 7907 + l_orderkey * 31 AS ta, CASE WHEN l_linenumber % 2 = 0 THEN 8 ELSE 4 END AS width,
  CASE l_returnflag WHEN 'R' THEN 'RESOLVED' WHEN 'A' THEN 'NULL' ELSE 'UNRESOLVED' END AS status FROM lineitem) l
JOIN clus c ON c.segment = l.segment AND c.cluster = l.cluster GROUP BY 1, 2, 3""",
    "ptr": """SELECT p.segment, p.cluster, p.logical_offset, p.width, p.status,
  CASE WHEN p.status = 'RESOLVED' THEN c.segment END AS target_segment, CASE WHEN p.status = 'RESOLVED' THEN c.cluster END AS target_cluster,
  CASE WHEN p.status = 'RESOLVED' THEN p.target_offset % c.allocated_bytes END AS target_offset
FROM ptr0 p JOIN clus c ON c.segment = 1 + (p.logical_offset % 4) AND c.cluster = 1 + (p.target_offset % 3)""",
    "held": """SELECT p.*, CASE WHEN p.logical_offset + p.width <= a.logical_offset + a.size THEN a.id END AS s_id
FROM ptr p ASOF LEFT JOIN alloc a ON a.segment = p.segment AND a.cluster = p.cluster AND a.logical_offset <= p.logical_offset""",
    "aimed": """SELECT p.*, CASE WHEN p.target_offset < a.logical_offset + a.size THEN a.id END AS t_id
FROM held p ASOF LEFT JOIN alloc a ON a.segment = p.target_segment AND a.cluster = p.target_cluster AND a.logical_offset <= p.target_offset""",
    "edge": """SELECT e.*, s.type_name AS s_type, t.type_name AS t_type,
  CASE WHEN s.id IS NULL THEN NULL WHEN s.vector = 1 AND s.element_stride > 0 THEN (e.logical_offset - s.logical_offset - coalesce(s.array_header_size, 0)) % s.element_stride
    ELSE e.logical_offset - s.logical_offset END AS displacement
FROM aimed e LEFT JOIN alloc s ON s.id = e.s_id LEFT JOIN alloc t ON t.id = e.t_id""",
    "chunk": """SELECT a.segment, a.cluster, a.logical_offset AS logical_start, octet_length(encode(d.text)) AS length, encode(d.text) AS data, a.id
FROM alloc a JOIN documents d ON d.doc_id = a.id WHERE octet_length(encode(d.text)) > 0""",
}


def with_ctes(body: str, *extra: str) -> str:
    """The query with the expressions that it needs before it."""
    import re

    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                need(CTES[name])
                wanted.add(name)

    need(body)
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in wanted] + list(extra)
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


class Archive:
    """The derived archive's frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def alloc(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "lang", "n_chars")
        ranks = docs.select("lang").distinct().withColumn("segment", F.dense_rank().over(Window.orderBy("lang")).cast("long"))
        a = docs.join(F.broadcast(ranks), docs["lang"].eqNullSafe(ranks["lang"])).selectExpr(
            "doc_id AS id", "segment", "CAST(1 + doc_id % 3 AS BIGINT) AS cluster", "CAST(greatest(n_chars, 4) AS BIGINT) AS size", "concat('T', doc_id % 7) AS type_name",
            "CAST(doc_id % 2 AS INT) AS vector", "CAST(4 * (1 + doc_id % 5) AS BIGINT) AS element_stride", "CAST(16 * (doc_id % 2) AS BIGINT) AS array_header_size",
        )
        before = Window.partitionBy("segment", "cluster").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        a = a.withColumn("logical_offset", F.coalesce(F.sum(F.col("size") + 16).over(before), F.lit(0)).cast("long"))
        return a.withColumn("element_count", element_count())

    @cached_property
    def clus(self) -> DataFrame:
        return self.alloc.groupBy("segment", "cluster").agg((F.max(F.col("logical_offset") + F.col("size")) + 16).cast("long").alias("allocated_bytes"))

    @cached_property
    def ptr(self) -> DataFrame:
        l = self.table("lineitem").selectExpr(
            "1 + l_orderkey % 4 AS segment", "1 + l_partkey % 3 AS cluster", "l_partkey * 7919 + l_orderkey * 13 + l_linenumber * 104729 AS so", "l_suppkey * 7907 + l_orderkey * 31 AS ta",
            "CASE WHEN l_linenumber % 2 = 0 THEN 8 ELSE 4 END AS width", "CASE l_returnflag WHEN 'R' THEN 'RESOLVED' WHEN 'A' THEN 'NULL' ELSE 'UNRESOLVED' END AS status",
        )
        clus = F.broadcast(self.clus)  # one row a cluster: 3 for each language
        p = l.join(clus, ["segment", "cluster"]).withColumns({"logical_offset": F.expr("so % allocated_bytes"), "target": F.expr("ta % allocated_bytes")})
        p = p.groupBy("segment", "cluster", "logical_offset").agg(F.max("width").alias("width"), F.max("status").alias("status"), F.max("target").alias("target"))
        to = self.clus.toDF("t_segment", "t_cluster", "t_bytes")
        p = p.join(F.broadcast(to), F.expr("t_segment = 1 + (logical_offset % 4) AND t_cluster = 1 + (target % 3)"))
        when = lambda e: F.when(F.col("status") == "RESOLVED", F.expr(e))
        return p.select("segment", "cluster", "logical_offset", "width", "status", when("t_segment").alias("target_segment"), when("t_cluster").alias("target_cluster"), when("target % t_bytes").alias("target_offset"))

    @cached_property
    def edge(self) -> DataFrame:
        return edges(self.ptr, self.alloc)

    @cached_property
    def chunk(self) -> DataFrame:
        docs = self.table("documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("data"))
        a = self.alloc.select("id", "segment", "cluster", F.col("logical_offset").alias("logical_start"))
        return a.join(docs, "id").withColumn("length", F.octet_length("data").cast("long")).where("length > 0")
