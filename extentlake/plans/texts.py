"""Stored texts, blobs, indexes of documents, and layouts of classes over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binary
from ..operators import decode, verify
from .fixture import Archive
from .registry import registry

QUERIES, SQL, query = registry()


@query(r"""SELECT p_partkey, regexp_replace(path, '\[[0-9]+\]', '[]', 'g') AS symbolic, CASE WHEN p_partkey % 3 = 0 THEN 'N' || (p_partkey % 25) END AS element
FROM (SELECT p_partkey, 'a[' || (p_partkey % 7) || '].b[' || p_size || '].c' AS path FROM part)""")
def q111_symbolic_paths(a: Archive) -> DataFrame:
    """Paths without their indices, and the element type of List<T*>; List<T> and Set<T*> name none."""
    p = a.table("part").selectExpr(
        "p_partkey", "concat('a[', p_partkey % 7, '].b[', p_size, '].c') AS path",
        "concat(element_at(array('List< N', 'List<N', 'Set<N'), CAST(1 + p_partkey % 3 AS INT)), p_partkey % 25, element_at(array(' * >', '>', '*>'), CAST(1 + p_partkey % 3 AS INT))) AS type_name",
    )
    return p.select("p_partkey", binary.symbolic_path(F.col("path")).alias("symbolic"), binary.template_argument(F.col("type_name"), "List").alias("element"))


_TURNS = "SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"


@query(f"""SELECT check_name, count(*) AS n FROM (SELECT DISTINCT 'document_nodes.type' AS check_name, c, 0 AS place FROM ({_TURNS}) WHERE c % 13 = 0 AND c % 7 > 0 UNION ALL SELECT 'document_nodes.parent', c, place FROM ({_TURNS}) WHERE c % 7 = 0
UNION ALL SELECT DISTINCT 'document_nodes.children', c, 0 FROM ({_TURNS}) WHERE c % 5 = 0 UNION ALL SELECT 'document_nodes.order', c, place FROM ({_TURNS}) WHERE (c % 9 = 0 AND place > 0) OR (c % 11 = 0 AND place = 1 AND c % 7 > 0 AND c % 13 > 0)) GROUP BY 1""")
def q112_document_tree(a: Archive) -> DataFrame:
    """Conversations as sequences of turns, some with a wrong kind, count, parent, place or member."""
    turns = a.table("conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    t = turns.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("place"))
    roots = t.groupBy("conv_id").agg(F.count("*").alias("k")).selectExpr(
        "'c' AS kind", "CAST(conv_id AS STRING) AS name", "'' AS path", "CAST(NULL AS STRING) AS parent", "CAST(NULL AS STRING) AS member", "0L AS ordinal",
        "CASE WHEN conv_id % 7 = 0 THEN 'leaf' WHEN conv_id % 13 = 0 THEN 'odd' ELSE 'sequence' END AS node_type", "k + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS child_count",
    )
    leaves = t.selectExpr(
        "'c'", "CAST(conv_id AS STRING)", "CAST(place AS STRING)", "''", "CASE WHEN conv_id % 11 = 0 AND place = 1 THEN 'x' ELSE CAST(place AS STRING) END",
        "place + CASE WHEN conv_id % 9 = 0 AND place > 0 THEN 1 ELSE 0 END", "'leaf'", "0L",
    )
    found = verify.tree_violations(roots.union(leaves))
    whole = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return whole.groupBy("check_name").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ab' || p_partkey WHEN 1 THEN repeat('y', p_size) ELSE 'k' || p_partkey END AS text, CASE WHEN p_partkey % 3 = 0 THEN 'TERMINATED' WHEN p_partkey % 3 = 1 AND p_size >= 20 THEN 'TEXT_BOUND' ELSE 'ALLOCATION_END' END AS status FROM part""")
def q113_text_status(a: Archive) -> DataFrame:
    data = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(CAST(concat('ab', p_partkey) AS BINARY), X'007A7A') WHEN 1 THEN CAST(repeat('y', p_size) AS BINARY) ELSE CAST(concat('k', p_partkey) AS BINARY) END")
    p = a.table("part").select("p_partkey", data.alias("data"))
    return p.select("p_partkey", binary.latin1(F.col("data")).alias("text"), binary.text_status(F.col("data"), 20).alias("status"))


@query("""SELECT doc_id, status, CASE WHEN status = 'VERIFIED' THEN sha256(text) END AS sha256, CASE WHEN status = 'VERIFIED' THEN CAST(octet_length(encode(text)) AS BIGINT) END AS bytes
FROM (SELECT doc_id, text, CASE WHEN text IS NULL OR doc_id % 5 = 0 THEN 'MALFORMED_BLOB' WHEN doc_id % 7 = 0 THEN 'DIGEST_MISMATCH' ELSE 'VERIFIED' END AS status FROM documents)""")
def q114_blob_roundtrip(a: Archive) -> DataFrame:
    """Every text packed and unpacked; some blobs state a wrong length or digest."""
    d = a.table("documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    d = d.select("doc_id", F.octet_length("raw").cast("long").alias("size"), binary.packed_blobs(F.col("raw")).alias("blob"))
    length = F.col("size") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    digest = F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("blob.sha256"))
    got = d.select("doc_id", binary.unpacked_blob(F.col("blob.codec"), F.col("blob.data"), length, digest).alias("got"))
    return got.select("doc_id", "got.status", F.sha2("got.data", 256).alias("sha256"), F.octet_length("got.data").cast("long").alias("bytes"))


@query("SELECT p_partkey, -p_size::DOUBLE + (p_size::DOUBLE + 1 + p_size::DOUBLE) * (p_partkey * 1000)::DOUBLE / 1431655765::DOUBLE AS x FROM part")
def q115_dequantised(a: Archive) -> DataFrame:
    low = -F.col("p_size").cast("double")
    x = binary.dequantised(low, F.col("p_size").cast("double") + 1, (F.col("p_partkey") * 1000).cast("double"))
    return a.table("part").select("p_partkey", x.alias("x"))


@query("""SELECT 'N' || s_nationkey AS type_name, CASE WHEN s_nationkey % 6 = 0 OR bool_or(s_suppkey % 17 = 0) OR bool_or(s_suppkey % 23 = 0) THEN 'SOURCE_COMPACT_STORAGE_MISMATCH' ELSE 'STRUCTURALLY_CORROBORATED_SOURCE_LAYOUT' END AS admission FROM supplier GROUP BY s_nationkey""")
def q116_admitted_layouts(a: Archive) -> DataFrame:
    """Nations as classes, suppliers as their members: natively some have another category, a second node beside them, or the class another size."""
    s = a.table("supplier")
    base = ["concat('N', s_nationkey) AS type_name", "16L * s_suppkey AS at", "8L AS size"]
    kind = "element_at(array('int', 'ptr', 'f64'), CAST(1 + s_suppkey % 3 AS INT))"
    source = s.selectExpr(*base, f"{kind} AS category", "65536L AS type_size")
    sizes = "65536L + CASE WHEN s_nationkey % 6 = 0 THEN 8 ELSE 0 END AS type_size"
    native = s.selectExpr(*base, f"CASE WHEN s_suppkey % 17 = 0 THEN 'f32' ELSE {kind} END AS category", sizes)
    stray = s.where("s_suppkey % 23 = 0").selectExpr(base[0], "16L * s_suppkey + 4 AS at", "4L AS size", "'int' AS category", sizes)
    return decode.admitted(source, native.union(stray))
