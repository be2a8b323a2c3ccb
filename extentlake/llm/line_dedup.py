"""Line deduplication across documents.

Each text is split at line ends and its lines are normalised; the distinct keys of a document are hashed and
exploded, documents counted for each hash, and the lines of a key over the threshold dropped except in the largest
doc_id that holds it.  Only hashes and line numbers are shuffled; the text moves once, to meet the numbers of the
lines it loses.  Built-in functions only.

A common key is pre-aggregated by (key, document) before its documents are counted; the join back is one that adaptive execution splits.

Nulls: a null or empty text is one empty line, and its digest is that of the empty text.  A null doc_id is not counted
and keeps no line that goes elsewhere.  Repeated rows of a doc_id are one document: all lose or keep a line alike.
Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import WHITE, let, lower_ascii
from .shared import table, written


def keyed(docs: DataFrame, text: str, least_chars: int) -> DataFrame:
    """(doc_id, text_hash, key, places): the distinct keys of each document that are long enough, hashed, with their line numbers."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keys = F.transform(F.split(lower_ascii(t), "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(WHITE)).alias("k"), i.alias("i")))
    long_ = F.filter(keys, lambda x: F.length(x["k"]) >= least_chars)
    hashed = F.transform(long_, lambda x: F.struct(F.md5(x["k"]).alias("key"), x["i"].alias("i")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), F.explode(hashed).alias("x"))
    return rows.select("doc_id", "text_hash", F.unhex("x.key").alias("key"), F.col("x.i").alias("place"))


def dropped(docs: DataFrame, text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, places): numbers, from 0, of the lines that each text loses."""
    lines = keyed(docs, text, least_chars)
    counts = lines.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_docs)
    counts = written(counts.select("key", "keeper"))  # apart from the join, so that adaptive execution can split a common key there
    gone = lines.join(counts, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))


def deduplicated(docs: DataFrame, text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for each row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    gone = dropped(docs, text, least_chars, least_docs).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "places")
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    n_lines = (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    lines = F.split("text", "\n")
    # the numbers in order are walked along with the lines: from one number to the next the lines between are kept
    stops = F.concat(F.array(F.lit(-1)), F.sort_array("places"), F.array(F.size(lines)))
    kept = let(
        lines,
        lambda x: let(
            stops,
            lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.slice(x, s[k - 1] + 2, s[k] - s[k - 1] - 1))),
        ),
    )
    return met.select(
        "doc_id",
        n_lines.alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {
    "op5_line_dedup": r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t)),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id != k.keeper AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""
}
