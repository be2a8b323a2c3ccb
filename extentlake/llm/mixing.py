"""Mixing sources to target weights by systematic sampling.

Sources get shares of a total by weight, none above a multiple of its own size.  Within a source, documents stand in
an order by size; each expects target / size copies, the running sum of which starts from one offset of the source,
and a document comes out once for every whole number that the sum passes.  So every class of
sizes gives its part, and the words taken come near the target.

The running sum is taken in three steps, over a source's size classes (some 200 at most), over the slices of a class, and within
a slice, so that no task holds a source; a size class has one slice for each BLOCK documents, dealt by a digest of id and text.
Only the table of sources, a row for each, is ordered in one task.  Built-in functions only; the offset is a digest of the
source and the seed, so reruns agree.

Nulls: a null source is a source, the last; a null text has size 0.  Null ids come first within their block.  Repeated
rows each count.  Extra columns are kept in the struct row.  An empty table, or one without a word, takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import n_words
from .shared import table, written

#: Documents of a source and size class in one slice, about.
BLOCK = 1 << 8
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """(source, n_docs, source_size, target) from the same without target.

    What the limit of one source leaves goes to the others by weight until none is above, so a target is the limit or
    the weight times one level.  Sources in order of limit / weight: the level is settled by the first k whose limits hold.
    """
    spot = Window.orderBy(F.col("source").isNull(), "source")
    picked = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(spot) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", picked.cast("double")).withColumn("limit", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (percent * F.sum("source_size").over(everything) / 100.0 - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source in order that its weight times the level leaves within its limit sets the level for it and all after
    s = s.withColumn("settled", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return s.select("source", "n_docs", "source_size", F.least("limit", F.coalesce(F.col("weight") * F.col("settled"), F.col("limit"))).alias("target"))


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(row, doc_id, mix): the documents as a struct, and what the mix needs: size, source, a digest and the size class."""
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))).cast("binary"))
    mix = F.struct(n_words(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"), F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").alias("digest"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), mix.alias("mix"))
    return rows.withColumn("mix", F.col("mix").withField("class", F.floor(8 * F.log2(F.col("mix.size") + 1)).cast("int")))


def mixed(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Sized documents with struct `mix`: size, source_size, target and copies.  Of their columns row may lack."""
    others = [c for c in rows.columns if c != "mix"]
    groups = rows.groupBy(F.col("mix.source").alias("g_source"), F.col("mix.class").alias("g_class")).agg(F.count("*").alias("n"), F.sum("mix.size").alias("words"))
    smaller = Window.partitionBy("g_source").orderBy("g_class").rowsBetween(Window.unboundedPreceding, -1)
    groups = written(groups.withColumn("smaller", F.coalesce(F.sum("n").over(smaller), F.lit(0))))
    aims = targets(groups.groupBy(F.col("g_source").alias("source")).agg(F.sum("n").alias("n_docs"), F.sum("words").alias("source_size")))
    cut = groups.join(aims, F.col("g_source").eqNullSafe(F.col("source"))).select("g_source", "g_class", "smaller", F.ceil(F.col("n") / BLOCK).alias("slices"), "source_size", "target")
    rows = rows.join(written(cut), F.expr("mix.source <=> g_source AND mix.class = g_class"))
    rows = rows.withColumn("mix", F.col("mix").withField("slice", F.pmod("mix.digest", F.col("slices"))))
    blocks = rows.groupBy(F.col("mix.source").alias("b_source"), F.col("mix.class").alias("b_class"), F.col("mix.slice").alias("b_slice")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("b_source", "b_class").orderBy("b_slice").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n"))
    place = Window.partitionBy("mix.source", "mix.class", "mix.slice").orderBy("doc_id", "mix.size", "mix.digest")
    rows = rows.withColumn("mix", F.col("mix").withField("place", F.row_number().over(place)))
    rows = rows.join(blocks, F.expr("mix.source <=> b_source AND mix.class = b_class AND mix.slice = b_slice"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("mix.source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ranked = (F.col("smaller") + F.col("before") + F.col("mix.place")).cast("double")
    copies = (F.floor(ranked * rate + offset) - F.floor((ranked - 1) * rate + offset)).cast("long")
    mix = F.struct(F.col("mix.size").alias("size"), "source_size", "target", F.least(copies, F.lit(2)).alias("copies"))  # a rate of 2 may round to 3
    return rows.select(*others, mix.alias("mix"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "mix"))
    return mixed(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


QUERIES = {"op4_mixing": op4_mixing}
SQL = {
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
e AS (SELECT *, CAST(floor(8 * log2(size + 1)) AS INT) AS class FROM d),
c AS (SELECT *, digest % ((count(*) OVER (PARTITION BY source, class) + 255) // 256) AS slice FROM e),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
v AS (
  SELECT *, cap / weight AS ratio,
    (150 * sum(source_size) OVER () / 100.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
a AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, ratio) FROM v WHERE level <= ratio), cap)) AS target FROM v),
p AS (
  SELECT c.doc_id, c.size, a.source_size, a.target, row_number() OVER (PARTITION BY c.source ORDER BY class, slice, doc_id NULLS FIRST, size, digest) AS k,
    CAST('0x' || substr(md5('0:' || coalesce(c.source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u,
    CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate
  FROM c JOIN a ON c.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  size * CAST(least(2, floor(CAST(k AS DOUBLE) * rate + u) - floor((CAST(k AS DOUBLE) - 1) * rate + u)) AS BIGINT) AS taken
FROM p"""
}
