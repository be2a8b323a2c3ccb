"""The corpus pipeline: documents that pass the quality rules, one of each group of near duplicates, none contaminated by the
benchmark, mixed to the sources' weights, and written as token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last returns a row for each document
written.  Rows that repeat a doc_id are one document to the filters after the first: they stay or go alike.

Nulls: a null or empty text fails the quality rules, so it goes in the first stage; alone, the other stages keep it, the last as
its end id.  A null doc_id is an id like others.  A null source is a source.  Ties: the smallest doc_id of a group stays, all rows of it.
Extra columns are kept, whatever their names, but by the last stage.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extentlake.llm import decontaminate, jaccard_join, mixing, quality, token_store
from extentlake.llm.shared import table, written

#: Words in a shingle, and least similarity in percent, of near duplicates.
SHINGLE, SIMILAR = 5, 80


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose doc_id isn't among those gone; a null doc_id is an id like others."""
    gone = gone.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs).where(quality.passes()).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component stays."""
    groups = jaccard_join.join_components(docs, k=SHINGLE, percent=SIMILAR)
    return _without(docs, groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mixed(written(mixing.sized(docs))).where("mix.copies > 0")  # a table, so that words are counted once
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int")))).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.token_output(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
    ("token-ID output", token_output),
]

#: Byte-pair encoding has no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
