"""Sinks of reports and records, none of which writes over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.paging import packed


def json_lines(rows: DataFrame, path: str, compressed: bool = True) -> DataFrame:
    """A JSON object a line; gives the summary (rows, digest of the rows in any order)."""
    from ..operators.verify import table_digest

    rows.write.mode("errorifexists").option("compression", "gzip" if compressed else "none").json(path)
    return table_digest(rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("line")), ["line"])


def tagged_text(sections: list[tuple[str, DataFrame]], path: str) -> None:
    """Lines "TAG json" of several frames, each in its own folder part so that sections keep their order by name."""
    for i, (tag, df) in enumerate(sections):
        line = F.concat(F.lit(f"{tag} "), F.to_json(F.struct(*df.columns)))
        df.select(line.alias("value")).write.mode("errorifexists").text(f"{path}/{i:02d}_{tag}")


def text_pages(rows: DataFrame, group: list[str], order: list[str], text: str, page_bytes: int, path: str) -> None:
    """Records as text on pages of about page_bytes, a folder a page, records of a page in order."""
    sized = rows.withColumn("_size", F.octet_length(text) + 1)
    pages = packed(sized, group, order, "_size", page_bytes)
    key = F.concat_ws("_", *(F.col(g).cast("string") for g in group), F.format_string("%06d", "page"))
    pages = pages.withColumn("page_key", key).repartition("page_key").sortWithinPartitions("page_key", *order)
    pages.select("page_key", F.col(text).alias("value")).write.mode("errorifexists").partitionBy("page_key").text(path)


def hex_dump(files: DataFrame, width: int = 64) -> DataFrame:
    """(path, offset, hex) of binary files (path, content), a row for each `width` bytes."""
    rows = files.withColumn("k", F.explode(F.expr(f"sequence(0, greatest(0, (octet_length(content) - 1) div {width}))")))
    part = F.expr(f"substring(content, k * {width} + 1, {width})")
    return rows.select("path", (F.col("k").cast("long") * width).alias("offset"), F.lower(F.hex(part)).alias("hex"))


def preserved(dump: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose dump doesn't give their bytes back."""
    whole = dump.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "hex"))), lambda x: x["hex"]), "").alias("hex"))
    met = files.select("path", F.sha2("content", 256).alias("want")).join(whole.select("path", F.sha2(F.unhex("hex"), 256).alias("got")), "path", "left")
    return met.where(~F.col("want").eqNullSafe(F.col("got"))).select("path")
