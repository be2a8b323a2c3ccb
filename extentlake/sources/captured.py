"""Captured archives in SQLite files, read as a data source split by row ranges, and whole files with their digests."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import KEYS, TABLES

#: Rows of one task.
ROWS = 50_000


def _opened(path: str) -> sqlite3.Connection:
    """Read-only and immutable: no journal is looked for and nothing is written beside the file."""
    con = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
    con.execute("PRAGMA query_only=ON")
    return con


class Page(InputPartition):
    """Rows of a table from one key on, before another."""

    def __init__(self, low: tuple | None, high: tuple | None):
        self.low, self.high = low, high


class CapturedReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.name, self.schema = options["path"], options["table"], schema
        self.keys, self.rows = KEYS[self.name], int(options.get("rows", ROWS))

    def partitions(self) -> list[InputPartition]:
        """Cuts at every so many keys; each task seeks its first key in the table's own order."""
        order, cuts = ", ".join(self.keys), []
        with closing(_opened(self.path)) as con:
            if con.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (self.name,)).fetchone()[0] == 0:
                return []
            low: tuple | None = None
            while True:
                after = f"WHERE ({order}) >= ({', '.join('?' * len(self.keys))})" if low else ""
                row = con.execute(f"SELECT {order} FROM {self.name} {after} ORDER BY {order} LIMIT 1 OFFSET {self.rows}", low or ()).fetchone()
                cuts.append(Page(low, row))
                if row is None:
                    return cuts
                low = row

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # the archive lacks the table
            return
        order, marks = ", ".join(self.keys), ", ".join("?" * len(self.keys))
        where = [f"({order}) >= ({marks})"] * (partition.low is not None) + [f"({order}) < ({marks})"] * (partition.high is not None)
        with closing(_opened(self.path)) as con:
            have = {r[1] for r in con.execute(f"PRAGMA table_info({self.name})")}
            columns = ", ".join(f.name if f.name in have else "NULL" for f in self.schema)
            sql = f"SELECT {columns} FROM {self.name} {'WHERE ' + ' AND '.join(where) if where else ''} ORDER BY {order}"
            for row in con.execute(sql, (*(partition.low or ()), *(partition.high or ()))):
                yield tuple(bool(v) if isinstance(f.dataType, T.BooleanType) and v is not None else v for v, f in zip(row, self.schema, strict=True))


class Captured(DataSource):
    """spark.read.format("captured").option("table", name).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> T.StructType:
        return TABLES[self.options["table"]]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CapturedReader(dict(self.options), schema)


def captured(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a captured archive; the file must be at the path on every machine."""
    spark.dataSource.register(Captured)
    return {name: spark.read.format("captured").option("table", name).load(path) for name in TABLES}


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified, sha256) of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files that are other than at the first look: gone, new, or with other bytes."""
    j = before.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is_")), "path", "full")
    state = F.when(F.col("is_").isNull(), "GONE").when(F.col("was").isNull(), "NEW").when(F.col("was") != F.col("is_"), "CHANGED")
    return j.select("path", state.alias("state")).where("state IS NOT NULL")
