"""What the operators share: the folder that all machines see, tables written there, and bitmaps of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits, as a power of two, of the largest bitmap that goes to all executors: 16 MB whatever the input.
BITMAP_BITS = 27


@cache
def _local() -> str:
    return f"file://{tempfile.mkdtemp(prefix='extentlake')}"


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a local folder if everything runs on one machine, else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = _local()
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bits_for(n: int) -> int:
    """Bits of a bitmap in which n places fill an eighth, within BITMAP_BITS."""
    return min(max(8 * n, 1 << 16).bit_length(), BITMAP_BITS)


def bitmap(places: DataFrame, column: str, bits: int) -> bytes:
    """The set bits at the places of a column of longs from 0 to 2**bits - 1, as bytes, lowest bit first."""
    parts = places.groupBy(F.shiftright(column, 15).alias("part")).agg(F.expr(f"bitmap_construct_agg({column} & 32767)").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for part, got in parts.toLocalIterator():
        out[part << 12 : (part + 1) << 12] = np.frombuffer(got, np.uint8)
    return out.tobytes()


def marked(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which places are set in a bitmap."""
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
