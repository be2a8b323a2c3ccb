"""Event-time windows, for batch frames and streams alike, and runs that go on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts by window; a stream needs `late`, the delay after which its state goes.  Users are exact in a batch and approximate in a
    stream, where distinct ones would be kept whole."""
    streams = events.isStreaming
    events = events.withWatermark("ts", late) if late else events
    users = F.approx_count_distinct("user_id") if streams else F.count_distinct("user_id")
    return events.groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n"), users.alias("users")).withColumns({"start": F.col("window.start"), "stop": F.col("window.end")}).drop("window")


def sliding(events: DataFrame, size: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", size, step), *keys).agg(F.count("*").alias("n")).withColumns({"start": F.col("window.start"), "stop": F.col("window.end")}).drop("window")


def sessions(events: DataFrame, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n")).withColumns({"start": F.col("session_window.start"), "stop": F.col("session_window.end")}).drop("session_window")


def last_state(events: DataFrame) -> DataFrame:
    """The last event of each user, ties by id."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


def resume(spark: SparkSession, source: str, schema, checkpoint: str, pin: str, apply: Callable[[DataFrame, int], None], files: int | None = None) -> None:
    """Takes what is new below a folder of Parquet files, each file once, in batches that are committed under a pin.

    The pin names source, configuration and code: another pin has another checkpoint, so a run never goes on
    with state that was made otherwise.
    """
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    stream = reader.parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/{pin}").trigger(availableNow=True).start()
    stream.awaitTermination()


def counted(spark: SparkSession, source: str, schema, keys: list[str], checkpoint: str, pin: str, table: str) -> None:
    """Counters by key, kept in a Parquet folder: each batch is added to what the one before left, exactly once.

    Batch i reads generation i - 1 and writes generation i, so a batch that is done again gives the same.
    """

    def add(batch: DataFrame, i: int) -> None:
        new = batch.groupBy(*keys).agg(F.count("*").alias("n"))
        if i:
            new = new.unionByName(spark.read.parquet(f"{table}/generation={i - 1}")).groupBy(*keys).agg(F.sum("n").alias("n"))
        new.write.mode("overwrite").parquet(f"{table}/generation={i}")

    resume(spark, source, schema, checkpoint, pin, add, files=1)
