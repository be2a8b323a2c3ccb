"""An archive as a set of Parquet tables with a manifest, and whole tables in the shared folder."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TABLES
from ..operators import verify

FORMAT, VERSION = "extentlake-archive", 1
CAPABILITIES = {"tables", "document-index"}
#: What a reader takes at most in one value.
MAX_BLOB, MAX_JSON = 16 << 20, 16 << 20


@cache
def _local() -> str:
    return f"file://{tempfile.mkdtemp(prefix='extentlake')}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a table below spark.checkpoint.dir, where its lineage ends."""
    top = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError("IO_FAILURE: spark.checkpoint.dir must name a folder that all machines share")
        top = _local()
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """A written archive, opened for reading: its version and capabilities are checked, its tables are frames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        manifest = {r.key: json.loads(r.value) for r in self.table("manifest").limit(1000).collect()}
        if manifest.get("format") != FORMAT or manifest.get("version") != VERSION:
            raise ValueError("UNSUPPORTED_LAYOUT: not an archive of a known version")
        if unknown := set(manifest.get("capabilities", [])) - CAPABILITIES:
            raise ValueError(f"UNSUPPORTED_LAYOUT: unknown capabilities {sorted(unknown)}")
        self.manifest = manifest

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def allocations(self, segment: int | None = None, cluster: int | None = None, name: str | None = None, names: list[str] | None = None) -> DataFrame:
        """Allocations with their names, in address order; either one name or some names, of which none gives nothing."""
        if name is not None and names is not None:
            raise ValueError("INVALID_ARGUMENT: name and names exclude each other")
        rows = self.table("allocations").join(self.table("names").withColumnsRenamed({"id": "name_id", "name": "type_name"}), "name_id")
        for c, v in (("segment", segment), ("cluster", cluster), ("type_name", name)):
            rows = rows.where(F.col(c) == v) if v is not None else rows
        rows = rows.where(F.col("type_name").isin(names)) if names is not None else rows
        return rows.orderBy("segment", "cluster", "logical_offset")

    def blobs(self) -> DataFrame:
        """(sha256, data, status): blobs inflated and checked; what is over the policy is left out with its state."""
        from ..functions.binary import unpacked_blob

        b = self.table("blobs")
        ok = (F.col("raw_length") <= MAX_BLOB) & (F.octet_length("data") <= MAX_BLOB)
        read = b.where(ok).withColumn("x", unpacked_blob("codec", "data", "raw_length", "sha256")).select("sha256", "x.data", "x.status")
        return read.unionByName(b.where(~ok).select("sha256", F.lit(None).cast("binary").alias("data"), F.lit("RESOURCE_BOUND").alias("status")))

    def chunks(self) -> DataFrame:
        c, b = self.table("chunks"), self.blobs().withColumnRenamed("sha256", "blob_sha256")
        return c.join(b, "blob_sha256").select("segment", "cluster", "logical_start", "length", "data", "status")

    def document(self, kind: str, name: str) -> DataFrame:
        d = self.table("documents").where((F.col("kind") == kind) & (F.col("name") == name)).withColumnRenamed("blob_sha256", "sha256")
        return d.join(self.blobs(), "sha256").select("kind", "name", F.decode("data", "UTF-8").alias("json"), "status")


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: dict | None = None) -> DataFrame:
    """Writes the tables after their constraints hold, the manifest last, so what isn't whole can't be opened.

    Gives the violations, and writes nothing where there is one.
    """
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"INVALID_ARGUMENT: no such tables {sorted(unknown)}")
    given = {n: df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[n])) for n, df in tables.items()}
    empty = lambda n: spark.createDataFrame([], TABLES[n])
    full = {n: given.get(n, empty(n)) for n in TABLES if n != "manifest"}
    faults = written(verify.violations(full))
    if faults.isEmpty():
        for n, df in full.items():
            spread = ["segment", "cluster"] if n in ("allocations", "pointers") else None
            (df.repartition(*spread, F.expr("logical_offset div 16777216")) if spread else df).write.mode("errorifexists").parquet(f"{path}/{n}")
        counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in full.items()]
        entries = {"format": FORMAT, "version": VERSION, "capabilities": sorted(CAPABILITIES), **(manifest or {}), "counts": {r["name"]: r.n for r in reduce(DataFrame.union, counts).collect()}}
        rows = [(k, json.dumps(v, sort_keys=True, separators=(",", ":"))) for k, v in entries.items()]
        spark.createDataFrame(rows, TABLES["manifest"]).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return faults
