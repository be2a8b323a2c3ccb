"""Commands over written archives: python -m extentlake.cli COMMAND ARCHIVE [..]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import census, graph, verify
from .sources import captured, exports, store


def _alloc(s: store.Store) -> DataFrame:
    meta = s.table("allocation_templates").select(F.col("id").alias("template_id"), *(F.get_json_object("metadata", f"$.{k}").cast("long").alias(k) for k in ("element_stride", "array_header_size")))
    a = s.allocations().join(meta, "template_id", "left")
    return a.withColumns({"vector": F.col("vector").cast("int"), "array_header_size": F.coalesce("array_header_size", F.lit(0).cast("long"))})


def _edges(s: store.Store) -> DataFrame:
    return census.edges(s.table("pointers"), _alloc(s))


def main(given: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="extentlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "verify", "datasets", "discover", "links", "walk", "capture", "export"):
        c = sub.add_parser(name)
        c.add_argument("archive")
        if name in ("links", "walk"):
            c.add_argument("allocation", type=int)
        if name == "links":
            c.add_argument("--direction", choices=("out", "in"), default="out")
            c.add_argument("--limit", type=int, default=100)
        if name in ("capture", "export"):
            c.add_argument("output")
    a = p.parse_args(given)
    spark = SparkSession.builder.appName("extentlake").getOrCreate()
    if a.command == "capture":
        faults = store.write(spark, a.output, {n: store.written(df) for n, df in captured.captured(spark, a.archive).items() if n != "manifest"})
        faults.show(50, False)
        return int(not faults.isEmpty())
    s = store.Store(spark, a.archive)
    if a.command == "info":
        print(json.dumps(s.manifest, indent=2, sort_keys=True))
    elif a.command == "verify":
        faults = verify.violations({n: s.table(n) for n in store.TABLES if n != "manifest"}).union(s.blobs().where("status != 'VERIFIED'").selectExpr("concat('blobs.', status)", "sha256"))
        faults.show(50, False)
        return int(not faults.isEmpty())
    elif a.command == "datasets":
        census.type_census(_alloc(s)).orderBy("type_name").show(1000, False)
    elif a.command == "discover":
        census.reference_shapes(_edges(s)).orderBy(F.desc("n")).show(1000, False)
    elif a.command == "links":
        graph.neighbours(_edges(s), a.allocation, a.direction, None, a.limit).select("s_id", "s_type", "t_id", "t_type", "status", "displacement").show(a.limit, False)
    elif a.command == "walk":
        e = _edges(s).where("s_id IS NOT NULL AND t_id IS NOT NULL").selectExpr("s_id AS source", "t_id AS target", "struct(segment, cluster, logical_offset) AS link_id")
        print(json.dumps(graph.walk(e, a.allocation), default=str))
    else:
        exports.json_lines(_alloc(s), a.output).show(1, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
