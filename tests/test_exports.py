import zlib

import pytest

from extentlake.sources.store import written
from extentlake.operators import decode, discovery, geometry, graph
from extentlake.sources import exports
from extentlake.streaming import windows


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(50)], "id long, t string")
    s = exports.json_lines(df, f"file://{tmp_path}/j").first()
    assert s.rows == 50 and spark.read.json(f"file://{tmp_path}/j").count() == 50
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        exports.json_lines(df, f"file://{tmp_path}/j")
    exports.tagged_text([("HEADER", df.limit(1)), ("VALUE", df)], f"file://{tmp_path}/t")
    assert spark.read.text(f"file://{tmp_path}/t/01_VALUE").count() == 50
    exports.text_pages(df.selectExpr("1 AS g", "id", "t"), ["g"], ["id"], "t", 40, f"file://{tmp_path}/p")
    assert spark.read.text(f"file://{tmp_path}/p").count() == 50 and len(list((tmp_path / "p").glob("page_key=*"))) > 3


def test_hex_dump_keeps_all_bytes(spark):
    files = spark.createDataFrame([("a", bytearray(range(200))), ("b", bytearray())], "path string, content binary")
    dump = exports.hex_dump(files)
    assert dump.where("path = 'a'").count() == 4 and exports.preserved(dump, files).count() == 0
    assert [r.path for r in exports.preserved(dump.where("offset != 64"), files).collect()] == ["a"]


def test_meshes(spark):
    pts = spark.createDataFrame([(1, i, float(i), 0.5, 1 / 3) for i in range(3)], "mesh long, index long, x double, y double, z double")
    faces = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 0, 1, 3), (1, 2, 1, 1, 2)], "mesh long, face long, a long, b long, c long")
    assert sorted((r.face, r.fault) for r in geometry.face_faults(faces, pts).collect()) == [(1, "INDEX_OUT_OF_RANGE"), (2, "DEGENERATE")]
    lines = [r.line for r in geometry.obj_lines(pts, faces).orderBy("section", "number").collect()]
    assert lines[0] == "v 0.0 0.5 0.3333333333333333" and lines[3] == "f 1 2 3"
    flat = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], ",".join(f"{p}{k} double" for p in "abc" for k in "xyz"))
    assert geometry.shaded(flat).first().shade == 1.0


def test_picture(spark):
    from pyspark.sql import functions as F

    pixels = spark.createDataFrame([(0, 0, 0.0), (1, 1, 1.0)], "x long, y long, v double").withColumn("rgb", geometry.ramp(F.col("v"), 0.0, 1.0))
    image = geometry.png(((r.y, bytes(r.row)) for r in geometry.png_rows(pixels, 2).collect()), 2, 3)
    at = image.index(b"IDAT")
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    assert zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at], "big")]) == bytes([0, 0, 0, 255, 0, 0, 0, 0, 0, 0, 0, 255, 0, 0] + [0] * 7)


def test_records_by_schema(spark):
    slots = [("T", "n", 0, "int", 2, None, None), ("T", "f", 2, "bits", 1, 3, 5), ("T", "s", 3, "char", 4, None, None), ("T", "q", 6, "int", 4, None, None), ("T", "z", 0, "vax", 2, None, None)]
    s = spark.createDataFrame(slots, "type_name string, path string, offset long, kind string, size long, bit_offset int, bit_width int")
    e = spark.createDataFrame([(1, 0, "T", bytearray(b"\xff\xff\xf8ab\0c"))], "id long, element long, type_name string, data binary")
    got = {r.path: r for r in decode.decoded(e, s).collect()}
    assert (got["n"].value, got["f"].value, got["s"].text) == (-1, 31, "ab")
    assert (got["q"].status, got["z"].status) == ("BEYOND_STORAGE", "UNSUPPORTED_KIND") and got["z"].raw_hex == "ffff"


def test_costs_are_bounded(spark):
    s = spark.createDataFrame([("A", [10, 10], 2), ("B", [10**6, 10**6], 1), ("A", None, 0)], "type_name string, counts array<long>, depth int")
    got = {r.type_name: (r.leaves, r.admitted) for r in decode.expansion_cost(s).collect()}
    assert got["A"] == (101, True) and not got["B"][1]


def test_catalog(spark):
    inherits = spark.createDataFrame([("MySurface", "TriSurface"), ("TriSurface", "Shape"), ("Blob", "Shape")], "t string, b string")
    ancestors = graph.closure(inherits, "t", "b", written)
    shapes = spark.createDataFrame([(1, "MySurface"), (2, "Blob")], "id long, type_name string")
    ents = spark.createDataFrame([(7, "x", 1, "g"), (8, "y", 2, None), (9, "z", 3, "h"), (10, "w", None, None)], "id long, name string, shape_id long, group_id string")
    groups = graph.paths(spark.createDataFrame([("r", None), ("g", "r")], "child string, parent string").selectExpr("child", "parent", "child AS label"), "child", "parent", "label", written)
    got = {r.id: (r.render_class, r.path, r.diagnostic) for r in discovery.catalog(ents, shapes, ancestors, groups).collect()}
    assert got[7] == ("triangles", "r/g", "CATALOGUED") and got[8][0] == "unsupported_shape_type"
    assert got[9][2] == "SHAPE_NOT_FOUND" and got[10][2] == "NO_SHAPE"


def test_counters_go_on_where_they_stopped(spark, tmp_path):
    source, schema = f"file://{tmp_path}/in", "k string, v long"
    run = lambda: windows.counted(spark, source, schema, ["k"], f"file://{tmp_path}/c", "pin", f"file://{tmp_path}/out")
    last = lambda: {r.k: r.n for r in spark.read.parquet(sorted(str(p) for p in (tmp_path / "out").glob("generation=*"))[-1]).collect()}
    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], schema).coalesce(1).write.parquet(source)
    run()
    assert last() == {"a": 2, "b": 1}
    spark.createDataFrame([("a", 9)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert last() == {"a": 3, "b": 1}


def test_windows_on_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1L AS user_id UNION ALL SELECT timestamp'2024-01-01 03:00:00', 2L").write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, user_id long").parquet(f"file://{tmp_path}/e")
    q = windows.tumbling(stream, "1 hour", [], "10 minutes").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("SELECT * FROM hours").collect()] == [1]
