import hashlib

import pytest

from extentlake.functions import binary
from extentlake.sources import store


def tables(spark, broken=False):
    raw = b"abcdefgh" * 20
    codec, data, sha = binary.packed_blob(raw)
    return {
        "blobs": spark.createDataFrame([(sha, codec, len(raw), bytearray(data))], "sha256 string, codec string, raw_length long, data binary"),
        "clusters": spark.createDataFrame([(1, 1, 160)], "segment long, cluster long, allocated_bytes long"),
        "chunks": spark.createDataFrame([(1, 1, 0, 160, sha)], "segment long, cluster long, logical_start long, length long, blob_sha256 string"),
        "names": spark.createDataFrame([(1, "Thing")], "id long, name string"),
        "allocations": spark.createDataFrame([(1, 1, 1, 0, 16, 1), (2, 1, 1, 8 if broken else 16, 16, 1)], "id long, segment long, cluster long, logical_offset long, size long, name_id long"),
        "pointers": spark.createDataFrame([(1, 1, 0, 4, bytearray(b"abcd"), "RESOLVED", 1, 1, 16), (1, 1, 8, 4, bytearray(b"zzzz"), "NULL", None, None, None)], "segment long, cluster long, logical_offset long, width int, raw binary, status string, target_segment long, target_cluster long, target_offset long"),
    }


def test_written_and_read(spark, tmp_path):
    from extentlake.operators import verify

    path = f"file://{tmp_path}/a"
    assert store.write(spark, path, tables(spark)).count() == 0
    s = store.Store(spark, path)
    assert s.manifest["counts"]["allocations"] == 2
    assert [r.id for r in s.allocations(name="Thing").collect()] == [1, 2] and s.allocations(names=[]).count() == 0
    with pytest.raises(ValueError):
        s.allocations(name="a", names=["b"])
    assert [(r.length, r.status) for r in s.chunks().collect()] == [(160, "VERIFIED")]
    assert [r.key for r in verify.bytes_differ(s.table("pointers"), s.chunks()).collect()] == ["1:1:8"]


def test_a_broken_archive_is_not_written(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    assert [r.check_name for r in store.write(spark, path, tables(spark, True)).collect()] == ["allocations.disjoint"]
    assert not (tmp_path / "b").exists()


def test_blobs_that_lie(spark):
    raw = b"x" * 100
    codec, data, sha = binary.packed_blob(raw)
    rows = [(codec, bytearray(data), 100, sha), (codec, bytearray(data), 99, sha), ("zlib", bytearray(b"no"), 2, sha), ("raw", bytearray(b"y"), 1, sha)]
    df = spark.createDataFrame(rows, "codec string, data binary, raw_length long, sha256 string")
    got = [r.x.status for r in df.select(binary.unpacked_blob("codec", "data", "raw_length", "sha256").alias("x")).collect()]
    assert sorted(got) == ["DIGEST_MISMATCH", "MALFORMED_BLOB", "MALFORMED_BLOB", "VERIFIED"]


def test_scalars(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"\x01\x02\xff\x80"),)], "d binary")
    r = df.select(binary.le_unsigned(F.col("d"), 0, 2).alias("u"), binary.le_signed(F.col("d"), 2, 2).alias("s"), binary.signed_bits(binary.bit_field(F.lit(0xF8), 3, 5), 5).alias("b")).first()
    assert (r.u, r.s, r.b) == (0x0201, -32513, -1)
    f = spark.createDataFrame([(bytearray.fromhex("000000000000f87f"),), (bytearray.fromhex("0000000000000080"),), (bytearray.fromhex("cdcccc3d"),)], "d binary").select(binary.float_evidence("d").alias("x")).collect()
    assert [x.x.text for x in f] == ["nan", "-0.0", "0.1"] and f[1].x.raw_hex == "0000000000000080"
    t = spark.createDataFrame([(bytearray(b"caf\xe9\0xx"),)], "d binary").select(binary.latin1(F.col("d")).alias("t"), binary.text_status(F.col("d"), 7).alias("s")).first()
    assert (t.t, t.s) == ("café", "TERMINATED")
    a = spark.createDataFrame([("1:0x10:7",), ("1:2",), ("x:1:2",)], "t string").select(binary.parsed_address(F.col("t")).alias("a")).collect()
    assert tuple(a[0].a) == (1, 16, 7) and a[1].a is None and a[2].a is None
    c = spark.createDataFrame([('{"b": 1, "a": [1, {"z": null}]}',), ("{",), (None,)], "t string").select(binary.canonical_json("t").alias("c")).collect()
    assert [x.c for x in c] == ['{"a":[1,{"z":null}],"b":1}', None, None]


def test_frames_and_depth():
    assert binary.row_frame([1, b"\x01", None])[:8] == (len(b'[1,{"data":"01","encoding":"hex"},null]')).to_bytes(8, "big")
    assert binary.json_depth('{"a":[{}]}') == 3
    with pytest.raises(ValueError):
        binary.json_depth("[" * 70 + "]" * 70)
    with pytest.raises(ValueError):
        binary.json_depth("[NaN]")
    assert binary.facets({"status": "UNKNOWN_X", "f": [{"status": "DECODED"}]}) == {"nodes": 2, "fields": 2, "open": 1}
    assert hashlib.sha256(b"").hexdigest() == binary.packed_blob(b"")[2]
