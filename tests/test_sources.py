import sqlite3

from extentlake import cli
from extentlake.operators import links
from extentlake.sources import captured, directory, store

from .test_store import tables


def test_captured_archive_becomes_tables(spark, tmp_path, capsys):
    path = tmp_path / "a.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE names(id INTEGER PRIMARY KEY, name TEXT)")
    con.executemany("INSERT INTO names VALUES (?, ?)", [(i, f"T{i}") for i in range(105)])
    con.execute("CREATE TABLE clusters(segment INTEGER, cluster INTEGER, allocated_bytes INTEGER, metadata TEXT, PRIMARY KEY(segment, cluster)) WITHOUT ROWID")
    con.executemany("INSERT INTO clusters VALUES (?, ?, 64, '{}')", [(s, c) for s in range(3) for c in range(4)])
    con.execute("CREATE TABLE allocations(id INTEGER PRIMARY KEY, segment, cluster, logical_offset, size, name_id, vector)")
    con.execute("INSERT INTO allocations VALUES (1, 0, 0, 8, 16, 3, 1)")
    con.commit()
    con.close()
    t = captured.captured(spark, str(path))
    names = spark.read.format("captured").option("table", "names").option("rows", "10").load(str(path))
    assert names.rdd.getNumPartitions() == 11 and names.count() == 105 and names.agg({"id": "sum"}).first()[0] == sum(range(105))
    assert t["clusters"].count() == 12 and t["allocations"].first().vector is True and t["pointers"].count() == 0


def test_commands(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/a"
    store.write(spark, path, tables(spark))
    for command in (["info"], ["datasets"]):
        assert cli.main([*command, path]) == 0
    assert "Thing" in capsys.readouterr().out


def test_snapshots_show_changes(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for n in "ab":
        (tmp_path / "f" / n).write_text(n)
    before = store.written(captured.snapshots(spark, f"file://{tmp_path}/f"))
    (tmp_path / "f" / "a").write_text("A")
    (tmp_path / "f" / "b").unlink()
    (tmp_path / "f" / "c").write_text("c")
    got = {r.path[-1]: r.state for r in captured.changed(before, captured.snapshots(spark, f"file://{tmp_path}/f")).collect()}
    assert got == {"a": "CHANGED", "b": "GONE", "c": "NEW"}


def test_directory_events(spark):
    rows = [(1, 1, 1, "create", None, None), (1, 1, 2, "append", 100, 10), (1, 1, 3, "append", 110, 5), (1, 1, 4, "append", 300, 10), (1, 1, 5, "truncate", None, 20), (1, 2, 1, "append", 1, 1), (1, 3, 1, "create", None, None), (1, 3, 2, "delete", None, None)]
    df = spark.createDataFrame(rows, "segment long, cluster long, seq long, event string, physical_start long, length long")
    got = sorted(((r.cluster, r.logical_start, r.physical_start, r.length, r.status) for r in directory.replayed(df).collect()), key=str)
    assert got == [(1, 0, 100, 15, "CURRENT"), (1, 15, 300, 5, "CURRENT"), (2, None, None, None, "MALFORMED_SOURCE: append at 1")]


def test_references_are_proven(spark):
    slots = spark.createDataFrame([(1, 1, o, 4, bytearray(b"abcd")) for o in (0, 4, 8, 12)], "segment long, cluster long, offset long, width int, raw binary")
    p = [(1, 1, 0, 4, bytearray(b"abcd"), "RESOLVED", 1, 1, 9), (1, 1, 4, 8, bytearray(b"abcdefgh"), "NULL", None, None, None), (1, 1, 8, 4, bytearray(b"zzzz"), "NULL", None, None, None)]
    pointers = spark.createDataFrame(p, "segment long, cluster long, logical_offset long, width int, raw binary, status string, target_segment long, target_cluster long, target_offset long")
    got = {r.offset: r.reference for r in links.proven(slots, pointers).collect()}
    assert got == {0: "PROVEN", 4: "SOURCE_SLOT_WIDTH_MISMATCH", 8: "SOURCE_SLOT_RAW_MISMATCH", 12: "BINDING_NOT_RECORDED"}
    walk = spark.createDataFrame([(1, 2, "ARRAY_ALLOCATION"), (2, 3, "OTHER_ENTITY"), (3, 4, "ARRAY_ALLOCATION")], "source long, target long, storage string")
    assert sorted(r.node for r in links.payload(walk, spark.createDataFrame([(1,)], "node long")).collect()) == [1, 2, 3]
