import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from extentlake.sources.store import written
from extentlake.operators import graph, intervals, membership, paging

ALLOC = [(1, 1, 0, 16, 1), (1, 1, 16, 36, 2), (1, 1, 64, 32, 3)]


def alloc(spark):
    return spark.createDataFrame(ALLOC, "segment long, cluster long, start long, size long, id long")


def test_containing_at_the_edges(spark):
    probes = [(0, 1, 1), (15, 1, 1), (15, 4, None), (16, 4, 2), (51, 1, 2), (52, 1, None), (63, 1, None), (64, 4, 3), (92, 4, 3), (92, 8, None), (95, 1, 3), (96, 1, None), (4095, 1, None), (None, 1, None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1, at, need, want) for at, need, want in probes], "segment long, cluster long, at long, need int, want long")
    got = intervals.containing(df, alloc(spark), "at", "start", "size", F.col("need"), page=16).collect()
    assert len(got) == len(probes)
    assert all(r.id == r.want for r in got)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30)), max_size=12))
def test_overlapping_equals_all_pairs(spark, left, right):
    a = spark.createDataFrame([(1, 1, i, s, n) for i, (s, n) in enumerate(left)], "segment long, cluster long, i long, s long, n long")
    b = spark.createDataFrame([(1, 1, i, s, n) for i, (s, n) in enumerate(right)], "segment long, cluster long, j long, t long, m long")
    want = sorted((i, j) for i, (s, n) in enumerate(left) for j, (t, m) in enumerate(right) if s < t + m and t < s + n)
    got = intervals.overlapping(a, b, "inner", "s", "n", "t", "m", page=8)
    assert sorted((r.i, r._r_j) for r in got.collect()) == want
    semi = sorted(r.i for r in intervals.overlapping(a, b, "left_semi", "s", "n", "t", "m", page=8).collect())
    anti = sorted(r.i for r in intervals.overlapping(a, b, "left_anti", "s", "n", "t", "m", page=8).collect())
    assert semi == sorted({i for i, _ in want}) and sorted(semi + anti) == list(range(len(left)))


def test_gaps_cover_what_no_interval_does(spark):
    clusters = spark.createDataFrame([(1, 1, 100), (1, 2, 7)], "segment long, cluster long, allocated_bytes long")
    got = sorted(tuple(r) for r in intervals.gaps(alloc(spark), clusters, "start", "size", "allocated_bytes").collect())
    assert got == [(1, 1, 52, 64), (1, 1, 96, 100), (1, 2, 0, 7)]


def test_logical_read_and_spans(spark):
    chunks = spark.createDataFrame([(1, 1, 0, 4, bytearray(b"abcd")), (1, 1, 4, 3, bytearray(b"efg")), (1, 1, 9, 2, bytearray(b"jk"))], "segment long, cluster long, logical_start long, length long, data binary")
    r = spark.createDataFrame([(1, 1, 1, 2, 4), (2, 1, 1, 5, 3), (3, 1, 1, 9, 2), (4, 1, 1, 9, 3), (5, 1, 1, 3, 0)], "request_id long, segment long, cluster long, offset long, size long")
    got = {x.request_id: (x.status, x.data and bytes(x.data)) for x in intervals.logical_read(r, chunks, page=4).collect()}
    assert got[1] == ("READ", b"cdef") and got[2][0] == "INCOMPLETE" and got[3] == ("READ", b"jk") and got[4] == ("INCOMPLETE", None) and got[5][0] == "READ"
    ext = spark.createDataFrame([(1, 1, 0, 0x4000, 4096), (1, 1, 4096, 0xA000, 4096)], "segment long, cluster long, logical_start long, physical_start long, length long")
    one = spark.createDataFrame([(1, 1, 1, 4090, 12)], "request_id long, segment long, cluster long, offset long, size long")
    assert sorted((x.physical_start, x.length) for x in intervals.physical_spans(one, ext).collect()) == [(0x4FFA, 6), (0xA000, 6)]


def test_walk_budgets(spark):
    links = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 4, 3), (3, 4, 4), (4, 1, 5)], "source long, target long, link_id long")
    full = graph.walk(links, 1)
    assert full["nodes"] == [(1, 0), (2, 1), (3, 1), (4, 2)] and len(full["links"]) == 5 and not full["truncated"]
    assert graph.walk(links, 1, max_links=2)["truncated"]
    assert graph.walk(links, 1, max_nodes=2)["nodes"] == [(1, 0), (2, 1)]
    with pytest.raises(ValueError):
        graph.walk(links, 1, max_nodes=0)


def test_paths_with_faults(spark):
    t = spark.createDataFrame([("a", None), ("b", "a"), ("c", "x"), ("d", "e"), ("e", "d")], "child string, parent string")
    from pyspark.sql import functions as F

    got = {r.node: (r.path, r.status) for r in graph.paths(t.withColumn("label", F.col("child")), "child", "parent", "label", written).collect()}
    assert got["b"] == ("a/b", "COMPLETE") and got["c"][1] == "MISSING_PARENT" and got["d"][1] == "CYCLE"


def test_set_and_list_states(spark):
    sets = spark.createDataFrame([(1, 2, 2, 4), (2, 2, 2, 4), (3, 1, 2, 4)], "coll_id long, n_entries long, n_keys long, n_slots long")
    slots = spark.createDataFrame([(1, 0, 8), (1, 1, 9), (1, 2, 1), (1, 3, None), (2, 0, 8), (2, 1, 8), (3, 0, 8)], "coll_id long, slot_index long, target_id long")
    got = {r.coll_id: r.status for r in membership.set_membership(sets, slots).collect()}
    assert got == {1: "VERIFIED_CARDINALITY", 2: "DUPLICATE_SET_REFERENCE", 3: "CARDINALITY_MISMATCH"}
    blocks = spark.createDataFrame([(1, 1, 2, True, 2), (1, 2, 1, False, 1), (2, 1, None, True, 1)], "coll_id long, node_id long, next_node_id long, is_root boolean, local_card long")
    colls = spark.createDataFrame([(1, 3), (2, 4)], "coll_id long, declared long")
    got = {r.coll_id: (r.observed, r.status) for r in membership.list_membership(colls, blocks, membership.list_chains(blocks)).collect()}
    assert got == {1: (3, "VERIFIED_CARDINALITY"), 2: (1, "CARDINALITY_MISMATCH")}


def test_no_report_is_cut(spark):
    assert paging.within(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError, match="RESOURCE_LIMIT"):
        paging.within(spark.range(6), 5)
