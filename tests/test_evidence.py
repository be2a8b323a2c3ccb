"""Faults that tables in order can't show: long chains, equal rows, odd bytes, foreign databases, and ledgers that don't close."""

import struct

from pyspark.sql import functions as F

from extentlake import model
from extentlake.operators import decode, discovery, graph, intervals, ledger, links, paging, running, schema
from extentlake.sources import packing
from extentlake.sources.store import written

from .compare import same


def test_chains_of_two_hundred(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)] + [(300, 301), (301, 300), (302, 300), (400, 999)], "child long, parent long")
    got = {r.node: (r.path, r.status) for r in graph.paths(chain.withColumn("label", F.col("child")), "child", "parent", "label", written).collect()}
    assert got[199] == ("/".join(map(str, range(200))), "COMPLETE") and got[400] == ("400", "MISSING_PARENT")
    assert {got[i] for i in (300, 301, 302)} == {(None, "CYCLE")} and len(got) == 204
    reach = graph.closure(chain, "child", "parent", written).collect()
    assert sum(r.node == 199 for r in reach) == 200 and {r.ancestor for r in reach if r.node == 302} == {300, 301, 302}


def test_payload_goes_to_its_end_or_says_so(spark):
    steps = spark.createDataFrame([(i, i + 1, "ARRAY_ALLOCATION") for i in range(20)], "source long, target long, storage string")
    seed = spark.createDataFrame([(0,)], "node long")
    assert {(r.node, r.depth, r.status) for r in links.payload(steps, seed).collect()} == {(i, i, "REACHED") for i in range(21)}
    assert {r.node: r.status for r in links.payload(steps, seed, 3).collect()} == {0: "REACHED", 1: "REACHED", 2: "REACHED", 3: "RESOURCE_BOUND"}


def test_equal_rows_stay_as_many_as_they_are(spark):
    left = spark.createDataFrame([(1, 1, 0, 8), (1, 1, 0, 8), (1, 1, 90, 8)], "segment long, cluster long, s long, n long")
    right = spark.createDataFrame([(1, 1, 4, 8), (1, 1, 5, 8)], "segment long, cluster long, t long, m long")
    assert intervals.overlapping(left, right, "left_semi", "s", "n", "t", "m").count() == 2
    assert intervals.overlapping(left, right, "left_anti", "s", "n", "t", "m").count() == 1


def test_sweeps_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SWEEP", 10)
    rows = [(1, 1, 3 * i, 2 if i % 7 else 50) for i in range(60)]
    df = spark.createDataFrame(rows, "segment long, cluster long, s long, n long")
    want, end = {}, None
    for _, _, s, n in rows:
        want[s] = end
        end = max(end or 0, s + n)
    assert {r.s: r.previous_end for r in intervals.with_previous_end(df, "s", "n").collect()} == want


def test_running_sums_with_null_groups(spark):
    df = spark.createDataFrame([(None, i, 2) for i in range(5)] + [("a", 70_000 * i, 3) for i in range(4)], "g string, k long, v long")
    got = {(r.g, r.k): r.b for r in running.before(df, ["g"], ["k"], running.bucket_of(df, "k"), F.col("v"), "b").collect()}
    assert got == {**{(None, i): 2 * i or None for i in range(5)}, **{("a", 70_000 * i): 3 * i or None for i in range(4)}}


def test_every_kind_and_size_is_decoded(spark):
    data = struct.pack("<fdqQ", 1.5, -0.0, -2, (1 << 64) - 1) + b"\x01ab\x00"
    slots = [("f", 0, "f32", 4), ("d", 4, "f64", 8), ("q", 12, "int", 8), ("Q", 20, "uint", 8), ("b", 28, "bool", 1), ("t", 29, "char", 3), ("x", 30, "f32", 4), ("y", 0, "vax", 4), ("z", 0, "f64", 4)]
    e = spark.createDataFrame([(1, 0, "T", data)], "id long, element long, type_name string, data binary")
    s = spark.createDataFrame([("T", *x, None, None) for x in slots], "type_name string, path string, offset long, kind string, size long, bit_offset int, bit_width int")
    got = {r.path: r for r in decode.decoded(e, s).collect()}
    assert (got["f"].number, got["f"].text) == (1.5, "1.5") and (got["d"].text, got["d"].raw_hex) == ("-0.0", "0000000000000080")
    assert got["q"].value == -2 and got["Q"].value is None and int(got["Q"].big) == (1 << 64) - 1 and (got["b"].value, got["t"].text) == (1, "ab")
    assert [got[p].status for p in "fdqQbtxyz"] == ["DECODED"] * 6 + ["BEYOND_STORAGE", "UNSUPPORTED_KIND", "UNSUPPORTED_KIND"]


def test_pointers_into_another_database_have_no_target(spark):
    head = (1 << 31) | (5 << 10)
    (thread,) = packing.threads(struct.pack("<2I", head, 77), 1, 2)
    assert thread.database == 77
    page = struct.pack("<I", 0x1234) + bytes(60)
    (p,) = packing.chained(page, [thread])
    assert (p["status"], p["target"]) == ("EXTERNAL_DATABASE", (None, None, None))
    pages = spark.createDataFrame([(1, 2, 0, page, struct.pack("<2I", head, 77))], "segment long, cluster long, page_offset long, data binary, heads binary")
    r = packing.page_pointers(pages).first()
    assert (r.status, r.target_segment, r.target_offset) == ("EXTERNAL_DATABASE", None, None)


def test_layouts_with_unknown_classes_and_endless_ones(spark, monkeypatch):
    monkeypatch.setattr(schema, "MAX_DEPTH", 5)
    names = "type_name string, member string, offset long, kind string, size long, target string, count long, stride long"
    rows = [("A", "b", 0, "class", 8, "Nowhere", None, None), ("C", "c", 4, "class", 4, "C", None, None), ("C", "n", 0, "int", 4, None, 2, 4)]
    got = [(r.type_name, r.path, r.status) for r in schema.slots(spark.createDataFrame(rows, names), written).where("type_name = 'A' OR length(path) < 4 OR status != 'DECLARED'").collect()]
    assert ("A", "b", "UNKNOWN_CLASS") in got and ("C", "n", "DECLARED") in got and [x[2] for x in got].count("RESOURCE_BOUND") == 1
    types = spark.createDataFrame([("a", "alias", "b"), ("b", "const", "a"), ("c", "alias", "d"), ("e", "volatile", "f"), ("f", "class", None)], "name string, kind string, target string")
    got = {r.name: (r.resolved, r.qualifiers, r.status) for r in schema.resolved_types(types, written).collect()}
    assert got["a"][2] == got["b"][2] == "RECURSIVE" and got["c"][2] == "UNKNOWN_TARGET" and got["e"] == ("f", ["volatile"], "RESOLVED")
    members = spark.createDataFrame([("T", "p", 0, "pointer", 8, "e", None, None), ("T", "q", 8, "pointer", 8, "zz", None, None)], names)
    assert {r.member: (r.pointee, r.status) for r in schema.declared_pointees(members, types, written).collect()} == {"p": ("f", "RESOLVED"), "q": (None, "UNKNOWN_TARGET")}


def test_places_in_arrays_of_any_length(spark, monkeypatch):
    """Arrays within arrays, long ones, without a stride, backwards, overlapping and empty, equal and NULL places; against all elements by loops."""
    from itertools import product

    arrays = {"plain": [], "a": [(3, 8)], "ab": [(3, 100), (4, 8)], "none": [(2, None)], "zero": [(3, 0)], "back": [(4, -8)], "over": [(3, 4), (2, 8)], "empty": [(0, 8), (2, 4)], "long": [(2, 400), (20, 16), (2, 4)], "longback": [(30, -12), (2, 4)], "longnone": [(20, None)]}
    slots = [("T", p, 8 + i, 4, a) for i, (p, a) in enumerate(arrays.items())] + [("U", "u", 0, 4, [])]
    s = spark.createDataFrame([(t, p, o, n, a, False) for t, p, o, n, a in slots], "type_name string, path string, offset long, size long, arrays array<struct<count:bigint,stride:bigint>>, conditional_union boolean")
    places = [(i, "T", d) for i, d in enumerate(range(-60, 800))] + [(5, "U", 0), (5, "U", 0), (6, "U", 1), (7, None, 0), (8, "T", None), (9, "V", 0)]
    want = []
    for i, t, d in places:
        hits = [(p, list(x)) for u, p, o, _, a in slots for x in product(*(range(n) for n, _ in a)) if u == t and d is not None and o + sum(k * (by or 0) for k, (_, by) in zip(x, a, strict=True)) == d]
        want += [(i, t, d, *h) for h in hits or [(None, None)]]
    for many in (1 << 12, 7):
        monkeypatch.setattr(schema, "MANY", many, raising=False)
        got = schema.at_displacement(spark.createDataFrame(places, "place long, type_name string, displacement long"), s).collect()
        assert sorted(map(repr, ((r.place, r.type_name, r.displacement, r.path, r.indices) for r in got))) == sorted(map(repr, want))


def test_places_in_endless_arrays_and_large_classes(spark):
    """A thousand million elements are not laid out, and places meet the slots of their displacement alone."""
    s = spark.createDataFrame([("T", "x", 4, 4, [(1 << 30, 16), (2, 8)], False)], "type_name string, path string, offset long, size long, arrays array<struct<count:bigint,stride:bigint>>, conditional_union boolean")
    places = spark.createDataFrame([(16 * 999_999_999 + 12, "T"), (16 * (1 << 30) + 12, "T"), (5, "T")], "displacement long, type_name string")
    assert {r.displacement: r.indices for r in schema.at_displacement(places, s).collect()} == {15_999_999_996: [999_999_999, 1], 16 * (1 << 30) + 12: None, 5: None}
    wide = spark.range(1 << 13).selectExpr("'T' AS type_name", "CAST(id AS STRING) AS path", "8 * id AS offset", "8L AS size", "CAST(array() AS ARRAY<STRUCT<count:BIGINT,stride:BIGINT>>) AS arrays", "false AS conditional_union")
    many = spark.range(1 << 18).selectExpr("'T' AS type_name", "id AS displacement")  # 2^31 pairs of one type
    got = schema.at_displacement(many, wide).agg(F.count("*").alias("n"), F.count("path").alias("found"), F.count_if(F.expr("8 * CAST(path AS BIGINT) = displacement")).alias("right")).first()
    assert tuple(got) == (1 << 18, 1 << 13, 1 << 13)


def test_ledger_faults_one_by_one(spark):
    alloc = spark.createDataFrame([(i, 10) for i in range(1, 6)], "id long, element_count long")
    rows = [(1, 0, 10), (2, 0, 5), (2, 6, 10), (3, 0, 6), (3, 5, 10), (4, 0, 12), (9, 0, 1)]
    got = {tuple(r) for r in ledger.violations(spark.createDataFrame(rows, "allocation_id long, first long, last long"), alloc).collect()}
    assert got == {("ranges.gap", 2), ("ranges.overlap", 3), ("ranges.end", 4), ("ranges.allocation", 9), ("ranges.missing", 5)}
    v = spark.createDataFrame([(True, True, False, True, True), (False, False, False, True, True), (False, True, True, True, True), (False, True, False, False, True), (False, True, False, True, False), (False, True, False, True, True)], "primitive_block boolean, known_type boolean, bounded boolean, admitted boolean, resolved boolean")
    assert [r.status for r in ledger.value_states(v).collect()] == ["NATIVE_PRIMITIVE_BLOCK_CHECKED", "UNKNOWN_NATIVE_TYPE", "VALUE_DECODE_RESOURCE_BOUND", "VALUE_DECODE_ADMISSION_UNESTABLISHED", "VALUE_DECODE_UNRESOLVED", "DECODED"]


def test_roots_walk_together(spark):
    alloc = spark.createDataFrame([(1, 1, 1, 0, 10, "T"), (2, 1, 1, 20, 10, "T"), (3, 1, 1, 40, 10, "T")], "id long, segment long, cluster long, logical_offset long, size long, type_name string")
    roots = spark.createDataFrame([("a", 1, 1, 0), ("b", 1, 1, 25), ("c", 1, 1, 99)], "name string, segment long, cluster long, offset long")
    steps = spark.createDataFrame([(1, 2, "ARRAY_ALLOCATION"), (2, 3, "ARRAY_ALLOCATION")], "source long, target long, storage string")
    assert {r.node: r.depth for r in discovery.root_walk(roots, alloc, steps).collect()} == {1: 0, 2: 1, 3: 2}


def test_phases_add_up(spark):
    a = spark.createDataFrame([(1, 100, 16, 3, 20, 24), (2, 5, 0, 1, 4, 5)], "id long, size long, array_header_size long, element_count long, element_size long, element_stride long")
    got = paging.phases(a, "id = 1").groupBy("id").agg(F.sum("bytes").alias("n")).collect()
    assert {r.id: r.n for r in got} == {1: 100, 2: 5}


def test_regions_of_empty_and_reversed_stretches(spark):
    """All pairs with first < l and f < last, whatever the order of their ends; pages are narrower than they are."""
    ends = [(f, l) for f in range(0, 14, 3) for l in range(1, 14, 2)] + [(6, 6), (9, 9), (4, 4), (40, 7), (7, 40)]
    stretches = spark.createDataFrame([(i, *x) for i, x in enumerate(ends)] + [(None, None, 9)], "id long, f long, l long")
    regions = [("a", 0, 4), ("b", 4, 12), ("c", 12, 20), ("d", 20, 50), ("e", 2, 45), ("empty", 6, 6), ("reversed", 9, 5)]
    want = sorted((i, n, max(a, f), min(b, l)) for i, (f, l) in enumerate(ends) for n, a, b in regions if a < l and f < b)
    got = decode.overlay(stretches, spark.createDataFrame(regions, "name string, first long, last long"), 4).collect()
    assert sorted(tuple(r) for r in got) == want and any(x[2] > x[3] for x in want)


def test_small_documents_under_regions(spark, tmp_path):
    """q66: documents of fewer characters than where their stretch begins; its SQL has rows for them."""
    import duckdb

    from extentlake.plans.queries import QUERIES, SQL

    spark.createDataFrame([(i, "en", n) for i, n in enumerate((5, 2, 5, 5, 40, 3, 6, 7, None, 20, 9, 9))], "doc_id long, lang string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(QUERIES["q66_region_overlay"](spark, str(tmp_path)), con, SQL["q66_region_overlay"])


def test_kinds_of_failure_and_pins():
    assert model.failure(ValueError("RESOURCE_LIMIT: too many")) == "RESOURCE_LIMIT" and model.failure(FileNotFoundError("x")) == "IO_FAILURE"
    assert model.failure(packing.Malformed("MALFORMED_SOURCE")) == "MALFORMED_SOURCE" and model.failure(AssertionError()) == "PROGRAMMING_FAILURE" and model.failure(KeyError("k")) == "INVALID_ARGUMENT"
    assert model.pin(source="a") == model.pin(source="a") != model.pin(source="b")
