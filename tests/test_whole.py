"""Queries that read every row, word and element of their input, against brute force; no count is bounded."""

import re

from extentlake.operators import membership
from extentlake.plans.fixture import Archive
from extentlake.plans.queries import QUERIES

from .conftest import SMALL


def test_every_word_is_decoded(spark, tmp_path):
    texts = ["", "abc", "abcd", None, "é" + "wörd " * 700, "\0tail of bytes, over eighty characters: " * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in enumerate(texts):
        data = re.sub("[^\x01-\x7f]", "", t or "").encode()
        want |= {(i, k, int.from_bytes(data[4 * k : 4 * k + 4], "little"), data[4 * k : 4 * k + 4].hex().upper()) for k in range(len(data) // 4)}
    got = [tuple(r) for r in QUERIES["q62_typed_words"](spark, str(tmp_path)).select("id", "element", "value", "raw_hex").collect()]
    assert len(got) == len(want) > 700 and set(got) == want


def test_every_element_is_expanded(spark):
    want = set()
    for r in Archive(spark, SMALL).alloc.collect():
        n = (r.size - r.array_header_size) // r.element_stride if r.vector else 1
        want |= {(r.id, i, r.logical_offset + r.array_header_size + i * r.element_stride) for i in range(n)}
    got = [tuple(r) for r in QUERIES["q23_element_expand"](spark, SMALL).select("id", "element_index", "offset").collect()]
    assert max(w[1] for w in want) > 40 and len(got) == len(want) and set(got) == want


def test_every_allocation_is_read(spark):
    text = {r.doc_id: (r.text or "").encode() for r in Archive(spark, SMALL).table("documents").collect()}
    want = {}
    for i, data in text.items():
        first, size = i % 7, 40 + i % 3 * 5000
        whole = len(data) >= first + size
        want[i] = ("READ", data[first : first + size].hex().upper()) if whole else ("INCOMPLETE", None)
    got = QUERIES["q28_logical_read"](spark, SMALL).collect()
    assert len(got) == len(want) and {r.request_id: (r.status, r.bytes) for r in got} == want


def test_every_allocation_is_mapped(spark):
    want = set()
    for r in Archive(spark, SMALL).alloc.collect():
        for k in range(r.logical_offset // 4096, (r.logical_offset + r.size - 1) // 4096 + 1):
            first, last = max(r.logical_offset, 4096 * k), min(r.logical_offset + r.size, 4096 * k + 4096)
            base = 512 + r.segment * 1000000007 + r.cluster * 100000007 + k * 7919 % 1000003 * 4096
            want.add((r.id, first, base + first - 4096 * k, last - first))
    got = [tuple(r) for r in QUERIES["q59_physical_spans"](spark, SMALL).select("request_id", "logical_start", "physical_start", "length").collect()]
    assert len(got) == len(want) and set(got) == want


def test_every_block_of_a_list_is_followed(spark, tmp_path):
    turns = [(1, t) for t in range(19)] + [(2, t) for t in range(3)] + [(3, t) for t in (0, 1, 3)]
    spark.createDataFrame(turns, "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.coll_id: (r.declared, r.observed, r.status) for r in QUERIES["q38_list_membership"](spark, str(tmp_path)).collect()}
    assert got == {1: (19, 19, "VERIFIED_CARDINALITY"), 2: (3, 3, "VERIFIED_CARDINALITY"), 3: (3, 2, "CARDINALITY_MISMATCH")}


def test_a_budget_that_ends_a_list_is_told(spark):
    blocks = spark.createDataFrame([(c, i, i + 1 if i < n else None, i == 0, 1) for c, n in ((1, 2), (2, 5)) for i in range(n + 1)], "coll_id long, node_id long, next_node_id long, is_root boolean, local_card long")
    declared = spark.createDataFrame([(1, 3), (2, 6)], "coll_id long, declared long")
    got = {r.coll_id: (r.observed, r.status) for r in membership.list_membership(declared, blocks, membership.list_chains(blocks, 2)).collect()}
    assert got == {1: (3, "VERIFIED_CARDINALITY"), 2: (3, "RESOURCE_BOUND")}
