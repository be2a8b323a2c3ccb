"""Quality rules, line deduplication and mixing against their SQL and on odd rows."""

import hashlib
import re
from collections import Counter

import pytest

from extentlake.llm import line_dedup, mixing, quality
from extentlake.llm.registry import QUERIES, SQL

from ..compare import same
from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck, SQL[name])


@pytest.mark.parametrize("name", ["op4_mixing", "op5_line_dedup", "op8_quality_rules"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_of_odd_rows(odd_documents):
    rows = quality.judged(odd_documents).collect()
    assert len(rows) == 12 and all(r.row.ledger == "clash" for r in rows)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.row.text or "")
        assert r.ledger.n_words == len(w) and r.ledger.word_chars == sum(map(len, w))
        g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {p for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        assert r.ledger.n_repeat_words == len(hit)
        assert bool(r.ledger.fail_bits & 1) == (len(w) < 50)


def test_ablation_adds_up(odd_documents, no_documents):
    judged = quality.judged(odd_documents)
    got = {r.rule: (r.n_failed, r.n_failed_alone) for r in quality.ablation(judged).collect()}
    bits = [r.ledger.fail_bits for r in judged.collect()]
    for rule, bit in quality.BIT.items():
        assert got[rule] == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))
    assert quality.judged(no_documents).count() == 0


def test_line_dedup_of_odd_rows(odd_documents, no_documents):
    rows = line_dedup.deduplicated(odd_documents).collect()
    assert len(rows) == 12
    held = {}
    key = lambda line: re.sub(r"^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    docs = odd_documents.select("doc_id", "text").collect()
    for d in docs:
        for line in (d.text or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(d.doc_id)
    want = Counter()
    for d in docs:
        kept = [line for line in (d.text or "").split("\n") if len(held.get(key(line), {None} - {None}) - {None}) < 3 or d.doc_id == max(held[key(line)] - {None})]
        want[d.doc_id, "\n".join(kept)] += 1
    assert Counter((r.doc_id, r.kept_text) for r in rows) == want
    assert line_dedup.deduplicated(no_documents).count() == 0
    assert hashlib.sha256(b"").hexdigest() in {hashlib.sha256((r.kept_text).encode()).hexdigest() for r in rows}


def test_mixing_of_odd_rows(odd_documents, no_documents):
    rows = mixing.mixed(mixing.sized(odd_documents)).collect()
    assert len(rows) == 12 and all(0 <= r.mix.copies <= 2 and r.row.mix == r.row.target == "clash" for r in rows)
    assert mixing.mixed(mixing.sized(no_documents)).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + (id * 7919) % 400 AS INT)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE concat('s', id % 4) END AS source")
    got = mixing.mixed(mixing.sized(docs)).selectExpr("row.source", "mix.*").groupBy("source").agg({"source_size": "max", "target": "max"}).collect()
    taken = {r.source: r.t for r in mixing.mixed(mixing.sized(docs)).selectExpr("row.source", "mix.size * mix.copies AS taken").groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    total = sum(r["max(source_size)"] for r in got)
    assert abs(sum(r["max(target)"] for r in got) - 1.5 * total) < 1e-6 * total
    for r in got:
        assert r["max(target)"] <= 2 * r["max(source_size)"] + 1e-6
        assert abs(taken[r.source] - r["max(target)"]) < 0.02 * r["max(target)"]
