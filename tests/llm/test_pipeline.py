"""The pipeline's stages on their own inputs, against brute force."""

from collections import Counter

import corpus_pipeline
from extentlake.llm.shared import written

from ..conftest import SMALL
from .test_operators import brute_components, brute_hits


def test_stages(spark, odd_documents):
    plain = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = plain.unionByName(odd_documents, allowMissingColumns=True)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SMALL))
        if name != "token-ID output":
            assert out.columns == docs.columns
            assert {x for x, _ in rows(out)} <= {x for x, _ in rows(docs)}
        if name == "n-gram Jaccard join":
            gone = {d for d, _, c in brute_components(rows(docs), 5, 80) if d != c}
            assert Counter(rows(out)) == Counter(r for r in rows(docs) if r[0] not in gone)
        if name == "benchmark decontamination":
            gone = {x[0] for x in brute_hits(rows(docs), bench) if x[5]}
            assert Counter(rows(out)) == Counter(r for r in rows(docs) if r[0] not in gone) and gone
        if name == "mixing sources":
            assert max(Counter(rows(out)).values()) <= 2 and out.count() > docs.count()
        if name == "token-ID output":
            assert Counter(r.doc_id for r in out.collect()) == Counter(x for x, _ in rows(docs))
        docs = out
