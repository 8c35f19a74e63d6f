from collections import Counter

import corpus_pipeline as cp
from conftest import SF
from helpers import edge, empty
from test_nearcopies import brute_groups

from rillstone.llm import quality
from rillstone.llm.store import materialize


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = seen["quality"]
    model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = before.collect()
    scores = model.score([r.text for r in rows])
    assert {r.doc_id for r, s in zip(rows, scores, strict=True) if s >= quality.CUT} == {r.doc_id for r in after.collect()}
    before, after = seen["exact_dedup"]
    best = {}
    for r in before.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(best.values())
    before, after = seen["near_dedup"]
    groups = brute_groups([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == set(groups.values()) and after.count() < before.count()
    before, after = seen["mixing"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 2
    before, after = seen["packing"]
    assert Counter(r.doc_id for r in after.filter("piece = 0").collect()) == Counter(r.doc_id for r in before.collect())
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_edges(spark):
    for make in (edge, empty):
        docs = make(spark)
        for name, stage in cp.STAGES[make is edge :]:  # without labels among the edge rows the classifier says nothing
            after = materialize(stage(spark, docs, SF), name)
            assert name == "packing" or after.columns == docs.columns
            docs = after
    assert cp.keep_quality(spark, edge(spark), SF).columns == edge(spark).columns
