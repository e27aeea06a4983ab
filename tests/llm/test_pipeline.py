"""The pipeline's stages against brute-force versions over the same documents."""

import collections

import corpus_pipeline
from webloom.llm import pii, semicrf
from webloom.llm.common import read


def test_stages(spark, folder, rows):
    docs = read(spark, folder, "documents")
    counted = collections.Counter(r[1] for r in docs.select("doc_id", "text").collect())
    assert counted
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert kept.columns == docs.columns
    verdict = {r["doc_id"]: r["kept"] for r in __import__("webloom.llm.registry", fromlist=["queries"]).queries()["op1_quality_rules"](spark, folder).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows if verdict[r[0]])

    one = corpus_pipeline.STAGES[1][1](spark, docs, folder)
    assert one.columns == docs.columns
    parts = {r["doc_id"]: r["component_id"] for r in __import__("webloom.llm.registry", fromlist=["queries"]).queries()["op10_simhash_golay"](spark, folder).collect()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(r[0] for r in rows if parts[r[0]] == r[0])

    clean = corpus_pipeline.STAGES[2][1](spark, docs, folder)
    weights = semicrf.trained()
    want = sorted((r[0], pii.redacted(r[1], pii.spans(r[1], weights)[1]) if r[1] is not None else "") for r in rows)
    assert sorted((r["doc_id"], r["text"] or "") for r in clean.collect()) == want
    assert clean.columns == docs.columns

    mixed = corpus_pipeline.STAGES[3][1](spark, docs, folder)
    assert mixed.columns == docs.columns
    assert set(r["doc_id"] for r in mixed.collect()) == {r[0] for r in rows}


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0


def test_empty(spark, bare):
    assert corpus_pipeline.run(spark, bare).count() == 0
