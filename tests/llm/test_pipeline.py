"""The pipeline against the stages' meaning in plain Python, and the registration of its query."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlake.llm import mixing, quality
from emberlake.llm.queries import oracle_sql, queries
from emberlake.llm.shared import table
from tests.llm.common import docs_frame, odd_texts, rows
from tests.llm.test_native import brute_added, brute_pii
from tests.llm.test_sets import brute_components, brute_hits
from tests.oracle import compare, connect


def test_pipeline(spark, sf_dir):
    docs, labels, items = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    scores = {r["doc_id"]: r["predicted"] for r in rows(quality.op3_quality(docs, labels))}
    left = [r for r in rows(docs) if scores[r["doc_id"]]]
    assert 0 < len(left) < docs.count()
    component = {k[1]: c for k, _, c in brute_components([(r["doc_id"], r["text"]) for r in left], 5, 80)}
    left = [r for r in left if component[r["doc_id"]] == r["doc_id"]]
    hit = {x[0] for x in brute_hits([(r["doc_id"], r["text"]) for r in left], [(r["item_id"], r["text"]) for r in rows(items)]) if x[-1]}
    left = [r for r in left if r["doc_id"] not in hit]
    for r in left:
        spans = sorted((s, -e, k) for x in [*brute_pii(r["text"]), brute_added(r["text"])] for k, s, e in x)
        out, at = "", 0
        for s, e, k in spans:
            if s >= at:
                out += r["text"][at:s] + f"[{k.upper()}]"
            at = max(at, -e)
        r["text"] = out + r["text"][at:] if spans else r["text"]
        r["n_chars"] = len(r["text"])
    after_pii = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in left], docs.schema)
    want = {r["doc_id"]: r["copies"] for r in rows(mixing.plan_mix(after_pii))}
    got = rows(corpus_pipeline.run(spark, sf_dir))
    assert sorted(tuple(r[c] for c in docs.columns) for r in got) == sorted(tuple(r[c] for c in docs.columns) for r in left for _ in range(want[r["doc_id"]]))


def test_stages_keep_columns(spark, sf_dir):
    docs = docs_frame(spark, odd_texts(), [None, None, *range(13)])
    docs = docs.withColumns({c: F.lit("own") for c in ("_key", "_marked", "_nth", "_slot", "_bits", "_row", "_hit_id", "_own_text", "_pii_text", "_mix_rate", "terms", "items", "copies")})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, sf_dir)
            got = rows(out)
            assert out.columns == docs.columns and len(got) <= 3 * 15 and all(r[c] == "own" for r in got for c in docs.columns[7:]), k


def test_only_the_result_stays(spark, sf_dir):
    from pathlib import Path

    from emberlake.llm.shared import shared_dir

    there = lambda: set(Path(shared_dir(spark)).iterdir())
    before = there()
    out = corpus_pipeline.run(spark, sf_dir)
    assert [p.name.split("-")[:2] for p in there() - before] == [["stage", "mixing"]] and out.count() > 0


def test_queries():
    assert sorted(q.split("_")[0] for q in queries()) == sorted([f"op{n}" for n in range(1, 11)] + ["pipeline"])
    assert set(oracle_sql()) <= set(queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf_dir, name):
    compare(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name])
