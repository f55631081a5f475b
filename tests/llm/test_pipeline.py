"""The pipeline on the smallest table, stage by stage."""

from collections import Counter

import corpus_pipeline
from millrace.llm import pii
from tests.conftest import SF_SMALL
from tests.llm.helpers import shingle_set


def test_stages(llm):
    docs = llm.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(llm, seen[-1], SF_SMALL), f"test-stage-{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        seen.append(out)
    rows = [{r["doc_id"]: r["text"] for r in s.collect()} for s in seen[:-1]]
    assert set(rows[4]) <= set(rows[3]) == set(rows[2]) <= set(rows[1]) <= set(rows[0])
    sets = {d: shingle_set(t, 5) for d, t in rows[1].items()}
    left = sorted(rows[2])
    for i, a in enumerate(left):  # no two that stay are near duplicates; what went is like one that is left or linked to it
        for b in left[:i]:
            both = len(sets[a] & sets[b])
            assert both < 0.8 * (len(sets[a]) + len(sets[b]) - both)
    for d in set(rows[1]) - set(rows[2]):
        assert any((both := len(sets[d] & sets[o])) >= 0.8 * (len(sets[d]) + len(sets[o]) - both) for o in sets if o != d)
    assert not any(pii.pattern_spans(t) for t in rows[3].values())
    mixed = Counter(r["doc_id"] for r in seen[4].collect())
    assert max(mixed.values()) <= 3
    pieces = seen[5].collect()
    assert Counter(p["doc_id"] for p in pieces if p["piece"] == 0) == mixed


def test_run(llm):
    assert corpus_pipeline.run(llm, SF_SMALL).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_empty(empty, llm):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, SF_SMALL)
        assert docs.count() == 0
