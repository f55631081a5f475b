"""Targets against the rule in words, exact totals, reruns."""

from collections import Counter

import pytest

from millrace.llm import mixing
from tests.llm.helpers import as_counter, words


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            free.discard(s)
    return target


@pytest.mark.parametrize(("bucket_rows", "max_block"), [(100_000, 4096), (7, 50)])
def test_mix(odd, bucket_rows, max_block):
    docs, rows = odd
    docs = docs.drop("size", "block", "node")
    got = mixing.mix_counts(docs, bucket_rows=bucket_rows, max_block=max_block).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = _targets(sizes)
    want = Counter((r[0], len(words(r[1])), sizes[r[3]], round(target[r[3]], 2)) for r in rows)
    assert Counter((g["doc_id"], g["size"], g["source_size"], round(g["target"], 2)) for g in got) == want
    assert all(0 <= g["taken"] <= 3 * g["size"] for g in got)
    for size in set(sizes.values()):
        members = [g for g in got if g["source_size"] == size]
        n = sum(v == size for v in sizes.values())
        if n == 1:
            assert abs(sum(g["taken"] for g in members) - members[0]["target"]) <= 1
    again = mixing.mix_counts(docs, bucket_rows=bucket_rows, max_block=max_block).collect()
    assert as_counter(again) == as_counter(got)


def test_caps(llm):
    """A tiny source of heavy weight stops at three times its size, and what it
    leaves is shared by weight."""
    rows = [(i, "w " * 100, "b") for i in range(30)] + [(100, "w " * 10, "a"), (101, None, "a"), (102, "", "empty")]
    got = mixing.mix_counts(llm.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {g["doc_id"]: g for g in got}
    assert by[100]["target"] == 30 and by[100]["taken"] == 30
    assert by[101]["taken"] == 0 and by[102]["target"] == 0
    assert sum(g["taken"] for g in got) in (3009, 3010)


def test_schedule_spreads(llm):
    """Every stretch of the schedule holds each source near its share."""
    sources = llm.createDataFrame([(1, 0.0, 0.5), (2, 0.5, 0.8), (3, 0.8, 0.8), (4, 0.8, 1.0)], "sid int, low double, high double")
    got = sorted(mixing.schedule(sources, 3000, 128).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(3000))
    for sid in (1, 2, 4):
        own = [r for r in got if r["sid"] == sid]
        assert [r["rank"] for r in own] == list(range(len(own)))
    for start in range(0, 3000, 100):
        c = Counter(r["sid"] for r in got[start:start + 100])
        assert abs(c[1] - 50) <= 3 and abs(c[2] - 30) <= 3 and abs(c[4] - 20) <= 3 and not c[3]


def test_documents(llm):
    rows = [(i, f"w{i} " * 20, "a", i) for i in range(40)] + [(100 + i, f"v{i} " * 20, "b", i) for i in range(40)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, source string, row int")
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    counts = Counter(r["source"] for r in got.collect())
    assert abs(counts["a"] - 80 * 5 / 7) <= 1 and abs(counts["b"] - 80 * 2 / 7) <= 1
    assert set(map(tuple, got.collect())) <= set(rows)


def test_empty(empty):
    assert mixing.mix_counts(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
