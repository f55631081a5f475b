"""Deduplication operators against plain versions, over several chunks."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import partenum, suffixes, windows
from tests.llm.helpers import as_counter, shingle_set


def _cut_windows(rows, size):
    first = {}
    low = -(2**63)
    ids = [low if r[0] is None else r[0] for r in rows]
    each = [(r[1] or "").encode().split() for r in rows]
    for d, w in zip(ids, each, strict=True):
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            first[k] = min(first.get(k, d), d)
    out = []
    for r, d, w in zip(rows, ids, each, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < d:
                gone[i:i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 30, 40_000])
def test_windows(odd, chunk_bytes):
    docs, rows = odd
    cut = windows.cut_repeated_windows(docs, 13, chunk_bytes)
    got = windows.digests(cut).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert as_counter(got) == Counter(_cut_windows(rows, 13))


def test_window_spans_are_maximal(llm):
    text = " ".join(f"w{i}" for i in range(30))
    docs = llm.createDataFrame([(1, text), (2, "x " + text + " y")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in windows.cut_repeated_windows(docs, 13).collect()}
    assert got[1]["spans"] == [] and got[1]["kept_text"] == text
    assert [tuple(s) for s in got[2]["spans"]] == [(1, 31)] and got[2]["kept_text"] == "x y"


def _cut_bytes(rows, length):
    each = [(r[1] or "").encode() for r in rows]
    count = Counter(t[i:i + length] for t in each for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, each, strict=True):
        change = [0] * (len(t) + 1)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                change[i] += 1
                change[i + length] -= 1
        kept, spans, depth, inside = bytearray(), 0, 0, False
        for b, c in zip(t, change, strict=False):
            depth += c
            spans += depth > 0 and not inside
            inside = depth > 0
            if not inside:
                kept.append(b)
        out.append((r[0], len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("chunk_bytes", "hot_runs"), [(1 << 30, 100_000), (60_000, 100_000), (60_000, 1), (60_000, 2)])
def test_suffixes(odd, chunk_bytes, hot_runs):
    docs, rows = odd
    got = suffixes.digests(suffixes.cut_repeated_bytes(docs, 200, chunk_bytes, hot_runs=hot_runs)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert as_counter(got) == Counter(_cut_bytes(rows, 200))


def test_phrase_in_a_third_of_the_documents(llm):
    """Runs around one common phrase are spread; what repeats is still found."""
    rng = np.random.default_rng(4)
    phrase = "this very common phrase of sixty-four bytes stands nearly everywhere "

    def noise(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    shared = phrase.join([noise(150), noise(150)])
    texts = [noise(300) + (phrase if i % 3 == 0 else " ") + noise(300) for i in range(900)] + [noise(50) + shared + noise(40) for _ in range(5)]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter(_cut_bytes(list(enumerate(texts)), 200))
    for hot_runs in (100_000, 50):
        got = suffixes.digests(suffixes.cut_repeated_bytes(docs, 200, 50_000, hot_runs=hot_runs)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert as_counter(got) == want
    assert sum(r[2] > 0 for r in want.elements()) == 5


def test_string_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"abcab" * 60 + b"xyz" * 40, np.uint8)
    got = suffixes.string_hashes(data, 40)
    same = {}
    for i, h in enumerate(got.tolist()):
        assert same.setdefault(data[i:i + 40].tobytes(), h) == h
    assert len(set(same.values())) == len(same) and (suffixes.string_hashes(data[7:120], 40) == got[7:81]).all()


def test_suffix_segments(llm):
    """A text longer than a segment gives the same as a short segment."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, 5000))) * 2
    whole = suffixes.ChunkRuns(pa.array([text]), 200)
    assert (whole.last - whole.first + 1).sum() == len(text) - 199
    assert ((whole.anchor >= whole.first) & (whole.anchor <= whole.last + 200 - 32)).all()


def test_multikey_sort():
    import numpy as np
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 99, 24).astype(np.uint8)) for _ in range(300)] + [b"a" * 24] * 3
    order, shared = suffixes.multikey_sort(suffixes._keys(strings, 24))
    ranked = [strings[i] for i in order]
    assert ranked == sorted(strings)
    for x, y, n in zip(ranked, ranked[1:], shared[1:], strict=False):
        assert n == next((i for i in range(24) if x[i] != y[i]), 24)


def _components(rows, size, similarity):
    sets = [shingle_set(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    holders = {}
    for i, s in enumerate(sets):
        seen = Counter(j for x in s for j in holders.get(x, ()))
        for j, both in seen.items():
            if both >= similarity * (len(s) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("shingle", "similarity", "chunk_bytes", "block"), [(3, 0.9, 1 << 30, 4096), (3, 0.9, 50_000, 3), (5, 0.8, 50_000, 4096)])
def test_jaccard(odd, shingle, similarity, chunk_bytes, block):
    docs, rows = odd
    got = partenum.near_duplicate_components(docs, shingle, similarity, chunk_bytes, block).collect()
    assert as_counter(got) == Counter(_components(rows, shingle, similarity))


def test_jaccard_chains(llm):
    """Links that don't touch the smallest set of their signature groups."""
    import random
    rnd, rows = random.Random(4), []
    for group in range(12):
        base = [f"g{group}x{i}" for i in range(rnd.choice((30, 80, 200)))]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.choice((0, 1, 2, 3, 5, 8, 12))):
                w[rnd.randrange(len(w))] = f"n{rnd.random()}"
            rows.append((len(rows), " ".join(w)))
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = partenum.near_duplicate_components(docs, 3, 0.9, 20_000, 5).collect()
    assert as_counter(got) == Counter(_components(rows, 3, 0.9))


def test_across_is_dealt_in_bounded_groups(llm, monkeypatch):
    """300 unlinked sets of one signature, 16 a block: no task's group holds more
    than a block and a few blocks of probes, and every pair meets."""
    import numpy as np
    import pyarrow as pa
    members = llm.createDataFrame([(7, i) for i in range(300)], "signature long, node long")
    sketches = llm.createDataFrame([(i, 10, bytes(8)) for i in range(300)], "node long, n long, sketch binary")
    labels = llm.createDataFrame([(0, 0), (1, 0)], "node long, component long")

    def missed():
        if hasattr(partenum, "_sized"):
            mixed = partenum._mixed(members, sketches, labels)
            return partenum._missed(mixed, partenum._sized(mixed, 16), sketches, 0.8, 16)
        return partenum._missed(members, sketches, labels, 0.8, 16)
    assert {(r["a"], r["b"]) for r in missed().collect()} == {(a, b) for b in range(300) for a in range(b)} - {(0, 1)}

    def counted(_):
        return lambda key, table: pa.table({"a": pa.array([table.num_rows], pa.int64()), "b": pa.array(np.zeros(1, np.int64))})
    monkeypatch.setattr(partenum, "_across", counted)
    assert max(r["a"] for r in missed().collect()) <= 3 * 5 * 16


def test_across_starts_from_new_centres(llm):
    """Two templates that share signatures and not a link: found whole with
    blocks of three sets, as by plain comparison."""
    base = [f"w{i}" for i in range(400)]
    other = base[:60] + [f"v{i}" for i in range(340)]
    rows = [(i, " ".join((base if i % 2 else other)[:390] + [f"u{i}"]), None, None, None) for i in range(40)]
    docs = llm.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicate_components(docs, 3, 0.8, block_sets=3).collect()}
    assert got == {i: i % 2 for i in range(40)}


def test_signatures_meet():
    """Any two similar enough sets of one size band share a signature."""
    import numpy as np
    rng = np.random.default_rng(5)
    for size in (1, 2, 5, 9, 10, 19, 20, 37, 100, 400):
        for similarity in (0.8, 0.9):
            for _ in range(20):
                differ = int((1 - similarity) / (1 + similarity) * 2 * size + 1e-9)
                drop, add = differ // 2, differ - differ // 2
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64))))
                both = len(np.intersect1d(a, b))
                if both + 1e-9 < similarity * (len(a) + len(b) - both):
                    continue
                sigs, of = partenum.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), similarity)
                assert set(sigs[of == 0]) & set(sigs[of == 1])


def test_empty(empty):
    assert windows.cut_repeated_windows(empty).count() == 0
    assert suffixes.cut_repeated_bytes(empty).count() == 0
    assert partenum.near_duplicate_components(empty).count() == 0


def test_keep_one(llm):
    text = " ".join(f"w{i}" for i in range(60))
    docs = llm.createDataFrame([(4, text, "a"), (2, text + " more", "b"), (3, "other", "c"), (9, None, "d")], "doc_id long, text string, source string")
    got = partenum.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 3, 9]
