"""Divergence, vector codes and decontamination against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import decontaminate, divergence, terms, veccodes
from tests.conftest import SF_SMALL
from tests.llm.helpers import as_counter

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _audit(rows, min_docs=10, top=10):
    each = defaultdict(Counter)
    docs, langs = Counter(), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = _LETTERS.findall((text or "").translate(_FOLD))
        each[lang, source].update(found)
        docs.update({(lang, t) for t in found})
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for (l, t), n in docs.items() if l == lang and n >= min_docs]
        v = len(kept)
        counts = {s: {t: each[lang, s][t] for t in kept} for s in sources}
        total = {t: sum(counts[s][t] for s in sources) for t in kept}

        def shares(c, v=v):
            whole = sum(c.values()) + 2 * v
            return {t: 1 + 10**9 * (n + 2) // whole for t, n in c.items()}

        p, q = {s: shares(counts[s]) for s in sources}, shares(total)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, apart(p[s][t], q[t])) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", own, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:limit])]
    return out


@pytest.mark.parametrize("sizes", [{}, {"spill_cells": 40, "task_cells": 30, "source_block": 3}])
def test_divergence(odd, sizes):
    docs, rows = odd
    got = divergence.source_divergence(docs, **sizes).select("lang", "source", "part", "item", "value", "rank").collect()
    assert as_counter(got) == Counter(_audit(rows))


def test_divergence_counts_beyond_64_bits_of_product():
    count, whole = np.array([10**14 + 7, 1, 0]), np.array([9 * 10**14 + 1] * 3)
    assert divergence._share(count, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole, strict=True)]


def test_divergence_without_frequent_terms(llm, empty):
    docs = llm.createDataFrame([("a b", "en", "x"), (None, "en", "y"), ("b", None, None)], "text string, lang string, source string")
    got = {tuple(r) for r in divergence.source_divergence(docs).collect()}
    assert got == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    assert divergence.source_divergence(empty).count() == 0


def _codes(vectors, parts, entries, rounds):
    """Vectors of Python integers in id order."""
    width = len(vectors[0]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for v in vectors] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def near(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for x in cut[p]]

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            of = defaultdict(list)
            for x, (_, k) in zip(cut[p], near(p), strict=True):
                of[k].append(x)
            moved.append([tuple(sum(c) // len(of[k]) for c in zip(*of[k], strict=True)) if k in of else e for k, e in enumerate(books[p])])
        books = moved
    last = [near(p) for p in range(parts)]
    return ["".join(f"{last[p][i][1]:02x}" for p in range(parts)) for i in range(len(vectors))], [sum(last[p][i][0] for p in range(parts)) for i in range(len(vectors))], books


def _digest(books):
    return hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def test_codes(llm):
    rows = llm.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    vectors = [[int(np.floor(x * 1024)) for x in r["embedding"]] for r in rows]
    for entries, groups in ((256, 8), (17, 3), (5, 8)):
        coded, books = veccodes.encode_vectors(llm.read.parquet(f"{SF_SMALL}/embeddings.parquet").repartition(5), entries=entries, groups=groups)
        got = {r["vec_id"]: r for r in coded.collect()}
        codes, errors, plain = _codes(vectors, 4, entries, 4)
        assert [got[r["vec_id"]]["code"] for r in rows] == codes and [got[r["vec_id"]]["error"] for r in rows] == errors
        assert books.sha256() == _digest(plain)
        by_label = Counter()
        for r, e in zip(rows, errors, strict=True):
            by_label[r["label"]] += e
        assert all(got[r["vec_id"]]["label_error"] == by_label[r["label"]] for r in rows)


def test_codes_odd_rows(llm):
    nan, inf = float("nan"), float("inf")
    good = [(3, [1.0, -2.0, 0.5, 4.0], 1), (1, [0.001, 0.0, -0.001, 9.0], None), (1, [0.0, 0.0, 0.0, 0.0], None), (None, [5.0, 5.0, 5.0, 5.0], 2),
            (3, [1.0, -2.0, 0.5, 4.0], 1), (7, [1.0], 2), (8, [], 3)]
    bad = [(4, None, 1), (5, [1.0, None, 0.0, 0.0], 1), (6, [nan, 0.0, 0.0, 0.0], 1), (9, [0.0, 0.0, 0.0, -inf], 1)]
    schema = "vec_id long, embedding array<float>, label int, x string, state string, sums string, error string"
    coded, books = veccodes.encode_vectors(llm.createDataFrame([(*r, "a", "b", "c", "d") for r in good + bad], schema), entries=3)
    filled = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[int(np.floor(np.float32(x) * 1024)) for x in r[1]] + [0] * (4 - len(r[1])) for r in filled]
    codes, errors, plain = _codes(vectors, 4, 3, 4)
    by_label = Counter()
    for r, e in zip(filled, errors, strict=True):
        by_label[r[2]] += e
    assert as_counter(coded.select("vec_id", "code", "error", "label_error").collect()) == Counter((r[0], c, e, by_label[r[2]]) for r, c, e in zip(filled, codes, errors, strict=True))
    assert books.sha256() == _digest(plain)
    assert veccodes.encode_vectors(llm.createDataFrame(bad, "vec_id long, embedding array<float>, label int"))[0].count() == 0


def test_large_components_stay_exact(llm):
    rng = np.random.default_rng(5)
    values = [[float(np.float32(x)) for x in rng.normal(0, 30_000, 8)] for _ in range(40)]
    coded, _ = veccodes.encode_vectors(llm.createDataFrame([(i, v, 0) for i, v in enumerate(values)], "vec_id long, embedding array<double>, label int"), entries=6)
    codes, errors, _ = _codes([[int(np.floor(x * 1024)) for x in v] for v in values], 4, 6, 4)
    assert {(r["vec_id"], r["code"], r["error"]) for r in coded.collect()} == {(i, c, e) for i, (c, e) in enumerate(zip(codes, errors, strict=True))}


def test_net_displacement_rules_out_more_than_summed_drifts():
    """An entry that moves away and comes back leaves stamped bounds as they were;
    codes stay those of a full scan, with fewer distances computed."""
    rng = np.random.default_rng(3)
    x = np.rint(rng.normal(0, 300, (3000, 8)))
    first = x[:64].copy()
    group = veccodes.entry_groups(first, 8)
    state = np.zeros(len(x), veccodes._state_type(8))
    full = veccodes.assign(x, state, [first], group, True)
    away = first + rng.integers(-40, 40, first.shape)
    held = state.copy()
    moved = veccodes.assign(x, held, [first, away], group, False)
    assert (held["code"] == veccodes._squares(x, away).argmin(axis=1)).all() and moved < full
    back = veccodes.assign(x, state, [first, away, first], group, False)  # bounds of round 0, net displacement 0
    assert (state["code"] == veccodes._squares(x, first).argmin(axis=1)).all() and back < moved / 2
    books, summed, scanned = [first, away], 0, moved
    for k in range(6):  # further rounds, each from the bounds and stamps of the ones before
        books.append(books[-1] + rng.integers(-9, 10, first.shape) if k % 2 else books[-2].copy())
        scanned += veccodes.assign(x, held, books, group, False)
        summed += full
        assert (held["code"] == veccodes._squares(x, books[-1]).argmin(axis=1)).all(), k
    assert scanned < summed


def _contaminated(rows, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = _ALNUM.findall((text or "").translate(_FOLD))
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if w else ():
            windows[tuple(w[i:i + size])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for r in rows:
        w = _ALNUM.findall((r[1] or "").translate(_FOLD))
        hit, seen = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i:i + size]))
                if found is not None:
                    hit.update(range(i, i + size))
                    seen |= found
        names = sorted(str(i) for i in seen if i is not None)
        out.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def bench(llm):
    rows = [tuple(r) for r in llm.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows += [(900, None), (901, ""), (902, " .,; "), (903, "one"), (904, "Two, WORDS!"), (905, "the quick brown fox jumps over the lazy dog while seven wizards"), (906, "café 你好"),
             (905, "w0 w1 w4"), (907, "one"), (None, "potion in the old tower"), (10, "ha ha ha ha ha ha ha ha ha ha ha")]
    return llm.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, found string"), rows


@pytest.mark.parametrize("block_bytes", [1 << 30, 20_000])
def test_contamination(odd, bench, block_bytes):
    docs, rows = odd
    found = decontaminate.find_contamination(docs, bench[0], block_bytes=block_bytes)
    assert as_counter(decontaminate.digests(found).collect()) == Counter(_contaminated(rows, bench[1]))


@pytest.mark.parametrize("block_bytes", [1 << 30, 20_000])
def test_removal(odd, bench, block_bytes):
    docs, rows = odd
    docs = docs.withColumnRenamed("node", "found")
    hit = Counter({r[:2]: 0 for r in rows})
    for r, c in zip(rows, _contaminated(rows, bench[1]), strict=True):
        hit[r[:2]] = c[-1]
    whole = decontaminate.decontaminate(docs, bench[0], "documents", block_bytes=block_bytes)
    assert whole.columns == docs.columns
    assert as_counter(whole.select("doc_id", "text").collect()) == Counter(r[:2] for r in rows if not hit[r[:2]])
    cut = decontaminate.decontaminate(docs, bench[0], block_bytes=block_bytes)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    short = [w for i, t in bench[1] for w in [_ALNUM.findall((t or "").translate(_FOLD))] if len(w) == 1]
    for r in cut.select("doc_id", "text").collect():
        if r["text"] is not None:
            assert not any([s[0]] for s in short if s[0] in _ALNUM.findall(r["text"].translate(_FOLD)))
    text = "Before. ONE after, two  words; the end"
    one = docs.sparkSession.createDataFrame([(1, text)], "doc_id long, text string")
    assert decontaminate.decontaminate(one, bench[0]).first()["text"] == "Before.  after, ; the end"
    with pytest.raises(ValueError):
        decontaminate.decontaminate(one, bench[0], "words")


def test_empty_benchmark(odd, empty, llm):
    docs, rows = odd
    none = llm.createDataFrame([], "item_id long, text string")
    got = decontaminate.digests(decontaminate.find_contamination(docs, none)).collect()
    assert as_counter(got) == Counter(_contaminated(rows, []))
    assert decontaminate.find_contamination(empty, none).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch, llm):
    """With all hashes equal, the windows' own words decide."""
    monkeypatch.setattr(terms.tk, "mix", lambda x: x & np.uint64(0))
    rows = [decontaminate._Windows(2, [{"hash": 0, "lengths": np.array(n, "<i4").tobytes(), "letters": s, "items": [s.decode()]} for n, s in (((2, 1), b"abc"), ((1, 2), b"abc"), ((1, 2), b"abd"))])]
    import pyarrow as pa
    got = decontaminate._found(pa.array(["x A bc y ab d", "ab-c"]), rows).to_pylist()
    assert [g["items"] for g in got] == [["abc"], ["abc"]]
    assert [[(s["first"], s["last"]) for s in g["spans"]] for g in got] == [[(1, 3)], [(0, 2)]]
