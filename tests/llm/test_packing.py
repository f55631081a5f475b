"""Tokenising and packing: ids against the tokenizers library, round trips,
bounds of the search."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("group_pieces", [4096, 20])
def test_pack_documents(odd, tokenizer, group_pieces):
    docs, rows = odd
    got = packing.pack_documents(docs, keep_ids=True, group_pieces=group_pieces).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0])
    pieces = defaultdict(lambda: defaultdict(list))
    for r in got:
        pieces[r["doc_id"]][r["piece"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert 1 <= r["length"] == len(r["ids"]) <= 2048 and (r["piece"] == 0 or r["length"] == 2048)
    for doc_id, wanted in texts.items():
        if len(wanted) == 1:
            parts = [pieces[doc_id][k][0] for k in sorted(pieces[doc_id])]
            assert [i for p in parts for i in p["ids"]] == wanted[0]
            assert [p["start"] for p in parts] == list(np.cumsum([0] + [p["length"] for p in parts[:-1]]))
        assert sum(p["length"] for x in pieces[doc_id].values() for p in x) == sum(map(len, wanted))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    least = -(-total // 2048)  # groups of 20 pieces leave a little more open
    assert len(sequences) <= (least + 1 if group_pieces > 1000 else 1.05 * least)


def test_added_tokens(llm, tmp_path):
    """The registered query's ids are the tokenizers library's with its default settings."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.llm.queries import QUERIES
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", " ", "  ", "\n", "a", " b", "it's", "'s", "<", ">", "é", "你", "12", "..."]
    texts = ["a <|endoftext|> b", "<|endoftext|>"] + ["".join(rnd.choices(parts, k=rnd.randrange(12))) for _ in range(500)]
    path = packing.vocabulary_path()
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(packing.encode(path, t, added_tokens=True)) for t in texts] == want and 50256 in want[0]
    llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in QUERIES["op1_pack"](llm, str(tmp_path)).collect()}
    assert got == {i: (len(w) + 1, zlib.crc32(np.array(w + [0], "<u4").tobytes())) for i, w in enumerate(want)}


def _loads(bins, lengths):
    return sorted(int(lengths[b].sum()) for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_search_keeps_items_and_empties_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, rng.choice((300, 700, 1001)), 400)
    start = packing.best_fit(lengths, 1000)
    found = packing.local_search(start, lengths, 1000)
    assert sorted(i for b in found for i in b) == list(range(400))
    assert max(_loads(found, lengths)) <= 1000 and len(found) <= len(start)
    # from a poor start (one item a bin) the search does the packing
    poor = packing.local_search([[i] for i in range(60)], lengths[:60], 1000)
    assert sorted(i for b in poor for i in b) == list(range(60))
    assert max(_loads(poor, lengths)) <= 1000
    assert len(poor) <= -(-int(lengths[:60].sum()) // 1000) + 6


def test_exchanges():
    """Two bins that only exchanges, not moves, can turn into fewer."""
    lengths = np.array([6, 3, 5, 4, 1, 1])
    bins = packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 10)
    assert len(bins) == 2
    same = packing.local_search([[0], [1]], np.array([7, 7]), 10)
    assert len(same) == 2
    work = packing._OpenBins([[0, 1], [2, 3]], np.array([6, 2, 5, 3]), 11)
    while work.exchange(0):
        pass
    assert sorted(work.fills) == [5, 11]  # from 8 and 8


def test_best_fit():
    bins = packing.best_fit(np.array([5, 5, 4, 4, 2]), 10)
    assert [sorted(b) for b in bins] == [[0, 1], [2, 3, 4]]


def test_empty(empty):
    assert packing.pack_documents(empty).count() == 0
