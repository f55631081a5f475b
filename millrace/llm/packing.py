"""Packing of tokenised documents into sequences of bounded length.

A best-fit start is improved by a swap-based local search: moves, one-for-one,
two-for-one and one-for-two exchanges between underfull bins, each of which
increases the sum of squared fills, until bins empty or no exchange is left.
Pieces are dealt into groups of bounded size that are packed apart; what their
underfull bins hold is pooled and packed once more.
"""

from __future__ import annotations

import base64
import functools
import math
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import doc_rows, materialize

#: Pieces packed together in one task's memory.
GROUP_PIECES = 4096
#: Added tokens of ``byte_bpe_50k``.
ADDED_TOKENS = {"<|endoftext|>": 50256}


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS)


def encode(path: str, text: str, added_tokens: bool = False) -> array:
    """Ids of a whole text. With ``added_tokens`` their strings have their own
    ids, as in the ``tokenizers`` library; otherwise they are ordinary text."""
    if added_tokens and any(s in text for s in ADDED_TOKENS):
        return array("I", _encoding(path).encode(text, allowed_special=set(ADDED_TOKENS), disallowed_special=()))
    return array("I", _encoding(path).encode_ordinary(text))


def token_pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0,
                 keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Token ids of every whole text, closed by ``end_id``, cut where longer than
    ``capacity``: all pieces but the first then hold ``capacity`` ids.

    Returns per piece ``doc_id, piece, start, length, ids_crc32`` and, with
    ``keep_ids``, ``ids`` (array<long>). A NULL or empty text is one piece of one
    id; rows with the same id yield pieces each; other columns are ignored.
    ``added_tokens``: see ``encode``. ``path`` must be readable on every executor (it is part of the install).
    """
    path = path or vocabulary_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids

    def run(batches):
        for batch in batches:
            out = defaultdict(list)
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.frombuffer(encode(path, text, added_tokens) + array("I", [end_id]), np.uint32).astype("<u4", copy=False)
                total, at, piece = len(ids), 0, 0
                step = total % capacity or capacity
                while at < total:
                    part = ids[at:at + step]
                    row = (doc_id, piece, at, step, zlib.crc32(part), *([part.tolist()] if keep_ids else []))
                    for k, v in enumerate(row):
                        out[k].append(v)
                    at, piece, step = at + step, piece + 1, capacity
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            width = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(out[k], types[k]) for k in range(width)], names=names[:width])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Items by bin: the longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if room > size:
            by_room[room - size].append(b)
            open_rooms |= 1 << (room - size)
    return bins


def _amounts(items: list[int], lengths: np.ndarray, pairs: bool) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Lengths that can leave a bin, each once: its different item lengths and,
    with ``pairs``, sums of two items; and the items that make them up."""
    found: dict[int, tuple[int, ...]] = {}
    by_size: dict[int, list[int]] = defaultdict(list)
    for i in items:
        by_size[int(lengths[i])].append(i)
    if pairs:
        sizes = sorted(by_size)
        for a, s in enumerate(sizes):
            if len(by_size[s]) > 1:
                found[2 * s] = tuple(by_size[s][:2])
            for t in sizes[a + 1:]:
                found[s + t] = (by_size[s][0], by_size[t][0])
    else:
        found = {s: (v[0],) for s, v in by_size.items()}
    return np.array(list(found), np.int64), list(found.values())


class _OpenBins:
    """Underfull bins with, for each, the amounts that can leave it: lengths of
    one item and of two."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins, self.fills, self.one, self.two = bins, [0] * len(bins), [None] * len(bins), [None] * len(bins)
        for b in range(len(bins)):
            self.refresh(b)

    def refresh(self, b: int) -> None:
        items = self.bins[b]
        self.fills[b] = int(self.lengths[items].sum()) if items else 0
        self.one[b], self.two[b] = _amounts(items, self.lengths, False), _amounts(items, self.lengths, True)

    def open(self) -> list[int]:
        return [b for b, f in enumerate(self.fills) if 0 < f < self.capacity]

    def exchange(self, donor: int) -> bool:
        """The exchange of one item or two of the donor for none, one or two of
        another bin that raises the sum of squared fills most, if any does: a
        gain g of a bin filled v from one filled d raises it by 2g(v - d + g)."""
        others = [b for b in self.open() if b != donor]
        if not others or not self.bins[donor]:
            return False
        fill = self.fills[donor]
        fills = np.array([self.fills[b] for b in others], np.int64)
        best, choice = 0, None
        nothing = [(np.zeros(1, np.int64), [()])] * len(others)
        for (out, outs), backs in ((self.one[donor], nothing), (self.one[donor], [self.one[b] for b in others]),
                                   (self.two[donor], [self.one[b] for b in others]), (self.one[donor], [self.two[b] for b in others])):
            counts = [len(x[0]) for x in backs]
            if not len(out) or not sum(counts):
                continue
            of = np.repeat(np.arange(len(others)), counts)
            gain = out[:, None] - np.concatenate([x[0] for x in backs])[None, :]
            held = fills[of][None, :]
            worth = np.where((gain > 0) & (gain <= self.capacity - held), gain * (held - fill + gain), 0)
            k = int(worth.argmax())
            if worth.flat[k] > best:
                i, j = divmod(k, worth.shape[1])
                other = int(of[j])
                best, choice = int(worth.flat[k]), (outs[i], others[other], backs[other][1][j - sum(counts[:other])])
        if choice is None:
            return False
        given, other, taken = choice
        for i in given:
            self.bins[donor].remove(i)
            self.bins[other].append(i)
        for i in taken:
            self.bins[other].remove(i)
            self.bins[donor].append(i)
        self.refresh(donor)
        self.refresh(other)
        return True


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchange items between underfull bins while that increases the sum of
    squared fills, the least filled bin giving first, until a round over all
    bins empties none or no fewer bins could hold the items. The sum is a
    bounded integer that grows with every exchange, so each round ends."""
    fills = [int(lengths[b].sum()) if b else 0 for b in bins]
    least = -(-sum(fills) // capacity)
    full = [b for b, f in zip(bins, fills, strict=True) if f == capacity]
    work = _OpenBins([list(b) for b, f in zip(bins, fills, strict=True) if 0 < f < capacity], lengths, capacity)
    used, before = len(bins), len(bins) + 1
    while least < used < before:
        before = used
        for donor in sorted(work.open(), key=lambda b: work.fills[b]):
            while 0 < work.fills[donor] < capacity and work.exchange(donor):
                pass
            used = len(full) + sum(map(bool, work.bins))
            if used == least:
                break
    return full + [b for b in work.bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of every item; lengths lie between 1 and ``capacity``."""
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    of, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for b, items in enumerate(bins):
        of[items] = b
        at[items] = np.cumsum(lengths[items]) - lengths[items]
    return of, at


def _pack_groups(pieces: DataFrame, capacity: int, groups: int, base: int) -> DataFrame:
    columns = pieces.columns
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece") if c in columns], F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, filled long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy().astype(np.int64)
        of, at = pack_lengths(lengths, capacity)
        filled = np.bincount(of, weights=lengths).astype(np.int64)[of]
        sequence = (base + int(frame["_group"].iloc[0])) * (1 << 31) + of
        return frame.drop(columns="_group").assign(sequence_id=sequence, offset=at, filled=filled)

    return dealt.groupBy("_group").applyInPandas(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack rows by their ``length`` (1 to ``capacity``) into sequences.

    Returns the rows with ``sequence_id``, ``offset`` (gapless from 0) and
    ``filled`` (the sequence's total). Sequences never exceed ``capacity``. Ties
    and repeated rows are packed each; an empty table gives an empty result.
    Groups of at most about ``group_pieces`` rows are packed apart; the rows of
    all sequences left underfull are then pooled and packed again.
    """
    pieces = materialize(pieces, "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    packed = _pack_groups(pieces, capacity, groups, 0)
    if groups == 1:
        return packed
    packed = materialize(packed, "packed")
    rest = packed.filter(F.col("filled") < capacity).select(*pieces.columns)
    again = _pack_groups(rest, capacity, max(1, math.ceil(rest.count() / group_pieces)), groups)
    return packed.filter(F.col("filled") == capacity).unionByName(again)


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, keep_ids: bool = False,
                   group_pieces: int = GROUP_PIECES, added_tokens: bool = False) -> DataFrame:
    """Tokenise ``docs`` and pack the pieces; see ``token_pieces`` and ``pack_pieces``."""
    return pack_pieces(token_pieces(docs, capacity, path, keep_ids=keep_ids, added_tokens=added_tokens), capacity, group_pieces)
