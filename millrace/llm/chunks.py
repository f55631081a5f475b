"""Document fingerprints by content-defined chunking.

A gear hash over the last bytes decides, by content alone, where a text is cut:
a stricter mask before the normal chunk size and a looser one after it keep the
chunks near that size. The fingerprint is the set of the chunks' digests and
lengths, so an insertion or a replaced part changes only the chunks it touches.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import doc_rows, id_chunks

#: Bytes of a chunk: least, normal and most; and the bits that must be zero in
#: the hash before and after the normal size.
LEAST, NORMAL, MOST = 12, 32, 96
STRICT_BITS, LOOSE_BITS = 6, 4
#: Bytes that the gear hash looks back on (older ones have left its 32 bits).
_REACH = 32
CHUNK_BYTES = 12 << 20
_ENTRY = 5  # four bytes of digest, one of length


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h(i) = 2 h(i - 1) + key of byte i, modulo 2 ** 32, for every byte; by
    doubling the number of bytes summed."""
    h = (tk.byte_keys(data) >> np.uint64(32)).astype(np.uint32)
    width = 1
    while width < _REACH:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, width * 2
    return h


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chunk ends of all texts (ascending; every text's end is one). The hash's
    upper bits are tested: they depend on the most bytes. A hash that reaches
    back beyond the text's first byte counts only from the least chunk size on,
    and only bytes of the chunk's own text are looked at from ``_REACH`` on."""
    h = gear_hashes(data)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = h[loose] >> np.uint32(32 - STRICT_BITS) == 0
    places, firm = (loose + 1).tolist(), strict.tolist()
    ends, at, n = [], 0, len(places)
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while start < stop:
            least, normal, most = start + LEAST, start + NORMAL, min(start + MOST, stop)
            while at < n and places[at] < least:
                at += 1
            cut, k = most, at
            while k < n and places[k] <= most:
                if firm[k] or places[k] > normal:
                    cut = places[k]
                    break
                k += 1
            ends.append(cut)
            start = cut
    return np.array(ends, np.int64)


class Prints:
    """Chunk digest sets of many texts: per text ascending (digest, length)."""

    def __init__(self, texts: pa.Array):
        data, offsets = tk.column_bytes(texts)
        digests, sizes, counts = [], [], []
        for i, j in tk.slices(offsets):
            part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            ends = self._apart(part, at)
            if not len(ends):
                counts.append(np.zeros(j - i, np.int64))
                continue
            starts = np.concatenate(([0], ends[:-1]))
            length = ends - starts
            place = np.arange(len(part)) - np.repeat(starts, length)
            sums = np.add.reduceat(tk.byte_keys(part) * tk.powers(MOST)[place], starts)
            digests.append((tk.mix(sums + length.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))
            sizes.append(length.astype(np.uint8))
            counts.append(np.diff(np.searchsorted(ends, at, "right")))
        count = np.concatenate(counts) if counts else np.empty(0, np.int64)
        text = np.repeat(np.arange(len(count)), count)
        digest = np.concatenate(digests) if digests else np.empty(0, np.uint32)
        size = np.concatenate(sizes) if sizes else np.empty(0, np.uint8)
        key = (digest.astype(np.uint64) << np.uint64(8)) | size
        order = np.lexsort((key, text))
        key, text = key[order], text[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        self.keys, self.text = key[fresh], text[fresh]
        self.at = np.searchsorted(self.text, np.arange(len(count) + 1))
        self.weight = np.bincount(self.text, weights=(self.keys & np.uint64(255)).astype(np.float64), minlength=len(count))

    @staticmethod
    def _apart(part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Boundaries as if each text stood alone: a gap of ``_REACH`` zero bytes
        before each keeps the hash from reaching into its neighbour."""
        n = len(at) - 1
        spread = np.zeros(len(part) + _REACH * n, np.uint8)
        shift = np.repeat((np.arange(n) + 1) * _REACH, np.diff(at))
        spread[np.arange(len(part)) + shift] = part
        begins = at[:-1] + (np.arange(n) + 1) * _REACH
        # a gap is its own "text" of one piece, whose ends are dropped again
        borders = np.empty(2 * n + 1, np.int64)
        borders[0], borders[1::2], borders[2::2] = 0, begins, at[1:] + (np.arange(n) + 1) * _REACH
        ends = boundaries(spread, borders)
        which = np.searchsorted(borders, ends, "left") - 1
        ends = ends[which % 2 == 1]
        return ends - (np.searchsorted(borders, ends, "left") // 2) * _REACH

    def strings(self) -> list[str]:
        """Fingerprints as text: base64 of each chunk's digest and length."""
        raw = self.keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
        return [base64.b64encode(raw[_ENTRY * s:_ENTRY * e]).decode() for s, e in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]


def _likeness(a: Prints, b: Prints, other: np.ndarray) -> np.ndarray:
    """Weight that text i of ``a`` and text ``other[i]`` of ``b`` share, by the
    heavier's weight: the smaller of the two containments. Two empty: 1."""
    inverse_rows = np.concatenate([np.arange(b.at[o], b.at[o + 1]) for o in other]) if len(other) else np.empty(0, np.int64)
    text = np.repeat(np.arange(len(other)), b.at[other + 1] - b.at[other])
    keys = np.concatenate((a.keys, b.keys[inverse_rows]))
    texts = np.concatenate((a.text, text))
    order = np.lexsort((keys, texts))
    keys, texts = keys[order], texts[order]
    same = (keys[1:] == keys[:-1]) & (texts[1:] == texts[:-1])
    shared = np.bincount(texts[1:][same], weights=(keys[1:][same] & np.uint64(255)).astype(np.float64), minlength=len(other))
    heavier = np.maximum(a.weight, b.weight[other])
    return np.where(heavier > 0, shared / np.maximum(heavier, 1), 1.0)


def likeness(one: str, other: str) -> float:
    """Likeness of two fingerprints: shared weight by the heavier's weight."""
    def entries(s):
        raw = base64.b64decode(s)
        return {raw[i:i + _ENTRY] for i in range(0, len(raw), _ENTRY)}
    a, b = entries(one), entries(other)
    top = max(sum(x[-1] for x in a), sum(x[-1] for x in b))
    return sum(x[-1] for x in a & b) / top if top else 1.0


def containment(one: str, other: str) -> float:
    """Share of the first fingerprint's weight that the second has too."""
    raw = base64.b64decode(one), base64.b64decode(other)
    a, b = ({r[i:i + _ENTRY] for i in range(0, len(r), _ENTRY)} for r in raw)
    top = sum(x[-1] for x in a)
    return sum(x[-1] for x in a & b) / top if top else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row. Equal texts have equal
    fingerprints; NULL and empty texts have an empty one; NULL ids, ties and
    repeated rows are rows like any other; other columns are ignored."""
    def run(batches):
        for batch in batches:
            texts = batch["text"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.compute.utf8_length(texts).cast(pa.int64()), pa.array(Prints(texts).strings(), pa.string())],
                                             names=["doc_id", "n_chars", "fingerprint"])
    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down, in code points) replaced by
    the first as many of ``following``, or by all of it."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _compare(key, table):
    from pyarrow.compute import sort_indices
    own = table.filter(pa.compute.invert(table["ghost"]))
    own = own.take(sort_indices(own, sort_keys=[("doc_id", "descending"), ("text", "ascending")], null_placement="at_end"))
    after = table.filter(table["ghost"])["text"].to_pylist()
    ids, texts = own["doc_id"].combine_chunks(), own["text"].to_pylist()
    follows = [*texts[1:], *after[:1]]
    changed = [edited(t, f) for t, f in zip(texts, follows, strict=True)]
    plain, new = Prints(pa.array([*texts, *after[:1]], pa.string())), Prints(pa.array(changed, pa.string()))
    n = len(texts)
    front = Prints.__new__(Prints)
    front.keys, front.text, front.at, front.weight = plain.keys[:plain.at[n]], plain.text[:plain.at[n]], plain.at[:n + 1], plain.weight[:n]
    here = np.arange(n)
    return pa.table([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                     pa.array(plain.strings()[:n], pa.string()), pa.array(new.strings(), pa.string()),
                     pa.array(_likeness(front, new, here)), pa.array(_likeness(front, plain, here + 1))],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edit_trial(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is
    that of the next document, in descending order of ids (after the last the
    first); and the likeness of the first to both the edited and the next text's.

    Returns per input row ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. Rows with the same id follow
    each other by text; NULL ids come last; NULL texts are empty; a single row
    follows itself; an empty table gives an empty result; other columns are
    ignored. Chunks of consecutive ids are compared apart; each also gets the
    row that follows its last.
    """
    rows, n = id_chunks(doc_rows(docs, id_col, text_col), chunk_bytes)
    firsts = _first_rows(rows)
    return rows.withColumn("ghost", F.lit(False)).unionByName(firsts).repartition(n, "chunk").groupBy("chunk").applyInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _first_rows(rows: DataFrame) -> DataFrame:
    """The first row of every chunk, as the ghost that follows the next chunk's
    last: chunks are ascending ranges of ids that are gone through in descending
    order, and the first of all follows the last. Holds one id a chunk here, as
    the chunks' bounds are."""
    tops = {r["chunk"]: r["top"] for r in rows.groupBy("chunk").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    follows = dict(zip(order, order[1:] + order[:1], strict=True))
    known = [t for t in tops.values() if t is not None]
    first = F.col("doc_id").isin(known)
    if len(known) < len(tops):  # chunk 0 has NULL ids only
        first = first | F.col("doc_id").isNull()
    if not order:
        return rows.withColumn("ghost", F.lit(True)).limit(0)
    target = F.element_at(F.create_map(*[F.lit(x) for pair in follows.items() for x in pair]), F.col("chunk"))
    return (rows.filter(first).groupBy("chunk", "doc_id").agg(F.min("text").alias("text"))
            .select("doc_id", "text", target.alias("chunk"), F.lit(True).alias("ghost")))
