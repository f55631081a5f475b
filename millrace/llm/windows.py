"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows.

Documents are dealt into chunks of consecutive ids. A chunk hashes every window
of its texts and ships each different hash once, so a line that a third of all
documents share costs one entry a chunk. Hash ranges gather the chunks' sorted
hashes and tell each chunk which of its hashes also occur in an earlier chunk,
that is in a smaller id; repeats inside a chunk it sees itself. Repeated windows
merge into maximal intervals of removed words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import doc_rows, id_chunks

#: Bytes of text that one task holds at a time, and so also the share of the
#: window hashes that one counting task gets.
CHUNK_BYTES = 12 << 20


def _chunk_windows(texts, size: int):
    """Hash, first word (counted over the chunk) of all windows; words per text."""
    data, offsets = tk.column_bytes(texts)
    hashes, begins, counts, seen = [], [], [np.zeros(1, np.int64)], 0
    for i, j in tk.slices(offsets):
        part = data[offsets[i]:offsets[j]]
        starts, ends, first = tk.words(part, offsets[i:j + 1] - offsets[i])
        h, at = tk.window_hashes(tk.word_hashes(part, starts, ends), first, size)
        hashes.append(h)
        begins.append(at + seen)
        counts.append(first[1:] + seen)
        seen += len(starts)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), counts[0]
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(counts)


def _edges(buckets: int) -> np.ndarray:
    """First hash of every bucket but the first."""
    return np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Differences of ascending hashes, byte plane by byte plane (the upper
    planes are zeros, which the shuffle's compression drops)."""
    return np.diff(sorted_hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _ship(size: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary())])

    def run(key, table):
        hashes = np.unique(_chunk_windows(table["text"], size)[0])
        parts = np.split(hashes, np.searchsorted(hashes, _edges(buckets)))
        rows = [(b, _pack(p)) for b, p in enumerate(parts) if len(p)]
        return pa.table([pa.array([b for b, _ in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()),
                         pa.array([p for _, p in rows], pa.binary())], schema=schema)
    return run


def _count(key, table):
    """Of every chunk's hashes, those that an earlier chunk has too, as bits."""
    rows = sorted(zip(table["chunk"].to_pylist(), (x.as_buffer() for x in table["hashes"].combine_chunks()) if table.num_rows else (), strict=True), key=lambda r: r[0])
    each = [_unpack(x) for _, x in rows]
    every = np.concatenate(each) if each else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    earlier = np.zeros(len(every), bool)
    earlier[order[1:][ranked[1:] == ranked[:-1]]] = True
    bits = np.split(earlier, np.cumsum([len(e) for e in each])[:-1]) if each else []
    out = [(c, np.packbits(b).tobytes()) for (c, _), b in zip(rows, bits, strict=True) if b.any()]
    return pa.table([pa.array([c for c, _ in out], pa.int32()), pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([b for _, b in out], pa.binary())],
                    names=["chunk", "bucket", "seen"])


def _cut(size: int, buckets: int):
    def run(key, table, replies):
        ids = table["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        table, ids = table.take(pa.array(order)), ids[order]
        hashes, begins, first = _chunk_windows(table["text"], size)
        kinds, head, which = np.unique(hashes, return_index=True, return_inverse=True)
        earlier = np.zeros(len(kinds), bool)
        borders = np.concatenate(([0], np.searchsorted(kinds, _edges(buckets)), [len(kinds)]))
        for b, seen in zip(replies["bucket"].to_pylist(), replies["seen"].to_pylist(), strict=True):
            lo, hi = borders[b], borders[b + 1]
            earlier[lo:hi] = np.unpackbits(np.frombuffer(seen, np.uint8), count=hi - lo).astype(bool)
        text = np.repeat(np.arange(len(ids)), np.diff(first))
        gone = earlier[which]
        if len(begins):
            gone |= ids[text[begins]] > ids[text[begins[head]]][which]
        change = np.zeros(int(first[-1]) + size + 1, np.int32)
        np.add.at(change, begins[gone], 1)
        np.add.at(change, begins[gone] + size, -1)
        covered = np.cumsum(change)[:first[-1]] > 0
        kept, spans = [], []
        for k, t in enumerate(table["text"]):
            w = (t.as_py() or "").encode().split()
            c = covered[first[k]:first[k + 1]]
            if c.any():
                edge = np.flatnonzero(np.diff(c.astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                left = []
                for s, e in zip([0, *edge[1::2]], [*edge[::2], len(w)], strict=True):
                    left += w[s:e]
                w = left
            else:
                spans.append([])
            kept.append(b" ".join(w).decode())
        return pa.table([table["doc_id"].combine_chunks(), pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
                        names=["doc_id", "n_words", "spans", "kept_text"])
    return run


def cut_repeated_windows(docs: DataFrame, size: int = 13, chunk_bytes: int = CHUNK_BYTES,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``size`` words whose words also
    stand, as a window, in a document with a smaller id.

    Returns one row per input row: ``doc_id``, ``n_words``, ``spans`` (maximal
    intervals of removed words, end exclusive) and ``kept_text`` (the words that
    stay, joined by one space). Windows are judged on the input. A NULL text is
    empty; a text of fewer than ``size`` words loses nothing; a NULL id counts
    as smaller than any other; rows with the same id never cut each other, so
    repeated rows are all kept; an empty table gives an empty result; other
    columns are ignored. Words are compared by 64-bit hashes: a window is cut
    wrongly with a chance of about (number of windows) / 2**64.
    """
    rows, n = id_chunks(doc_rows(docs, id_col, text_col), chunk_bytes)
    dealt = rows.repartition(max(n, 1), "chunk")
    shipped = dealt.groupBy("chunk").applyInArrow(_ship(size, n), "bucket int, chunk int, hashes binary")
    replies = shipped.repartition(max(n, 1), "bucket").groupBy("bucket").applyInArrow(_count, "chunk int, bucket int, seen binary")
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        _cut(size, n), "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept_text string")


def digests(cut: DataFrame) -> DataFrame:
    """The contract columns of the registered query."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))
