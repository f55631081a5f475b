"""Removal of repeated byte strings by sorting suffixes.

Only suffixes at anchors are sorted. The anchor of a string of ``length`` bytes
is its leftmost smallest gram hash, so equal strings have equal anchors at equal
places, and about one position in 85 is one. Consecutive strings with the same
anchor make a run, which is kept whole.

Each chunk of texts ships a hash of every run and of its anchor's gram. Runs
that stand twice are repeated throughout; runs whose gram stands nowhere else
are not. The rest share an anchor's gram with some other run and differ
somewhere near: one copy of each different run goes, as bytes, to the bucket of
its anchor's suffix. Buckets are ranges of suffixes between sampled splitters on
their leading bytes. A bucket sorts its suffixes, and the reversed strings
before the anchors, by multikey quicksort with eight-byte keys; common prefixes
of neighbours then tell which strings are equal. Splitters are no longer than a
gram, so equal strings never lie on both sides of one.

No border can part the runs around one gram. Where a gram has more than ``HOT_RUNS``
different ones, as a phrase of 32 to 199 bytes that many documents share has, the
hashes of their strings are counted by Spark instead, row by row over all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import doc_rows, materialize, text_bytes

CHUNK_BYTES = 12 << 20
GRAM = 32
#: Bytes of text that the kernels take at a time; longer texts are cut into
#: overlapping segments.
SEGMENT_BYTES = 1 << 20
#: Leading bytes compared with a splitter, and sampled suffixes a bucket.
LEADING = 16
SAMPLES_A_BUCKET = 64
#: Different runs around one gram that a bucket sorts (about 1 KB of memory each); of
#: grams with more, the strings are counted.
HOT_RUNS = 100_000
_PLACE = np.uint64(28)
_PLACES = np.uint64((1 << 28) - 1)


def _joined(low: np.ndarray, width: int, base: np.uint64) -> tuple[np.ndarray, np.uint64]:
    """Hashes of strings twice as long, from those of ``width`` bytes."""
    return low[:-width] * base + low[width:], base * base


def segment_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of the ``len(data) - length + 1`` strings of one segment: first and
    last start, anchor, gram hash and hash of the run's bytes."""
    count = len(data) - length + 1
    if count <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    with np.errstate(over="ignore"):
        level, base, width = tk.byte_keys(data), tk.BASE, 1
        while width < GRAM:
            level, base = _joined(level, width, base)
            width *= 2
        grams = tk.mix(level)
        while width < 128:
            level, base = _joined(level, width, base)
            width *= 2
    span = length - GRAM + 1
    ranked = ((grams >> _PLACE) << _PLACE) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(ranked) // span) * span, np.uint64(2**64 - 1))
    padded[:len(ranked)] = ranked
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    anchors = (np.minimum(ahead[:count], behind[span - 1:span - 1 + count]) & _PLACES).astype(np.int64)
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    last = np.append(first[1:], count) - 1
    end = last + length
    size = (end - first).astype(np.uint64)
    # three strings of 128 bytes cover any run (of 200 to 368 bytes)
    tail = end - 128
    whole = tk.mix(level[first] + tk.mix(level[tail] + tk.mix(level[np.minimum(first + 128, tail)] + size)))
    return first, last, anchors[first], grams[anchors[first]], whole


class ChunkRuns:
    """The runs of a chunk's texts and the chunk's entries: its different (gram,
    run) pairs, ascending."""

    def __init__(self, texts, length: int):
        self.data, self.offsets = tk.column_bytes(texts)
        sizes = np.diff(self.offsets)
        # longer texts first overlap by a string less one byte
        per = []
        for t in np.flatnonzero(sizes >= length):
            for s in range(0, int(sizes[t]) - length + 1, SEGMENT_BYTES):
                lo = int(self.offsets[t]) + s
                hi = min(lo + SEGMENT_BYTES + length - 1, int(self.offsets[t + 1]))
                per.append((lo, *segment_runs(self.data[lo:hi], length)))
        def stack(k, kind):
            return np.concatenate([p[k] + (p[0] if k < 4 else 0) for p in per]).astype(kind) if per else np.empty(0, kind)
        self.first, self.last, self.anchor = (stack(k, np.int64) for k in (1, 2, 3))
        self.gram, self.whole = (stack(k, np.uint64) for k in (4, 5))
        order = np.lexsort((self.whole, self.gram))
        g, w = self.gram[order], self.whole[order]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        self.entry = np.empty(len(g), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        self.head = order[fresh]  # a run of every entry
        self.grams, self.wholes = g[fresh], w[fresh]
        self.twice = np.bincount(self.entry, minlength=len(self.grams)) > 1

    def cuts(self, buckets: int) -> np.ndarray:
        edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
        return np.concatenate(([0], np.searchsorted(self.grams, edges), [len(self.grams)]))


def _ordered(table: pa.Table) -> pa.Table:
    from pyarrow.compute import sort_indices
    return table.take(sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def _ship(length: int, buckets: int):
    def run(key, table):
        runs = ChunkRuns(_ordered(table)["text"], length)
        cuts = runs.cuts(buckets)
        rows = [(b, runs.grams[s:e].tobytes(), runs.wholes[s:e].tobytes(), np.packbits(runs.twice[s:e]).tobytes())
                for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()),
                         *[pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2, 3)]], names=["bucket", "chunk", "grams", "wholes", "twice"])
    return run


#: What becomes of an entry.
_ALONE, _REPEATED, _UNSURE, _MODEL = range(4)
#: Added to the codes of runs around a hot gram.
_HOT = 4


def _judge(hot_runs: int):
    return lambda key, table: _judged(key, table, hot_runs)


def _judged(key, table, hot_runs: int):
    """Per chunk, the codes of its entries: repeated runs, runs to be compared,
    and repeated runs that others are to be compared with."""
    chunks = table["chunk"].to_pylist()
    grams, wholes = ([np.frombuffer(x, np.uint64) for x in table[c].to_pylist()] for c in ("grams", "wholes"))
    sizes = [len(g) for g in grams]
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["twice"].to_pylist(), sizes, strict=True)]).astype(bool)
    g, w = np.concatenate(grams), np.concatenate(wholes)
    order = np.lexsort((w, g))
    gs, ws = g[order], w[order]
    new_gram = np.concatenate(([True], gs[1:] != gs[:-1]))
    new_run = new_gram | np.concatenate(([True], ws[1:] != ws[:-1]))
    run_at, gram_at = np.cumsum(new_run) - 1, np.cumsum(new_gram) - 1
    copies = np.bincount(run_at, weights=1 + twice[order])[run_at]
    kinds = np.bincount(gram_at, weights=new_run)[gram_at]
    lone = np.bincount(gram_at, weights=copies == 1)[gram_at]
    codes = np.where(copies > 1, np.where((kinds > 1) & (lone > 0) & new_run, _MODEL, _REPEATED), np.where(kinds > 1, _UNSURE, _ALONE)).astype(np.uint8)
    codes[(codes >= _UNSURE) & (kinds > hot_runs)] += _HOT
    back = np.empty(len(g), np.uint8)
    back[order] = codes
    parts = [(c, p.tobytes(), bool((p >= _HOT).any())) for c, p in zip(chunks, np.split(back, np.cumsum(sizes)[:-1]), strict=True) if p.any()]
    return pa.table([pa.array([c for c, *_ in parts], pa.int32()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array([p for _, p, _ in parts], pa.binary()),
                     pa.array([h for *_, h in parts], pa.bool_())], names=["chunk", "part", "codes", "hot"])


def _codes(runs: ChunkRuns, buckets: int, replies: pa.Table) -> np.ndarray:
    codes, cuts = np.zeros(len(runs.grams), np.uint8), runs.cuts(buckets)
    for b, c in zip(replies["part"].to_pylist(), replies["codes"].to_pylist(), strict=True):
        if b >= 0:
            codes[cuts[b]:cuts[b + 1]] = np.frombuffer(c, np.uint8)
    return codes


def _send(length: int, buckets: int, splitters: list[bytes]):
    borders = np.array(splitters, f"S{LEADING}")

    def run(key, table, replies):
        out = [[], [], [], [], []]
        if replies.num_rows:
            runs = ChunkRuns(_ordered(table)["text"], length)
            codes = _codes(runs, buckets, replies)
            wanted = np.flatnonzero((codes >= _UNSURE) & (codes < _HOT))
            head = runs.head[wanted]
            raw = runs.data.tobytes()
            first, last, anchor = runs.first[head], runs.last[head], runs.anchor[head]
            leads = np.array([raw[p:p + LEADING] for p in anchor.tolist()], f"S{LEADING}")
            out = [np.searchsorted(borders, leads, "right"), wanted, anchor - first, last - first + 1,
                   [raw[s:e + length] for s, e in zip(first.tolist(), last.tolist(), strict=True)]]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        chunk = pa.array([key[0].as_py()] * len(out[0]), pa.int32())
        return pa.table([*[pa.array(x, k) for x, k in zip(out, kinds, strict=True)], chunk], names=["bucket", "entry", "lead", "starts", "bytes", "chunk"])
    return run


def _send_hot(length: int, buckets: int):
    """The strings of the runs around hot grams, as one row of hashes a run."""
    def run(key, table, replies):
        entries, starts, packed = np.empty(0, np.int64), [], []
        if table.num_rows and replies.num_rows:
            runs = ChunkRuns(_ordered(table)["text"], length)
            entries = np.flatnonzero(_codes(runs, buckets, replies) >= _HOT)
            for head in runs.head[entries].tolist():
                first, last = int(runs.first[head]), int(runs.last[head])
                starts.append(last - first + 1)
                packed.append(string_hashes(runs.data[first:last + length], length).view(np.int64).tolist())
        return pa.table([pa.array([key[0].as_py()] * len(starts), pa.int32()), pa.array(entries, pa.int32()), pa.array(starts, pa.int32()), pa.array(packed, pa.list_(pa.int64()))],
                        names=["chunk", "entry", "starts", "hashes"])
    return run


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of each of the ``len(data) - length + 1`` strings, which does not
    depend on where the string stands."""
    keys = tk.byte_keys(data) * tk.powers(len(data))[::-1]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(keys, dtype=np.uint64)))
        rolled = sums[length:] - sums[:-length]
        return tk.mix(rolled * _inverse_powers(len(data), length))


def _inverse_powers(n: int, length: int) -> np.ndarray:
    """What brings the hash of the string at each start to the same power."""
    inverse = pow(int(tk.BASE), -1, 1 << 64)
    steps = np.full(n - length + 1, np.uint64(int(tk.BASE)), np.uint64)
    steps[0] = pow(inverse, n - length, 1 << 64)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(steps)


def _pack_hot(key, rows):
    """The counted strings that stand twice, as codes of their chunk."""
    rows = rows.sort_by([("entry", "ascending"), ("at", "ascending")])
    entry, starts, at = (rows[c].to_numpy().astype(np.int64) for c in ("entry", "starts", "at"))
    heads = np.flatnonzero(np.diff(entry, prepend=-1))
    begin = np.cumsum(starts[heads]) - starts[heads]
    bits = np.zeros(int(starts[heads].sum()), bool)
    bits[np.repeat(begin, np.diff(np.append(heads, len(entry)))) + at] = True
    packed = entry[heads].astype(np.int32).tobytes() + np.packbits(bits).tobytes()
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([-len(heads)], pa.int32()), pa.array([packed], pa.binary())], names=["chunk", "part", "codes"])


def _hot_flags(sent: DataFrame) -> DataFrame:
    """Count the strings around hot grams over all tasks, and tell each chunk
    which of its own stand in another run too."""
    strings = materialize(sent.select("chunk", "entry", "starts", F.posexplode("hashes").alias("at", "h")), "hot-strings")
    twice = strings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")  # partial sums before the shuffle
    return strings.join(twice, "h", "left_semi").select("chunk", "entry", "starts", "at").groupBy("chunk").applyInArrow(_pack_hot, "chunk int, part int, codes binary")


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long strings given as rows of big-endian eight-byte keys,
    and the bytes each shares with the one before. Key by key, only strings that
    are still equal to a neighbour are sorted again, among themselves."""
    count, width = words.shape
    order, group = np.arange(count), np.zeros(count, np.int64)
    shared = np.full(count, 8 * width)
    shared[:1] = 0
    active = np.arange(count)
    for k in range(width):
        if len(active) < 2:
            break
        keys, group_of = words[order[active], k], group[active]
        turn = np.lexsort((keys, group_of))
        order[active], keys = order[active][turn], keys[turn]
        split = np.concatenate(([False], (group_of[1:] == group_of[:-1]) & (keys[1:] != keys[:-1])))
        differ = keys[split] ^ keys[np.flatnonzero(split) - 1]
        shared[active[split]] = 8 * k + sum((differ < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(1, 8))
        fresh = split | np.concatenate(([True], group_of[1:] != group_of[:-1]))
        number = np.cumsum(fresh) - 1
        group[active] = number
        active = active[np.bincount(number)[number] > 1]
    return order, shared


def _keys(strings: list[bytes], size: int) -> np.ndarray:
    size = -(-size // 8) * 8
    return np.frombuffer(b"".join(s.ljust(size, b"\0") for s in strings), ">u8").astype(np.uint64).reshape(-1, size // 8)


def equal_strings(texts: list[bytes], lead: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For every run (its bytes, its anchor's place and its number of strings):
    which of its strings also stands in another run, at the same place from the
    anchor. Returns the flags run after run."""
    begin = np.concatenate(([0], np.cumsum(starts)))
    flags = np.zeros(begin[-1], bool)
    right_order, right = multikey_sort(_keys([t[p:p + length] for t, p in zip(texts, lead.tolist(), strict=True)], length))
    left_order, left = multikey_sort(_keys([t[:p][::-1] for t, p in zip(texts, lead.tolist(), strict=True)], length))
    least = lead - starts + 1  # the last string's distance to the anchor
    a, b = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    for d in range(int(least.min()), int(lead.max()) + 1):
        here = np.flatnonzero((least <= d) & (d <= lead))
        if len(here) < 2:
            continue
        a[right_order] = np.cumsum(right < length - d)
        b[left_order] = np.cumsum(left < d)
        pair = a[here] * (len(texts) + 1) + b[here]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        hit = np.zeros(len(here), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        found = here[hit]
        flags[begin[found] + lead[found] - d] = True
    return flags


def _compare(length: int):
    def run(key, table):
        starts, lead = (table[c].to_numpy().astype(np.int64) for c in ("starts", "lead"))
        flags = equal_strings(table["bytes"].to_pylist(), lead, starts, length)
        chunks, entries = table["chunk"].to_numpy(), table["entry"].to_numpy().astype(np.int32)
        begin = np.concatenate(([0], np.cumsum(starts)))
        rows = []
        for c in np.unique(chunks):
            own = [i for i in np.flatnonzero(chunks == c).tolist() if flags[begin[i]:begin[i + 1]].any()]
            if own:
                bits = np.concatenate([flags[begin[i]:begin[i + 1]] for i in own])
                rows.append((int(c), entries[own].tobytes() + np.packbits(bits).tobytes(), len(own)))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([-r[2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                        names=["chunk", "part", "codes"])
    return run


def _cut(length: int, buckets: int):
    def run(key, table, replies):
        table = _ordered(table)
        runs = ChunkRuns(table["text"], length)
        codes = _codes(runs, buckets, replies)
        change = np.zeros(len(runs.data) + 1, np.int32)
        sure = np.flatnonzero(np.isin(codes, (_REPEATED, _MODEL, _MODEL + _HOT))[runs.entry])
        np.add.at(change, runs.first[sure], 1)
        np.add.at(change, runs.last[sure] + length, -1)
        for part, packed in zip(replies["part"].to_pylist(), replies["codes"].to_pylist(), strict=True):
            if part < 0:
                entries = np.frombuffer(packed, np.int32, -part)
                head = runs.head[entries]  # such an entry has one run
                counts = runs.last[head] - runs.first[head] + 1
                bits = np.unpackbits(np.frombuffer(packed, np.uint8, offset=4 * -part), count=int(counts.sum())).astype(bool)
                at = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(runs.first[head], counts))[bits]
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
        gone = np.cumsum(change)[:-1] > 0
        sizes, spans, kept = np.diff(runs.offsets), [], []
        for t in range(len(sizes)):
            lo, hi = runs.offsets[t], runs.offsets[t + 1]
            mask, raw = gone[lo:hi], runs.data[lo:hi]
            if mask.any():
                edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                raw = raw[~mask]
            else:
                spans.append([])
            kept.append(raw.tobytes())
        return pa.table([table["doc_id"].combine_chunks(), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
    return run


def _splitters(rows: DataFrame, length: int, buckets: int, n_texts: int) -> list[bytes]:
    """Borders of ``buckets`` suffix ranges, from a sample of anchors' leading
    bytes. They only balance the buckets; no result depends on them."""
    if buckets < 2 or not n_texts:
        return []
    texts = SAMPLES_A_BUCKET * buckets
    sampled = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(max(1, n_texts // texts))) == 0)

    def run(batches):
        for batch in batches:
            leads = []
            for t in batch["text"]:
                runs = ChunkRuns(pa.array([t.as_py()], pa.string()), length)
                anchors = runs.anchor[len(runs.anchor) // 2:][:1].tolist()
                leads += [runs.data[p:p + LEADING].tobytes() for p in anchors]
            yield pa.RecordBatch.from_arrays([pa.array(leads, pa.binary())], names=["lead"])
    got = sorted(bytes(r["lead"]) for r in sampled.mapInArrow(run, "lead binary").collect())
    return sorted({got[len(got) * b // buckets] for b in range(1, buckets)}) if got else []


def cut_repeated_bytes(docs: DataFrame, length: int = 200, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text",
                       hot_runs: int = HOT_RUNS) -> DataFrame:
    """Remove every byte covered by a string of ``length`` UTF-8 bytes that also
    starts anywhere else, in the same or another document.

    Returns one row per input row: ``doc_id, n_bytes, spans`` (maximal removed
    runs of bytes, end exclusive) and ``kept`` (the other bytes, joined). Strings
    are judged on the input and never cross documents; every copy is removed, the
    first too. NULL texts are empty; texts shorter than ``length`` lose nothing;
    NULL and repeated ids are rows like any other; an empty table gives an empty
    result; other columns are ignored. ``length`` must lie between 160 and 240.
    Whole runs are compared by 64-bit hashes of grams and of runs together, and
    strings around a gram with more than ``hot_runs`` different runs by a 64-bit
    hash each.
    """
    if not 160 <= length <= 240:
        raise ValueError("length must lie between 160 and 240")
    rows = doc_rows(docs, id_col, text_col)
    n = max(1, math.ceil(text_bytes(rows) / chunk_bytes))
    splitters = _splitters(rows, length, n, rows.count())
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "chunk")
    shipped = dealt.groupBy("chunk").applyInArrow(_ship(length, n), "bucket int, chunk int, grams binary, wholes binary, twice binary")
    judged = materialize(shipped.repartition(n, "bucket").groupBy("bucket").applyInArrow(_judge(hot_runs), "chunk int, part int, codes binary, hot boolean"), "run-codes")
    codes = judged.drop("hot")
    sent = dealt.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(
        _send(length, n, splitters), "bucket int, entry int, lead int, starts int, bytes binary, chunk int")
    flags = sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(_compare(length), "chunk int, part int, codes binary")
    hot = judged.filter("hot").select("chunk").distinct()
    if hot.limit(1).count():  # only the chunks with such a run are read again
        some = dealt.join(F.broadcast(hot), "chunk", "left_semi").repartition(n, "chunk")  # numbers of chunks
        strings = some.groupBy("chunk").cogroup(codes.join(F.broadcast(hot), "chunk", "left_semi").groupBy("chunk")).applyInArrow(_send_hot(length, n), "chunk int, entry int, starts int, hashes array<bigint>")
        flags = flags.unionByName(_hot_flags(strings))
    return dealt.groupBy("chunk").cogroup(codes.unionByName(flags).groupBy("chunk")).applyInArrow(
        _cut(length, n), "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    """The contract columns of the registered query."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
