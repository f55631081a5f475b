"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures.

Sets are dealt into bands of similar size. In a band whose largest set has
``hi`` shingles, a similarity of at least ``s`` allows at most
``k = 2 * hi * (1 - s) / (1 + s)`` shingles that only one of two sets has. The
shingle domain is cut into (k + 1) / 2 partitions of three parts each; in some
partition two such sets differ in one shingle at most, so they share the
signature of the two parts that it isn't in. Signatures are the enumerated pairs
of parts of every partition. Where a pair of parts is empty its signature would
bring together all such sets: there the third part holds the whole partition,
and its signatures with and without each one of its shingles stand in.

Sets that share a signature are compared by sketches whose difference never
exceeds the sets' own, and what passes is checked exactly.

In a group of sets with the same signature each is checked against the smallest
one. Where that leaves a group of several blocks in several components, the
smallest set outside the largest one is the next centre, as long as that saves a
quarter of the comparisons left. Then sets of different components are compared with one another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import doc_rows, materialize, text_bytes
from millrace.llm.graph import components

CHUNK_BYTES = 12 << 20
#: Sets with one signature that one task compares at a time.
BLOCK_SETS = 4096
#: The same in bytes of sketches.
BLOCK_BYTES = 16 << 20
#: Blocks of probes that meet a block at a time.
PROBE_BLOCKS = 4
#: Blocks' worth of dealt rows, and their bytes of sketches, that one task goes
#: through where signatures of one block lie together.
BLOCKS_A_TASK = 32
TASK_BYTES = 64 << 20
#: A band's largest size by its smallest, at most.
_BAND_RATIO = 1.4
_SALT = np.uint64(0x632BE59BD9B4E019)


class Bands:
    """Size bands and the signature parameters of each."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.lo: list[int] = [1]
        self._grow(1)

    def _grow(self, size: int) -> None:
        steps = max(1, int(math.log(_BAND_RATIO) / math.log(1 / self.similarity)))
        ratio = (1 / self.similarity) ** steps
        while self.lo[-1] <= size:
            self.lo.append(max(int(self.lo[-1] * ratio), self.lo[-1]) + 1)

    def allowed(self, total: np.ndarray) -> np.ndarray:
        """Shingles in which two sets of ``total`` shingles together may differ."""
        s = self.similarity
        return np.floor(total * ((1 - s) / (1 + s)) + 1e-9).astype(np.int64)

    def contexts(self, sizes: np.ndarray):
        """For every set its own band, then each further band with a size that
        is similar enough: (sets, band, k)."""
        if not len(sizes):
            return
        self._grow(int(sizes.max() / self.similarity) + 1)
        self._grow(self.lo[-1] + 1)
        lo = np.array(self.lo)
        own = np.searchsorted(lo, sizes, "right") - 1
        step = 0
        while True:
            band = own + step
            inside = band < len(lo) - 1
            which = np.flatnonzero(inside & (sizes + 1e-9 >= self.similarity * lo[np.minimum(band, len(lo) - 1)]) if step else inside)
            if not len(which):
                return
            yield which, band[which], self.allowed(2 * (lo[band[which] + 1] - 1))
            step += 1


def shingle_sets(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's different shingles (ascending, text by text) and
    the offsets of the texts. A-Z count as a-z; a text of fewer words than
    ``size`` has its whole sequence as one shingle, one without words none."""
    data, offsets = tk.column_bytes(texts)
    parts, counts = [], []
    for i, j in tk.slices(offsets):
        part = data[offsets[i]:offsets[j]]
        starts, ends, first = tk.words(part, offsets[i:j + 1] - offsets[i])
        hashes = tk.word_hashes(part, starts, ends, fold=True)
        rolled, at = tk.window_hashes(hashes, first, size)
        n_words = np.diff(first)
        text = np.repeat(np.arange(j - i), n_words)[at]
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        whole = np.array([tk.window_hashes(hashes[first[t]:first[t + 1]], np.array([0, n_words[t]]), int(n_words[t]))[0][0] for t in short], np.uint64)
        rolled, text = np.concatenate((rolled, tk.mix(whole + n_words[short].astype(np.uint64)))), np.concatenate((text, short))
        order = np.lexsort((rolled, text))
        rolled, text = rolled[order], text[order]
        fresh = np.ones(len(rolled), bool)
        fresh[1:] = (rolled[1:] != rolled[:-1]) | (text[1:] != text[:-1])
        parts.append(rolled[fresh])
        counts.append(np.bincount(text[fresh], minlength=j - i))
    if not parts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _cells(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cell of every hash; ascending hashes have ascending cells."""
    return (((hashes >> np.uint64(32)) * cells.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def signatures(hashes: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the set of each."""
    sizes = np.diff(at)
    filled = np.flatnonzero(sizes > 0)
    mixed = tk.mix(hashes ^ _SALT)
    out, of = [], []
    for which, band, k in Bands(similarity).contexts(sizes[filled]):
        sets = filled[which]
        rows = np.concatenate([np.arange(at[s], at[s + 1]) for s in sets])
        partitions = (k + 2) // 2
        begin = np.concatenate(([0], np.cumsum(3 * partitions)))
        cell = _cells(hashes[rows], np.repeat(3 * partitions, sizes[sets])) + np.repeat(begin[:-1], sizes[sets])
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        sums, held = np.zeros(begin[-1], np.uint64), np.bincount(cell, minlength=begin[-1]).reshape(-1, 3)
        sums[cell[starts]] = np.add.reduceat(mixed[rows], starts)
        sums = sums.reshape(-1, 3)
        whole, size = sums.sum(axis=1), held.sum(axis=1)
        owner = np.repeat(np.arange(len(sets)), partitions)
        place = (np.arange(len(owner)) - np.repeat(begin[:-1] // 3, partitions)).astype(np.uint64)
        key = tk.mix(place * np.uint64(8) + (band[owner].astype(np.uint64) << np.uint64(40)))
        one = k[owner] == 0  # no difference allowed: the whole set is the signature
        out.append(tk.mix(whole[one] + key[one]))
        of.append(sets[owner[one]])
        for j in range(3):
            some = ~one & (held[:, j] < size)
            out.append(tk.mix(whole[some] - sums[some, j] + key[some] + np.uint64(j + 1)))
            of.append(sets[owner[some]])
        # partitions held by one part, or empty: with and without each shingle
        narrow = ~one & (held.max(axis=1) == size)
        out.append(tk.mix(whole[narrow] + key[narrow] + np.uint64(4)))
        of.append(sets[owner[narrow]])
        partition = cell // 3
        less = narrow[partition]
        at_less = partition[less]
        out.append(tk.mix(whole[at_less] - mixed[rows][less] + key[at_less] + np.uint64(4)))
        of.append(sets[owner[at_less]])
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def _same_sets(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every text the first text of the chunk with the same set."""
    sizes = np.diff(at)
    sums = np.zeros((len(sizes), 2), np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        for c, salt in enumerate((np.uint64(1), np.uint64(2))):
            sums[filled, c] = np.add.reduceat(tk.mix(hashes + salt), at[filled])
    kinds = np.rec.fromarrays([sums[:, 0], sums[:, 1], sizes])
    _, head, which = np.unique(kinds, return_index=True, return_inverse=True)
    return head[which]


def _ordered(table: pa.Table) -> pa.Table:
    """Rows of a chunk in an order that depends on their values only."""
    keys = pa.table({"i": table["doc_id"], "t": table["text"]})
    return table.take(pa.compute.sort_indices(keys, sort_keys=[("i", "ascending"), ("t", "ascending")]))


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _values(planes: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _sign(size: int, similarity: float, buckets: int):
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("signatures", pa.binary()), ("sets", pa.binary())])

    def run(key, table):
        hashes, at = shingle_sets(_ordered(table)["text"], size)
        same = _same_sets(hashes, at)
        sigs, of = signatures(hashes, at, similarity)
        own = same[of] == of
        order = np.lexsort((of[own], sigs[own]))
        sigs, of = sigs[own][order], of[own][order].astype(np.uint32)
        cuts = np.concatenate(([0], np.searchsorted(sigs, edges), [len(sigs)]))
        rows = [(b, _planes(np.diff(sigs[s:e], prepend=np.uint64(0))), _planes(of[s:e])) for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()),
                         pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=schema)
    return run


def _group(key, table):
    """Pairs (smallest set, other set) of each signature's sets, each once; and
    the members of groups of three or more."""
    sigs, nodes = [], []
    for chunk, packed, sets in zip(table["chunk"].to_pylist(), table["signatures"].to_pylist(), table["sets"].to_pylist(), strict=True):
        sigs.append(np.cumsum(_values(packed, np.uint64), dtype=np.uint64))
        nodes.append((np.int64(chunk) << 32) + _values(sets, np.uint32).astype(np.int64))
    sigs, nodes = (np.concatenate(x) for x in (sigs, nodes))
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    starts = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
    counts = np.diff(np.append(starts, len(sigs)))
    centre, many = np.repeat(nodes[starts], counts), np.repeat(counts, counts)
    pairs = np.unique(np.stack((centre, nodes), 1)[centre != nodes], axis=0)
    large = many > 2
    none = np.zeros(len(pairs), np.int64)
    return pa.table({"signature": pa.array(np.concatenate((none, sigs[large].view(np.int64)))), "a": pa.array(np.concatenate((pairs[:, 0], nodes[large]))),
                     "b": pa.array(np.concatenate((pairs[:, 1], np.full(int(large.sum()), -1))))})


def _sketch(hashes: np.ndarray) -> bytes:
    """Whether each of a power of two of cells, three to six times as many as
    hashes, holds an odd number of them, as bits: sets that differ in d hashes
    differ in d bits at most, and in nearly as many unless d is large."""
    cells = 1 << max(6, (3 * len(hashes)).bit_length())
    return np.packbits(np.bincount(_cells(hashes, np.full(len(hashes), cells)), minlength=cells) & 1 == 1).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as if it had ``size`` bytes of cells, in words of 64 bits."""
    if len(sketch) > size:
        odd = np.unpackbits(np.frombuffer(sketch, np.uint8)).reshape(8 * size, -1).sum(axis=1) & 1
        sketch = np.packbits(odd == 1).tobytes()
    return np.frombuffer(sketch, np.uint64)


def _describe(size: int):
    """Every row's node and size; the sketch of every node asked for."""
    def run(key, table, wanted):
        table = _ordered(table)
        hashes, at = shingle_sets(table["text"], size)
        chunk = np.int64(key[0].as_py()) << 32
        same, sizes = _same_sets(hashes, at), np.diff(at)
        rows = (wanted["node"].to_numpy() - chunk).astype(np.int64)
        empty = len(rows) * [None]
        return pa.table([*[pa.concat_arrays([table[c].combine_chunks(), pa.array(empty, pa.int64())]) for c in ("doc_id", "text_key")],
                         pa.array(np.concatenate((chunk + same, chunk + rows)), pa.int64()), pa.array(np.concatenate((sizes, sizes[rows])), pa.int64()),
                         pa.array([None] * len(sizes) + [_sketch(hashes[at[i]:at[i + 1]]) for i in rows], pa.binary())],
                        names=["doc_id", "text_key", "node", "n", "sketch"])
    return run


def _sets(size: int):
    """The shingle hashes of every node asked for."""
    def run(key, table, wanted):
        if not wanted.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "hashes": pa.array([], pa.binary())})
        hashes, at = shingle_sets(_ordered(table)["text"], size)
        nodes = wanted["node"].to_numpy()
        rows = (nodes - (np.int64(key[0].as_py()) << 32)).astype(np.int64)
        return pa.table({"node": pa.array(nodes, pa.int64()), "hashes": pa.array([hashes[at[i]:at[i + 1]].tobytes() for i in rows], pa.binary())})
    return run


def _asked(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("chunk", F.shiftright("node", 32).cast("int"))


def _joined(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with ``columns`` of both nodes, as ``a_...`` and ``b_...``."""
    side = lambda s: sets.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return pairs.join(side("b"), "b").join(side("a"), "a")


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches don't rule out that the sets are similar."""
    bands = Bands(similarity)

    def run(batches):
        for batch in batches:
            total = batch["a_n"].to_numpy() + batch["b_n"].to_numpy()
            allowed, keep = bands.allowed(total), []
            for x, y, k in zip(batch["a_sketch"].to_pylist(), batch["b_sketch"].to_pylist(), allowed.tolist(), strict=True):
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= k)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return _joined(pairs, sketches, ["n", "sketch"]).mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, dealt: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose sets are similar enough, by exact intersection."""
    sets = materialize(dealt.groupBy("chunk").cogroup(_asked(pairs).groupBy("chunk")).applyInArrow(_sets(shingle), "node long, hashes binary"), "sets")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["a_hashes"].to_pylist(), batch["b_hashes"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both + 1e-9 >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return _joined(pairs, sets, ["hashes"]).mapInArrow(run, "a long, b long")


def _across(similarity: float):
    bands = Bands(similarity)

    def run(key, table):
        """Pairs of a probe and a resident of another component, in one block of
        a signature's sets, whose sketches don't rule out that they are similar."""
        nodes, comps, sizes, probe = (table[c].to_numpy(zero_copy_only=False) for c in ("node", "component", "n", "probe"))
        sketches = table["sketch"].to_pylist()
        signature, block = table["signature"].to_numpy(), table["block"].to_numpy()
        order = np.lexsort((block, signature))
        cuts = np.flatnonzero((np.diff(signature[order]) != 0) | (np.diff(block[order]) != 0)) + 1
        found = []
        for rows in np.split(order, cuts):
            size = min(len(sketches[r]) for r in rows)
            home = rows[~probe[rows]]
            if not len(home):
                continue
            level = np.stack([_folded(sketches[r], size) for r in home])
            for i in rows[probe[rows]]:
                other = comps[home] != comps[i]
                near = np.bitwise_count(level[other] ^ _folded(sketches[i], size)).sum(axis=1) <= bands.allowed(sizes[home[other]] + sizes[i])
                hits = nodes[home[other][near]]
                found.append(np.stack((np.minimum(hits, nodes[i]), np.maximum(hits, nodes[i])), 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})
    return run


def _mixed(members: DataFrame, sketches: DataFrame, labels: DataFrame) -> DataFrame:
    """``signature, node, component, n`` of signatures whose sets lie in several
    components. Of signatures with the same sets one is taken."""
    named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = (named.groupBy("signature").agg(F.count(F.lit(1)).alias("total"), F.bit_xor(F.xxhash64("node")).alias("sets"), F.min("component").alias("lo"), F.max("component").alias("hi"))
              .filter("lo != hi").groupBy("total", "sets").agg(F.min("signature").alias("signature")))
    return materialize(named.join(groups.select("signature"), "signature").join(sketches.select("node", "n"), "node"), "mixed")


def _sized(rows: DataFrame, block_sets: int) -> DataFrame:
    """Of every signature the largest component, the sets in all (``total``) and
    outside it (``out``), an upper bound of a set's mean bytes of sketch, the
    ``blocks`` of sets and the ``turns`` in which probes meet each."""
    per = (rows.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") + 8).alias("w")).groupBy("signature")
           .agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("total"), (F.sum("c") - F.max("c")).alias("out"), (F.sum("w") / F.sum("c")).alias("bytes")))
    places = F.greatest(F.lit(1 / block_sets), F.col("bytes") / BLOCK_BYTES)  # blocks a set fills
    return materialize(per.withColumn("blocks", F.ceil(F.col("total") * places).cast("int")).withColumn("turns", F.ceil(F.col("out") * places / PROBE_BLOCKS).cast("int")), "sized")


def _work(sized: DataFrame) -> int:
    """Comparisons that signatures of several blocks ask for."""
    return int(sized.filter("blocks > 1").agg(F.sum(F.col("out").cast("double") * F.col("total"))).first()[0] or 0)


def _recentred(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """Pairs of every set of a signature of several blocks and a new centre, the
    smallest set outside the signature's largest component."""
    large = rows.join(sized.filter("blocks > 1").select("signature", "main"), "signature")
    centres = large.filter("component != main").groupBy("signature").agg(F.min(F.struct("node", "component")).alias("centre"))
    return (large.join(centres, "signature").filter("component != centre.component")
            .select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct())


def _missed(rows: DataFrame, sized: DataFrame, sketches: DataFrame, similarity: float, block_sets: int) -> DataFrame:
    """Candidate pairs between components inside signature groups: all but the
    largest component's sets are compared with the whole group, a block of it
    with a few blocks of probes at a time. What is dealt for one signature of
    several blocks is a group for each such meeting; the other signatures are
    put together by the rows and bytes dealt."""
    dealt_rows = F.col("total") + F.col("out")
    load = sized.filter("blocks = 1").agg(F.sum(dealt_rows).alias("r"), F.sum(dealt_rows * F.col("bytes")).alias("b")).first()
    n = max(1, math.ceil(max((load["r"] or 0) / (BLOCKS_A_TASK * block_sets), (load["b"] or 0) / TASK_BYTES)))
    placed = rows.join(sized, "signature").join(sketches.select("node", "sketch"), "node")
    homes = (placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("probe", F.lit(False)))
    probes = (placed.filter("component != main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int")).withColumn("probe", F.lit(True)))
    large = F.col("blocks") > 1
    dealt = homes.unionByName(probes).select(
        "signature", "block", "node", "component", "n", "sketch", "probe", F.when(large, F.col("signature")).otherwise(F.pmod(F.xxhash64("signature"), F.lit(n))).alias("part"),
        F.when(large, F.col("block")).otherwise(-1).alias("part_block"), F.when(large, F.col("turn")).otherwise(-1).alias("part_turn"))
    return dealt.groupBy("part", "part_block", "part_turn").applyInArrow(_across(similarity), "a long, b long").distinct()


def _classes(docs: DataFrame, shingle: int, similarity: float, chunk_bytes: int, block_sets: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id`` of every row."""
    rows = doc_rows(docs, id_col, text_col)
    n = max(1, math.ceil(text_bytes(rows) / chunk_bytes))
    dealt = (rows.withColumn("text_key", F.xxhash64("text")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(n)).cast("int"))
             .repartition(n, "chunk"))
    signed = dealt.groupBy("chunk").applyInArrow(_sign(shingle, similarity, n), "bucket int, chunk int, signatures binary, sets binary")
    grouped = materialize(signed.repartition(n, "bucket").groupBy("bucket").applyInArrow(_group, "signature long, a long, b long"), "groups")
    pairs = grouped.filter("b >= 0").select("a", "b").distinct()
    members = grouped.filter("b < 0").select("signature", F.col("a").alias("node"))
    described = materialize(dealt.groupBy("chunk").cogroup(_asked(pairs).groupBy("chunk")).applyInArrow(
        _describe(shingle), "doc_id long, text_key long, node long, n long, sketch binary"), "sketches")
    sketches, every = described.filter("sketch IS NOT NULL"), described.filter("sketch IS NULL").select("doc_id", "text_key", "node", "n")
    links = materialize(_verify(materialize(_possible(pairs, sketches, similarity), "possible"), dealt, shingle, similarity), "links")
    labels = components(links)
    mixed = _mixed(members, sketches, labels)
    sized = _sized(mixed, block_sets)
    work, before = _work(sized), math.inf
    while 0 < work <= 0.75 * before:
        near = materialize(_possible(_recentred(mixed, sized), sketches, similarity), "possible")
        more = None if near.isEmpty() else materialize(_verify(near, dealt, shingle, similarity), "links")
        if more is None or more.isEmpty():
            break
        links = links.unionByName(more)
        labels = components(links)
        mixed = _mixed(members, sketches, labels)
        sized = _sized(mixed, block_sets)
        work, before = _work(sized), work
    missed = materialize(_missed(mixed, sized, sketches, similarity, block_sets), "missed")
    if not missed.isEmpty():
        more = materialize(_verify(missed, dealt, shingle, similarity), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    # sets without words stay alone: each of their rows is its own class
    named = every.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicate_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, chunk_bytes: int = CHUNK_BYTES,
                              block_sets: int = BLOCK_SETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link texts whose sets of ``shingle``-word shingles (A-Z as a-z) have a
    Jaccard similarity of at least ``similarity``.

    Returns one row per input row: ``doc_id, n_shingles`` and ``component_id``,
    the smallest id reachable by links, itself included. A text of fewer words
    has its whole sequence as one shingle; NULL and empty texts have none and
    link with nothing; a NULL id is passed over when the smallest is sought;
    repeated rows and ties are rows of their own; an empty table gives an empty
    result; other columns are ignored. No pair similar enough is missed.
    Shingles are compared by 64-bit hashes.
    """
    return _classes(docs, shingle, similarity, chunk_bytes, block_sets, id_col, text_col).drop("text_key")


def keep_one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, chunk_bytes: int = CHUNK_BYTES,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less near duplicates: of each group of
    linked documents the one with the smallest id stays, and of rows with the
    same id and text one. Rows without an id go where a document with an id has
    such a text, and stay, one of each text, where none has."""
    found = _classes(docs, shingle, similarity, chunk_bytes, BLOCK_SETS, id_col, text_col)
    kept = materialize(found.filter("doc_id = component_id OR component_id IS NULL").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "kept")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("_id"),
                        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_key"))
    same = (keyed["_key"] == kept["_key"]) & keyed["_id"].eqNullSafe(kept["_id"])
    once = Window.partitionBy("_key", "_id").orderBy("_key")
    return keyed.join(kept, same, "left_semi").withColumn("_nth", F.row_number().over(once)).filter("_nth = 1").select("row.*")
