"""Benchmark decontamination: the windows of normalised benchmark items as a
broadcast hash set, scanned for in the windows of every document.

A hit by hash is verified term by term against the window's own bytes. The scan
deals no document anywhere: it is one pass over the table. A benchmark whose
windows outgrow ``BLOCK_BYTES`` is scanned for in blocks, one pass each, so that
what a task holds stays bounded; the passes' spans are then joined by text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import terms
from millrace.llm import textkernel as tk
from millrace.llm.common import materialize

#: Consecutive terms of a window; a shorter item is one window.
WINDOW = 10
#: Bytes of windows that are broadcast at a time.
BLOCK_BYTES = 48 << 20
#: Bytes that a window takes besides its letters.
_OVERHEAD = 100

SPAN = "struct<first:int,last:int,start:int,end:int>"
FOUND = f"struct<n_words:bigint,spans:array<{SPAN}>,items:array<string>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))), ("items", pa.list_(pa.string()))])


def _item_windows(window: int):
    """Every window of every item: its size, hash, term lengths and letters."""
    def run(batches):
        for batch in batches:
            data, offsets = tk.column_bytes(batch["text"])
            out = []
            for k, item in enumerate(batch["item"].to_pylist()):
                text = data[offsets[k]:offsets[k + 1]]
                starts, ends, _ = terms.locate(text, np.array([0, len(text)]), terms.ALNUM)
                if not len(starts):
                    continue
                letters, at = terms.folded(text, starts, ends, terms.ALNUM)
                size = min(window, len(starts))
                for _, h in terms.runs(terms.hashes(letters, at), [size]):
                    out += [(item, size, int(x), np.diff(at[i:i + size + 1]).astype("<i4").tobytes(), letters[at[i]:at[i + size]].tobytes())
                            for i, x in enumerate(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                             names=["item", "size", "hash", "lengths", "letters"])
    return run


class _Windows:
    """The benchmark windows of one size, ordered by hash."""

    def __init__(self, size: int, rows: list) -> None:
        rows.sort(key=lambda r: r["hash"] & (2**64 - 1))
        self.size = size
        self.hash = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
        self.lengths = np.frombuffer(b"".join(r["lengths"] for r in rows), "<i4").reshape(-1, size)
        self.at = np.concatenate(([0], np.cumsum([len(r["letters"]) for r in rows])))
        self.letters = np.frombuffer(b"".join(r["letters"] for r in rows), np.uint8)
        self.items = [r["items"] for r in rows]
        self.shift = np.uint64(64 - max(8, min(26, 4 + len(rows).bit_length())))
        self.marked = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.marked[self.hash >> self.shift] = True

    def match(self, run_hashes: np.ndarray, letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified pairs (first term of the run, number of the window)."""
        likely = np.flatnonzero(self.marked[run_hashes >> self.shift])
        low = np.searchsorted(self.hash, run_hashes[likely], "left")
        count = np.searchsorted(self.hash, run_hashes[likely], "right") - low
        run = np.repeat(likely, count)
        which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        same = (np.diff(at)[run[:, None] + np.arange(self.size)] == self.lengths[which]).all(axis=1)
        run, which = run[same], which[same]
        if not len(run):
            return run, which
        long = self.at[which + 1] - self.at[which]
        borders = np.concatenate(([0], np.cumsum(long)))
        inner = np.arange(borders[-1]) - np.repeat(borders[:-1], long)
        equal = letters[np.repeat(at[run], long) + inner] == self.letters[np.repeat(self.at[which], long) + inner]
        same = np.logical_and.reduceat(equal, borders[:-1])
        return run[same], which[same]


def _found(column, block: list[_Windows]):
    """Per text the number of its words, the maximal runs of hit words and the
    items whose windows it holds."""
    data, offsets = tk.column_bytes(column)
    sizes = [w.size for w in block]
    n_words, n_spans, n_items = [], [], []
    places, names = [], []
    for i, j in tk.slices(offsets):
        part, borders = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        starts, ends, first = terms.locate(part, borders, terms.ALNUM)
        letters, at = terms.folded(part, starts, ends, terms.ALNUM)
        text = np.repeat(np.arange(j - i), np.diff(first))
        change = np.zeros(len(starts) + 1, np.int32)
        pairs = set()
        for windows, (size, h) in zip(block, terms.runs(terms.hashes(letters, at), sizes), strict=False):
            run, which = windows.match(h, letters, at)
            inside = text[run] == text[run + size - 1]
            run, which = run[inside], which[inside]
            np.add.at(change, run, 1)
            np.add.at(change, run + size, -1)
            for t, w in set(zip(text[run].tolist(), which.tolist(), strict=True)):
                pairs.update((t, item) for item in windows.items[w])
        hit = np.cumsum(change)[:-1] > 0
        n_words.append(np.diff(first))
        opens = hit.copy()
        opens[1:] &= ~hit[:-1] | (text[1:] != text[:-1])
        closes = hit.copy()
        closes[:-1] &= ~hit[1:] | (text[1:] != text[:-1])
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        n_spans.append(np.bincount(text[a], minlength=j - i))
        if len(a):
            points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
            t = text[a]
            places.append(np.stack([a - first[t], b + 1 - first[t], points[starts[a]] - points[borders[t]], points[ends[b]] - points[borders[t]]]))
        pairs = sorted(pairs)
        names += [item for _, item in pairs]
        n_items.append(np.bincount(np.array([t for t, _ in pairs], np.int64), minlength=j - i))

    def borders(parts):
        return pa.array(np.concatenate(([0], np.cumsum(np.concatenate([*parts, np.empty(0, np.int64)])))), pa.int32())

    columns = np.concatenate(places, axis=1) if places else np.empty((4, 0), np.int64)
    spans = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], fields=list(_FOUND.field("spans").type.value_type))
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate([*n_words, np.empty(0, np.int64)]), pa.int64()), pa.ListArray.from_arrays(borders(n_spans), spans),
         pa.ListArray.from_arrays(borders(n_items), pa.array(names, pa.string()))], fields=list(_FOUND))


def _scan(block, text: str, out: str):
    def run(batches):
        windows = block.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _found(batch[text], windows)], names=[*batch.schema.names, out])
    return run


def _blocks(benchmark: DataFrame, window: int, block_bytes: int, item_col: str, text_col: str):
    """Broadcast the windows of all items, ``block_bytes`` of them at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    each = items.mapInArrow(_item_windows(window), "item string, size int, hash long, lengths binary, letters binary")
    distinct = materialize(each.groupBy("size", "hash", "lengths", "letters").agg(F.sort_array(F.collect_set("item")).alias("items")), "benchmark-windows")
    weight = F.octet_length("letters") + F.octet_length("lengths") + F.lit(_OVERHEAD) + F.aggregate("items", F.lit(0), lambda a, i: a + F.octet_length(i) + 16)
    total = distinct.agg(F.sum(weight.cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        sizes: dict[int, list] = {}
        for row in distinct.filter(F.pmod(F.xxhash64("hash"), F.lit(n)) == k).toLocalIterator():
            sizes.setdefault(row["size"], []).append(row)
        yield n, spark.sparkContext.broadcast([_Windows(s, sizes[s]) for s in sorted(sizes)])


def _union(spans: list[dict]) -> list[dict]:
    """Maximal runs of several passes' spans, which may overlap or touch."""
    merged: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if not merged or s["first"] > merged[-1]["last"]:
            merged.append(s)
        elif s["last"] > merged[-1]["last"]:
            merged[-1] |= {"last": s["last"], "end": s["end"]}
    return merged


def _merge(out: str):
    def run(batches):
        for batch in batches:
            n_words, spans, items = batch[out].flatten()
            spans = pa.array([_union(s) for s in spans.to_pylist()], spans.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays([n_words, spans, items], fields=list(_FOUND))], names=batch.schema.names)
    return run


def with_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a column, whose name is returned too, of ``n_words``,
    ``spans`` (maximal runs of hit words: first and end word, start and end code
    point, ends exclusive) and ``items`` (ids of the items whose windows occur,
    as strings, ascending). All other columns stay as they are."""
    out = "found"
    while out.lower() in {c.lower() for c in docs.columns} | {text_col.lower()}:
        out = f"_{out}"
    added = f"`{out}` {FOUND}"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [added])
    blocks = _blocks(benchmark, window, block_bytes, item_col, item_text_col)
    n, block = next(blocks)
    scanned = docs.mapInArrow(_scan(block, text_col, out), schema)
    if n == 1:
        return scanned, out
    texts, parts = docs.select(F.col(f"`{text_col}`").alias("text")), []
    for _, block in blocks:
        seen = texts.mapInArrow(_scan(block, "text", "found"), f"text string, found {FOUND}").filter(F.size("found.spans") > 0)
        parts.append(materialize(seen.select(F.sha2("text", 256).alias("key"), "found.spans", "found.items").dropDuplicates(["key"]), "contaminated"))
    more = parts[0]
    for p in parts[1:]:
        more = more.unionByName(p)
    more = more.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    base = scanned.withColumn(f"{out}_key", F.sha2(F.col(f"`{text_col}`").cast("string"), 256))
    joined = base.join(more.select(F.col("key").alias(f"{out}_key"), F.struct("spans", "items").alias(f"{out}_more")), f"{out}_key", "left")
    found, rest = F.col(out), F.col(f"{out}_more")
    both = F.struct(found["n_words"].alias("n_words"), F.concat(found["spans"], F.coalesce(rest["spans"], F.array().cast(f"array<{SPAN}>"))).alias("spans"),
                    F.array_sort(F.array_distinct(F.concat(found["items"], F.coalesce(rest["items"], F.array().cast("array<string>"))))).alias("items"))
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], both.alias(out))
    return joined.mapInArrow(_merge(out), schema), out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items``.

    Words are runs of letters, digits 0-9 and characters beyond ASCII, A-Z in
    lower case. A NULL or empty text has no words; an item without words has no
    window; equal items count each under their id and rows with the same item id
    as one item; an item without id marks words but is not listed; repeated
    documents give a row each; empty tables give an empty result or no hits;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scanned, out = with_contamination(rows, benchmark, window, block_bytes, "text", item_col, item_text_col)
    return scanned.select("doc_id", f"{out}.n_words", f"{out}.spans", f"{out}.items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without what they share with the benchmark: every column stays.

    ``remove="spans"`` cuts each run of hit words, from its first to its last
    character, out of the text; ``remove="documents"`` leaves out every document
    with a hit. Rows without a hit, NULL texts among them, stay unchanged.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")
    scanned, out = with_contamination(docs, benchmark, window, block_bytes, text_col, item_col, item_text_col)
    spans, text = F.col(out)["spans"], F.col(f"`{text_col}`")
    if remove == "documents":
        return scanned.filter(F.size(spans) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    pieces = F.zip_with(F.concat(F.array(F.lit(0)), spans["end"]), F.concat(spans["start"], F.array(F.length(text))),
                        lambda end, start: F.substr(text, end + 1, start - end))
    kept = F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))
    return scanned.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    """The contract columns of the registered query."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
