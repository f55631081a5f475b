"""Source divergence audit by in-mapper stripes.

A task folds whole documents into one hash stripe a term: its document frequency
and its count in every source. Stripes that outgrow ``SPILL_CELLS`` are emitted
and begun anew. One shuffle brings a term's stripes together, one a task and
spill, and Spark adds them up. The merged stripes of frequent terms are dealt, a
bounded number of cells at a time, to tasks that emit the divergences of all their
terms at once. All numbers are integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import terms
from millrace.llm import textkernel as tk
from millrace.llm.common import materialize

#: Cells (term, source) that a task's stripes hold before they are emitted.
SPILL_CELLS = 500_000
#: Cells of merged stripes that one task compares, and sources on one side of
#: its comparisons; cells of the dense table it holds at a time.
TASK_CELLS = 1_000_000
SOURCE_BLOCK = 256
DENSE_CELLS = 1 << 20

SCALE = 1_000_000_000
_CELLS = "lang string, term string, source string, n_docs long, n long"
_EMITTED = "lang string, source string, part string, item string, value long"


def _slice_cells(texts: pa.Array, langs: list[str], sources: list[str]):
    """Cells (lang, term, source, documents, occurrences) of whole documents,
    some MB of text at a time."""
    data, offsets = tk.column_bytes(texts)
    for i, j in tk.slices(offsets):
        part, borders = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        starts, ends, first = terms.locate(part, borders, terms.LETTERS)
        if not len(starts):
            continue
        letters, at = terms.folded(part, starts, ends, terms.LETTERS)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
        term, n_terms = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
        groups = sorted(set(zip(langs[i:j], sources[i:j], strict=True)))
        number = {g: k for k, g in enumerate(groups)}
        of_text = np.array([number[g] for g in zip(langs[i:j], sources[i:j], strict=True)])
        text = np.repeat(np.arange(j - i), np.diff(first))
        in_text, count = np.unique(text * n_terms + term, return_counts=True)
        cell = of_text[in_text // n_terms] * n_terms + in_text % n_terms
        order = np.argsort(cell, kind="stable")
        cell, count = cell[order], count[order]
        heads = np.flatnonzero(np.diff(cell, prepend=-1))
        group = cell[heads] // n_terms
        yield pa.table([pa.array([g[0] for g in groups], pa.string()).take(pa.array(group)), words.dictionary.cast(pa.string()).take(pa.array(cell[heads] % n_terms)),
                        pa.array([g[1] for g in groups], pa.string()).take(pa.array(group)), pa.array(np.diff(np.append(heads, len(cell))), pa.int64()),
                        pa.array(np.add.reduceat(count, heads), pa.int64())], names=["lang", "term", "source", "n_docs", "n"])


def _fold(parts: list[pa.Table]) -> pa.Table:
    folded = pa.concat_tables(parts).group_by(["lang", "term", "source"], use_threads=False).aggregate([("n_docs", "sum"), ("n", "sum")])
    return folded.rename_columns({"n_docs_sum": "n_docs", "n_sum": "n"})


def _stripes(cells: pa.Table):
    """One row a term: document frequency and counts by source."""
    cells = cells.sort_by([("lang", "ascending"), ("term", "ascending")])
    lang, term = (cells[c].combine_chunks() for c in ("lang", "term"))
    same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1])) if len(lang) > 1 else pa.array([], pa.bool_())
    heads = np.concatenate(([0], np.flatnonzero(~same.to_numpy(zero_copy_only=False).astype(bool)) + 1))
    counts = pa.StructArray.from_arrays([cells[c].combine_chunks() for c in ("source", "n_docs", "n")], names=["source", "n_docs", "n"])
    for a in range(0, len(heads), 4096):
        b = min(a + 4096, len(heads))
        lo, hi = heads[a], heads[b] if b < len(heads) else len(lang)
        at = pa.array(np.append(heads[a:b], hi) - lo, pa.int32())
        yield pa.RecordBatch.from_arrays([lang.take(pa.array(heads[a:b])), term.take(pa.array(heads[a:b])), pa.ListArray.from_arrays(at, counts[lo:hi])], names=["lang", "term", "counts"])


def _map_stripes(spill: int):
    def run(batches):
        held, loose = None, 0
        parts: list[pa.Table] = []
        for batch in batches:
            for cells in _slice_cells(batch["text"], batch["lang"].to_pylist(), batch["source"].to_pylist()):
                parts.append(cells)
                loose += len(cells)
                if loose >= spill // 2:
                    held, loose = _fold(parts if held is None else [held, *parts]), 0
                    parts = []
                    if len(held) >= spill:
                        yield from _stripes(held)
                        held = None
        if held is not None or parts:
            yield from _stripes(_fold(parts if held is None else [held, *parts]))
    return run


def term_stripes(docs: DataFrame, spill_cells: int = SPILL_CELLS) -> DataFrame:
    """``lang, term, n_docs, counts`` of every term: the number of the language's
    documents that hold it, and per source (``counts``: array of source, n_docs,
    n) its occurrences. Input: ``text, lang, source`` without NULLs."""
    mapped = docs.select("text", "lang", "source").mapInArrow(_map_stripes(spill_cells), "lang string, term string, counts array<struct<source:string,n_docs:bigint,n:bigint>>")
    cells = mapped.repartition("lang", "term").select("lang", "term", F.inline("counts"))  # both sums need no other shuffle
    merged = cells.groupBy("lang", "term", "source").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    return merged.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "n_docs", "n")).alias("counts"))


def _share(count: np.ndarray, whole) -> np.ndarray:
    """1 + floor(SCALE * count / whole) by long division in three steps, exact
    for wholes below 2 ** 63 / 1000."""
    got, rest = np.divmod(count, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        got = got * 1000 + digits
    return 1 + got


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(top: int):
    """Divergences of the terms of one language that lie in one task, for one
    block of its sources against all others."""
    def run(key, cells, groups):
        out: list[pa.Table] = []
        order = np.argsort(np.array(groups["source"].to_pylist(), object), kind="stable") if groups.num_rows else np.empty(0, int)
        if len(order):
            groups = groups.take(pa.array(order))
            names = groups["source"].to_pylist()
            number = {s: k for k, s in enumerate(names)}
            whole = groups["n"].to_numpy().astype(np.int64) + 2 * groups["n_terms"].to_numpy()
            all_whole = int(groups["lang_n"][0].as_py()) + 2 * int(groups["n_terms"][0].as_py())
            mine = np.flatnonzero(groups["block"].to_numpy() == key[2].as_py())
            sums = np.zeros((len(mine), len(names)), np.int64)
            found: list[tuple] = []
            step = max(1, DENSE_CELLS // len(names))
            words = cells["term"].to_pylist()
            lists = cells["counts"].combine_chunks() if cells.num_rows else None
            for a in range(0, cells.num_rows, step):
                some = lists[a:a + step]
                flat = some.flatten()
                row = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy())
                col = np.array([number[s] for s in flat.field("source").to_pylist()], np.int64)
                count = np.zeros((len(some), len(names)), np.int64)
                count[row, col] = flat.field("n").to_numpy()
                p = _share(count + 2, whole)
                for k, s in enumerate(mine):
                    sums[k] += _apart(p[:, [s]], p).sum(axis=0)
                q = _share(count.sum(axis=1) + 2, all_whole)
                for s in mine:
                    over = np.flatnonzero((count[:, s] > 0) & (p[:, s] > q))
                    value = _apart(p[over, s], q[over])
                    if len(over) > top:
                        least = np.partition(value, -top)[-top]
                        over, value = over[value >= least], value[value >= least]
                    best = sorted(((-int(v), words[a + w]) for w, v in zip(over, value, strict=True)))[:top]
                    found += [(names[s], word, -v) for v, word in best]
            pairs = [(names[s], names[o], int(sums[k, o])) for k, s in enumerate(mine) for o in range(len(names)) if o != s]
            for part, rows in (("pair", pairs), ("term", found)):
                out.append(pa.table([pa.array([key[0].as_py()] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([part] * len(rows), pa.string()),
                                     pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "source", "part", "item", "value"]))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], pa.int64() if n == "value" else pa.string()) for n in ("lang", "source", "part", "item", "value")})
    return run


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      spill_cells: int = SPILL_CELLS, task_cells: int = TASK_CELLS, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """How far the sources of each language lie apart, and by which terms.

    Terms are runs of letters A-Z, a-z (in lower case) and of characters beyond
    ASCII; those in at least ``min_docs`` documents of a language are compared.
    With ``n`` occurrences among a source's ``N``, and ``V`` terms, a share is
    ``p = 1 + floor(10^9 (n + 2) / (N + 2 V))`` and two shares lie
    ``floor((p - q)^2 / (p + q))`` apart. Returns ``lang, source, part, item,
    value, rank``: part ``pair`` has, for every other source of the language, the
    sum over its terms; part ``term`` the ``top`` terms that the source uses more
    than its language does.

    A NULL text, language or source is an empty string; a group without terms
    counts as one that uses no term; a language without frequent terms has pairs
    of value 0; equal values rank by the item's bytes; repeated rows count each;
    an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    kept = materialize(term_stripes(rows, spill_cells).filter(F.col("n_docs") >= min_docs).select("lang", "term", "counts"), "stripes")
    used = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    occurring = rows.select("lang", "source").distinct()
    by_lang = Window.partitionBy("lang")
    groups = occurring.join(used, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["n", "n_terms"])
    groups = groups.withColumn("lang_n", F.sum("n").over(by_lang)).withColumn("block", ((F.row_number().over(by_lang.orderBy("source")) - 1) / source_block).cast("int"))
    groups = materialize(groups, "source-groups")
    cells, = kept.agg(F.sum(F.size("counts")).alias("cells")).first()
    last_block, = groups.agg(F.max("block")).first()
    tasks = max(1, math.ceil((cells or 0) / task_cells))
    dealt = kept.withColumn("task", F.pmod(F.xxhash64("term"), F.lit(tasks)).cast("int")).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(last_block or 0))))
    beside = groups.select("lang", "block").distinct().withColumnRenamed("block", "side").join(groups, "lang") \
        .withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    emitted = dealt.groupBy("lang", "task", "side").cogroup(beside.groupBy("lang", "task", "side")).applyInArrow(_compare(top), _EMITTED)
    summed = emitted.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
