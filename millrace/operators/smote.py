"""Synthetic rows for the smaller classes, by interpolation between
neighbours (declared only in the rules; built as an operator of its own).

Neighbours are searched inside a class along several random projections: rows are
ranked by each projection, dealt in blocks of neighbouring ranks with a margin on
both sides, and compared exactly inside their block. So a class of any size is
searched in blocks of bounded size, one per projection, and no pair outside a block
is formed; equal rows share out over blocks. The nearest over all projections are
kept: they are true neighbours with the recall that the projections give.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.rowindex import quoted, rank_in_group, written
from millrace.operators.profile import is_numeric_type, value_of

NEIGHBOURS = 5
PROJECTIONS = 8
#: Rows of a block, and of the margin that it shares with the blocks beside it.
BLOCK_ROWS = 512
MARGIN_ROWS = 128


def _nearest(k: int):
    def run(key, rows):
        x = np.stack(rows["x"].combine_chunks().to_pylist()).astype(float) if rows.num_rows else np.empty((0, 1))
        own, ids = rows["own"].to_numpy(zero_copy_only=False).astype(bool), rows["row"].to_numpy()
        far = ((x[own][:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
        far[ids[own][:, None] == ids[None, :]] = np.inf  # a row isn't its own neighbour
        out = []
        for r, line in zip(ids[own].tolist(), far, strict=True):
            best = np.lexsort((ids, line))[:k]
            out += [(r, int(ids[b]), float(line[b])) for b in best if np.isfinite(line[b])]
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["row", "near", "far"])
    return run


def class_neighbours(rows: DataFrame, k: int = NEIGHBOURS, projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS, margin_rows: int = MARGIN_ROWS, seed: int = 42) -> DataFrame:
    """``row, near, far``: the ``k`` nearest rows of the same ``class`` that the
    projections find, with squared distances. ``rows``: row (long), class, x
    (array of doubles, of one length)."""
    width = len(rows.select("x").first()["x"]) if rows.limit(1).count() else 1
    found = None
    for p in range(min(projections, 1) if width == 1 else projections):  # on a line one projection finds all
        axis = np.random.default_rng([seed, p]).normal(size=width).tolist()
        value = F.aggregate(F.zip_with("x", F.array(*[F.lit(a) for a in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        placed = rank_in_group(rows.withColumn("along", value), ["class"], ["along", "row"], "at")
        block, inside = F.floor(F.col("at") / block_rows), F.col("at") % block_rows
        beside = F.array_compact(F.array(F.when((inside < margin_rows) & (block > 0), F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
                                         F.struct(block.alias("block"), F.lit(True).alias("own")),
                                         F.when(inside >= block_rows - margin_rows, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))))
        dealt = placed.select("row", "class", "x", F.explode(beside).alias("b")).select("row", "class", "x", "b.*")
        near = dealt.groupBy("class", "block").applyInArrow(_nearest(k), "row long, near long, far double")
        found = near if found is None else found.unionByName(near)
    once = found.groupBy("row", "near").agg(F.min("far").alias("far"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("far", "near"))), 1, k)  # k a projection at most
    return once.groupBy("row").agg(best.alias("b")).select("row", F.explode("b").alias("b")).select("row", "b.near", "b.far")


def balance_smote(df: DataFrame, column: str, key_cols: Sequence[str], features: Sequence[str] | None = None, k: int = NEIGHBOURS, seed: int = 42, marker: str = "is_synthetic", **search) -> DataFrame:
    """``df`` and as many synthetic rows as bring every class to the largest
    class's rows, with ``marker``.

    A synthetic row is a row of its class with its ``features`` (numeric columns
    other than the key, by default) moved by a hashed share of the way to one of its
    nearest rows; integers are rounded, other columns are copied. Each row of a class
    serves equally often, but for one. NULL features stay NULL and count as 0 in
    distances, which are of features divided by their standard deviation. A class of
    one row is repeated. Rows without a class are kept and get no class."""
    names = list(features) if features is not None else [f.name for f in df.schema.fields if is_numeric_type(f.dataType, bool_numeric=False) and f.name not in (*key_cols, column)]
    known = df.filter(quoted(column).isNotNull())
    sizes = written(known.groupBy(quoted(column).alias("class")).agg(F.count(F.lit(1)).alias("size")), "class-sizes")
    most = sizes.agg(F.max("size")).first()[0]
    if most is None:
        return df.withColumn(marker, F.lit(False))
    spread = df.agg(*[F.stddev_pop(value_of(df, c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]).first() if names else []
    x = F.array(*[F.coalesce(value_of(df, c).cast("double") / F.lit(s if s else 1.0), F.lit(0.0)) for c, s in zip(names, spread, strict=True)] or [F.lit(0.0)])
    hashed = F.xxhash64(*[quoted(c) for c in key_cols], F.lit(seed))
    small = known.join(sizes.filter(F.col("size") < most).withColumnRenamed("class", column), column).select(
        F.struct(*[quoted(c) for c in df.columns]).alias("base"), quoted(column).alias("class"), "size", x.alias("x"), hashed.alias("h"))
    ranked = written(rank_in_group(small, ["class"], ["h"], "at"), "minority")
    numbered = written(ranked.withColumn("row", F.monotonically_increasing_id()), "minority")  # fixed by the write
    near = written(class_neighbours(numbered.select("row", "class", "x"), k, seed=seed, **search), "neighbours")
    others = near.join(numbered.select(F.col("row").alias("near"), F.col("base").alias("other")), "near").select("row", "far", "near", "other")
    listed = others.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("far", "near", "other"))).alias("others"))  # k of them
    need = F.floor((F.lit(most) - F.col("size")) / F.col("size")) + ((F.lit(most) - F.col("size")) % F.col("size") > F.col("at")).cast("long")
    made = numbered.withColumn("need", need).filter("need > 0").join(listed, "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("need"))))
    drawn = F.xxhash64("h", "copy", F.lit(seed))
    other = F.coalesce(F.get("others", F.pmod(drawn, F.size("others")).cast("int"))["other"], F.col("base"))
    share = F.pmod(F.xxhash64("copy", "h", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cells = []
    for f in df.schema.fields:
        a, b = F.col("base")[f.name], other[f.name]
        if f.name in names:
            moved = a.cast("double") + share * (F.coalesce(b, a).cast("double") - a.cast("double"))
            fractional = isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))
            a = (moved if fractional else F.round(moved)).cast(f.dataType)
        cells.append(a.alias(f.name))
    return df.withColumn(marker, F.lit(False)).unionByName(made.select(*cells, F.lit(True).alias(marker)))
