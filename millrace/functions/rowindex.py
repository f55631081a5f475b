"""Distributed row numbers, in-group ranks and running sums over a table that is
written once in order.

Rows are dealt by range on the ordering key, sorted inside their partition and
written as Parquet to the shared folder, each with its partition and its place
there. A row's number is then the rows of all earlier partitions plus that place:
one small table with a row per partition holds the first part. What was written
is fixed, so a replanned or recomputed job gives the same numbers; nothing is
collected, and no bound or list that grows with the rows enters a plan. The
number of partitions is Spark's (``spark.sql.shuffle.partitions``, joined by
adaptive execution where they are small). A hash of the whole row ends each key
that isn't unique, so one value with a third of the rows spreads over many
partitions; rows that are equal throughout lie in one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import scratch_path

#: ``monotonically_increasing_id`` numbers a partition's rows in the lower bits.
_PLACE_BITS = 33
#: Of a row group of a table that several jobs read again.
_GROUP_BYTES = 8 << 20


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _col(name: str | Column) -> Column:
    return quoted(name) if isinstance(name, str) else name


def written(df: DataFrame, tag: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, f"{tag}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, tag: str) -> DataFrame:
    """``written`` under neutral names, whatever characters the columns' have, and in
    small row groups, so that many tasks read what few have written."""
    return written(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), tag, **{"parquet.block.size": _GROUP_BYTES}).toDF(*df.columns)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns; maps, which Spark doesn't hash, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(quoted(f.name))) if _holds_map(f.dataType) else quoted(f.name) for f in df.schema.fields])


def _running(value_type: pa.DataType):
    """Per row of a sorted partition, the sum of ``v`` over the earlier rows of
    the same group (rows of a group are neighbours; ``g`` tells groups apart)."""
    def run(batches):
        group, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch["g"].to_numpy(zero_copy_only=False)
            v = batch["v"].fill_null(0).to_numpy(zero_copy_only=False)
            heads = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1))
            before = np.concatenate(([0], np.cumsum(v)))
            off = before[heads]
            if group is not None and g[0] == group:
                off[0] -= total
            sums = before[:-1] - np.repeat(off, np.diff(np.append(heads, len(v))))
            group, total = g[-1], sums[-1] + v[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, value_type)], names=[*batch.schema.names, "s"])
    return run


def running_sum(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[str | Column], value: str | Column | None, out_col: str,
                unique_key: bool = False) -> DataFrame:
    """Add ``out_col``: the sum of ``value`` (rows, if None) over the rows of the
    same group that come before in ``order_by`` (ascending). Groups are compared
    with NULLs as equal, and told apart by 64-bit hashes where they are
    neighbours. Without group columns the whole table is one group. NULL values
    count as 0; an empty table stays empty."""
    groups = [quoted(g) for g in group_cols]
    names = [f"c{i}" for i in range(len(df.columns))]
    key = [*groups, *[_col(k) for k in order_by], *([] if unique_key else [row_hash(df)])]
    keys = [f"k{i}" for i in range(len(key))]
    counted = value is None
    v = F.lit(1).cast("long") if counted else _col(value)
    v = v.cast("double") if not counted and df.select(v.alias("v")).schema[0].dataType in (T.FloatType(), T.DoubleType()) else v.cast("long")
    keyed = df.select(*[quoted(c).alias(n) for c, n in zip(df.columns, names, strict=True)], *[k.alias(n) for k, n in zip(key, keys, strict=True)],
                      (F.xxhash64(*groups) if groups else F.lit(0).cast("long")).alias("g"), v.alias("v"))
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("place", F.monotonically_increasing_id())
    if counted and not groups:  # the place is the sum
        stored = dealt.withColumn("s", F.col("place").bitwiseAND((1 << _PLACE_BITS) - 1))
    else:
        double = isinstance(dealt.schema["v"].dataType, T.DoubleType)
        fields = [*dealt.schema.fields, T.StructField("s", T.DoubleType() if double else T.LongType())]
        stored = dealt.mapInArrow(_running(pa.float64() if double else pa.int64()), T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    table = written(stored.withColumn("part", F.shiftright("place", _PLACE_BITS).cast("int")).drop("place"), "ordered")
    parts = table.groupBy("part", "g").agg(F.sum("v").alias("v"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the group that opens a partition has rows in earlier ones: at most one row each
    carried = written(parts.select("part", "g", F.sum("v").over(before).alias("carry")).filter(F.col("carry").isNotNull()), "carried")
    joined = table.join(carried, ["part", "g"], "left")
    return joined.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)], (F.col("s") + F.coalesce("carry", F.lit(0))).alias(out_col))


def global_index(df: DataFrame, order_by: Sequence[str | Column], idx_col: str = "idx", unique_key: bool = False) -> DataFrame:
    """Attach ``idx_col`` = 0..n-1 following ``order_by`` (ascending).

    ``unique_key=True`` states that ``order_by`` already is a total order;
    otherwise rows with equal keys follow a hash of the whole row, and rows that
    are equal throughout share out their numbers in any way.
    """
    return running_sum(df, [], order_by, None, idx_col, unique_key)


def rank_in_group(df: DataFrame, group_cols: Sequence[str], order_by: Sequence[str | Column], rank_col: str = "rk") -> DataFrame:
    """0-based rank of each row inside its group following ``order_by``; rows
    with equal keys follow a hash of the whole row. A hot group spreads over
    partitions. Rows with a NULL group key are dropped."""
    for c in group_cols:
        df = df.filter(quoted(c).isNotNull())
    return running_sum(df, group_cols, order_by, None, rank_col)


def cumulative_sum(df: DataFrame, order_col: str, value_col: str, out_col: str = "cum") -> DataFrame:
    """Running sum of ``value_col`` in ``order_col`` order, the row itself
    included (order values unique)."""
    value = quoted(value_col).cast("double")
    return running_sum(df, [], [order_col], value, out_col, True).withColumn(out_col, quoted(out_col) + value)
