"""Multisets of rows compared by fingerprints: only two 64-bit hashes a row are
shuffled, and only rows whose counts differ are looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.rowindex import quoted

#: Differing fingerprints that are broadcast to find their rows; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def fingerprint(df: DataFrame) -> list[Column]:
    """Two hashes of a whole row. Spark's hash passes over NULLs, so each column's
    absence is hashed too; maps and nested values are hashed as JSON."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = quoted(f.name)
        parts += [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else c, c.isNull()]
    return [F.xxhash64(F.lit(0), *parts).alias("h0"), F.xxhash64(F.lit(1), *parts).alias("h1")]


def _counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per fingerprint, its rows in ``a`` and in ``b`` (columns by position)."""
    sides = [d.select(*fingerprint(d), F.lit(x).alias("a"), F.lit(1 - x).alias("b")) for d, x in ((a, 1), (b, 0))]
    return sides[0].unionByName(sides[1]).groupBy("h0", "h1").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of ``a`` that ``b`` lacks, as often as it lacks them (as EXCEPT
    ALL). Both have the same columns in the same order."""
    same = b.select(*[quoted(c).cast(f.dataType).alias(f.name) for c, f in zip(b.columns, a.schema.fields, strict=True)])
    more = _counts(a, same).filter("a > b").select("h0", "h1", (F.col("a") - F.col("b")).alias("times"))
    side = F.broadcast(more) if more.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else more
    row = F.struct(*[quoted(c) for c in a.columns])
    found = a.select(*fingerprint(a), row.alias("row")).join(side, ["h0", "h1"])
    once = found.groupBy("h0", "h1").agg(F.first("row").alias("row"), F.first("times").alias("times"))  # rows of one fingerprint are equal
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of both sides, and rows only in one: n_a, n_b, only_a, only_b."""
    zero = F.lit(0).cast("long")
    return _counts(a, b).agg(F.coalesce(F.sum("a"), zero).alias("n_a"), F.coalesce(F.sum("b"), zero).alias("n_b"),
                             F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), zero)), zero).alias("only_a"), F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), zero)), zero).alias("only_b"))
