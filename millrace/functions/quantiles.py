"""Exact quantiles by radix selection.

A double's bits, read as an integer and turned around below zero, order as the
double does. Rows are counted by the upper 16 bits of that key; the counts tell
which prefix holds the wanted rank, and only rows under a wanted prefix are
counted again by the next 16 bits, four times at most, or until a prefix holds
one value only. Counts are partial sums before the shuffle, at most 65,536 a
group and task; nothing is sorted, and no task holds a column or a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rowindex import quoted, written

_DIGITS = (48, 32, 16, 0)
_INFINITE, _FRACTION = 2047 << 52, (1 << 52) - 1
#: Wanted prefixes that are broadcast; more are joined by a shuffle.
BROADCAST_PREFIXES = 50_000


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def ordered_bits(x: Column) -> Column:
    """The IEEE bits of ``abs(x)``, negated below zero: a long that orders as
    the double does. NaN is the greatest."""
    a = F.abs(x)
    near = F.floor(F.log2(a)).cast("int")
    e = F.when(_power(near) > a, near - 1).when(_power(near + 1) <= a, near + 1).otherwise(near)
    small = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((a / _power(e) - 1.0) * F.lit(2.0**52)).cast("long")
    bits = F.when(a == float("inf"), F.lit(_INFINITE)).when(a < F.lit(2.0**-1022), small).otherwise(normal)
    return F.when(F.isnan(x), F.lit(_INFINITE + 1)).when(x < 0, -bits).otherwise(bits)


def from_ordered_bits(key: Column) -> Column:
    """The double whose ``ordered_bits`` are given."""
    bits = F.abs(key)
    e, rest = F.shiftright(bits, 52), bits.bitwiseAND(_FRACTION).cast("double")
    a = (F.when(bits > _INFINITE, F.lit(float("nan"))).when(bits == _INFINITE, F.lit(float("inf")))
         .when(e == 0, rest * F.lit(2.0**-537) * F.lit(2.0**-537)).otherwise((rest / F.lit(2.0**52) + 1.0) * _power(e - 1023)))
    return F.when(key < 0, -a).otherwise(a)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group_cols: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles (numpy 'linear', DuckDB quantile_cont),
    exact, of ``value`` as a double.

    Output: ``group_cols..., p, n, q``. Rows whose value or group is NULL are
    ignored; NaN is the greatest value; a group without values has no row.
    """
    groups = [f"g{i}" for i in range(max(1, len(group_cols)))]
    cols = [quoted(c) for c in group_cols] or [F.lit(0)]
    rows = df.select(*[c.alias(n) for c, n in zip(cols, groups, strict=True)], ordered_bits(quoted(value).cast("double")).alias("key")).dropna()
    rows = written(rows, "quantile-keys")

    # counts by the upper digit give each group's size, and so the wanted ranks
    digit, low, high = F.shiftright("key", _DIGITS[0]).alias("prefix"), F.min("key").alias("low"), F.max("key").alias("high")
    counts = rows.groupBy(*groups, digit).agg(F.count(F.lit(1)).alias("c"), low, high)
    inside = Window.partitionBy(*groups)
    placed = (counts.withColumn("n", F.sum("c").over(inside))
              .withColumn("end", F.sum("c").over(inside.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))))
    wanted = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.struct(p.alias("p"), (p * (F.col("n") - 1)).alias("at")))
    sides = [F.struct("w.p", "w.at", F.lit(s).alias("side"), f("w.at").cast("long").alias("rank")) for s, f in ((0, F.floor), (1, F.ceil))]
    found = (placed.withColumn("w", F.explode(wanted)).withColumn("w", F.explode(F.array(*sides)))
             .filter((F.col("w.rank") >= F.col("end") - F.col("c")) & (F.col("w.rank") < F.col("end")))
             .select(*groups, "n", "w.p", "w.at", "w.side", (F.col("w.rank") - F.col("end") + F.col("c")).alias("rank"), "prefix", "low", "high"))
    found = written(found, "quantile-prefixes")
    done = [found.filter("low = high")]
    for above, shift in zip(_DIGITS, _DIGITS[1:], strict=False):
        left = found.filter("low < high")
        open_ = left.select(*groups, "prefix").distinct()
        n_open = open_.count()
        if not n_open:
            break
        parent = F.shiftright("key", above).alias("prefix")
        some = rows.select(*groups, "key", parent).join(F.broadcast(open_) if n_open <= BROADCAST_PREFIXES else open_, [*groups, "prefix"], "left_semi")
        counts = some.groupBy(*groups, F.col("prefix").alias("parent"), F.shiftright("key", shift).alias("prefix")).agg(F.count(F.lit(1)).alias("c"), low, high)
        inside = Window.partitionBy(*groups, "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("end", F.sum("c").over(inside))
        ranks = left.select(*groups, "n", "p", "at", "side", "rank", F.col("prefix").alias("parent"))
        found = (ranks.join(placed, [*groups, "parent"]).filter((F.col("rank") >= F.col("end") - F.col("c")) & (F.col("rank") < F.col("end")))
                 .select(*groups, "n", "p", "at", "side", (F.col("rank") - F.col("end") + F.col("c")).alias("rank"), "prefix", "low", "high"))
        found = written(found, "quantile-prefixes")
        done.append(found.filter("low = high"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    x = from_ordered_bits(F.col("low"))
    lo, hi = (F.max(F.when(F.col("side") == s, x)) for s in (0, 1))
    both = every.groupBy(*groups, "p", "n", "at").agg(lo.alias("lo"), hi.alias("hi"))
    q = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at")))
    return both.select(*[F.col(n).alias(c) for n, c in zip(groups, group_cols, strict=False)], "p", "n", q.alias("q"))


def exact_quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """Ungrouped exact quantiles on the driver: one number per probability."""
    rows = {float(r["p"]): r["q"] for r in exact_quantiles(df, value, probs).collect()}
    return [rows.get(float(p)) for p in probs]
