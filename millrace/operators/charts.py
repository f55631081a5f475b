"""Chart-ready aggregates. Every chart runs on all rows (no sampling) except
the display outputs that are point lists (scatter), which keep the
reference's stride rule on a distributed row index."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.quantiles import exact_quantiles
from millrace.functions.rowindex import global_index
from millrace.functions.small import attach_row
from millrace.operators.profile import (is_numeric_type, junk_columns, numeric_columns, value_of)

# --- fixed values -----------------------------------------------------------
BOX_TOP_LABELS = 30
CATEGORY_TOP = 50
CORR_TOP = 20
SCATTER_MAX_POINTS = 5000
# ---------------------------------------------------------------------------


def stride_sample(df: DataFrame, order_by: Sequence[str], every_nth: int = 1, idx_col: str = "idx") -> DataFrame:
    """Every ``every_nth`` row in ``order_by`` order, starting at row 0; all
    rows unless asked for less. Adds the row index."""
    idx = global_index(df, order_by, idx_col=idx_col, unique_key=True)
    return idx.filter(F.col(idx_col) % every_nth == 0) if every_nth > 1 else idx


# --- D9 -----------------------------------------------------------------------
def auto_bin_count(n: int, lo: float, hi: float, q1: float | None, q3: float | None,
                   sqrt_floor: bool = False) -> tuple[int, float, float]:
    """numpy 'auto' rule: width = min(Freedman-Diaconis, Sturges), Sturges when
    the IQR is 0; nbins = ceil(range / width); a zero range gives one bin
    [x - 0.5, x + 0.5]. ``sqrt_floor`` adds the newer numpy floor of FD at half
    the sqrt-rule width."""
    first, last = lo, hi
    if first == last:
        return 1, first - 0.5, last + 0.5
    ptp = hi - lo
    sturges = ptp / (math.log2(n) + 1.0)
    iqr = (q3 - q1) if (q1 is not None and q3 is not None) else 0.0
    fd = 2.0 * iqr * n ** (-1.0 / 3.0)
    if sqrt_floor and fd:
        fd = max(fd, ptp / math.sqrt(n) / 2.0)
    width = min(fd, sturges) if fd else sturges
    nb = int(math.ceil(ptp / width)) if width else 1
    return max(nb, 1), first, last


def histogram_stats(df: DataFrame, column: str) -> dict:
    x = value_of(df, column).cast("double")
    s = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    r = s.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
              F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
              F.approx_count_distinct("x").alias("nd")).first()
    out = r.asDict()
    if out["n"]:
        qs = {row["p"]: row["q"] for row in exact_quantiles(s, "x", [0.25, 0.75]).collect()}
        out["q1"], out["q3"] = qs.get(0.25), qs.get(0.75)
    return out


def histogram(df: DataFrame, column: str, bins: int | str = "auto", sqrt_floor: bool = False) -> DataFrame:
    """column, bin, bin_lo, bin_hi, count for every bin (empty bins too); the
    last bin is closed. NULL/NaN dropped. Two passes: stats, then one
    partial/final count aggregate over bin ids."""
    spark = df.sparkSession
    st = histogram_stats(df, column)
    if not st["n"]:
        return spark.createDataFrame([], "column string, bin int, bin_lo double, bin_hi double, count bigint")
    if bins == "auto":
        nb, first, last = auto_bin_count(st["n"], st["lo"], st["hi"], st.get("q1"), st.get("q3"), sqrt_floor)
    else:
        nb = int(bins)
        first, last = (st["lo"], st["hi"]) if st["lo"] != st["hi"] else (st["lo"] - 0.5, st["hi"] + 0.5)
    x = value_of(df, column).cast("double")
    b = F.least(F.greatest(F.floor((x - F.lit(first)) * F.lit(nb) / F.lit(last - first)), F.lit(0)),
                F.lit(nb - 1)).cast("int")
    counts = df.select(b.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"))
    width = (last - first) / nb
    edges = spark.range(nb).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(counts, "bin", "left")
            .select(F.lit(column).alias("column"), "bin",
                    (F.lit(first) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    F.when(F.col("bin") == nb - 1, F.lit(last))
                    .otherwise(F.lit(first) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# --- D10 ----------------------------------------------------------------------
def top_labels(df: DataFrame, label: str, k: int) -> DataFrame:
    """k most frequent non-null labels (ties: value ascending): a distributed
    top-k (TakeOrderedAndProject), no window over the count table."""
    vc = (df.select(F.col(f"`{label}`").alias("label")).filter(F.col("label").isNotNull())
          .groupBy("label").agg(F.count(F.lit(1)).alias("count")))
    return vc.orderBy(F.desc("count"), F.asc("label")).limit(k)


def boxplot_by_label(df: DataFrame, target: str, label: str, top: int = BOX_TOP_LABELS) -> DataFrame:
    """Five-number summary (linear quartiles) of ``target`` per label, for the
    ``top`` most frequent labels, and a row '__others__' with the number of values
    under all other labels (when any). label, min, q1, median, q3, max, n."""
    labels = top_labels(df, label, top).select("label")
    every = df.select(F.col(f"`{label}`").alias("label"), value_of(df, target).cast("double").alias("x"))
    data = every.join(F.broadcast(labels), "label", "left_semi")  # at most `top` rows: bounded broadcast
    others = (every.filter(F.col("label").isNotNull()).join(F.broadcast(labels), "label", "left_anti").agg(F.count("x").alias("n")).filter("n > 0")
              .select(F.lit("__others__").alias("label"), *[F.lit(None).cast("double").alias(c) for c in ("min", "q1", "median", "q3", "max")], "n"))
    qs = exact_quantiles(data, "x", [0.0, 0.25, 0.5, 0.75, 1.0], ["label"])
    pick = {p: F.max(F.when(F.col("p") == p, F.col("q"))) for p in (0.0, 0.25, 0.5, 0.75, 1.0)}
    return (qs.groupBy("label", "n")
            .agg(pick[0.0].alias("min"), pick[0.25].alias("q1"), pick[0.5].alias("median"),
                 pick[0.75].alias("q3"), pick[1.0].alias("max"))
            .select(F.col("label").cast("string").alias("label"), "min", "q1", "median", "q3", "max", "n").unionByName(others))


# --- D11 / D12 ----------------------------------------------------------------
def class_distribution(df: DataFrame, column: str, top: int = CATEGORY_TOP) -> DataFrame:
    """Top ``top`` values by count plus one '__others__' row with the rest
    (when any). label, count, rank (others rank = top + 1)."""
    vc = (df.select(F.col(f"`{column}`").alias("label")).filter(F.col("label").isNotNull())
          .groupBy("label").agg(F.count(F.lit(1)).alias("count")))
    head = vc.orderBy(F.desc("count"), F.asc("label")).limit(top)
    w = Window.orderBy(F.desc("count"), F.asc("label"))  # over at most `top` rows
    ranked = head.withColumn("rank", F.row_number().over(w).cast("long")).select(
        F.col("label").cast("string").alias("label"), "count", "rank")
    total = vc.agg(F.sum("count").alias("t"))
    shown = head.agg(F.sum("count").alias("s"))
    others = (attach_row(total, shown)  # two single-row aggregates
              .select(F.lit("__others__").alias("label"), (F.col("t") - F.coalesce("s", F.lit(0))).alias("count"),
                      F.lit(top + 1).cast("long").alias("rank"))
              .filter(F.col("count") > 0))
    return ranked.unionByName(others)


def pareto(df: DataFrame, column: str, top: int = CATEGORY_TOP) -> DataFrame:
    """D11 plus cumulative percent; the denominator includes the others."""
    dist = class_distribution(df, column, top)
    head = dist.filter(F.col("label") != "__others__")
    total = dist.agg(F.sum("count").alias("t"))
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # <= top rows
    return (attach_row(head.withColumn("cum", F.sum("count").over(w)), total)
            .select("label", "count", "rank", (F.col("cum") / F.col("t") * 100).alias("cumulative_pct")))


# --- D13 ----------------------------------------------------------------------
def correlation_bar(df: DataFrame, target: str | None = None, order_by: str | None = None,
                    top: int = CORR_TOP) -> DataFrame:
    """|Pearson| of the target against every other numeric non-junk column
    (pairwise complete), all-NULL columns dropped, top 20; the default target
    is the column with the largest sample std. One aggregate for std and
    counts, one for all correlations."""
    junk = {r["name"] for r in junk_columns(df, order_by).filter("junk").collect()}
    nums = [c for c in numeric_columns(df, bool_numeric=False) if c not in junk]
    spark = df.sparkSession
    empty = spark.createDataFrame([], "target_column string, column string, value double, rank int")
    if len(nums) < 2:
        return empty
    r = df.agg(*[F.count(value_of(df, c)).alias(f"n{i}") for i, c in enumerate(nums)],
               *[F.stddev_samp(value_of(df, c).cast("double")).alias(f"s{i}") for i, c in enumerate(nums)]).first()
    stds = {c: r[f"s{i}"] for i, c in enumerate(nums) if r[f"n{i}"]}
    nums = [c for c in nums if c in stds]  # all-NULL columns dropped
    if len(nums) < 2:
        return empty
    if target is None or target not in nums:
        cands = [(sd, c) for c, sd in stds.items() if sd is not None and not math.isnan(sd)]
        target = max(cands, key=lambda t: t[0])[1] if cands else nums[0]
    others = [c for c in nums if c != target]
    y = value_of(df, target).cast("double")
    cor = df.agg(*[F.corr(value_of(df, c).cast("double"), y).alias(f"c{i}") for i, c in enumerate(others)])
    long = cor.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(f"c{i}")).alias("value"))
                                         for i, c in enumerate(others)])).alias("r")).select("r.*")
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    w = Window.orderBy(F.desc_nulls_last("value"), F.asc("column"))  # one row per column
    return (long.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)
            .select(F.lit(target).alias("target_column"), "column", "value", "rank"))


# --- D14 ----------------------------------------------------------------------
def scatter_points(df: DataFrame, order_by: Sequence[str], x: str | None = None, y: str | None = None,
                   max_points: int = SCATTER_MAX_POINTS) -> DataFrame:
    """Two numeric columns (default: the two largest sample std among those that
    aren't junk), rows with a NULL in either removed, more than ``max_points`` -> every (n // max)-th in
    row order. idx, x, y (idx = position among the kept pairs)."""
    nums = numeric_columns(df, bool_numeric=False)
    if x is None or y is None or x == y:
        junk = {r["name"] for r in junk_columns(df, order_by[0]).filter("junk").collect()}  # names of columns
        nums = [c for c in nums if c not in junk or c in (x, y)]
        r = df.agg(*[F.stddev_samp(value_of(df, c).cast("double")).alias(f"s{i}") for i, c in enumerate(nums)]).first()
        ranked = sorted([(r[f"s{i}"], c) for i, c in enumerate(nums) if r[f"s{i}"] is not None],
                        key=lambda t: -t[0])
        x = x if x in nums else ranked[0][1]
        y = y if (y in nums and y != x) else next(c for _, c in ranked if c != x)
    pts = df.select(*order_by, value_of(df, x).cast("double").alias("x"), value_of(df, y).cast("double").alias("y"))
    pts = pts.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    n = pts.count()
    stride = n // max_points if n > max_points else 1
    idx = global_index(pts, list(order_by), idx_col="idx", unique_key=True)
    if stride > 1:
        idx = idx.filter(F.col("idx") % stride == 0)
    return idx.select("idx", F.lit(x).alias("x_column"), F.lit(y).alias("y_column"), "x", "y")


# --- B9 -----------------------------------------------------------------------
def pick_columns(df: DataFrame, order_by: str | None = None, numeric_hint: str | None = None,
                 label_hint: str | None = None) -> DataFrame:
    """Numeric pick: hint if numeric and not junk, else first numeric non-junk.
    Categorical pick: hint if present and not junk, else the non-numeric
    non-junk column with the fewest (>= 2) distinct values."""
    junk = {r["name"] for r in junk_columns(df, order_by).filter("junk").collect()}
    nums = [f.name for f in df.schema.fields if is_numeric_type(f.dataType, True)]
    if numeric_hint in nums and numeric_hint not in junk:
        num_pick = numeric_hint
    else:
        num_pick = next((c for c in df.columns if c in nums and c not in junk), None)
    if label_hint in df.columns and label_hint not in junk:
        cat_pick = label_hint
    else:
        cands = [c for c in df.columns if c not in nums and c not in junk]
        cat_pick = None
        if cands:
            r = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cands)]).first()
            ok = sorted([(r[f"d{i}"], i, c) for i, c in enumerate(cands) if r[f"d{i}"] >= 2])
            cat_pick = ok[0][2] if ok else None
    return df.sparkSession.createDataFrame([(num_pick, cat_pick)], "numeric_pick string, categorical_pick string")
