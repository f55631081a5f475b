"""Column profiling: one wide aggregate per question, unpivoted to one row per
column. Nothing is collected except where a caller needs a handful of scalars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import is_number, nan_to_null, try_to_double

# --- fixed values -----------------------------------------------------------
# Column names that mark a label column for the imbalance check (upper-cased).
LABEL_HINTS = ("PASS_YN", "JUDGE", "JUDGEMENT", "RESULT", "OK_NG", "DEFECT_TYPE", "LABEL")
IMBALANCE_MINORITY_LIMIT = 0.10
MIXED_SAMPLE_ROWS = 200
# ---------------------------------------------------------------------------

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def dtype_name(dt: T.DataType) -> str:
    """Catalog dtype vocabulary: integer, float, boolean, datetime, text, array, unknown."""
    if isinstance(dt, _INTEGRAL):
        return "integer"
    if isinstance(dt, _FRACTIONAL):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, T.ArrayType):
        return "array"
    return "unknown"


def is_numeric_type(dt: T.DataType, bool_numeric: bool = True) -> bool:
    if isinstance(dt, _INTEGRAL + _FRACTIONAL):
        return True
    return bool_numeric and isinstance(dt, T.BooleanType)


def numeric_columns(df: DataFrame, bool_numeric: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType, bool_numeric)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def value_of(df: DataFrame, name: str) -> Column:
    """Column value with NaN folded into NULL for floating columns."""
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return nan_to_null(c)
    return c


def _unpivot_one_row(agg_row: DataFrame, fields: list[tuple[str, list[tuple[str, Column]]]]) -> DataFrame:
    """Turn a one-row aggregate into one row per column via explode(array(struct))."""
    structs = []
    for _, members in fields:
        structs.append(F.struct(*[expr.alias(alias) for alias, expr in members]))
    return agg_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = True) -> DataFrame:
    """Name, ordinal, dtype, n_rows, null_count, n_unique for every column,
    in one aggregate. Distinct counts are HyperLogLog sketches unless
    ``approx=False``, which shuffles every column's different values."""
    cols = list(columns) if columns is not None else df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        v = value_of(df, c)
        aggs.append(F.count(v).alias(f"nn{i}"))
        aggs.append((F.approx_count_distinct(v) if approx else F.count_distinct(v)).alias(f"nd{i}"))
    one = df.agg(*aggs)
    fields = []
    for i, c in enumerate(cols):
        fields.append((c, [
            ("name", F.lit(c)),
            ("ordinal", F.lit(i)),
            ("dtype", F.lit(dtype_name(df.schema[c].dataType))),
            ("n_rows", F.col("__n")),
            ("null_count", F.col("__n") - F.col(f"nn{i}")),
            ("n_unique", F.col(f"nd{i}").cast("long")),
        ]))
    return _unpivot_one_row(one, fields)


def mixed_dtype(df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None,
                head_rows: int | None = None) -> DataFrame:
    """For text columns, share of non-null values that parse as numbers
    (rounded 3); ``mixed`` when strictly between 0 and 1. Evaluated on every
    non-null value (the whole column) by default; with ``order_by`` and
    ``head_rows`` (the reference uses 200) only the first non-null values in
    row order count, selected by a distributed in-column rank."""
    cols = list(columns) if columns is not None else text_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "name string, numeric_ratio double, mixed boolean")
    if order_by and head_rows:
        from millrace.functions.rowindex import rank_in_group
        keys = list(order_by)
        long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v"))
                                                    for c in cols])).alias("r")).select(*keys, "r.*")
        head = rank_in_group(long.filter(F.col("v").isNotNull()), ["name"], keys, "__rk").filter(F.col("__rk") < head_rows)
        agg = head.groupBy("name").agg(F.count(F.lit(1)).alias("nn"), F.count(F.when(is_number(F.col("v")), 1)).alias("nm"))
        ratio = F.col("nm") / F.col("nn")
        found = agg.select("name", F.round(ratio, 3).alias("numeric_ratio"), ((ratio > 0) & (ratio < 1)).alias("mixed"))
        names = df.sparkSession.createDataFrame([(c,) for c in cols], "name string")
        return (names.join(found, "name", "left")
                .select("name", F.coalesce("numeric_ratio", F.lit(0.0)).alias("numeric_ratio"),
                        F.coalesce("mixed", F.lit(False)).alias("mixed")))
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        aggs.append(F.count(v).alias(f"nn{i}"))
        aggs.append(F.count(F.when(is_number(v), 1)).alias(f"nm{i}"))
    one = df.agg(*aggs)
    fields = []
    for i, c in enumerate(cols):
        ratio = F.when(F.col(f"nn{i}") > 0, F.col(f"nm{i}") / F.col(f"nn{i}")).otherwise(F.lit(0.0))
        fields.append((c, [("name", F.lit(c)), ("numeric_ratio", F.round(ratio, 3)),
                           ("mixed", (ratio > 0) & (ratio < 1))]))
    return _unpivot_one_row(one, fields)


def value_counts(df: DataFrame, column: str, count_col: str = "count") -> DataFrame:
    """Non-null value counts (hash aggregate with map-side combine)."""
    v = value_of(df, column)
    return (df.select(v.alias("value")).filter(F.col("value").isNotNull())
            .groupBy("value").agg(F.count(F.lit(1)).alias(count_col)))


def class_imbalance(df: DataFrame, columns: Sequence[str] | None = None,
                    limit: float = IMBALANCE_MINORITY_LIMIT) -> DataFrame:
    """D3: columns with exactly two non-null classes whose minority share is
    below ``limit``. Output: name, n_classes, minority_ratio (round 4),
    imbalanced. One distinct-count aggregate decides the candidates; only the
    candidates are grouped."""
    cols = list(columns) if columns is not None else df.columns
    spark = df.sparkSession
    schema = "name string, n_classes bigint, minority_ratio double, imbalanced boolean"
    if not cols:
        return spark.createDataFrame([], schema)
    # candidates from a one-pass HyperLogLog estimate (exact at such tiny
    # cardinalities; a margin of one keeps the test safe), then exact counts
    nd = df.agg(*[F.approx_count_distinct(value_of(df, c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    hinted = {c for c in cols if c.strip().upper() in LABEL_HINTS}
    cands = [c for i, c in enumerate(cols) if nd[f"d{i}"] <= 3 or c in hinted]
    if not cands:
        return spark.createDataFrame([], schema)
    # all candidates' class counts in one aggregate over the long form
    parts = [F.struct(F.lit(c).alias("name"), value_of(df, c).cast("string").alias("value")) for c in cands]
    long = df.select(F.explode(F.array(*parts)).alias("r")).select("r.*").filter(F.col("value").isNotNull())
    vc = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("count"))
    out = vc.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.round(F.min("count") / F.sum("count"), 4).alias("minority_ratio"))
    hint_list = F.array(*[F.lit(c) for c in hinted]) if hinted else F.array().cast("array<string>")
    out = out.filter((F.col("n_classes") == 2) | F.array_contains(hint_list, F.col("name")))
    return out.withColumn(
        "imbalanced", (F.col("n_classes") == 2) & (F.col("minority_ratio") < limit))


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3, approx: bool = True) -> DataFrame:
    """D5 compute_stats: count, mean, std (sample), min, max, unique per column,
    rounded; text columns get count/unique only (mean/std/min/max NULL). Distinct
    counts as in ``profile_columns``."""
    cols = list(columns) if columns is not None else df.columns
    aggs = []
    for i, c in enumerate(cols):
        v = value_of(df, c)
        num = is_numeric_type(df.schema[c].dataType)
        x = v.cast("double") if num else None
        aggs += [F.count(v).alias(f"c{i}"), (F.approx_count_distinct(v) if approx else F.count_distinct(v)).alias(f"u{i}")]
        if num:
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    one = df.agg(*aggs)
    fields = []
    null_d = F.lit(None).cast("double")
    for i, c in enumerate(cols):
        num = is_numeric_type(df.schema[c].dataType)
        fields.append((c, [
            ("name", F.lit(c)),
            ("count", F.col(f"c{i}")),
            ("mean", F.round(F.col(f"m{i}"), digits) if num else null_d),
            ("std", F.round(nan_to_null(F.col(f"s{i}")), digits) if num else null_d),
            ("min", F.round(F.col(f"lo{i}"), digits) if num else null_d),
            ("max", F.round(F.col(f"hi{i}"), digits) if num else null_d),
            ("unique", F.col(f"u{i}").cast("long")),
        ]))
    return _unpivot_one_row(one, fields)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Top-k values per column by count (ties: value ascending), in one pass:
    all columns' values are counted together (partial sums before the shuffle),
    a column's counts are cut to k in each of many buckets of values, and the
    rest, at most k per column and bucket, are ranked."""
    if not columns:
        return df.sparkSession.createDataFrame([], "name string, value string, count bigint, rank int")
    from pyspark.sql import Window
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), value_of(df, c).cast("string").alias("value")) for c in columns]))
    counts = (df.select(cells.alias("r")).select("r.*").filter(F.col("value").isNotNull()).groupBy("name", "value").agg(F.count(F.lit(1)).alias("count")))
    best = [F.desc("count"), F.asc("value")]
    dealt = counts.withColumn("__b", F.pmod(F.xxhash64("value"), F.lit(256)))
    few = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("name", "__b").orderBy(*best))).filter(F.col("__r") <= k)
    return (few.drop("__b", "__r").withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(*best))).filter(F.col("rank") <= k)
            .select("name", "value", "count", "rank"))


def eda_profile(df: DataFrame, approx: bool = True) -> DataFrame:
    """D1 plus numeric min/max/mean/std (sample) with NaN/Inf as NULL and
    the top-5 values of non-numeric columns as 'value:count' text."""
    prof = profile_columns(df, approx=approx)
    nums = [f.name for f in df.schema.fields if is_numeric_type(f.dataType, bool_numeric=True)]
    aggs = []
    for i, c in enumerate(nums):
        x = value_of(df, c).cast("double")
        x = F.when(F.abs(x) != F.lit(float("inf")), x)
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}")]
    if nums:
        one = df.agg(*aggs)
        stats = _unpivot_one_row(one, [(c, [
            ("name", F.lit(c)), ("is_numeric", F.lit(True)),
            ("range_min", F.col(f"lo{i}")), ("range_max", F.col(f"hi{i}")),
            ("mean", F.col(f"m{i}")), ("std", nan_to_null(F.col(f"s{i}")))]) for i, c in enumerate(nums)])
    else:
        stats = df.sparkSession.createDataFrame(
            [], "name string, is_numeric boolean, range_min double, range_max double, mean double, std double")
    others = [c for c in df.columns if c not in nums]
    tops = top_values(df, others, 5)
    top_txt = (tops.groupBy("name")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
                                             lambda s: F.concat(s["value"], F.lit(":"), s["count"].cast("string"))),
                                 "|").alias("top_values")))
    return (prof.join(stats, "name", "left").join(top_txt, "name", "left")
            .withColumn("is_numeric", F.coalesce(F.col("is_numeric"), F.lit(False))))


# --- junk columns and picks --------------------------------------------------
# --- fixed values -----------------------------------------------------------
INDEX_NAME_PATTERN = r"^(unnamed.*|index|idx|no\.?|seq(no)?|순번|행번호|번호|row(num)?)$"
TIME_NAME_PATTERN = r"^(_?time|timestamp|datetime|_?start|_?stop|date|reg_?date|dttm|일시|시각|날짜)$"
# ---------------------------------------------------------------------------


def junk_columns(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Columns excluded from feature/target choice (never deleted).

    name rules: index-like names, datetime types, anchored time names.
    value rule (needs a row order ``order_by``): numeric, >= 3 non-null values,
    strictly increasing in row order. The increasing test is distributed: rows
    are range-partitioned on the order key, each partition checks its own
    neighbours and reports its first/last value; only those boundary rows (two
    per partition) are compared across partitions.
    Output: name, reason ('index_name' | 'time' | 'monotonic' | NULL), junk.
    """
    import re
    spark = df.sparkSession
    idx_re = re.compile(INDEX_NAME_PATTERN, re.IGNORECASE)
    time_re = re.compile(TIME_NAME_PATTERN, re.IGNORECASE)
    rows, value_cands = [], []
    for f in df.schema.fields:
        name = f.name.strip()
        if name.lower().startswith("unnamed") or idx_re.match(name):
            rows.append((f.name, "index_name"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) or time_re.match(name):
            rows.append((f.name, "time"))
        elif is_numeric_type(f.dataType, bool_numeric=True) and order_by is not None and f.name != order_by:
            value_cands.append(f.name)
            rows.append((f.name, None))
        else:
            rows.append((f.name, None))
    mono = set()
    if value_cands:
        mono = set(strictly_increasing(df, value_cands, order_by))
    if order_by is not None and order_by in df.columns:
        # the order key itself is strictly increasing by construction when unique
        if is_numeric_type(df.schema[order_by].dataType, True) and dict(rows).get(order_by) is None:
            if order_by in set(strictly_increasing(df, [order_by], order_by)):
                mono.add(order_by)
    out = [(n, r if r is not None else ("monotonic" if n in mono else None)) for n, r in rows]
    return spark.createDataFrame(out, "name string, reason string").withColumn("junk", F.col("reason").isNotNull())


def strictly_increasing(df: DataFrame, columns: Sequence[str], order_by: str) -> list[str]:
    """Names of columns whose non-null values are strictly increasing in
    ``order_by`` order and that have at least 3 non-null values.

    One range shuffle on the order key; each partition checks its neighbours
    (window partitioned by the range partition id), and only first/last values
    per partition (columns x partitions rows) are compared across partitions.
    """
    from pyspark.sql import Window
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cols = list(columns)
    xs = {c: f"x{i}" for i, c in enumerate(cols)}
    base = df.select(F.col(f"`{order_by}`").alias("__o"),
                     *[value_of(df, c).cast("double").alias(xs[c]) for c in cols])
    part = base.repartitionByRange(n, "__o").withColumn("__p", F.spark_partition_id())
    w = (Window.partitionBy("__p").orderBy("__o")
         .rowsBetween(Window.unboundedPreceding, -1))
    for c in cols:
        part = part.withColumn("prev_" + xs[c], F.last(xs[c], ignorenulls=True).over(w))
    aggs = []
    for c in cols:
        x = xs[c]
        aggs += [F.count(x).alias("n_" + x),
                 F.sum(F.when(F.col(x) <= F.col("prev_" + x), 1).otherwise(0)).alias("bad_" + x),
                 F.min_by(x, F.when(F.col(x).isNotNull(), F.col("__o"))).alias("first_" + x),
                 F.max_by(x, F.when(F.col(x).isNotNull(), F.col("__o"))).alias("last_" + x)]
    per_part = [r.asDict() for r in part.groupBy("__p").agg(*aggs).collect()]  # one row per partition
    per_part.sort(key=lambda r: r["__p"])
    out = []
    for c in cols:
        x = xs[c]
        total = sum(r["n_" + x] for r in per_part)
        ok = all(r["bad_" + x] == 0 for r in per_part)
        prev_last = None
        for r in per_part:
            if r["n_" + x] == 0:
                continue
            if prev_last is not None and r["first_" + x] <= prev_last:
                ok = False
            prev_last = r["last_" + x]
        if total >= 3 and ok:
            out.append(c)
    return out


def profile_pass(df: DataFrame, label_limit: float = IMBALANCE_MINORITY_LIMIT):
    """D1 + D2 + D3 with two data passes: one aggregate gives every column's
    non-null count, a HyperLogLog distinct estimate and (text columns) the
    numeric share; a second grouped count runs only for the (at most
    3-valued or label-named) imbalance candidates. Returns three small local
    frames: the profile (one row per column, carrying the mixed and
    imbalance flags), the mixed rows and the imbalance rows."""
    spark = df.sparkSession
    cols = df.columns
    texts = set(text_columns(df))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        v = value_of(df, c)
        aggs += [F.count(v).alias(f"nn{i}"), F.approx_count_distinct(v).alias(f"nd{i}")]
        if c in texts:
            aggs.append(F.count(F.when(is_number(v), 1)).alias(f"nm{i}"))
    r = df.agg(*aggs).first()  # one row of scalars
    n = r["__n"]
    prof_rows, mixed_rows = [], []
    for i, c in enumerate(cols):
        prof_rows.append((c, i, dtype_name(df.schema[c].dataType), n, n - r[f"nn{i}"], int(r[f"nd{i}"])))
        if c in texts:
            nn, nm = r[f"nn{i}"], r[f"nm{i}"]
            ratio = nm / nn if nn else 0.0
            mixed_rows.append((c, round(ratio, 3), 0 < ratio < 1))
    mixed = spark.createDataFrame(mixed_rows, "name string, numeric_ratio double, mixed boolean")
    mixed_of = {m[0]: m[2] for m in mixed_rows}
    hinted = [c for c in cols if c.strip().upper() in LABEL_HINTS]
    cands = [c for i, c in enumerate(cols) if r[f"nd{i}"] <= 3 or c in hinted]
    schema = "name string, n_classes bigint, minority_ratio double, imbalanced boolean"
    prof_schema = ("name string, ordinal int, dtype string, n_rows bigint, null_count bigint, n_unique bigint, "
                   "mixed boolean, n_classes bigint, minority_ratio double, imbalanced boolean")

    def combined(imb_rows):
        by = {r[0]: r for r in imb_rows}
        rows = [p + (mixed_of.get(p[0], False),) + (tuple(by[p[0]][1:]) if p[0] in by else (None, None, False))
                for p in prof_rows]
        return spark.createDataFrame(rows, prof_schema)

    if not cands:
        return combined([]), mixed, spark.createDataFrame([], schema)
    parts = [F.struct(F.lit(c).alias("name"), value_of(df, c).cast("string").alias("value")) for c in cands]
    long = df.select(F.explode(F.array(*parts)).alias("r")).select("r.*").filter(F.col("value").isNotNull())
    vc = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("count"))
    out = vc.groupBy("name").agg(F.count(F.lit(1)).alias("n_classes"),
                                 F.round(F.min("count") / F.sum("count"), 4).alias("minority_ratio"))
    hint_list = F.array(*[F.lit(c) for c in hinted]) if hinted else F.array().cast("array<string>")
    out = out.filter((F.col("n_classes") == 2) | F.array_contains(hint_list, F.col("name")))
    out = out.withColumn("imbalanced", (F.col("n_classes") == 2) & (F.col("minority_ratio") < label_limit))
    imb_rows = [tuple(r) for r in out.select("name", "n_classes", "minority_ratio", "imbalanced").collect()]  # candidates only
    return combined(imb_rows), mixed, spark.createDataFrame(imb_rows, schema)
