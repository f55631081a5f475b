"""Post-run checks as DataFrames: compliance / transform / integrity checks
over step results, constraint violations on the untouched input, output
health on the processed output, row loss, and the report roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import try_to_double
from millrace.operators.profile import is_numeric_type, value_of

ISSUE_COLS = ["kind", "severity", "step_order", "target", "detail"]
ISSUE_SCHEMA = "kind string, severity string, step_order int, target string, detail string"

# --- fixed values -----------------------------------------------------------
ROW_LOSS_LIMIT = 0.5          # > 50 % rows lost = high
NORM_MEAN_TOL = 0.1           # pooled |mean| above this = medium
NORM_STD_TOL = 0.1            # pooled |std - 1| above this = medium
# ---------------------------------------------------------------------------


def _issues(df: DataFrame, kind: str, severity: Column | str, order: Column, target: Column, detail: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(kind).alias("kind"), sev.alias("severity"), order.cast("int").alias("step_order"),
                     target.cast("string").alias("target"), detail.cast("string").alias("detail"))


def empty_issues(spark) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def constraint_violations(source: DataFrame, constraints: DataFrame, removed_columns: Sequence[str] = ()) -> DataFrame:
    """Per constraint (key, lo, hi): matching column (case-insensitive),
    n_violations below lo / above hi among numeric values, n_total numeric.
    One aggregate over ``source`` (the untouched input). Missing column -> low
    issue; all-null column silent; violations medium, or low + removed when
    outlier removal ran on the column.
    Output: key, column, n_violations, n_total, severity, removed."""
    spark = source.sparkSession
    cons = constraints.select("key", "lo", "hi").collect()  # one row per user constraint
    lower = {}
    for c in source.columns:
        lower.setdefault(c.lower(), c)
    aggs, meta = [], []
    for i, r in enumerate(cons):
        if r["lo"] is None and r["hi"] is None:
            continue
        actual = lower.get(str(r["key"]).lower())
        meta.append((i, r, actual))
        if actual is None:
            continue
        x = try_to_double(F.col(f"`{actual}`"))
        viol = F.lit(False)
        if r["lo"] is not None:
            viol = viol | (x < F.lit(r["lo"]))
        if r["hi"] is not None:
            viol = viol | (x > F.lit(r["hi"]))
        aggs += [F.count(F.when(viol, 1)).alias(f"v{i}"), F.count(x).alias(f"t{i}")]
    removed = set(removed_columns)
    one = source.agg(*aggs) if aggs else None
    structs = []
    for i, r, actual in meta:
        if actual is None:
            structs.append(F.struct(F.lit(r["key"]).alias("key"), F.lit(None).cast("string").alias("column"),
                                    F.lit(0).cast("long").alias("n_violations"), F.lit(0).cast("long").alias("n_total"),
                                    F.lit("low").alias("severity"), F.lit(False).alias("removed")))
        else:
            rem = actual in removed
            sev = F.when(F.col(f"v{i}") > 0, F.lit("low" if rem else "medium"))
            structs.append(F.struct(F.lit(r["key"]).alias("key"), F.lit(actual).alias("column"),
                                    F.col(f"v{i}").alias("n_violations"), F.col(f"t{i}").alias("n_total"),
                                    sev.alias("severity"), F.lit(rem).alias("removed")))
    schema = "key string, column string, n_violations bigint, n_total bigint, severity string, removed boolean"
    if not structs:
        return spark.createDataFrame([], schema)
    base = one if one is not None else spark.range(1)
    return (base.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
            .filter(F.col("severity").isNotNull()))


def output_health_aggs(out: DataFrame, touched: Sequence[str] = (), groups: Sequence[tuple[str, Sequence[str]]] = (),
                       cond: Column | None = None):
    """Aggregate expressions for D16 and a function turning the collected row
    into issue tuples; ``cond`` restricts the rows (e.g. rows still alive)."""
    import math
    nums = [f.name for f in out.schema.fields if is_numeric_type(f.dataType, bool_numeric=False)
            and not f.name.startswith("__")]
    touched = [c for c in dict.fromkeys(touched) if c in nums]
    keep = (lambda e: F.when(cond, e)) if cond is not None else (lambda e: e)
    aggs = []
    for i, c in enumerate(nums):
        x = keep(F.col(f"`{c}`").cast("double"))
        aggs.append(F.max(F.when(F.abs(x) == F.lit(float("inf")), 1).otherwise(0)).alias(f"h_inf{i}"))
    for i, c in enumerate(touched):
        x = keep(value_of(out, c).cast("double"))
        aggs += [F.count(x).alias(f"h_tn{i}"), F.stddev_pop(x).alias(f"h_ts{i}")]
    gstats = []
    for gi, (gname, members) in enumerate(groups):
        mem = [m for m in members if m in nums]
        if not mem:
            continue
        for mi, m in enumerate(mem):
            x = keep(value_of(out, m).cast("double"))
            aggs += [F.count(x).alias(f"h_g{gi}n{mi}"), F.avg(x).alias(f"h_g{gi}m{mi}"), F.var_pop(x).alias(f"h_g{gi}v{mi}")]
        gstats.append((gi, gname, mem))

    def interpret(r) -> list[tuple]:
        rows = []
        for i, c in enumerate(nums):
            if r[f"h_inf{i}"]:
                rows.append(("output_health", "high", None, c, "inf"))
        for i, c in enumerate(touched):
            if (r[f"h_tn{i}"] or 0) > 1 and r[f"h_ts{i}"] == 0.0:
                rows.append(("output_health", "high", None, c, "zero_std"))
        for gi, gname, mem in gstats:
            parts = [(r[f"h_g{gi}n{mi}"], r[f"h_g{gi}m{mi}"], r[f"h_g{gi}v{mi}"]) for mi in range(len(mem)) if r[f"h_g{gi}n{mi}"]]
            n = sum(p[0] for p in parts)
            if n <= 1:
                continue
            mu = sum(p[0] * p[1] for p in parts) / n
            sd = math.sqrt(sum(p[0] * p[2] + p[0] * (p[1] - mu) ** 2 for p in parts) / n)
            if abs(mu) > NORM_MEAN_TOL or abs(sd - 1.0) > NORM_STD_TOL:
                rows.append(("output_health", "medium", None, gname, f"group_mean={mu:.4f},group_std={sd:.4f}"))
        return rows

    return aggs, interpret


def output_health(out: DataFrame, touched: Sequence[str] = (), groups: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """D16 in one aggregate: +-Inf in a numeric column (high); touched column
    with > 1 value and population std 0 (high); normalised group whose pooled
    |mean| > 0.1 or |std - 1| > 0.1 (medium). Output: issue rows."""
    spark = out.sparkSession
    aggs, interpret = output_health_aggs(out, touched, groups)
    if not aggs:
        return empty_issues(spark)
    return spark.createDataFrame(interpret(out.agg(*aggs).first()), ISSUE_SCHEMA)


def row_loss(n_before: Column, n_after: Column) -> Column:
    """Loss share; > 0.5 = high."""
    return F.when(n_before > 0, (n_before - n_after) / n_before)


def step_checks(results: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """D18 over step results (and the plan when given).

    results: order, operation, target_column, status, lineage_id,
    before_nulls, after_nulls, normalized, has_stats, semantic_group.
    """
    done = results.filter(F.col("status") == "done")
    comp = _issues(done.filter(F.col("lineage_id").isNull()), "compliance", "high", F.col("order"),
                   F.col("operation"), F.lit("missing lineage"))
    fill = _issues(done.filter((F.col("operation") == "fill_missing") & F.col("before_nulls").isNotNull()
                               & F.col("after_nulls").isNotNull() & (F.col("after_nulls") >= F.col("before_nulls"))),
                   "transform", "high", F.col("order"), F.col("target_column"), F.lit("nulls not reduced"))
    mask = _issues(done.filter((F.col("operation") == "clean_masking") & ~F.coalesce(F.col("has_stats"), F.lit(False))),
                   "transform", "medium", F.col("order"), F.col("target_column"), F.lit("no stats"))
    norm = _issues(done.filter((F.col("operation") == "normalize_group") & (F.coalesce(F.col("normalized"), F.lit(0)) == 0)),
                   "transform", "medium", F.col("order"), F.col("semantic_group"), F.lit("0 columns normalised"))
    steps = plan if plan is not None else results
    keyed = steps.select(
        "operation",
        F.when(F.col("target_column").isNull() & F.col("semantic_group").isNotNull(),
               F.concat(F.lit("group:"), F.col("semantic_group"))).otherwise(F.col("target_column")).alias("tgt"))
    dup = (keyed.filter(F.col("operation").isNotNull())
           .groupBy("operation", "tgt").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
    integ = _issues(dup, "integrity", "medium", F.lit(None), F.concat_ws(":", "operation", F.coalesce("tgt", F.lit("global"))),
                    F.col("n").cast("string"))
    members = (steps.filter(F.col("operation") == "normalize_group")
               .select(F.explode_outer("group_members").alias("m")).filter(F.col("m").isNotNull()).distinct())
    both = (steps.filter(F.col("operation").isin("clean_masking", "fill_missing"))
            .join(members, steps["target_column"] == members["m"], "left_semi"))
    overlap = _issues(both, "integrity", "low", F.col("order"), F.col("target_column"), F.lit("also in group normalisation"))
    return comp.unionByName(fill).unionByName(mask).unionByName(norm).unionByName(integ).unionByName(overlap)


def report(issues: DataFrame, results: DataFrame) -> DataFrame:
    """One row: counts by status and severity, six checks, next_action.
    Step results and issues are stacked and rolled up in one aggregate."""
    null_s = F.lit(None).cast("string")
    stacked = (results.select(F.col("status"), null_s.alias("severity"), null_s.alias("kind"))
               .unionByName(issues.select(null_s.alias("status"), "severity", "kind")))
    both = stacked.agg(
        F.count(F.when(F.col("status") == "done", 1)).alias("n_done"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("n_failed"),
        F.count(F.when(F.col("status") == "awaiting_approval", 1)).alias("n_pending"),
        F.count(F.when(F.col("severity") == "high", 1)).alias("n_high"),
        F.count(F.when(F.col("severity") == "medium", 1)).alias("n_medium"),
        F.count(F.when(F.col("severity") == "low", 1)).alias("n_low"),
        *[(F.count(F.when(F.col("kind") == k, 1)) == 0).alias(f"check_{k}")
          for k in ("compliance", "transform", "integrity", "regression", "constraint", "output_health")])
    return both.select(
        "*",
        ((F.col("n_high") == 0) & (F.col("n_failed") == 0)).alias("passed"),
        F.when((F.col("n_failed") > 0) | (F.col("n_high") > 0), "retry_or_human")
        .when(F.col("n_pending") > 0, "await_approval")
        .when(F.col("n_medium") > 0, "review_recommended")
        .otherwise("ready_for_ml").alias("next_action"))
