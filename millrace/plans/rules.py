"""Rule tables and rule-derived plans: semantic column groups, suggested
steps, permissions, approval gate, plan pre-check, capability filter and
chart-request filter. Plans are small DataFrames (one row per step)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Ordered rules (first match wins) over lower-cased, trimmed column names:
# (regex searched in the name, semantic group, normalisation strategy).
SEMANTIC_RULES = [
    (r"^lot[\s_.]*(no|id)?[\s_.]*$", "metadata", "passthrough"),
    (r"^(timestamp|time|date|datetime|일시|시각)$", "metadata", "passthrough"),
    (r"^(eqp[\s_]?id|equip|설비|장비|machine[\s_]?id)$", "metadata", "passthrough"),
    (r"^(tagid|tag[\s_]?id|id|uid|index|seq[\s_]?no)$", "metadata", "passthrough"),
    (r"^(operator|작업자|inspector|검사자)$", "metadata", "passthrough"),
    (r"^(pass[\s_]?yn|판정|판정결과|result|judge|judgement|ok[\s_]?ng|label|quality)$", "label", "label"),
    (r"injection\s*switch", "injection_switch_sequence", "sequence_preserve"),
    (r"injection\s*velocity", "injection_sequence", "sequence_preserve"),
    (r"injection\s*pressure", "injection_pressure_sequence", "sequence_preserve"),
    (r"\d+(st|nd|rd|th)\s*injection", "injection_sequence", "sequence_preserve"),
    (r"pack\s*pressure\s*\d+", "pack_pressure_profile", "profile_group"),
    (r"pack\s*time\s*\d+", "pack_time_profile", "profile_group"),
    (r"hold\s*pressure\s*\d+", "hold_pressure_profile", "profile_group"),
    (r"back\s*pressure", "back_pressure", "single_zscore"),
    (r"(servo|cnc).*load", "servo_load", "single_zscore"),
    (r"(servo|cnc).*current", "servo_current", "single_zscore"),
    (r"temp|temperature|온도", "temperature", "single_zscore"),
    (r"press(ure)?|압력|press_force", "pressure", "single_zscore"),
    (r"value|값|측정값|measure", "measurement", "single_zscore"),
    (r"cycle|사이클|cycletime", "cycle", "single_zscore"),
]
UNKNOWN_GROUP = ("unknown", "single_zscore")

# Operation -> permission level; unknown operations are L3.
OPERATION_PERMISSION = {
    "detect_encoding": "L1",
    "reparse_header": "L1",
    "compute_stats": "L1",
    "clean_masking": "L2",
    "fill_missing": "L2",
    "remove_outlier": "L2",
    "create_feature": "L2",
    "balance_classes": "L2",
    "normalize_group": "L2",
    "drop_column": "L3",
    "relabel": "L3",
    "merge_external": "L3",
}

# Step-order ranks for the plan pre-check (smaller must come first; compute_stats exempt; unknown 4).
ORDER_RANK = {
    "detect_encoding": 0, "reparse_header": 0,
    "clean_masking": 1,
    "fill_missing": 2, "remove_outlier": 2,
    "normalize_group": 3, "balance_classes": 3, "create_feature": 3,
    "drop_column": 5, "relabel": 5, "merge_external": 5,
    "compute_stats": 9,
}
UNKNOWN_RANK = 4

# Operations each modality's executor really applies (capability table).
IMPLEMENTED_OPS = {
    "timeseries": ("clean_masking", "fill_missing", "balance_classes", "compute_stats",
                   "normalize_group", "remove_outlier"),
    "order": ("clean_masking", "fill_missing", "balance_classes", "compute_stats",
              "normalize_group", "remove_outlier"),
    "event-log": ("balance_classes", "fill_missing", "compute_stats", "remove_outlier"),
}
# ---------------------------------------------------------------------------

PLAN_SCHEMA = T.StructType([
    T.StructField("order", T.IntegerType()),
    T.StructField("operation", T.StringType()),
    T.StructField("target_column", T.StringType()),
    T.StructField("permission_level", T.StringType()),
    T.StructField("semantic_group", T.StringType()),
    T.StructField("group_members", T.ArrayType(T.StringType())),
    T.StructField("strategy", T.StringType()),
    T.StructField("step_key", T.StringType()),
])


def permission_expr(op: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in OPERATION_PERMISSION.items() for x in kv])
    return F.coalesce(m[op], F.lit("L3"))


def step_key_expr(op: Column, group: Column, target: Column) -> Column:
    """J12: 'operation:target' with target = group, else column, else 'global'."""
    return F.concat_ws(":", op, F.coalesce(group, target, F.lit("global")))


def classify_expr(name: Column) -> tuple[Column, Column]:
    """(semantic_group, strategy) of a column name as one CASE chain."""
    n = F.lower(F.trim(name))
    g, s = F.lit(UNKNOWN_GROUP[0]), F.lit(UNKNOWN_GROUP[1])
    for pat, grp, strat in reversed(SEMANTIC_RULES):
        hit = n.rlike(pat)
        g = F.when(hit, F.lit(grp)).otherwise(g)
        s = F.when(hit, F.lit(strat)).otherwise(s)
    return g, s


def names_frame(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ordinal int")


def classify_columns(names_df: DataFrame) -> DataFrame:
    """J10 per column: name, ordinal, semantic_group, strategy, group_size, is_grouped."""
    g, s = classify_expr(F.col("name"))
    cls = names_df.withColumn("semantic_group", g).withColumn("strategy", s)
    sizes = cls.groupBy("semantic_group").agg(F.count(F.lit(1)).alias("group_size"))
    return (cls.join(sizes, "semantic_group")
            .withColumn("is_grouped", (F.col("group_size") > 1) & ~F.col("semantic_group").isin("unknown", "metadata")))


def classify_names(names: Sequence[str]) -> list[tuple[str, int, str, str]]:
    """J10 on a schema's column names (metadata, not data): (name, ordinal,
    group, strategy) with the same first-match rule table as classify_expr."""
    import re
    compiled = [(re.compile(p), g, s) for p, g, s in SEMANTIC_RULES]
    out = []
    for i, n in enumerate(names):
        key = n.strip().lower()
        hit = next(((g, s) for rx, g, s in compiled if rx.search(key)), UNKNOWN_GROUP)
        out.append((n, i, hit[0], hit[1]))
    return out


def semantic_groups_local(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """semantic_groups for a schema, built on the driver (column names only)."""
    groups: dict[tuple[str, str], list] = {}
    for n, i, g, s in classify_names(names):
        groups.setdefault((g, s), []).append((i, n))
    rows = [(g, s, [n for _, n in sorted(m)], len(m), min(i for i, _ in m)) for (g, s), m in groups.items()]
    return spark.createDataFrame(rows, "semantic_group string, strategy string, members array<string>, count bigint, "
                                       "first_ordinal int")


def semantic_groups(names_df: DataFrame) -> DataFrame:
    """J10 per group: semantic_group, strategy, members (source order), count, first_ordinal."""
    cls = classify_columns(names_df)
    return (cls.groupBy("semantic_group", "strategy")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("members"),
                 F.count(F.lit(1)).alias("count"),
                 F.min("ordinal").alias("first_ordinal")))


def resolve_constraints(spark: SparkSession, constraints: Mapping[str, object] | None,
                        names: Sequence[str]) -> DataFrame:
    """Constraint keys resolved once against a schema's column names: exact
    match first, else case-insensitive (first column in source order).
    Output: key, pos, lo, hi, actual (NULL when no column matches)."""
    from millrace.operators.transforms import bounds_of
    lower: dict[str, str] = {}
    for n in names:
        lower.setdefault(n.lower(), n)
    rows = []
    for i, (k, spec) in enumerate((constraints or {}).items()):
        lo, hi = bounds_of(spec)
        actual = k if k in names else lower.get(str(k).lower())
        rows.append((str(k), i, lo, hi, actual))
    return spark.createDataFrame(rows, "key string, pos int, lo double, hi double, actual string")


def constraints_frame(spark: SparkSession, constraints: Mapping[str, object] | None) -> DataFrame:
    """{column: [lo, hi] | {min, max}} -> (key, pos, lo, hi)."""
    from millrace.operators.transforms import bounds_of
    rows = []
    for i, (k, spec) in enumerate((constraints or {}).items()):
        lo, hi = bounds_of(spec)
        rows.append((str(k), i, lo, hi))
    return spark.createDataFrame(rows, "key string, pos int, lo double, hi double")


def suggest_steps(profile: DataFrame, mixed: DataFrame | None = None, imbalance: DataFrame | None = None,
                  groups: DataFrame | None = None, constraints: DataFrame | None = None,
                  flags: Iterable[str] = (), fill_after_mask: bool = False) -> DataFrame:
    """Rule-suggested steps in rule order, numbered 1..n.

    profile: name, ordinal, null_count; mixed: name, mixed; imbalance: name,
    imbalanced; groups: semantic_group, strategy, members, first_ordinal;
    constraints: key, pos, lo, hi.
    """
    spark = profile.sparkSession
    flags = list(flags)
    null_s = F.lit(None).cast("string")
    null_a = F.lit(None).cast("array<string>")

    def frame(df: DataFrame, stage: int, minor: Column, op: str, target: Column,
              group: Column = null_s, members: Column = null_a, strategy: Column = null_s) -> DataFrame:
        return df.select(F.lit(stage).alias("stage"), minor.cast("long").alias("minor"),
                         F.lit(op).alias("operation"), target.alias("target_column"),
                         group.alias("semantic_group"), members.alias("group_members"),
                         strategy.alias("strategy"))

    one = spark.range(1)
    parts = []
    if any("non-utf8" in f or "encoding" in f for f in flags):
        parts.append(frame(one, 0, F.lit(0), "detect_encoding", null_s))
    if any("headerless" in f for f in flags):
        parts.append(frame(one, 1, F.lit(0), "reparse_header", null_s))
    if "mixed" in profile.columns:  # profile already carries the flags (no join)
        prof = profile.select("name", "ordinal", "null_count", "mixed")
    elif mixed is not None:
        prof = profile.select("name", "ordinal", "null_count").join(mixed.select("name", "mixed"), "name", "left")
    else:
        prof = profile.select("name", "ordinal", "null_count").withColumn("mixed", F.lit(False))
    prof = prof.withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    parts.append(frame(prof.filter("mixed"), 2, F.col("ordinal"), "clean_masking", F.col("name")))
    fill_cond = F.col("null_count") > 0
    if not fill_after_mask:
        fill_cond = fill_cond & ~F.col("mixed")
    else:
        fill_cond = (F.col("null_count") > 0) | F.col("mixed")
    parts.append(frame(prof.filter(fill_cond), 3, F.col("ordinal"), "fill_missing", F.col("name")))
    if "imbalanced" in profile.columns:
        imb = profile.filter(F.coalesce(F.col("imbalanced"), F.lit(False)))
        parts.append(frame(imb, 4, F.col("ordinal"), "balance_classes", F.col("name")))
    elif imbalance is not None:
        imb = imbalance.filter("imbalanced").join(profile.select("name", "ordinal"), "name")
        parts.append(frame(imb, 4, F.col("ordinal"), "balance_classes", F.col("name")))
    if groups is not None:
        eligible = groups.filter(~F.col("strategy").isin("passthrough", "label")
                                 & ~F.col("semantic_group").isin("unknown", "metadata", "label")
                                 & (F.size("members") > 0))
        parts.append(frame(eligible, 5, F.col("first_ordinal"), "normalize_group", null_s,
                           F.col("semantic_group"), F.col("members"), F.col("strategy")))
    if constraints is not None and "actual" in constraints.columns:  # names resolved already
        matched = (constraints.filter(F.col("actual").isNotNull())
                   .groupBy("actual").agg(F.min("pos").alias("pos")))
        parts.append(frame(matched, 6, F.col("pos"), "remove_outlier", F.col("actual")))
    elif constraints is not None:
        names = profile.select("name")
        exact = constraints.join(names, constraints["key"] == names["name"], "left").select(
            "key", "pos", F.col("name").alias("exact"))
        lowered = (profile.select(F.lower("name").alias("lname"), "name", "ordinal")
                   .groupBy("lname").agg(F.min_by("name", "ordinal").alias("ci")))
        matched = (exact.join(lowered, F.lower(exact["key"]) == lowered["lname"], "left")
                   .select("pos", F.coalesce("exact", "ci").alias("actual"))
                   .filter(F.col("actual").isNotNull())
                   .groupBy("actual").agg(F.min("pos").alias("pos")))
        parts.append(frame(matched, 6, F.col("pos"), "remove_outlier", F.col("actual")))
    parts.append(frame(one, 7, F.lit(0), "compute_stats", null_s))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    # the plan has one row per step (bounded by the column count)
    w = Window.orderBy("stage", "minor")
    return (allp.withColumn("order", F.row_number().over(w).cast("int"))
            .withColumn("permission_level", permission_expr(F.col("operation")))
            .withColumn("step_key", step_key_expr(F.col("operation"), F.col("semantic_group"), F.col("target_column")))
            .select(*[f.name for f in PLAN_SCHEMA.fields]))


def plan_from_rows(spark: SparkSession, steps: Sequence[Mapping]) -> DataFrame:
    """Plan DataFrame from literal step dicts (permission and key derived)."""
    rows = []
    for i, s in enumerate(steps, start=1):
        rows.append((int(s.get("order", i)), s["operation"], s.get("target_column"), None,
                     s.get("semantic_group"), list(s.get("group_members") or []) or None,
                     s.get("strategy"), None))
    df = spark.createDataFrame(rows, PLAN_SCHEMA)
    return (df.withColumn("permission_level", permission_expr(F.col("operation")))
            .withColumn("step_key", step_key_expr(F.col("operation"), F.col("semantic_group"), F.col("target_column"))))


def approval_gate(plan: DataFrame, approved: DataFrame) -> DataFrame:
    """L1 always runs; L2/L3 run only when their step_key is approved."""
    appr = approved.select(F.col("step_key").alias("__k")).distinct().withColumn("__ok", F.lit(True))
    return (plan.join(appr, plan["step_key"] == appr["__k"], "left")
            .withColumn("gate", F.when((F.col("permission_level") == "L1") | F.col("__ok").isNotNull(), "run")
                        .otherwise("awaiting_approval"))
            .drop("__k", "__ok"))


def plan_precheck(plan: DataFrame) -> DataFrame:
    """Order violations (medium), drop_column conflicts (high), L3 notices (low).
    Output: order, kind, severity, operation, target_column, rank, prev_max_rank."""
    rank_map = F.create_map(*[F.lit(x) for kv in ORDER_RANK.items() for x in kv])
    p = plan.withColumn("rank", F.coalesce(rank_map[F.col("operation")], F.lit(UNKNOWN_RANK)))
    # running max over earlier non-stats steps; the plan is tiny (one row per step)
    w = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("prev_max_rank",
                     F.coalesce(F.max(F.when(F.col("operation") != "compute_stats", F.col("rank"))).over(w), F.lit(-1)))
    order_issues = (p.filter((F.col("operation") != "compute_stats") & (F.col("rank") < F.col("prev_max_rank")))
                    .select("order", F.lit("plan_order").alias("kind"), F.lit("medium").alias("severity"),
                            "operation", "target_column", "rank", "prev_max_rank"))
    dropped = plan.filter((F.col("operation") == "drop_column") & F.col("target_column").isNotNull()) \
        .select(F.col("target_column").alias("__t")).distinct()
    conflicts = (plan.filter(F.col("operation") != "drop_column")
                 .join(dropped, plan["target_column"] == dropped["__t"], "left_semi")
                 .select("order", F.lit("plan_conflict").alias("kind"), F.lit("high").alias("severity"),
                         "operation", "target_column", F.lit(None).cast("int").alias("rank"),
                         F.lit(None).cast("int").alias("prev_max_rank")))
    l3 = (plan.filter(F.col("permission_level") == "L3")
          .select("order", F.lit("plan_l3_notice").alias("kind"), F.lit("low").alias("severity"),
                  "operation", "target_column", F.lit(None).cast("int").alias("rank"),
                  F.lit(None).cast("int").alias("prev_max_rank")))
    return order_issues.unionByName(conflicts).unionByName(l3)


def capability_table(spark: SparkSession) -> DataFrame:
    rows = [(m, op) for m, ops in IMPLEMENTED_OPS.items() for op in ops]
    return spark.createDataFrame(rows, "modality string, operation string")


def plan_filter(plan: DataFrame, modality: str) -> DataFrame:
    """Keep steps implemented for the modality (semi join with the capability table)."""
    if modality not in IMPLEMENTED_OPS:
        return plan
    cap = capability_table(plan.sparkSession).filter(F.col("modality") == modality).select("operation")
    return plan.join(F.broadcast(cap), "operation", "left_semi")


def plan_permissions(plan: DataFrame, perm_table: DataFrame | None = None) -> DataFrame:
    """C4: attach permission levels by joining the operation->permission table;
    unknown -> L3. A caller's table is broadcast only where Spark finds it small."""
    spark = plan.sparkSession
    if perm_table is None:
        perm_table = spark.createDataFrame(list(OPERATION_PERMISSION.items()), "operation string, level string")
    return (plan.drop("permission_level").join(perm_table, "operation", "left")
            .withColumn("permission_level", F.coalesce(F.col("level"), F.lit("L3"))).drop("level"))


# --- fixed values -----------------------------------------------------------
# Chart types and the modalities each one is meaningful for.
CHART_MODALITIES = {
    "fft_spectrum": ("timeseries",),
    "boxplot_by_label": ("timeseries", "order", "event-log"),
    "histogram": ("timeseries", "order"),
    "class_distribution": ("event-log", "order"),
    "correlation_bar": ("timeseries", "order"),
    "scatter": ("timeseries", "order"),
    "pareto": ("event-log", "order"),
    "rms_trend": ("timeseries",),
}
# Default charts per function axis: primary, then secondary.
FUNCTION_CHART_GUIDE = {
    "maintenance": (("fft_spectrum",), ("rms_trend", "boxplot_by_label")),
    "quality": (("boxplot_by_label", "class_distribution"), ("histogram", "correlation_bar")),
    "process": (("boxplot_by_label",), ("correlation_bar", "scatter", "histogram")),
    "reference": (("pareto",), ("histogram", "class_distribution")),
}
FALLBACK_CHARTS = 2
# ---------------------------------------------------------------------------


def chart_table(spark: SparkSession) -> DataFrame:
    rows = [(ct, m) for ct, mods in CHART_MODALITIES.items() for m in mods]
    return spark.createDataFrame(rows, "chart_type string, modality string")


def chart_filter(requests: DataFrame, session_cols: Sequence[str] = ("session",), pos_col: str = "pos") -> DataFrame:
    """Keep requests whose chart type is known and allowed for the
    request's modality, first occurrence per (session, chart type).
    ``requests`` has session columns, pos, chart_type, modality. First
    occurrence is a min(pos) aggregate (no window over a possibly hot session)."""
    allowed = chart_table(requests.sparkSession)
    ok = requests.join(F.broadcast(allowed), ["chart_type", "modality"], "left_semi")  # fixed 16-row table
    keys = list(session_cols) + ["chart_type"]
    first = ok.groupBy(*keys).agg(F.min(pos_col).alias(pos_col))
    return ok.join(first, keys + [pos_col], "left_semi")


def fallback_charts(spark: SparkSession, function_axis: str, modality: str) -> DataFrame:
    """Up to two guide charts (primary then secondary) allowed for the modality."""
    prim, sec = FUNCTION_CHART_GUIDE.get(function_axis, ((), ()))
    out = [ct for ct in list(prim) + list(sec) if modality in CHART_MODALITIES.get(ct, ())][:FALLBACK_CHARTS]
    return spark.createDataFrame([(i + 1, ct, True) for i, ct in enumerate(out)],
                                 "rank int, chart_type string, fallback boolean")


def order_by_ranking(steps: DataFrame, ranking: DataFrame, position: str = "position") -> DataFrame:
    """Steps of every dataset in the order of an external ranking
    (``operation, rank``); operations it lacks come last, equal ranks keep their
    order. ``steps``: ``dataset_id, operation`` and a position. Adds ``order``."""
    turn = Window.partitionBy("dataset_id").orderBy(F.col("rank").asc_nulls_last(), position)  # one plan's steps
    return steps.join(ranking.select("operation", "rank"), "operation", "left").withColumn("order", F.row_number().over(turn))
