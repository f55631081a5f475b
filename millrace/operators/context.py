"""Profile flags and run context roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import percent_in_text

FLAG_SCHEMA = "flag string, column string, detail string"


def profile_flags(profile: DataFrame, mixed: DataFrame | None = None, imbalance: DataFrame | None = None,
                  modality: str = "timeseries", encoding: str | None = None, headerless: bool = False,
                  sheets: Sequence[str] | None = None) -> DataFrame:
    """Deterministic flags from the profile: non-utf8 encoding, headerless,
    mixed dtype, class imbalance (minority %), missing values (event-log
    only), multi-sheet merge. One row per flag: flag, column, detail."""
    spark = profile.sparkSession
    null_s = F.lit(None).cast("string")
    parts = []
    fixed = []
    if encoding in ("cp949", "euc-kr", "MS949"):
        fixed.append(("non_utf8", None, encoding))
    if headerless:
        fixed.append(("headerless", None, None))
    if sheets and len(sheets) > 1:
        fixed.append(("multi_sheet_merged", None, ",".join(sheets)))
    if fixed:
        parts.append(spark.createDataFrame(fixed, FLAG_SCHEMA))
    if mixed is not None:
        parts.append(mixed.filter("mixed").select(F.lit("mixed_dtype").alias("flag"), F.col("name").alias("column"),
                                                  null_s.alias("detail")))
    if imbalance is not None:
        parts.append(imbalance.filter("imbalanced").select(
            F.lit("class_imbalance").alias("flag"), F.col("name").alias("column"),
            F.format_string("%.2f", F.col("minority_ratio") * 100).alias("detail")))
    if modality == "event-log":
        parts.append(profile.filter(F.col("null_count") > 0).select(
            F.lit("missing_values").alias("flag"), F.col("name").alias("column"),
            F.col("null_count").cast("string").alias("detail")))
    if not parts:
        return spark.createDataFrame([], FLAG_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- grouped profiling: many modules in one pass ---------------------------------
def grouped_profile(df: DataFrame, group_cols: Sequence[str], columns: Sequence[str],
                    text_columns: Sequence[str] = ()) -> DataFrame:
    """Per group and column: n_rows, null_count, and for text columns the
    numeric share / mixed flag; one grouped aggregate for every module."""
    from millrace.functions.scalars import is_number
    g = list(group_cols)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(columns):
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"nn{i}"))
        if c in text_columns:
            aggs.append(F.count(F.when(is_number(F.col(f"`{c}`")), 1)).alias(f"nm{i}"))
    one = df.groupBy(*g).agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        if c in text_columns:
            ratio = F.when(F.col(f"nn{i}") > 0, F.col(f"nm{i}") / F.col(f"nn{i}")).otherwise(F.lit(0.0))
            mixed = (ratio > 0) & (ratio < 1)
        else:
            mixed = F.lit(False)
        rows.append(F.struct(F.lit(c).alias("name"), F.col("__n").alias("n_rows"),
                             (F.col("__n") - F.col(f"nn{i}")).alias("null_count"), mixed.alias("mixed")))
    return one.select(*g, F.explode(F.array(*rows)).alias("r")).select(*g, "r.*")


def grouped_minority(df: DataFrame, group_cols: Sequence[str], label: str) -> DataFrame:
    """Per group: number of non-null classes and minority share (round 4)."""
    g = list(group_cols)
    vc = df.filter(F.col(label).isNotNull()).groupBy(*g, label).agg(F.count(F.lit(1)).alias("n"))
    return vc.groupBy(*g).agg(F.count(F.lit(1)).alias("n_classes"),
                              F.round(F.min("n") / F.sum("n"), 4).alias("minority_ratio"))


# --- D21 / D22 ----------------------------------------------------------------------
# --- fixed values -----------------------------------------------------------
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1, "info": 0}
IMPLICATION_TEMPLATES = {
    "class_imbalance": "Use class weights or resampling for classification (training data may be biased).",
    "missing_values": "Missing values were filled; review the imputation effect in analysis.",
    "dtype_mixed": "Mixed dtype was cleaned (masking / numeric parse); re-check numeric assumptions.",
    "transformation_applied": "Transformations were recorded (backup and lineage exist; rollback possible).",
    "constraint_violation": "User constraint violations remain; clean further or relax constraints before modelling.",
    "validation_concern": "Validation warnings exist; interpret results with care.",
    "sequence_normalized": "Sequence/profile group normalisation applied (trend/shape kept); inspect per group in EDA.",
}
NO_FINDING_IMPLICATION = "Nothing notable."
MISSING_HIGH = 1000
MISSING_MEDIUM = 100
IMBALANCE_HIGH_PCT = 5.0
# ---------------------------------------------------------------------------

FINDING_COLS = ["stage_order", "module_index", "module_function", "type", "column", "severity", "detail"]


def key_findings(flags: DataFrame, steps: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings from profile flags (flag, column, detail), done steps
    (operation, target_column, status, before_nulls, semantic_group) and
    validation issues (kind, severity, target), each keyed by stage_order,
    module_index, module_function."""
    k = ["stage_order", "module_index", "module_function"]
    pct = F.coalesce(percent_in_text("detail"), F.col("detail").try_cast("double"))
    f = flags.filter(F.col("flag").isin("mixed_dtype", "class_imbalance")).select(
        *k, F.when(F.col("flag") == "mixed_dtype", "dtype_mixed").otherwise("class_imbalance").alias("type"),
        F.lit(None).cast("string").alias("column"),
        F.when(F.col("flag") == "mixed_dtype", "medium")
        .when(pct.isNotNull() & (pct < IMBALANCE_HIGH_PCT), "high").otherwise("medium").alias("severity"),
        F.concat_ws(":", "flag", "column", "detail").alias("detail"))
    done = steps.filter(F.col("status") == "done")
    nb = F.col("before_nulls")
    s = done.filter(F.col("operation") != "compute_stats").select(
        *k,
        F.when(F.col("operation") == "fill_missing", "missing_values")
        .when(F.col("operation") == "balance_classes", "class_imbalance")
        .when(F.col("operation") == "normalize_group", "sequence_normalized")
        .otherwise("transformation_applied").alias("type"),
        F.col("target_column").alias("column"),
        F.when(F.col("operation") == "fill_missing",
               F.when(nb > MISSING_HIGH, "high").when(nb > MISSING_MEDIUM, "medium").otherwise("low"))
        .when(F.col("operation") == "balance_classes", "high").otherwise("low").alias("severity"),
        F.concat_ws(":", "operation", F.coalesce("target_column", "semantic_group"),
                    nb.cast("string")).alias("detail"))
    s = s.filter(F.col("type").isNotNull())
    i = issues.select(
        *k, F.when(F.col("kind") == "constraint", "constraint_violation").otherwise("validation_concern").alias("type"),
        F.lit(None).cast("string").alias("column"),
        F.when(F.col("kind") == "constraint", "medium").otherwise("low").alias("severity"),
        F.concat_ws(":", "kind", "target").alias("detail"))
    return f.unionByName(s).unionByName(i)


def stage_chain(findings: DataFrame, stages: DataFrame) -> DataFrame:
    """D22 per stage: ``main_findings``, the labels 'type(severity): column' in the
    order of modules, then types and columns, and the implication text: distinct finding
    types in severity order, joined from the template table. stages: stage_order,
    node_id."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    tmpl = F.create_map(*[F.lit(x) for kv in IMPLICATION_TEMPLATES.items() for x in kv])
    fnd = findings.withColumn("label", F.concat(F.col("type"), F.lit("("), F.col("severity"), F.lit(")"),
                                                F.when(F.col("column").isNotNull(), F.concat(F.lit(": "), F.col("column")))
                                                .otherwise(F.lit(""))))
    placed = F.array_sort(F.collect_list(F.struct("module_index", "type", F.coalesce("column", F.lit("")).alias("column"), "label")))  # one stage's findings
    main = fnd.groupBy("stage_order").agg(F.transform(placed, lambda x: x["label"]).alias("main_findings"))
    types = (fnd.groupBy("stage_order", "type").agg(F.max(F.coalesce(rank[F.col("severity")], F.lit(0))).alias("r"))
             .groupBy("stage_order")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("nr"), F.col("type")))),
                                           lambda x: tmpl[x["type"]]), " ").alias("implication")))
    return (stages.join(main, "stage_order", "left").join(types, "stage_order", "left")
            .select("stage_order", "node_id", F.coalesce("main_findings", F.array().cast("array<string>")).alias("main_findings"),
                    F.coalesce(F.when(F.col("implication") != "", F.col("implication")), F.lit(NO_FINDING_IMPLICATION))
                    .alias("downstream_implication")))


def agent_records(modules: DataFrame, flags: DataFrame, steps: DataFrame, issues: DataFrame) -> DataFrame:
    """One flattened record per module with data: its flags and steps as
    delimited text, its issues by severity, and ``passed``: no issue of high severity and
    no failed step. All inputs carry stage_order and module_index."""
    k = ["stage_order", "module_index"]

    def listed(rows: DataFrame, name: str, *parts: str) -> DataFrame:
        return rows.groupBy(*k).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", *parts))), "|").alias(name))  # one module's

    levels = [F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s}") for s in ("high", "medium", "low")]
    failed = steps.groupBy(*k).agg(F.count(F.when(F.col("status") == "failed", 1)).alias("n_failed"))
    out = modules.filter(F.col("datalake_id").isNotNull()).select(*k, "module_function", "datalake_id", "modality")
    for side in (listed(flags, "flags", "flag", "column"), listed(steps, "steps", "operation", "target_column"), issues.groupBy(*k).agg(*levels), failed):
        out = out.join(side, k, "left")
    out = out.fillna(0, ["n_high", "n_medium", "n_low", "n_failed"])
    return out.withColumn("passed", (F.col("n_high") == 0) & (F.col("n_failed") == 0))


def function_axis(findings: DataFrame) -> DataFrame:
    """Findings per function axis and severity."""
    return findings.groupBy("module_function", "severity").agg(F.count(F.lit(1)).alias("n"))


def module_counts(modules: DataFrame) -> DataFrame:
    """Modules, with data, with constraints. modules: datalake_id, n_constraints."""
    return modules.agg(F.count(F.lit(1)).alias("modules_total"),
                       F.count("datalake_id").alias("modules_with_data"),
                       F.count(F.when(F.col("n_constraints") > 0, 1)).alias("modules_with_constraints"))


def missing_module_alarm(modules: DataFrame) -> DataFrame:
    """One alarm per stage listing its modules without a dataset."""
    miss = modules.filter(F.col("datalake_id").isNull())
    return miss.groupBy("stage_order").agg(
        F.array_join(F.array_sort(F.collect_list(F.col("module_index").cast("string"))), ",").alias("missing_modules"),
        F.count(F.lit(1)).alias("n_missing"))


def pick_target(modules: DataFrame) -> DataFrame:
    """First module with data that is not an image set, in (stage, index) order."""
    return (modules.filter(F.col("datalake_id").isNotNull() & (F.col("modality") != "inspection-image"))
            .orderBy("stage_order", "module_index").limit(1).select("stage_order", "module_index", "datalake_id", "modality"))


def vid_propagation(modules: DataFrame) -> DataFrame:
    """The flow id (vid) reaches every module and stage: an absent client
    vid takes the line's id, a different one is flagged as a mismatch."""
    return modules.select("stage_order", "module_index", "line_id", "client_vid",
                          F.coalesce("client_vid", "line_id").alias("vid"),
                          (F.col("client_vid").isNotNull() & F.col("line_id").isNotNull()
                           & (F.col("client_vid") != F.col("line_id"))).alias("mismatch"))


# --- fixed values -----------------------------------------------------------
PURPOSE_FUNCTION = {
    "anomaly_detection": "maintenance",
    "quality_classification": "quality",
    "process_optimization": "process",
    "predictive_maintenance": "maintenance",
    "demand_forecasting": "reference",
    "statistical_comparison": "reference",
}
NODE_MODALITY = {
    "semiconductor_inspect": "inspection-image",
    "surface_inspect": "inspection-image",
    "welding_inspect": "inspection-image",
    "order_planning": "order",
}
DEFAULT_MODALITY = "timeseries"
# ---------------------------------------------------------------------------


def axis_lookup(df: DataFrame, purpose_col: str | None = None, node_col: str | None = None,
                modality_col: str | None = None) -> DataFrame:
    """Purpose -> function axis, and module modality = explicit, else node
    map, else timeseries (literal maps, no join)."""
    out = df
    if purpose_col:
        m = F.create_map(*[F.lit(x) for kv in PURPOSE_FUNCTION.items() for x in kv])
        out = out.withColumn("function_axis", m[F.col(purpose_col)])
    if node_col:
        m = F.create_map(*[F.lit(x) for kv in NODE_MODALITY.items() for x in kv])
        explicit = F.col(modality_col) if modality_col else F.lit(None).cast("string")
        out = out.withColumn("modality", F.coalesce(explicit, m[F.col(node_col)], F.lit(DEFAULT_MODALITY)))
    return out
