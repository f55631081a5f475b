"""Catalog-level registration, model and reference checks.
Runs over stages of modules are in ``stage_runs``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import slug
from millrace.plans.commits import CommitConflict, CommitLog


# --- fixed values -----------------------------------------------------------
# Recommended models per process node (model, task); heavy deep models are advisory only.
NODE_MODELS = {
    "injection_molding": [("RandomForestRegressor", "regression"), ("IsolationForest", "anomaly"),
                          ("XGBoostClassifier", "classification")],
    "cnc_cutting": [("RandomForestClassifier", "classification"), ("IsolationForest", "anomaly")],
    "press_forming": [("RandomForestRegressor", "regression"), ("RandomForestClassifier", "classification")],
    "semiconductor_inspect": [("CNNClassifier", "classification"), ("RandomForestClassifier", "classification")],
    "pdm": [("IsolationForest", "anomaly"), ("RandomForestRegressor", "regression")],
}
ADVISORY_MODELS = ("CNNClassifier", "EfficientNet", "ResNet", "ViT", "BERT")
# ---------------------------------------------------------------------------


#: The dataset of the log that holds the catalog itself.
CATALOG = "catalog"


def register_dataset(log: CommitLog, name: str, path: str, modality: str, function_hint: str | None = None, site: str | None = None,
                     vid: str | None = None, company: str | None = None, reader: Callable[[str], DataFrame] | None = None) -> dict:
    """Register the rows under ``path`` as a dataset of the log.

    The id is a slug of ``name``; modality and function must be known; an id that
    the catalog has, or whose rows an earlier registration left without an entry, is
    refused. The rows (read by ``read_csv_safe`` unless a reader is given) are
    committed as the dataset's table ``source``; then its full entry and its
    columns in source order are upserted in one commit of the catalog, anew where
    another registration came first. Returns status, datalake_id, reason, n_columns and the
    catalog's version."""
    from millrace.operators.catalog import COLUMNS_SCHEMA, FUNCTION_AXES, MODALITIES, replace_columns, upsert_full
    from millrace.sources.files import read_csv_safe
    spark = log.spark
    did = spark.range(1).select(slug(F.lit(name))).first()[0]

    def refused(reason: str) -> dict:
        return {"status": "refused", "datalake_id": did, "reason": reason, "n_columns": None, "version": log.latest(CATALOG)}

    if not did or did == CATALOG:
        return refused("empty id" if not did else "id is taken by the catalog")
    if modality not in MODALITIES:
        return refused(f"modality not allowed: {modality}")
    if function_hint is not None and function_hint not in FUNCTION_AXES:
        return refused(f"function not allowed: {function_hint}")
    entries = log.read(CATALOG, "entries")
    if entries is not None and entries.filter(F.col("datalake_id") == did).limit(1).count():
        return refused("id already registered")
    if log.latest(did):
        return refused("orphan folder exists")
    done = log.commit(did, "register", {"source": (reader or (lambda p: read_csv_safe(spark, p)))(path)}, after=0)
    fields = log.read(did, "source", done.version).schema.fields
    columns = spark.createDataFrame([(did, f.name, f.dataType.simpleString(), "scalar", None, i, None, None) for i, f in enumerate(fields)], COLUMNS_SCHEMA)  # one row a column
    entry = spark.createDataFrame([(did, name, modality, function_hint, site, vid, company, f"{log.root}/data/{done.commit}/source")],
                                  "datalake_id string, name string, modality string, function string, site string, vid string, company string, data_path string")
    entry = entry.withColumns({"source": F.lit("user_registered"), "size_bytes": F.lit(None).cast("long"), "encoding": F.lit("utf-8"), "format": F.lit("parquet"),
                               "reusable_flag": F.lit(False), "registered_at": F.current_timestamp()})
    while True:
        version = log.latest(CATALOG)
        old, known = log.read(CATALOG, "entries", version), log.read(CATALOG, "columns", version)
        tables = {"entries": upsert_full(entry.limit(0) if old is None else old, entry),
                  "columns": replace_columns(columns.limit(0) if known is None else known, columns)}
        try:
            log.commit(CATALOG, f"register {did}", tables, after=version)
        except CommitConflict:
            continue
        return {"status": "registered", "datalake_id": did, "reason": None, "n_columns": len(fields), "version": version + 1}


def model_pool(stages: DataFrame) -> DataFrame:
    """Recommended models of every stage's node, de-duplicated by
    (model, node), advisory flag for heavy models; fallback = runnable ones.
    stages: stage_order, node_id."""
    spark = stages.sparkSession
    cat = spark.createDataFrame([(node, name, task) for node, ms in NODE_MODELS.items() for name, task in ms],
                                "node_id string, name string, task string")
    pool = (stages.select("node_id").distinct().join(F.broadcast(cat), "node_id")  # fixed catalog: tiny
            .dropDuplicates(["name", "node_id"])
            .withColumn("advisory_only", F.col("name").isin(*ADVISORY_MODELS)))
    return pool.withColumn("fallback_ok", ~F.col("advisory_only"))


def referential_check(hinted: DataFrame, known: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Hinted ids not in known ∪ excluded (left anti joins). Inputs: one column ``id``."""
    pool = known.select("id")
    if excluded is not None:
        pool = pool.unionByName(excluded.select("id"))
    return hinted.select("id").distinct().join(pool.distinct(), "id", "left_anti")


def set_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids only in a / only in b."""
    x, y = a.select("id").distinct(), b.select("id").distinct()
    return (x.join(y, "id", "left_anti").withColumn("side", F.lit("only_left"))
            .unionByName(y.join(x, "id", "left_anti").withColumn("side", F.lit("only_right"))))


def lineage_session(lineage: DataFrame, modules: DataFrame, steps: DataFrame) -> DataFrame:
    """Lineage rows of the session's module datasets, with the removed
    row count of outlier steps, whether the step was approved, and the place of
    the row in the order of application (time, then step)."""
    ds = modules.select(F.col("datalake_id").alias("dataset_id")).filter(F.col("dataset_id").isNotNull()).distinct()
    keys = ["step_order"] + (["dataset_id"] if "dataset_id" in steps.columns else [])
    if len(keys) == 1 and lineage.select("dataset_id").distinct().limit(2).count() > 1:
        raise ValueError("steps of several datasets need a dataset_id")
    removed = steps.select(F.col("order").alias("step_order"), *keys[1:], (F.col("rows_before") - F.col("rows_after")).alias("removed_rows"))
    return (lineage.join(ds, "dataset_id", "left_semi").join(removed, keys, "left")
            .withColumn("approved", F.col("user_approval_id").isNotNull())
            .withColumn("place", F.row_number().over(Window.partitionBy("dataset_id").orderBy("applied_at", "step_order")).cast("long"))  # one dataset's steps
            .select("dataset_id", "place", "step_order", "transformation_type", "source_column", "removed_rows", "approved"))
