"""Catalog relations as DataFrames: entries, columns metadata, constraints
and their append-only history, lineage. Every mutation returns new
DataFrames (write them to a new versioned folder; never overwrite a path
that is being read)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.rowsets import compare
from millrace.functions.scalars import try_to_double

# --- fixed values -----------------------------------------------------------
MODALITIES = ("timeseries", "inspection-image", "event-log", "order")
FUNCTION_AXES = ("process", "quality", "maintenance", "reference")
ENTRY_FIELDS = ("datalake_id", "source", "name", "modality", "function", "site", "vid", "size_bytes",
                "encoding", "format", "data_path", "reusable_flag", "company", "registered_at")
NAMES_A_TASK = 250_000  # compared by one task
# ---------------------------------------------------------------------------

ENTRY_SCHEMA = ("datalake_id string, source string, name string, modality string, function string, site string, "
                "vid string, size_bytes bigint, encoding string, format string, data_path string, "
                "reusable_flag boolean, company string, registered_at timestamp")
COLUMNS_SCHEMA = ("datalake_id string, name string, dtype string, column_kind string, group_desc string, "
                  "ordinal int, stat_min double, stat_max double")
CONSTRAINT_SCHEMA = "datalake_id string, column_name string, constraint_spec string, approved_at timestamp, approved_by string"
HISTORY_SCHEMA = ("history_id string, datalake_id string, column_name string, constraint_spec string, approved_by string, "
                  "approved_at timestamp, action string")


def lookup(entries: DataFrame, datalake_id: str) -> DataFrame:
    """Id -> path, modality."""
    return entries.filter(F.col("datalake_id") == datalake_id).select("datalake_id", "data_path", "modality")


def datasets_by_modality(entries: DataFrame) -> DataFrame:
    """Distinct (modality, id), ordered."""
    return entries.select("modality", "datalake_id").distinct().orderBy("modality", "datalake_id")


def list_entries(entries: DataFrame, **filters) -> DataFrame:
    """AND-filter on any of modality, function, site, source, vid, company; newest first."""
    out = entries
    for k in ("modality", "function", "site", "source", "vid", "company"):
        v = filters.get(k)
        if v is not None:
            out = out.filter(F.col(k) == v)
    return out.orderBy(F.desc("registered_at"), F.asc("datalake_id"))


def upsert_full(old: DataFrame, new: DataFrame) -> DataFrame:
    """L1: full-record upsert by datalake_id: a new record replaces every
    field (unspecified -> NULL) except registered_at, where the first
    registration time is kept."""
    o = old.select("datalake_id", F.col("registered_at").alias("__old_ts"))
    fields = [c for c in ENTRY_FIELDS if c not in ("datalake_id", "registered_at")]
    replaced = (new.join(o, "datalake_id", "left")
                .select("datalake_id", *fields, F.coalesce("__old_ts", "registered_at").alias("registered_at")))
    kept = old.join(new.select("datalake_id"), "datalake_id", "left_anti")
    return kept.select(*ENTRY_FIELDS).unionByName(replaced.select(*ENTRY_FIELDS))


def replace_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """L2: full replace of the column metadata of every datalake_id present in
    ``new`` (ordinals as given, 0-based source order)."""
    kept = old.join(new.select("datalake_id").distinct(), "datalake_id", "left_anti")
    return kept.unionByName(new.select(*kept.columns))


def column_ordinals(headers: DataFrame) -> DataFrame:
    """(datalake_id, header array) -> one row per column with its 0-based ordinal."""
    return headers.select("datalake_id", F.posexplode("header").alias("ordinal", "name")).select(
        "datalake_id", "name", F.col("ordinal").cast("int").alias("ordinal"))


def ordinal_integrity(columns_meta: DataFrame) -> DataFrame:
    """Per datalake_id: NULL ordinals and duplicated ordinals; ok flag."""
    dup = (columns_meta.filter(F.col("ordinal").isNotNull()).groupBy("datalake_id", "ordinal").count()
           .filter(F.col("count") > 1).groupBy("datalake_id").agg(F.count(F.lit(1)).alias("dup_ordinals")))
    nulls = columns_meta.groupBy("datalake_id").agg(
        F.count(F.when(F.col("ordinal").isNull(), 1)).alias("null_ordinals"), F.count(F.lit(1)).alias("n_columns"))
    return (nulls.join(dup, "datalake_id", "left")
            .withColumn("dup_ordinals", F.coalesce("dup_ordinals", F.lit(0)).cast("long"))
            .withColumn("ok", (F.col("null_ordinals") == 0) & (F.col("dup_ordinals") == 0)))


def schema_drift(source_names: DataFrame, catalog_names: DataFrame) -> DataFrame:
    """Names in the source but not in the catalog (missing_in_catalog) and
    the reverse (missing_in_source), per datalake_id; a dataset absent on one
    side drifts as a whole. Inputs: datalake_id, name."""
    keys = ["datalake_id", "name"]
    both = (source_names.select(*keys, F.lit(True).alias("s"), F.lit(False).alias("c"))
            .unionByName(catalog_names.select(*keys, F.lit(False).alias("s"), F.lit(True).alias("c"))))
    spread = max(both.sparkSession.sparkContext.defaultParallelism, -(-both.count() // NAMES_A_TASK))
    found = both.repartition(spread, *keys).groupBy(*keys).agg(F.max("s").alias("s"), F.max("c").alias("c"))
    unknown = F.col("datalake_id").isNull() | F.col("name").isNull()  # equals no other name
    drifts = F.array(F.when(F.col("s") & (~F.col("c") | unknown), F.lit("missing_in_catalog")),
                     F.when(F.col("c") & (~F.col("s") | unknown), F.lit("missing_in_source")))
    return found.select(*keys, F.explode(F.array_compact(drifts)).alias("drift"))


def stat_minmax(df: DataFrame, datalake_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Observed min/max of every column read as numbers (non-numeric ->
    NULL), one aggregate; all-NULL columns reported with all_null = true."""
    cols = list(columns) if columns is not None else df.columns
    aggs = []
    for i, c in enumerate(cols):
        x = try_to_double(F.col(f"`{c}`"))
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(datalake_id).alias("datalake_id"), F.lit(c).alias("name"),
                     F.col(f"lo{i}").alias("stat_min"), F.col(f"hi{i}").alias("stat_max"))
            for i, c in enumerate(cols)]
    return (one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .withColumn("all_null", F.col("stat_min").isNull()))


def stat_minmax_of_files(spark: SparkSession, path: str, datalake_id: str) -> DataFrame:
    """D15 for Parquet files: the numeric columns' min/max come from the files'
    footers (aggregate push-down), without reading a data page; only text columns
    are scanned. Files without statistics are scanned for all."""
    from millrace.operators.profile import is_numeric_type
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    footers = session.read.parquet(path)
    numbers = [f.name for f in footers.schema.fields if is_numeric_type(f.dataType, bool_numeric=False) and f.dataType.typeName() != "decimal"]
    rows = []
    if numbers:
        one = footers.agg(*[g(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(numbers) for k, g in (("lo", F.min), ("hi", F.max))])
        try:
            got = one.first()
        except Exception as e:  # noqa: BLE001 - Spark names no class for it
            if "min/max found" not in str(e) and "AGGREGATE_PUSHDOWN" not in str(e).upper():
                raise
            numbers = []
        else:
            rows = [(datalake_id, c, *[None if got[f"{k}{i}"] is None else float(got[f"{k}{i}"]) for k in ("lo", "hi")]) for i, c in enumerate(numbers)]
    told = spark.createDataFrame(rows, "datalake_id string, name string, stat_min double, stat_max double").withColumn("all_null", F.col("stat_min").isNull())
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in numbers]
    return told.unionByName(stat_minmax(df, datalake_id, rest)) if rest else told


class ColumnMismatch(ValueError):
    """Observed columns and the catalog's columns of a dataset differ."""


def apply_minmax(columns_meta: DataFrame, stats: DataFrame) -> DataFrame:
    """The observed min/max put into the column metadata of the datasets
    that ``stats`` has. Names that only one side has are an error."""
    keys = ["datalake_id", "name"]
    own = columns_meta.join(stats.select("datalake_id").distinct(), "datalake_id", "left_semi")
    odd = schema_drift(stats.select(*keys), own.select(*keys)).orderBy(*keys).limit(20).collect()  # named in the error
    if odd:
        raise ColumnMismatch("; ".join(f"{r['datalake_id']}.{r['name']}: {r['drift']}" for r in odd))
    s = stats.select(*keys, F.col("stat_min").alias("__lo"), F.col("stat_max").alias("__hi"))
    return (columns_meta.join(s, keys, "left").withColumn("stat_min", F.coalesce("__lo", "stat_min"))
            .withColumn("stat_max", F.coalesce("__hi", "stat_max")).drop("__lo", "__hi"))


def _history_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256)


def constraint_upsert(current: DataFrame, history: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L3: upsert constraints keyed by (datalake_id, column_name) and append one
    history row per change: 'create' when the key is new, 'update' otherwise.
    new: datalake_id, column_name, constraint_spec, approved_at, approved_by."""
    keys = ["datalake_id", "column_name"]
    exists = current.select(*keys).withColumn("__had", F.lit(True))
    tagged = new.join(exists, keys, "left").withColumn(
        "action", F.when(F.col("__had"), "update").otherwise("create")).drop("__had")
    hist = tagged.select(
        _history_id(F.col("datalake_id"), F.col("column_name"), F.col("approved_at"), F.col("action")).alias("history_id"),
        "datalake_id", "column_name", "constraint_spec", "approved_by", "approved_at", "action")
    cur = current.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*current.columns))
    return cur, history.unionByName(hist)


def constraint_delete(current: DataFrame, history: DataFrame, keys_df: DataFrame, remover: str,
                      at: Column) -> tuple[DataFrame, DataFrame]:
    """L4: delete constraints; history keeps the *old* spec with the remover;
    absent keys delete nothing and log nothing. Also returns via history
    which keys existed."""
    keys = ["datalake_id", "column_name"]
    gone = current.join(keys_df.select(*keys), keys, "left_semi")
    hist = gone.select(
        _history_id(F.col("datalake_id"), F.col("column_name"), at, F.lit("delete")).alias("history_id"),
        "datalake_id", "column_name", "constraint_spec", F.lit(remover).alias("approved_by"),
        at.alias("approved_at"), F.lit("delete").alias("action"))
    return current.join(keys_df.select(*keys), keys, "left_anti"), history.unionByName(hist)


def entry_delete_cascade(entries: DataFrame, columns_meta: DataFrame, current: DataFrame, history: DataFrame,
                         ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Delete entries and their children; each removed constraint is logged
    as 'delete' with its previous approver; history survives."""
    gone = current.join(ids.select("datalake_id"), "datalake_id", "left_semi")
    hist = gone.select(
        _history_id(F.col("datalake_id"), F.col("column_name"), at, F.lit("delete")).alias("history_id"),
        "datalake_id", "column_name", "constraint_spec", "approved_by", at.alias("approved_at"),
        F.lit("delete").alias("action"))
    keep = lambda d: d.join(ids.select("datalake_id"), "datalake_id", "left_anti")
    return keep(entries), keep(columns_meta), keep(current), history.unionByName(hist)


def snapshot_compare(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """Per table: row counts of both snapshots and rows only in a / only
    in b (duplicates respected), from one count of row fingerprints a table."""
    sides = ("n_a", "n_b", "only_a", "only_b")
    parts = []
    for name, rows in a.items():
        found = compare(rows, b[name].select(*[F.col(f"`{c}`") for c in rows.columns]))
        shown = F.array(*[F.struct(F.lit(s.removeprefix("n_")).alias("side"), F.col(s).alias("n")) for s in sides])
        parts.append(found.select(F.lit(name).alias("table"), F.explode(shown).alias("s")).select("table", "s.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lineage_chain(lineage: DataFrame, dataset_id: str) -> DataFrame:
    """Lineage of a dataset in application order: by version, where
    rows have one, then time, then step."""
    own = lineage.filter(F.col("dataset_id") == dataset_id)
    return own.orderBy(*[c for c in ("version", "applied_at", "step_order") if c in lineage.columns])


def list_constraints(current: DataFrame, datalake_id: str | None = None) -> DataFrame:
    """Constraints in force, of one entry or of all, by entry and column."""
    own = current if datalake_id is None else current.filter(F.col("datalake_id") == datalake_id)
    return own.orderBy("datalake_id", "column_name")


def constraint_history(history: DataFrame, datalake_id: str | None = None, column_name: str | None = None) -> DataFrame:
    """History of one constraint, one entry's or all, with ``version`` = 1 for
    a constraint's oldest change."""
    own = history
    for name, wanted in (("datalake_id", datalake_id), ("column_name", column_name)):
        own = own if wanted is None else own.filter(F.col(name) == wanted)
    age = Window.partitionBy("datalake_id", "column_name").orderBy("approved_at", "history_id")  # one constraint's changes
    return own.withColumn("version", F.row_number().over(age))


def upsert_column(columns_meta: DataFrame, new: DataFrame) -> DataFrame:
    """L2: replace or add single columns by (datalake_id, name); others stay."""
    keys = ["datalake_id", "name"]
    return columns_meta.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*columns_meta.columns))


def dump_snapshot(tables: dict[str, DataFrame], keys: dict[str, list[str]], root: str) -> None:
    """Every table below ``root``, its rows ordered by its keys, so that
    two dumps of the same rows have them in the same order."""
    for name, rows in tables.items():
        rows.orderBy(*keys[name]).write.parquet(f"{root.rstrip('/')}/{name}")


def restore_snapshot(spark, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The dumped tables, parents before children as in ``names``."""
    return {name: spark.read.parquet(f"{root.rstrip('/')}/{name}") for name in names}


def verify_snapshot(live: dict[str, DataFrame], dumped: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table live and dumped, and rows that differ: ``table,
    n_live, n_dump, n_differ``. Equal rows are counted, not paired."""
    parts = None
    for name, rows in live.items():
        both = (rows.select(F.xxhash64(*rows.columns).alias("h"), F.lit(1).alias("l"), F.lit(0).alias("d"))
                .unionByName(dumped[name].select(F.xxhash64(*rows.columns).alias("h"), F.lit(0).alias("l"), F.lit(1).alias("d"))))
        one = both.groupBy("h").agg(F.sum("l").alias("l"), F.sum("d").alias("d")).agg(
            F.coalesce(F.sum("l"), F.lit(0)).alias("n_live"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_dump"),
            F.coalesce(F.sum(F.abs(F.col("l") - F.col("d"))), F.lit(0)).alias("n_differ")).select(F.lit(name).alias("table"), "n_live", "n_dump", "n_differ")
        parts = one if parts is None else parts.unionByName(one)
    return parts
