"""Constraint specs: canonical validation, engine downconvert, the
session/stored merge view, and evaluation of aggregate constraints on
array-valued (group) columns (B16, B17, C2, D27, B21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CONSTRAINT_TYPES = ("range", "single_value", "ratio", "list", "text", "aggregate")
CANONICAL_TYPES = ("range", "single_value", "aggregate")
DEFERRED_TYPES = ("ratio", "list", "text")
AGG_METRICS = ("rms", "peak", "mean", "std")
AGG_OPS = ("<=", ">=")
CANONICAL_FIELDS = {
    "range": ("type", "min", "max", "unit"),
    "single_value": ("type", "value", "unit"),
    "aggregate": ("type", "metric", "op", "value", "unit"),
}
# ---------------------------------------------------------------------------

SPEC_SCHEMA = "type string, min string, max string, value string, metric string, op string, unit string"


def _json_kind(spec: Column, field: str) -> Column:
    """JSON type of a top-level field of a flat spec, from the first character
    of its value: 'string', 'number', 'boolean', 'null', 'other' or 'missing'."""
    first = F.regexp_extract(spec, r'"' + field + r'"\s*:\s*(\S)', 1)
    return (F.when(first == "", "missing")
            .when(first == '"', "string")
            .when(first.rlike(r"[-0-9]"), "number")
            .when(first.isin("t", "f"), "boolean")
            .when(first == "n", "null")
            .otherwise("other"))


def spec_error(spec: Column) -> Column:
    """B16 canonical check of one JSON spec; NULL when valid, else the reason."""
    t = F.get_json_object(spec, "$.type")
    keys = F.json_object_keys(spec)
    allowed = F.when(t == "range", F.array(*[F.lit(x) for x in CANONICAL_FIELDS["range"]])) \
        .when(t == "single_value", F.array(*[F.lit(x) for x in CANONICAL_FIELDS["single_value"]])) \
        .when(t == "aggregate", F.array(*[F.lit(x) for x in CANONICAL_FIELDS["aggregate"]]))
    extra = F.array_except(keys, allowed)
    kind = {f: _json_kind(spec, f) for f in ("min", "max", "value", "unit", "metric", "op")}
    num_or_null = lambda f: kind[f].isin("number", "null", "missing")
    metric = F.get_json_object(spec, "$.metric")
    op = F.get_json_object(spec, "$.op")
    return (F.when(keys.isNull(), "not a JSON object")
            .when(~t.isin(*CONSTRAINT_TYPES) | t.isNull(), "unknown type")
            .when(t.isin(*DEFERRED_TYPES), "deferred type")
            .when(F.size(extra) > 0, F.concat(F.lit("extra fields: "), F.array_join(F.array_sort(extra), ",")))
            .when(~kind["unit"].isin("string", "null", "missing"), "unit must be text or null")
            .when((t == "range") & ~num_or_null("min"), "range: min must be a number or null")
            .when((t == "range") & ~num_or_null("max"), "range: max must be a number or null")
            .when((t == "range") & kind["min"].isin("null", "missing") & kind["max"].isin("null", "missing"),
                  "range: min or max required")
            .when((t == "single_value") & (kind["value"] != "number"), "single_value: value must be a number")
            .when((t == "aggregate") & (~metric.isin(*AGG_METRICS) | metric.isNull()), "aggregate: bad metric")
            .when((t == "aggregate") & (~op.isin(*AGG_OPS) | op.isNull()), "aggregate: bad op")
            .when((t == "aggregate") & (kind["value"] != "number"), "aggregate: value must be a number"))


def check_specs(specs: DataFrame, columns_meta: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """B16 with catalog rules: entry exists, column exists, aggregate only on a
    group column. specs: datalake_id, column_name, spec (JSON text)."""
    out = specs.withColumn("error", spec_error(F.col("spec")))
    if entries is not None:
        ids = entries.select("datalake_id").distinct().withColumn("__e", F.lit(True))
        out = out.join(ids, "datalake_id", "left").withColumn(
            "error", F.coalesce("error", F.when(F.col("__e").isNull(), F.lit("entry not found")))).drop("__e")
    if columns_meta is not None:
        cm = columns_meta.select("datalake_id", F.col("name").alias("column_name"), "column_kind")
        out = out.join(cm, ["datalake_id", "column_name"], "left").withColumn(
            "error", F.coalesce(
                "error",
                F.when(F.col("column_kind").isNull(), F.lit("column not found")),
                F.when((F.get_json_object("spec", "$.type") == "aggregate") & (F.col("column_kind") != "group"),
                       F.lit("aggregate needs a group column")))).drop("column_kind")
    return out.withColumn("accepted", F.col("error").isNull())


def downconvert(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Range specs -> (column_name, lo, hi) for enforcement; everything
    else listed as excluded (column_name, type)."""
    t = F.get_json_object("spec", "$.type")
    engine = specs.filter(t == "range").select(
        "column_name", F.get_json_object("spec", "$.min").cast("double").alias("lo"),
        F.get_json_object("spec", "$.max").cast("double").alias("hi"))
    excluded = specs.filter((t != "range") | t.isNull()).select("column_name", t.alias("type"))
    return engine, excluded


def merge_view(columns: DataFrame, session: DataFrame, stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Session value (applied) > stored value (shown, never applied) >
    blank; session keys without a column are emitted as stale.
    columns: name; session: column_name, spec; stored: column_name, spec,
    approved_by; each with the columns ``by`` where they are of several datasets."""
    keys = [*by, "name"]
    s = session.select(*by, F.col("column_name").alias("name"), F.col("spec").alias("s_spec"))
    p = stored.select(*by, F.col("column_name").alias("name"), F.col("spec").alias("p_spec"), F.col("approved_by").alias("p_by"))
    base = columns.select(*keys).join(s, keys, "left").join(p, keys, "left")
    view = base.select(
        *by, F.col("name").alias("column_name"),
        F.when(F.col("s_spec").isNotNull(), "session").when(F.col("p_spec").isNotNull(), "prefill")
        .otherwise("blank").alias("source"),
        F.col("s_spec").alias("spec"),
        F.col("s_spec").isNotNull().alias("applied"),
        F.col("p_spec").alias("prefill_spec"), F.col("p_by").alias("prefill_by"),
        F.lit(False).alias("stale"))
    stale = (s.join(columns.select(*keys), keys, "left_anti").join(p, keys, "left")
             .select(*by, F.col("name").alias("column_name"), F.lit("session").alias("source"), F.col("s_spec").alias("spec"),
                     F.lit(True).alias("applied"), F.col("p_spec").alias("prefill_spec"), F.col("p_by").alias("prefill_by"),
                     F.lit(True).alias("stale")))
    return view.unionByName(stale)


def array_metric(arr: Column, metric: str) -> Column:
    """rms / peak (max |x|) / mean / std (population) of an array<double>."""
    n = F.size(arr)
    s = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x)
    if metric == "rms":
        return F.sqrt(ss / n)
    if metric == "peak":
        return F.array_max(F.transform(arr, lambda x: F.abs(x)))
    if metric == "mean":
        return s / n
    if metric == "std":
        mean = s / n
        return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n)
    raise ValueError(metric)


def aggregate_constraint(df: DataFrame, array_col: str, metric: str, op: str, value: float) -> DataFrame:
    """Evaluate an aggregate constraint per row of a group (array) column."""
    arr = F.transform(F.col(array_col), lambda x: x.cast("double"))
    m = array_metric(arr, metric)
    ok = (m <= F.lit(value)) if op == "<=" else (m >= F.lit(value))
    return df.withColumn("metric_value", m).withColumn("passed", ok)


def constrainable_columns(columns_meta: DataFrame) -> DataFrame:
    """Group columns, or numeric scalar columns."""
    return columns_meta.filter((F.col("column_kind") == "group") |
                               ((F.col("column_kind") == "scalar") & F.col("dtype").isin("integer", "float")))
