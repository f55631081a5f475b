"""Data rules behind result rendering: first-n samples, nested-result
flattening to (label, value) rows, and human-readable constraint specs
(B1, F9, F11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
FLATTEN_MAX_DEPTH = 4
FLATTEN_MAX_ITEMS = 50
FLATTEN_MAX_ROWS = 200
LABEL_SEP = " · "
# ---------------------------------------------------------------------------


def sample_head(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """B1: the first n rows in row order (NULLs kept as NULL). A distributed
    top-n (TakeOrderedAndProject), not a full sort."""
    return df.orderBy(*order_by).limit(n)


def _leaves(value: Column, dtype: T.DataType, label: Column, depth: int, max_depth: int, max_items: int) -> Column:
    """(label, value) of every leaf below ``value``, as one array column."""
    none = F.array().cast("array<struct<label:string,value:string>>")
    if depth > max_depth:
        return none
    if isinstance(dtype, T.StructType):
        parts = [_leaves(value.getField(f.name), f.dataType, F.concat(label, F.lit(LABEL_SEP + f.name)), depth + 1, max_depth, max_items) for f in dtype.fields]
        return F.concat(*parts) if parts else none
    if isinstance(dtype, T.ArrayType):
        nested = F.transform(F.slice(value, 1, max_items), lambda v, i: _leaves(
            v, dtype.elementType, F.concat(label, F.lit("["), i.cast("string"), F.lit("]")), depth + 1, max_depth, max_items))
        return F.coalesce(F.flatten(nested), none)
    return F.array(F.struct(label.alias("label"), value.cast("string").alias("value")))


def flatten_struct(df: DataFrame, label_col: str, value_col: str, max_depth: int = FLATTEN_MAX_DEPTH,
                   max_items: int = FLATTEN_MAX_ITEMS, max_rows: int = FLATTEN_MAX_ROWS) -> DataFrame:
    """every row's nested value as (label, value) rows, in schema order, in
    one pass: structs and arrays are gone into to ``max_depth``, arrays to
    ``max_items`` items, and a source row gives ``max_rows`` rows at most. Labels
    join keys with ' · ' and array positions as [i]; values are text."""
    leaves = _leaves(F.col(f"`{value_col}`"), df.schema[value_col].dataType, F.col(f"`{label_col}`").cast("string"), 0, max_depth, max_items)
    return df.select(F.explode(F.slice(leaves, 1, max_rows)).alias("r")).select("r.label", "r.value")


def spec_summary(spec: Column) -> Column:
    """'min ~ max unit' for ranges (open ends -inf/+inf), 'metric op value
    unit' for aggregates, 'value unit' for single values, else the JSON."""
    t = F.get_json_object(spec, "$.type")
    unit = F.get_json_object(spec, "$.unit")
    sfx = F.when(unit.isNotNull() & (unit != ""), F.concat(F.lit(" "), unit)).otherwise(F.lit(""))
    g = lambda k: F.get_json_object(spec, f"$.{k}")
    return (F.when(spec.isNull(), F.lit("(none)"))
            .when(t == "range", F.concat(F.coalesce(g("min"), F.lit("-inf")), F.lit(" ~ "),
                                         F.coalesce(g("max"), F.lit("+inf")), sfx))
            .when(t == "aggregate", F.concat(g("metric"), F.lit(" "), g("op"), F.lit(" "), g("value"), sfx))
            .when(t == "single_value", F.concat(g("value"), sfx))
            .otherwise(spec))
