"""Materialise bounded metadata frames (one row per column, per step or per
class) as local relations so a plan built from them does not re-run the
aggregates that produced them."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Refuse to pull anything bigger than this through the driver.
SMALL_ROW_LIMIT = 100_000


def small(df: DataFrame, limit: int = SMALL_ROW_LIMIT) -> DataFrame:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"metadata frame larger than {limit} rows; keep it distributed")
    return df.sparkSession.createDataFrame(rows, df.schema)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a single-row aggregate to every row of ``df``.

    The one row is computed first (one small job) and its values become typed
    literals, so the result plan has no join at all — a constant-key join
    would be folded by the optimizer into a nested-loop cross product."""
    from pyspark.sql import functions as F
    r = one_row.first()
    cols = []
    for f in one_row.schema.fields:
        v = r[f.name] if r is not None else None
        cols.append(F.lit(v).cast(f.dataType).alias(f.name))
    return df.select("*", *cols)
