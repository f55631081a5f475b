"""Sinks and file-set checks: backup/processed Parquet pair, before/after CSV
export with removed rows (A14-A16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.rowindex import quoted
from millrace.functions.rowsets import multiset_difference


def write_backup_pair(before: DataFrame, after: DataFrame, root: str, dataset_id: str) -> tuple[str, str]:
    """Untouched input and processed output, both Parquet."""
    b = f"{root.rstrip('/')}/{dataset_id}__backup.parquet"
    p = f"{root.rstrip('/')}/{dataset_id}__processed.parquet"
    before.write.mode("overwrite").parquet(b)
    after.write.mode("overwrite").parquet(p)
    return b, p


def export_diff(before: DataFrame, after: DataFrame, root: str | None = None) -> tuple[DataFrame, dict]:
    """Rows removed between before and after, as often as they were
    removed, and an optional CSV export of both sides."""
    removed = multiset_difference(before, after.select(*[quoted(c) for c in before.columns]))
    if root:
        before.write.mode("overwrite").option("header", "true").csv(f"{root}/before")
        after.write.mode("overwrite").option("header", "true").csv(f"{root}/after")
    return removed, {"before": before, "after": after}


def read_processed(spark: SparkSession, root: str, dataset_id: str) -> DataFrame | None:
    """A dataset's processed rows, or None where it has none yet. Any other
    failure to read them is raised."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/{dataset_id}__processed.parquet")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
