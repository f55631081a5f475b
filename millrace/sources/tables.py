"""Table access helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def rebalance(df: DataFrame, persist: bool = False) -> DataFrame:
    """Restore parallelism for multi-pass work on an under-split input.

    A scan with fewer partitions than the session's task slots (one big row
    group, a single small file) is spread round-robin over the slots; a scan
    that already has at least as many partitions is left alone (no shuffle).
    ``persist=True`` keeps the rebalanced rows for the following passes; it
    only applies when a rebalance happened, i.e. when the input is small
    relative to the cluster. The caller releases them with ``unpersist()``.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    out = df.repartition(slots)
    return out.persist() if persist else out
