"""Stateless cleaning on a stream (2.13): masking cleanup, fixed-parameter
normalisation, outlier filtering and aggregate constraints are column
expressions, so they run unchanged on a streaming DataFrame. One
``availableNow`` run processes everything present and stops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import clean_mask
from millrace.operators.transforms import in_bounds


def clean_stream(stream: DataFrame, mask_cols: Sequence[str] = (), bounds: Mapping[str, tuple] | None = None,
                 normalize: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    out = stream
    for c in mask_cols:
        out = out.withColumn(c, clean_mask(F.col(f"`{c}`")))
    for c, (lo, hi) in (bounds or {}).items():
        out = out.filter(in_bounds(F.col(f"`{c}`"), lo, hi))
    for c, (mu, sd) in (normalize or {}).items():
        out = out.withColumn(c, (F.col(f"`{c}`").cast("double") - F.lit(mu)) / F.lit(sd))
    return out


def run_available_now(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                      checkpoint_dir: str, **clean_kwargs) -> DataFrame:
    """Parquet file source -> clean_stream -> Parquet sink, trigger
    availableNow; returns the sink read back as a batch DataFrame."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    q = (clean_stream(stream, **clean_kwargs).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink_dir)
