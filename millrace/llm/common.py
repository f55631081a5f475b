"""Shared helpers: tables written to the shared folder, value-defined document
chunks and session preparation."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Rows of an Arrow batch sent to Python. Texts of 100 KB make batches of
#: 50 MB at most; the byte limit below cuts earlier where Spark supports it.
ARROW_ROWS = "512"
ARROW_BYTES = "8m"


def prepare(spark: SparkSession) -> None:
    """Ship the package to executors and bound the Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    # operators run in several jobs that hand on written tables: a finished job's
    # shuffle files are of no more use
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a (small) intermediate table to the shared folder and read it
    back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, text string)`` with NULL texts as empty strings; any
    other column of the input, whatever its name, is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_bytes(rows: DataFrame) -> int:
    """Bytes of all texts (one aggregate; lengths are stored, not computed)."""
    got = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int(got["b"] or 0) + 16 * int(got["n"])


def _bucket_of(value: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) that are <= value, by two searches of
    about sqrt(n) comparisons each. NULL goes to 0."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    top = F.lit([g[0] for g in groups])
    nested = F.array(*[F.lit(g) for g in groups])
    outer = F.size(F.filter(top, lambda b: b <= value))
    inner = F.size(F.filter(F.element_at(nested, F.greatest(outer, F.lit(1))), lambda b: b <= value))
    return F.when(value.isNull() | (outer == 0), F.lit(0)).otherwise((outer - 1) * step + inner).cast("int")


def id_chunks(rows: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Add ``chunk``: contiguous ranges of ``doc_id`` holding about
    ``chunk_bytes`` of text each, and return the number of chunks.

    Bounds are quantiles of the ids, kept as literals, so a row's chunk depends
    on its value only (recomputed tasks agree); equal ids share a chunk and
    smaller ids never lie in a later one. NULL ids lie in chunk 0.
    """
    n = max(1, math.ceil(text_bytes(rows) / chunk_bytes))
    if n == 1:
        return rows.withColumn("chunk", F.lit(0)), 1
    probs = [i / n for i in range(1, n)]
    got = rows.agg(F.percentile_approx("doc_id", probs, max(10_000, 20 * n)).alias("q")).first()["q"]
    bounds = sorted(set(got or []))
    return rows.withColumn("chunk", _bucket_of(F.col("doc_id"), bounds)), len(bounds) + 1
