"""Dataset rule checks over profiles and attribute tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.small import attach_row

#: JSON type of each catalog dtype; all others are text.
JSON_TYPES = {"integer": "integer", "float": "number", "boolean": "boolean", "array": "array"}


def required_and_nulls(profile: DataFrame, required: Sequence[str], max_null_ratio: float) -> DataFrame:
    """Required columns missing from the profile, and columns whose
    null_count / max(n, 1) exceeds the limit. kind, column, null_ratio."""
    spark = profile.sparkSession
    req = spark.createDataFrame([(c,) for c in required], "name string")
    missing = req.join(profile.select("name"), "name", "left_anti").select(
        F.lit("missing_required").alias("kind"), F.col("name").alias("column"), F.lit(None).cast("double").alias("null_ratio"))
    ratio = F.col("null_count") / F.greatest(F.col("n_rows"), F.lit(1))
    over = profile.filter(ratio > F.lit(max_null_ratio)).select(
        F.lit("null_ratio").alias("kind"), F.col("name").alias("column"), F.round(ratio, 4).alias("null_ratio"))
    return missing.unionByName(over)


def min_class_ratio(df: DataFrame, label: str, min_share: float) -> DataFrame:
    """Per class count and share; ``below`` when the share is under the limit."""
    vc = (df.select(F.col(f"`{label}`").alias("label")).filter(F.col("label").isNotNull())
          .groupBy("label").agg(F.count(F.lit(1)).alias("count")))
    tot = vc.agg(F.sum("count").alias("__t"))
    share = F.col("count") / F.col("__t")
    return attach_row(vc, tot).select("label", "count", F.round(share, 4).alias("share"),
                                      (share < F.lit(min_share)).alias("below"))


def attribute_rules(items: DataFrame, attr: str, required: str, label: str, min_per_class: int) -> DataFrame:
    """Items whose attribute differs from the required value (count and
    the three smallest item names) and classes with fewer than k items."""
    bad = items.filter(~F.col(attr).eqNullSafe(F.lit(required)))
    # the examples are a distributed top-3, never a collected list of all mismatches
    mism = bad.agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 0)
    ex = bad.select("file").orderBy("file").limit(3).agg(
        F.array_join(F.array_sort(F.collect_list("file")), ",").alias("examples"))
    mism = attach_row(mism, ex).select(F.lit("mode_mismatch").alias("kind"), F.lit(None).cast("string").alias("label"),
                                       "count", "examples")
    few = (items.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
           .filter(F.col("count") < min_per_class)
           .select(F.lit("class_too_few").alias("kind"), F.col(label).alias("label"), "count",
                   F.lit(None).cast("string").alias("examples")))
    return mism.unionByName(few)


def json_types(columns_meta: DataFrame) -> DataFrame:
    """F8: the JSON-Schema type of every catalog column: dataset, property,
    json_type (integer, number, boolean, array, else string)."""
    named = F.create_map(*[F.lit(x) for kv in JSON_TYPES.items() for x in kv])
    return columns_meta.select(F.col("datalake_id").alias("dataset"), F.col("name").alias("property"), F.coalesce(named[F.col("dtype")], F.lit("string")).alias("json_type"))
