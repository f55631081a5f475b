"""Manifest loads (A9, A13): which files belong to which dataset, what they hold,
and their rows copied as UTF-8.

The files below a root are listed and probed once for all datasets. A file belongs
to the dataset whose path is the longest that its own path begins with, component
by component, found by an equality join on the file's ancestors. The number of jobs does not
depend on the number of datasets, and the driver sees no list of files.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import human_size, safe_file_id
from millrace.sources.files import probe_files

TABULAR = "*.{csv,txt}"
#: Files whose facts are broadcast to their lines; more are joined by a shuffle.
BROADCAST_FILES = 50_000


def _plain(uri: Column) -> Column:
    """The path of a file's URI, without scheme and authority, escapes resolved."""
    path = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/+", "/")


def _root(spark: SparkSession, root: str) -> str:
    """The root as file listings name it: without scheme, authority and slash."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")


def _inside(path: Column, root: str) -> Column:
    return F.substring(_plain(path), len(root) + 2, 1 << 30)


def list_below(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: path (as Spark names it), inside (its path from
    the root on), length, modified. Contents are not read. Spark doesn't list files
    without a byte."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    uri = F.col("_metadata.file_path")
    return rows.select(uri.alias("path"), _inside(uri, _root(spark, root)).alias("inside"), "length", F.col("modificationTime").alias("modified"))


def match_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` with the ``dataset`` each belongs to; those of none are left out.
    ``manifest``: dataset, path (from the root on; a folder or a file)."""
    parts = F.split("inside", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    claims = manifest.select("dataset", F.regexp_replace("path", r"^/+|/+$", "").alias("claim")).filter(F.col("claim") != "")
    every = files.select("inside", F.explode(ancestors).alias("claim")).join(claims, "claim")
    longest = every.groupBy("inside").agg(F.max_by("dataset", F.struct(F.length("claim"), "dataset")).alias("dataset"))
    return files.join(longest, "inside")


def manifest_files(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """One row per matched file: dataset, path, inside, length and, of tabular
    files, encoding, valid, headerless, header, open_quote (NULL for others)."""
    files = match_files(list_below(spark, root), manifest)
    probes = probe_files(spark, root, TABULAR)
    own = probes.select(_inside(F.col("path"), _root(spark, root)).alias("inside"), "encoding", "valid", "headerless", "header", "open_quote")
    return files.join(own, "inside", "left")


def load_records(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One record per manifest row: dataset, exists, n_files, n_tabular,
    size_bytes, size (as text), encodings, headers_differ, n_columns and warnings.

    ``manifest``: dataset, path, declared_encoding (may be NULL). Datasets that no
    file belongs to are path_missing; files that can't be decoded as declared
    (encoding_mismatch), headers that differ, names that are missing from the first
    line, and folders without a tabular file are named too."""
    declared = files.join(manifest.select("dataset", "declared_encoding"), "dataset")
    undecodable = F.col("declared_encoding").isNotNull() & F.col("valid").isNotNull() & ~F.array_contains("valid", F.col("declared_encoding"))
    facts = declared.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("header").alias("n_tabular"), F.sum("length").alias("size_bytes"),
        F.array_join(F.array_sort(F.collect_set("encoding")), ",").alias("encodings"),
        F.min(F.size("header")).alias("n_columns"), F.bool_or(undecodable).alias("undecodable"), F.bool_or("headerless").alias("headerless"),
        F.bool_or(F.to_json("header").contains("__unnamed_")).alias("unnamed"))
    head = files.filter(F.col("header").isNotNull()).groupBy("dataset").agg(F.min(F.to_json("header")).alias("a"), F.max(F.to_json("header")).alias("b"))
    rows = manifest.select("dataset", "declared_encoding").join(facts, "dataset", "left").join(head, "dataset", "left")
    exists = F.col("n_files").isNotNull()
    warnings = F.array_compact(F.array(
        F.when(~exists, F.lit("path_missing")), F.when(exists & (F.col("n_tabular") == 0), F.lit("no_tabular_file")),
        F.when(F.col("a") != F.col("b"), F.lit("headers_differ")), F.when(F.col("undecodable"), F.lit("encoding_mismatch")),
        F.when(F.col("headerless"), F.lit("headerless")), F.when(F.col("unnamed"), F.lit("unnamed_columns"))))
    return rows.select("dataset", exists.alias("exists"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_tabular", F.lit(0)).alias("n_tabular"),
                       F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), human_size(F.coalesce("size_bytes", F.lit(0))).alias("size"), "encodings",
                       (F.col("a") != F.col("b")).alias("headers_differ"), "n_columns", F.array_join(warnings, ",").alias("warnings"))


def _reencode(batches):
    """Lines as UTF-8 text. Every task begins each dataset's part with the header
    and leaves out the files' own first lines, so each written part reads alone."""
    begun: set[str] = set()
    at = 0
    for batch in batches:
        out = []
        for folder, encoding, headerless, header_line, first, line in zip(*[batch[c].to_pylist() for c in ("folder", "encoding", "headerless", "header_line", "first", "line")], strict=True):
            if folder not in begun:
                begun.add(folder)
                if not headerless:
                    out.append((folder, at, header_line))
            if not first or headerless:
                out.append((folder, at + len(out), line.decode(encoding).removeprefix("﻿") if first else line.decode(encoding)))
        at += len(out) + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["folder", "place", "value"])


def copy_normalised(spark: SparkSession, root: str, files: DataFrame, target: str) -> DataFrame:
    """The lines of every tabular file as UTF-8 below
    ``target/folder=<dataset>``, and the folder of each dataset.

    Each file is decoded with its own probed encoding. Every written part begins with the
    header of its dataset, whose files must agree on it. Files in which a quoted
    field goes over a line's end are kept in one part, in order."""
    told = files.filter(F.col("encoding").isNotNull()).select("inside", safe_file_id("dataset").alias("folder"), "dataset", "encoding", "headerless", "open_quote",
                                                              F.array_join(F.transform("header", _csv_field), ",").alias("header_line"))
    if told.groupBy("folder").agg(F.count_distinct("header_line").alias("n"), F.count_distinct("dataset").alias("d")).filter("n > 1 or d > 1").limit(1).count():
        raise ValueError("files of a dataset have different headers, or two datasets one folder name")
    small = told.drop("dataset")
    small = F.broadcast(small) if small.count() <= BROADCAST_FILES else small
    lines = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", TABULAR).load(root).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line"))
    heads = lines.filter("start = 0").groupBy("path").agg(F.min("row").alias("row")).withColumn("head", F.lit(True))
    placed = lines.withColumn("inside", _inside(F.col("path"), _root(spark, root))).join(small, "inside")
    first = placed.join(F.broadcast(heads) if heads.count() <= BROADCAST_FILES else heads, ["path", "row"], "left").withColumn("first", F.coalesce("head", F.lit(False)))
    whole = first.filter("open_quote").repartition("path").sortWithinPartitions("folder", "path", "start", "row")
    free = first.filter("not open_quote")
    for part in (free, whole):
        done = part.select("folder", "encoding", "headerless", "header_line", "first", "line").mapInArrow(_reencode, "folder string, place long, value string")
        done.sortWithinPartitions("folder", "place").select("folder", "value").write.mode("append").partitionBy("folder").text(target)
    return told.select("dataset", "folder").distinct()


def _csv_field(name: Column) -> Column:
    """A header's name, quoted where it holds a comma, quote or line end."""
    return F.when(name.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(name)
