"""What runs leave behind: tables published together under a version.

A commit first writes its tables to a folder of its own. Then one small manifest
file, which names that folder, is published by a rename that fails where the
target exists: the version belongs to whoever published it first, and a run that
fails before has left nothing that a reader sees. Versions are only added; every
reader reads the tables of one version, whatever is written meanwhile. Lineage is
append-only: each version holds the rows of its run, with the time.

    <root>/data/<commit>/<table>           the written tables
    <root>/log/<dataset>/<version>.json    one manifest a version
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.java_gateway import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import safe_file_id

MANIFEST_SCHEMA = "dataset_id string, version int, commit string, run_id string, committed_at string, tables array<string>"


class CommitConflict(RuntimeError):
    """Another run published the version that this one was to follow."""


@dataclass(frozen=True)
class Commit:
    dataset_id: str
    version: int
    commit: str
    run_id: str
    committed_at: str
    tables: tuple[str, ...]


class CommitLog:
    """The versions under one folder, which every executor and the driver reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # --- files ----------------------------------------------------------------
    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("log").getFileSystem(self._conf)

    def _folder(self, dataset_id: str) -> str:
        """A folder name of the dataset's own: readable, and told apart by a hash."""
        safe, digest = self.spark.range(1).select(safe_file_id(F.lit(dataset_id)), F.sha2(F.lit(dataset_id), 256)).first()
        return f"log/{safe[:80]}-{digest[:12]}"

    def _publish(self, folder: str, version: int, text: str) -> bool:
        """Create the manifest of ``version``, or report that there is one."""
        target = self._path(f"{folder}/{version:08d}.json")
        fs = self._fs()
        fs.mkdirs(target.getParent())
        draft = self._path(f"{folder}/.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(target), none)
        except Py4JError as e:
            fs.delete(draft, False)
            cause = getattr(e, "java_exception", None)
            if cause is not None and cause.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    # --- writing --------------------------------------------------------------
    def commit(self, dataset_id: str, run_id: str, tables: Mapping[str, DataFrame], after: int | None = None) -> Commit:
        """Write all tables, then publish them as the next version. With
        ``after`` the commit must follow that version (0: be the first), else
        ``CommitConflict`` is raised and nothing shows."""
        folder, name = self._folder(dataset_id), uuid.uuid4().hex
        if after is not None and self.latest(dataset_id) != after:
            raise CommitConflict(f"{dataset_id} is no longer at version {after}")
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/data/{name}/{table}")
        while True:
            version = (self.latest(dataset_id) if after is None else after) + 1
            done = Commit(dataset_id, version, name, run_id, dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), tuple(tables))
            if self._publish(folder, version, json.dumps(done.__dict__, ensure_ascii=False)):
                return done
            if after is not None:
                raise CommitConflict(f"{dataset_id} is no longer at version {after}")

    # --- reading --------------------------------------------------------------
    def _versions(self, dataset_id: str) -> list[int]:
        folder = self._path(self._folder(dataset_id))
        fs = self._fs()
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]  # one file a version of one dataset
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def latest(self, dataset_id: str) -> int:
        """The last version; 0 where there is none."""
        return max(self._versions(dataset_id), default=0)

    def history(self, dataset_id: str | None = None) -> DataFrame:
        """One row per version, of one dataset or of all."""
        if not self._fs().exists(self._path("log")):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        rows = self.spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{self.root}/log")
        return rows if dataset_id is None else rows.filter(F.col("dataset_id") == dataset_id)

    def _commits(self, dataset_id: str, version: int | None, table: str) -> list[tuple[int, str]]:
        rows = self.history(dataset_id).filter(F.array_contains("tables", table))
        if version is not None:
            rows = rows.filter(F.col("version") <= version)
        return sorted((r["version"], r["commit"]) for r in rows.select("version", "commit").collect())  # one row a version

    def read(self, dataset_id: str, table: str, version: int | None = None) -> DataFrame | None:
        """The table as of ``version`` (the last one, if None); None where no
        version holds it. Failures to read are raised."""
        found = self._commits(dataset_id, version, table)
        return self.spark.read.parquet(f"{self.root}/data/{found[-1][1]}/{table}") if found else None

    def appended(self, dataset_id: str, table: str, version: int | None = None) -> DataFrame | None:
        """The rows that all versions up to ``version`` added, with ``version``."""
        found = self._commits(dataset_id, version, table)
        if not found:
            return None
        paths = {f"{self.root}/data/{c}/{table}": v for v, c in found}
        rows = self.spark.read.parquet(*paths)
        commit = F.element_at(F.split(F.input_file_name(), "/"), -3)
        return rows.withColumn("version", F.create_map(*[F.lit(x) for v, c in found for x in (c, v)])[commit])
