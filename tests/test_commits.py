"""The commit log: what is published shows whole or not at all."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.operators.catalog import lineage_chain
from millrace.plans.commits import CommitConflict, CommitLog
from millrace.plans.runner import run_plan
from millrace.plans.stages import CATALOG, register_dataset
from millrace.sources.files import write_csv

PLAN = [{"operation": "fill_missing", "target_column": "x"}, {"operation": "remove_outlier", "target_column": "x"}]


@pytest.fixture
def log(spark, tmp_path):
    return CommitLog(spark, f"file://{tmp_path}/runs")


def _rows(spark):
    return spark.createDataFrame([(i, None if i % 10 == 0 else float(i)) for i in range(100)], "id long, x double")


def test_a_run_is_one_version(spark, log):
    df = _rows(spark)
    assert log.read("d", "output") is None and log.latest("d") == 0 and log.history().count() == 0
    first = run_plan(df, PLAN, approved_keys=["fill_missing:x", "remove_outlier:x"], constraints={"x": [0, 60]}, dataset_id="d", run_id="a", log=log)
    assert first.commit.version == 1 and first.output.count() == log.read("d", "output").count() < 100
    assert log.read("d", "backup").exceptAll(df).count() == 0 and log.read("d", "backup").count() == 100
    run_plan(first.output, PLAN[:1], approved_keys=["fill_missing:x"], dataset_id="d", run_id="b", log=log)
    run_plan(df, PLAN[:1], dataset_id="other/d", run_id="c", log=log)
    assert (log.latest("d"), log.latest("other/d")) == (2, 1)
    assert log.read("d", "output", 1).count() == first.output.count()  # earlier versions stay readable
    chain = lineage_chain(log.appended("d", "lineage"), "d").collect()
    assert [(r["version"], r["step_order"], r["transformation_type"]) for r in chain] == [(1, 1, "fill_missing"), (1, 2, "remove_outlier"), (2, 1, "fill_missing")]
    assert all(a["applied_at"] <= b["applied_at"] for a, b in zip(chain, chain[1:], strict=False))
    assert log.appended("d", "lineage", 1).count() == 2
    assert {(r["dataset_id"], r["version"], r["run_id"]) for r in log.history().collect()} == {("d", 1, "a"), ("d", 2, "b"), ("other/d", 1, "c")}


def test_a_failed_run_leaves_nothing_visible(spark, log):
    log.commit("d", "good", {"output": _rows(spark)})
    broken = _rows(spark).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="no"):
        log.commit("d", "bad", {"lineage": _rows(spark), "output": broken})
    assert log.latest("d") == 1 and log.read("d", "lineage") is None and log.read("d", "output").count() == 100


def test_two_writers(spark, log):
    df = _rows(spark)
    log.commit("d", "a", {"output": df})
    with pytest.raises(CommitConflict):
        log.commit("d", "late", {"output": df.limit(1)}, after=0)
    assert not log._publish(log._folder("d"), 1, "{}") and log._publish(log._folder("d"), 2, '{"dataset_id":"d","version":2,"commit":"x","tables":[]}')
    assert log.commit("d", "b", {"output": df.limit(5)}).version == 3  # without `after` the next free version
    assert log.read("d", "output", 2).count() == 100 and log.read("d", "output").count() == 5
    names = [s.getPath().getName() for s in log._fs().listStatus(log._path(log._folder("d")))]
    assert not any(n.endswith(".draft") for n in names)


def test_registration(spark, log, tmp_path):
    path = write_csv(spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int"), f"file://{tmp_path}/csv")
    got = register_dataset(log, "My Data", path, "order", "quality", company="c")
    assert (got["status"], got["datalake_id"], got["n_columns"], got["version"]) == ("registered", "my_data", 2, 1)
    entry = log.read(CATALOG, "entries").first()
    assert (entry["datalake_id"], entry["company"], entry["function"]) == ("my_data", "c", "quality")
    assert [(r["name"], r["dtype"]) for r in log.read(CATALOG, "columns").orderBy("ordinal").collect()][0] == ("name", "string")
    assert spark.read.parquet(entry["data_path"]).count() == 2
    assert register_dataset(log, "my data", path, "order")["reason"] == "id already registered"
    log.commit("left_over", "x", {"source": _rows(spark)})
    assert register_dataset(log, "Left Over", path, "order")["reason"] == "orphan folder exists"
    with pytest.raises(AnalysisException):
        register_dataset(log, "absent", f"file://{tmp_path}/none", "order")
    assert log.latest("absent") == 0 and log.read(CATALOG, "entries").count() == 1
