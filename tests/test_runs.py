"""Plan runs, validation, sources and the driver contract."""

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_run_plan_invariants(spark):
    from millrace.checks.common import messy_lineitem
    from millrace.flagship import FLAGSHIP_CONSTRAINTS, flagship_plan
    from millrace.plans.runner import run_plan
    df = messy_lineitem(spark, SF_SMALL)
    plan = flagship_plan(df)
    keys = [r["step_key"] for r in plan.collect()]
    r1 = run_plan(df, plan, approved_keys=keys, constraints=FLAGSHIP_CONSTRAINTS)
    steps = r1.steps.toPandas()
    assert (steps["status"] == "done").all()
    assert r1.lineage.count() == (steps["status"] == "done").sum()          # lineage rows = done steps
    assert r1.backup.count() == df.count()                                  # backup untouched
    fills = steps[steps["operation"] == "fill_missing"]
    assert (fills["after_nulls"] < fills["before_nulls"]).all()             # filling lowers nulls
    r2 = run_plan(df, plan, approved_keys=keys, constraints=FLAGSHIP_CONSTRAINTS)
    a = sorted(map(tuple, r1.output.collect()), key=str)
    b = sorted(map(tuple, r2.output.collect()), key=str)
    assert a == b                                                            # run twice = equal
    rep = r1.report.first()
    assert rep["passed"] and rep["n_done"] == len(steps)
    # without approvals every L2 step waits
    r3 = run_plan(df, plan, approved_keys=[], constraints=FLAGSHIP_CONSTRAINTS)
    s3 = r3.steps.toPandas()
    assert set(s3[s3["permission_level"] == "L2"]["status"]) == {"awaiting_approval"}
    assert r3.report.first()["next_action"] == "await_approval"


def test_plan_precheck_flags(spark):
    from millrace.plans.rules import plan_from_rows, plan_precheck
    plan = plan_from_rows(spark, [{"operation": "fill_missing", "target_column": "a"},
                                  {"operation": "clean_masking", "target_column": "b"},
                                  {"operation": "drop_column", "target_column": "a"},
                                  {"operation": "compute_stats"}])
    issues = {(r["kind"], r["order"]) for r in plan_precheck(plan).collect()}
    assert ("plan_order", 2) in issues and ("plan_conflict", 1) in issues and ("plan_l3_notice", 3) in issues


def test_csv_cp949_dup_headers(spark):
    from millrace.sources.files import read_csv_safe
    d = tempfile.mkdtemp(prefix="mr-csv-")
    text = "uid,제품명,제품명,,수량\n1,가,나,x,3\n2,다,라,y,NA\n"
    with open(os.path.join(d, "part.csv"), "wb") as fh:
        fh.write(text.encode("cp949"))
    df = read_csv_safe(spark, d)
    assert df.columns == ["uid", "제품명", "제품명__dup2", "__unnamed_3", "수량"]
    rows = df.orderBy("uid").collect()
    assert rows[0]["제품명__dup2"] == "나" and rows[1]["수량"] is None
    assert dict(df.dtypes)["uid"] == "bigint"


def test_workbook_merge(spark):
    from millrace.sources.workbook import merge_sheets, read_workbook_cells, sheet_frames, write_xlsx
    d = tempfile.mkdtemp(prefix="mr-xlsx-")
    s1 = pd.DataFrame({"LOT_NO": ["L1", "L2", "L3"], "TEMP_1": [1.5, 2.5, 3.5], "EQP_ID": ["E1", "E2", "E3"]})
    s2 = pd.DataFrame({"LOT_NO": ["L1", "L4"], "PRESSURE": [10, 20], "EQP_ID": ["X", "Y"]})
    with open(os.path.join(d, "book.xlsx"), "wb") as fh:
        fh.write(write_xlsx({"s1": s1, "s2": s2}))
    frames = sheet_frames(read_workbook_cells(spark, d))
    merged = merge_sheets([f.drop("row_ord", "path") for f in frames.values()], "LOT_NO")
    assert sorted(merged.columns) == sorted(["LOT_NO", "TEMP_1", "EQP_ID", "PRESSURE", "EQP_ID_dup"])
    assert merged.count() == 4


def test_workbooks_of_many_groups(spark):
    from millrace.sources.workbook import build_workbooks, sheet_frames, workbook_cells
    df = spark.createDataFrame([(i % 3, i, f"<n{i}>" if i % 5 else None, i / 4) for i in range(60)], "g int, k long, name string, v double")
    books = build_workbooks({"all": df, "few & \"odd\"": df.filter("k < 30").select("g", "k")}, "g", "k")
    assert {r["path"] for r in books.collect()} == {"0.xlsx", "1.xlsx", "2.xlsx"}
    frames = sheet_frames(workbook_cells(books))
    assert list(frames) == ["all", "few & \"odd\""]
    got = {(r["path"], float(r["k"]), r["name"], float(r["v"])) for r in frames["all"].collect()}
    assert got == {(f"{i % 3}.xlsx", float(i), f"<n{i}>" if i % 5 else None, i / 4) for i in range(60)}
    assert frames["few & \"odd\""].count() == 30
    other = workbook_cells(books).unionByName(workbook_cells(build_workbooks({"all": df.select("g", "name", "k")}, "g", "k").withColumn("path", F.lit("z.xlsx"))))
    try:
        sheet_frames(other)
        raise AssertionError("different headers were merged")
    except ValueError:
        pass


def test_guarded_query(spark):
    from millrace.operators.adhoc import guarded_query
    df = spark.range(500).withColumn("x", F.col("id") * 2)
    ok = guarded_query(df, "SELECT id, x FROM t WHERE x > 10")
    assert ok.ok and ok.result.count() == 200 and ok.truncated and ok.total == 494
    for bad in ("DROP TABLE t", "SELECT * FROM other", "SELECT nope_fn(x) FROM t", "CREATE TABLE z AS SELECT 1"):
        r = guarded_query(df, bad)
        assert not r.ok and r.lineage.count() == 1


def test_isolation_forest_ratio(spark):
    import numpy as np
    from millrace.operators.ml import isolation_forest
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"a": rng.normal(size=2000), "b": rng.normal(size=2000)})
    pdf.loc[:19, ["a", "b"]] = 8.0
    res = isolation_forest(spark.createDataFrame(pdf), ["a", "b"], n_trees=30, contamination=0.01)
    st = res["stats"].first()
    assert st["n_total"] == 2000 and 15 <= st["n_anomaly"] <= 25
    top = res["scored"].orderBy("score").limit(20).toPandas()
    assert (top["f0"] == 8.0).mean() > 0.8


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


def test_constraint_resolution_and_gate(spark):
    from millrace.plans.rules import approval_gate, plan_from_rows, resolve_constraints
    cons = resolve_constraints(spark, {"L_QUANTITY": [1, 45], "missing": [0, 1], "Tax": {"min": 0}},
                               ["l_quantity", "tax", "Tax"])
    got = {r["key"]: r["actual"] for r in cons.collect()}
    assert got == {"L_QUANTITY": "l_quantity", "missing": None, "Tax": "Tax"}   # exact match wins
    plan = plan_from_rows(spark, [{"operation": "compute_stats"}, {"operation": "fill_missing", "target_column": "a"},
                                  {"operation": "drop_column", "target_column": "b"}])
    approved = spark.createDataFrame([("fill_missing:a",)], "step_key string")
    gate = {r["operation"]: r["gate"] for r in approval_gate(plan, approved).collect()}
    assert gate == {"compute_stats": "run", "fill_missing": "run", "drop_column": "awaiting_approval"}


def test_csv_is_not_misread(spark):
    from millrace.sources.files import probe_files, read_csv_safe
    d = tempfile.mkdtemp(prefix="mr-csv-")
    late = "a,b\n" + "1,plain\n" * 12_000 + "2,한글\n"  # the first other character lies after 64 KiB
    for name, text, codec in (("u.csv", "a,b\n1,\"two\nlines\"\na,b\n", "utf-8"), ("k.csv", late, "cp949")):
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(text.encode(codec))
    assert {r["encoding"] for r in probe_files(spark, d).collect()} == {"utf-8-sig", "cp949"}
    df = read_csv_safe(spark, d, typed=False)
    rows = [(r["a"], r["b"]) for r in df.collect()]
    assert len(rows) == 12_003 and ("1", "two\nlines") in rows and ("a", "b") in rows and ("2", "한글") in rows
    for bad in ({"encoding": "utf-8"}, {}):
        if not bad:
            with open(os.path.join(d, "z.csv"), "wb") as fh:
                fh.write(b"b,a\n1,2\n")
        try:
            read_csv_safe(spark, d, **bad)
            raise AssertionError("read what can't be read")
        except ValueError:
            pass
