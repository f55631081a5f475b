"""Manifest loads over files with odd names, encodings and shapes."""

import os

import pytest

from millrace.sources.manifest import copy_normalised, list_below, load_records, manifest_files, match_files

FILES = {
    "a/one.csv": "id,이름\n1,\"두\n줄\"\n2,셋\n".encode("cp949"), "a/deep/er/two.csv": b"\xef\xbb\xbfid,name\n3,x\n", "a/deep/er/three.csv": b"id,name\r\n4,y\r\n",
    "b +%/x y.csv": b"p,q\n1,2\n", "b +%/z.csv": b"q,p\n1,2\n", "c/none.bin": b"\x00\x01", "c/empty.csv": b"", "lone.csv": b"0.5,1\n2,3\n", "ab/no.csv": b"k\n1\n"}
MANIFEST = [("A", "a", "cp949"), ("A deep", "/a/deep/", "utf-8"), ("B", "b +%", None), ("C", "c", "utf-8"), ("D", "lone.csv", "utf-8"), ("E", "a/deeper", None), ("F", "d", None)]
SCHEMA = "dataset string, path string, declared_encoding string"


@pytest.fixture
def root(tmp_path):
    for name, data in FILES.items():
        path = tmp_path / "lake" / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(data)
    return f"file://{tmp_path}/lake"


def test_longest_path_wins(spark, root):
    got = {r["inside"]: r["dataset"] for r in match_files(list_below(spark, root), spark.createDataFrame(MANIFEST, SCHEMA)).collect()}
    assert got == {"a/one.csv": "A", "a/deep/er/two.csv": "A deep", "a/deep/er/three.csv": "A deep", "b +%/x y.csv": "B", "b +%/z.csv": "B", "c/none.bin": "C", "lone.csv": "D"}


def test_records_and_copies(spark, root, tmp_path):
    manifest = spark.createDataFrame(MANIFEST, SCHEMA)
    files = manifest_files(spark, manifest, root)
    got = {r["dataset"]: r for r in load_records(manifest, files).collect()}
    assert {d: (r["exists"], r["n_files"], r["n_tabular"], r["encodings"], r["warnings"]) for d, r in got.items()} == {
        "A": (True, 1, 1, "cp949", ""), "A deep": (True, 2, 2, "utf-8-sig", ""), "B": (True, 2, 2, "utf-8-sig", "headers_differ"),
        "C": (True, 1, 0, "", "no_tabular_file"), "D": (True, 1, 1, "utf-8-sig", "headerless"), "E": (False, 0, 0, None, "path_missing"), "F": (False, 0, 0, None, "path_missing")}
    assert got["A"]["size_bytes"] == len(FILES["a/one.csv"]) and got["A"]["size"] == f"{len(FILES['a/one.csv'])} B"
    with pytest.raises(ValueError):
        copy_normalised(spark, root, files, f"file://{tmp_path}/refused")
    target = f"file://{tmp_path}/copy"
    folders = copy_normalised(spark, root, files.filter("dataset != 'B'"), target)
    assert {tuple(r) for r in folders.collect()} == {("A", "A"), ("A deep", "A_deep"), ("D", "D")}
    rows = spark.read.option("header", "true").option("multiLine", "true").schema("id int, name string, folder string").csv(f"{target}/folder=A*").collect()
    assert sorted((r["id"], r["name"]) for r in rows) == [(1, "두\n줄"), (2, "셋"), (3, "x"), (4, "y")]
    assert [r[0] for r in spark.read.text(f"{target}/folder=D").collect()] == ["0.5,1", "2,3"]


def test_declared_encoding_that_fails(spark, root):
    manifest = spark.createDataFrame([("A", "a", "utf-8")], SCHEMA)
    assert load_records(manifest, manifest_files(spark, manifest, root)).first()["warnings"] == "headers_differ,encoding_mismatch"


def test_jobs_do_not_grow_with_the_manifest(spark, root):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"manifest-{n}", "")
        manifest = spark.createDataFrame([*MANIFEST, *[(f"x{i}", f"x/{i}", None) for i in range(n)]], SCHEMA)
        assert load_records(manifest, manifest_files(spark, manifest, root)).count() == n + len(MANIFEST)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"manifest-{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found
    assert abs(jobs(10_000) - jobs(10)) <= 2


def test_event_logs(spark, tmp_path):
    from millrace.sources.files import event_log_encodings
    for name, data in {"a.csv": b"a,b\n1,2\n", "k.csv": "가,나\n".encode("cp949"), "odd.csv": b"x\n\xff\xff\n", "Book.XLSX": b"PK", "log.bin": b"\x00"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["confidence"]) for r in event_log_encodings(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.csv": ("utf-8-sig", "high"), "k.csv": ("cp949", "high"), "odd.csv": ("unknown", "low"), "Book.XLSX": ("xlsx (multi-sheet)", "high"), "log.bin": ("unknown", "low")}
