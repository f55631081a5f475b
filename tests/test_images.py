"""Image folders: rows of a nested folder, and work that doesn't take a task for every few files."""

import os

import pytest

from millrace.sources import images as I


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("pictures")
    image = I.fake_image_bytes("PNG", 40, 30, "RGB")
    files = {"top.PNG": image, "a/1.png": image, "a/1.txt": b"a", "a/deep/2.png": image, "a/3.png": b"damaged", "a/empty.png": b"", "a/.hidden.png": image, "_kept/4.png": image,
             "b=_1/_5=x.png": image, "b=_1/6.csv": b"x", "b=_1/no_ending": b"x", "b=_1/7.b.png": image, "b=_1/7.b.TXT": b"x"}
    files |= {f"many/{i}.png": image for i in range(120)}
    for name, data in files.items():
        os.makedirs(os.path.dirname(top / name), exist_ok=True)
        (top / name).write_bytes(data)
    (top / "nothing").mkdir()
    return str(top)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_nested_folder(spark, folder, scheme):
    got = {r["file"]: (r["width"], r["label"], r["has_txt_label"], r["error"]) for r in I.scan_images(spark, scheme + folder).filter("label IS NULL OR label <> 'many'").collect()}
    fine = lambda label, txt=False: (40, label, txt, None)
    assert got == {"top.PNG": fine(None), "a/1.png": fine("a", True), "a/deep/2.png": fine("a"), "a/3.png": (None, "a", False, "corrupt/unreadable"),
                   "b=_1/_5=x.png": fine("b=_1"), "b=_1/7.b.png": fine("b=_1", True)}


def test_same_files_as_spark_lists(spark, folder):
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").collect()
    assert sorted(r["file"] for r in I.list_files(spark, folder).collect()) == sorted(r["path"].removeprefix(f"file:{folder}/") for r in listed)


def _tasks(spark, work) -> int:
    sc = spark.sparkContext
    group = f"tasks-{os.urandom(4).hex()}"
    sc.setJobGroup(group, group)
    try:
        work()
    finally:
        sc._jsc.clearJobGroup()
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(told.getStageInfo, stages) if i)


def test_tasks_do_not_follow_the_files(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a task a file, as Spark's reader deals them
    try:
        few = spark.sparkContext.defaultParallelism
        opened = I.list_files(spark, folder)
        assert opened.count() == 130
        assert _tasks(spark, lambda: I.scan_images(spark, f"{folder}/many")) < 12 * few
        assert _tasks(spark, lambda: I.image_set_check(spark, f"{folder}/many").collect()) < 12 * few
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_set_check_counts(spark, folder):
    got = {(r["kind"], r["key"]): (r["n"], r["mismatch"]) for r in I.image_set_check(spark, folder, 126, {"png": 125}).collect()}
    assert got == {("format", "png"): (126, True), ("n_images", None): (126, False), ("label_files", None): (2, False)}
