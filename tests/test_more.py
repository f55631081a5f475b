"""Signals, catalog relations, context roll-ups, modelling helpers."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _signal(spark, n, seed=42):
    rng = np.random.default_rng(seed)
    x = np.sin(np.arange(n) * 2 * np.pi / 16) + rng.normal(0, 0.1, n)
    return x, spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "v": x}))


def test_window_mean_fft_rms_match_numpy(spark):
    from millrace.operators import signals as S
    x, df = _signal(spark, 9000)
    wm = S.window_mean_signal(df, "v", ["t"]).orderBy("pos").toPandas()
    nwin = 9000 // 4096
    exp = x[: nwin * 4096].reshape(nwin, 4096).mean(axis=0)
    assert np.allclose(wm["value"].to_numpy(), exp, atol=1e-12)
    sp = S.fft_spectrum(df, "v", ["t"]).orderBy("k").toPandas()
    mag = np.abs(np.fft.rfft(exp))
    step = len(mag) // 512
    assert np.allclose(sp["magnitude"].to_numpy(), mag[::step], atol=1e-9)
    assert math.isclose(sp["peak_freq"].iloc[0], np.fft.rfftfreq(4096)[::step][np.argmax(mag[::step])])
    rms = S.rms_trend(df, "v", ["t"]).orderBy("win").toPandas()
    w = max(8, 9000 // 64)
    exp_rms = np.sqrt((x[: (9000 // w) * w].reshape(-1, w) ** 2).mean(axis=1))
    assert np.allclose(rms["rms"].to_numpy(), exp_rms, atol=1e-12)


def test_constraint_history_actions(spark):
    from millrace.operators import catalog as K
    t1, t2, t3 = (F.expr(f"timestamp_seconds({s})") for s in (100, 200, 300))
    cur0 = spark.createDataFrame([], K.CONSTRAINT_SCHEMA)
    hist0 = spark.createDataFrame([], K.HISTORY_SCHEMA)
    new1 = spark.createDataFrame([("d", "a", '{"type":"range","min":1}', "u1"), ("d", "b", '{"type":"range","max":2}', "u1")],
                                 "datalake_id string, column_name string, constraint_spec string, approved_by string").withColumn("approved_at", t1)
    cur1, hist1 = K.constraint_upsert(cur0, hist0, new1)
    new2 = spark.createDataFrame([("d", "a", '{"type":"range","min":5}', "u2")],
                                 "datalake_id string, column_name string, constraint_spec string, approved_by string").withColumn("approved_at", t2)
    cur2, hist2 = K.constraint_upsert(cur1, hist1, new2)
    keys = spark.createDataFrame([("d", "a"), ("d", "zz")], "datalake_id string, column_name string")
    cur3, hist3 = K.constraint_delete(cur2, hist2, keys, "remover", t3)
    h = sorted((r["column_name"], r["action"], r["approved_by"], r["constraint_spec"]) for r in hist3.collect())
    assert h == [("a", "create", "u1", '{"type":"range","min":1}'), ("a", "delete", "remover", '{"type":"range","min":5}'),
                 ("a", "update", "u2", '{"type":"range","min":5}'), ("b", "create", "u1", '{"type":"range","max":2}')]
    assert [r["column_name"] for r in cur3.collect()] == ["b"]


def test_upsert_keeps_first_registration(spark):
    from millrace.operators import catalog as K
    old = spark.createDataFrame([("x", "s", "n", "order", "quality", "site1", "v", 1, "utf-8", "csv", "/p", True, "c")],
                                "datalake_id string, source string, name string, modality string, function string, site string, "
                                "vid string, size_bytes bigint, encoding string, format string, data_path string, "
                                "reusable_flag boolean, company string").withColumn("registered_at", F.expr("timestamp_seconds(10)"))
    new = old.withColumn("site", F.lit(None).cast("string")).withColumn("registered_at", F.expr("timestamp_seconds(99)"))
    r = K.upsert_full(old, new).first()
    assert r["site"] is None and r["registered_at"] == old.first()["registered_at"]


def test_drift_and_ordinals(spark):
    from millrace.operators import catalog as K
    src = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "x")], "datalake_id string, name string")
    cat = spark.createDataFrame([("d", "a"), ("d", "c")], "datalake_id string, name string")
    got = sorted(tuple(r) for r in K.schema_drift(src, cat).collect())
    assert got == [("d", "b", "missing_in_catalog"), ("d", "c", "missing_in_source"), ("e", "x", "missing_in_catalog")]
    meta = spark.createDataFrame([("d", "a", 0), ("d", "b", 0), ("e", "x", None)], "datalake_id string, name string, ordinal int")
    ok = {r["datalake_id"]: r["ok"] for r in K.ordinal_integrity(meta).collect()}
    assert ok == {"d": False, "e": False}


def test_findings_thresholds_and_chain(spark):
    from millrace.operators import context as CX
    k = "stage_order int, module_index int, module_function string"
    flags = spark.createDataFrame([(1, 0, "quality", "class_imbalance", "y", "4.50"), (1, 0, "quality", "mixed_dtype", "c", None)],
                                  k + ", flag string, column string, detail string")
    steps = spark.createDataFrame([(1, 0, "quality", "fill_missing", "a", "done", 1500, None),
                                   (1, 0, "quality", "fill_missing", "b", "done", 50, None),
                                   (2, 0, "process", "normalize_group", None, "done", None, "g")],
                                  k + ", operation string, target_column string, status string, before_nulls bigint, semantic_group string")
    issues = spark.createDataFrame([(2, 0, "process", "constraint", "medium", "x")], k + ", kind string, severity string, target string")
    f = CX.key_findings(flags, steps, issues)
    sev = {(r["type"], r["column"]): r["severity"] for r in f.collect()}
    assert sev[("class_imbalance", None)] == "high" and sev[("missing_values", "a")] == "high"
    assert sev[("missing_values", "b")] == "low" and sev[("dtype_mixed", None)] == "medium"
    stages = spark.createDataFrame([(1, "n1"), (2, "n2"), (3, "n3")], "stage_order int, node_id string")
    chain = {r["stage_order"]: r["downstream_implication"] for r in CX.stage_chain(f, stages).collect()}
    assert chain[3] == CX.NO_FINDING_IMPLICATION
    assert chain[1].startswith(CX.IMPLICATION_TEMPLATES["class_imbalance"])
    assert chain[2].startswith(CX.IMPLICATION_TEMPLATES["constraint_violation"])


def test_hash_sample_is_exact_k_smallest(spark):
    from millrace.operators.ml import hash_key, hash_sample
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = {r["k"] for r in hash_sample(df, 300, ["k"]).collect()}
    exp = {r["k"] for r in df.withColumn("h", hash_key(["k"])).orderBy("h").limit(300).collect()}
    assert got == exp and len(got) == 300


def test_split_and_metrics(spark):
    from millrace.operators.ml import classification_metrics, split_train_test
    df = spark.createDataFrame([(i, "A" if i % 10 else "B") for i in range(1000)], "id long, y string")
    s = {(r["y"], r["is_test"]): r["count"] for r in split_train_test(df, ["id"], "y").groupBy("y", "is_test").count().collect()}
    assert s == {("A", True): 180, ("A", False): 720, ("B", True): 20, ("B", False): 80}
    pred = spark.createDataFrame([("p", "p", 0.9), ("p", "n", 0.4), ("n", "n", 0.1), ("n", "p", 0.6), ("n", "n", 0.4)],
                                 "y string, yhat string, s double")
    m = classification_metrics(pred, "y", "yhat", "s", "p").first()
    assert math.isclose(m["accuracy"], 0.6)
    # AUC by pairs: pos scores .9,.4 vs neg .1,.6,.4 -> (3 + 0.5 + 1) / 6
    assert math.isclose(m["auc"], 4.5 / 6)


def test_train_and_save_model(spark):
    import tempfile
    from pyspark.ml.classification import RandomForestClassificationModel
    from millrace.operators.ml import train_model
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"id": range(400), "a": rng.normal(size=400), "b": rng.normal(size=400)})
    pdf["y"] = np.where(pdf["a"] + pdf["b"] > 0, "pos", "neg")
    path = tempfile.mkdtemp(prefix="mr-model-") + "/rf"
    res = train_model(spark.createDataFrame(pdf), "RandomForestClassifier", "y", ["id"],
                      {"n_estimators": 10, "max_depth": 4, "random_state": 7}, save_path=path)
    m = res["metrics"].first()
    assert m["accuracy"] > 0.8 and res["n_train"] + res["n_test"] == 400
    assert res["params"]["random_state"] == 42 and any("random_state" in n for n in res["notices"])
    assert RandomForestClassificationModel.load(path).numFeatures == len(res["features"])


def test_csv_with_given_header_reads_every_file(spark, tmp_path):
    """First lines all differ: the encodings and quoted line ends of every file
    count, not those of a few groups."""
    from millrace.sources.files import read_csv_safe
    for i in range(40):
        word, codec = ("한글자료", "cp949") if i % 8 == 3 else (f"w{i}", "utf-8")
        (tmp_path / f"f{i:02}.csv").write_bytes(f"id{i},name{i}\n{i},{word}\n".encode(codec) + (b'100,"two\nlines"\n' if i == 21 else b""))
    got = read_csv_safe(spark, str(tmp_path), headerless=False, header=["a", "b"], typed=False).collect()
    want = [(str(i), "한글자료" if i % 8 == 3 else f"w{i}") for i in range(40)] + [("100", "two\nlines")]
    assert sorted(map(tuple, got)) == sorted(want)
