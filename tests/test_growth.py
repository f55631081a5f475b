"""Work of one task that stays bounded as tables grow."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.checks import catalog as C
from millrace.functions.rowindex import held
from millrace.operators import catalog as K
from millrace.operators import ml as M


def _noted_fit(monkeypatch, kind):
    parts, fit = [], kind.fit

    def noted(self, rows, *a):
        parts.append([n for n in rows.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()])
        return fit(self, rows, *a)
    monkeypatch.setattr(kind, "fit", noted)
    return parts


@pytest.mark.parametrize("name", ["RandomForestRegressor", "RandomForestClassifier", "XGBoostClassifier"])
def test_fit_reads_bounded_partitions(spark, monkeypatch, name):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    parts = _noted_fit(monkeypatch, {"RandomForestRegressor": RandomForestRegressor, "RandomForestClassifier": RandomForestClassifier, "XGBoostClassifier": GBTClassifier}[name])
    monkeypatch.setattr(M, "FIT_ROWS_A_TASK", 100)
    rows = [(i, float(i * 7 % 100), float(i % 2) if name == "RandomForestRegressor" else "ab"[i % 100 > 60]) for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, b double, y " + ("double" if name == "RandomForestRegressor" else "string")).coalesce(1)
    res = M.train_model(df, name, "y", ["a"], {"n_estimators": 10, "max_depth": 3, "class_weight": "balanced"})
    assert res["metrics"].first()["n"] == res["n_test"] and res["n_train"] + res["n_test"] == 4000
    assert sum(parts[0]) == res["n_train"] and max(parts[0]) <= 120


def test_few_rows_stay_where_they_are(spark):
    df = spark.range(50).coalesce(1)
    assert M._in_tasks(df, 50) is df


def test_schema_drift_deals_names_by_number(spark, monkeypatch):
    monkeypatch.setattr(K, "NAMES_A_TASK", 20)
    kind = "datalake_id string, name string"
    src = spark.createDataFrame([("x", f"c{i}") for i in range(300)] * 2 + [("x", None), ("y", None), (None, "n"), ("z", "only")], kind)
    cat = spark.createDataFrame([("x", f"c{i}") for i in range(1, 301)] + [("x", None), (None, "n"), ("w", "q"), ("w", "q")], kind)
    got = K.schema_drift(src, cat)
    here, there = "missing_in_catalog", "missing_in_source"
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("x", "c0", here), ("x", "c300", there), ("z", "only", here), ("w", "q", there), ("y", None, here),
                                                               ("x", None, here), ("x", None, there), (None, "n", here), (None, "n", there)], key=str)
    assert got.rdd.getNumPartitions() >= 45  # 604 + 304 names over tasks of 20


@pytest.fixture
def orders(spark, tmp_path):
    spark.createDataFrame([(k, k % 37) for k in range(1, 1200)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_history_is_written_once(spark, orders):
    for version in C._history_flow(spark, orders):
        plan = version._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "get_json_object" not in plan


def test_cascade_matches_sql(spark, orders):
    got = sorted(map(tuple, C.Q["entry_delete_cascade"](spark, orders).select("relation", "n").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/orders.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT relation, n FROM ({C.SQL['entry_delete_cascade']})").fetchall())


@pytest.fixture
def many(monkeypatch):
    monkeypatch.setattr(M, "SPLIT_RANKED_ROWS", -1, raising=False)


def _noted_ranks(monkeypatch):
    counts, rank = [], M.rank_in_group
    monkeypatch.setattr(M, "rank_in_group", lambda df, *a, **b: (counts.append(df.count()), rank(df, *a, **b))[1])
    return counts


def _first_by_hash(df, keys, label, share):
    """What the split means, by a full sort: (id, is_test) of each row."""
    w = Window.partitionBy(label or F.lit(0))
    ranked = df.withColumn("rk", F.row_number().over(w.orderBy(M.hash_key(keys)))).withColumn("n", F.count(F.lit(1)).over(w))
    ranked = ranked.filter(F.col(label).isNotNull()) if label else ranked
    return {(r["id"], r["t"]) for r in ranked.select("id", (F.col("rk") <= F.ceil(F.col("n") * F.lit(share))).alias("t")).collect()}


@pytest.mark.parametrize("label", [None, "y"])
@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_split_ranks_only_where_a_class_is_cut(spark, monkeypatch, many, label, share):
    ranked = _noted_ranks(monkeypatch)
    rows = [(i, None if i % 50 == 0 else "rare" if i == 1 else "abc"[i % 7 % 3]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, y string")
    got = M.split_train_test(df, ["id"], label, share)
    assert {(r["id"], r["is_test"]) for r in got.collect()} == _first_by_hash(df, ["id"], label, share)
    assert got.columns == (["y", "id", "is_test"] if label else ["id", "y", "is_test"])
    assert sum(ranked) <= 100


def test_split_rows_stay_spread(spark, many):
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = M.split_train_test(spark.range(20_000).repartition(6), ["id"])
        assert max(got.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) < 15_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_split_of_rows_of_one_hash(spark, many):
    df = spark.range(4000).selectExpr("id", "IF(id < 3000, 0, id) AS k", "IF(id < 3500, 'a', 'b') AS y")
    assert {r["is_test"]: r["count"] for r in M.split_train_test(df, ["k"]).groupBy("is_test").count().collect()} == {True: 800, False: 3200}
    got = M.split_train_test(df, ["k"], "y")
    assert {(r["y"], r["is_test"]): r["count"] for r in got.groupBy("y", "is_test").count().collect()} == {("a", True): 700, ("a", False): 2800, ("b", True): 100, ("b", False): 400}
    assert sorted(r["id"] for r in got.collect()) == [*range(4000)]


def test_split_of_few_and_many_rows_is_the_same(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "id % 70 AS k", "IF(id % 9 = 0, NULL, id % 3) AS y")
    shown = lambda x: sorted(map(str, x.collect()))
    few = [M.split_train_test(df, ["k"], y) for y in (None, "y")]
    monkeypatch.setattr(M, "SPLIT_RANKED_ROWS", -1, raising=False)
    for y, x in zip((None, "y"), few, strict=True):
        got = M.split_train_test(df, ["k"], y)
        assert got.columns == x.columns and shown(got) == shown(x)


def test_split_of_no_rows(spark, many):
    df = spark.createDataFrame([], "id long, `y.z` string")
    assert M.split_train_test(df, ["id"]).collect() == M.split_train_test(df, ["id"], "y.z").collect() == []


def test_tasks_share_what_one_task_wrote(spark):
    df = spark.range(3_000_000).select("id", F.xxhash64("id").alias("a.b")).coalesce(1)
    back = held(df, "test")
    assert back.columns == ["id", "a.b"] and back.count() == 3_000_000
    assert sum(1 for n in back.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n) > 1
