"""Registered queries: modelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.checks.common import EVENT_LABEL_SQL, event_labels
from millrace.operators import ml as M
from millrace.session import table

Q: dict = {}
SQL: dict = {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


@q("prep_features")
def _prep(spark, sf):
    feats, names, _ = M.prepare_features(table(spark, sf, "orders"), "o_orderstatus", True, key_cols=["o_orderkey"])
    return feats


_LEVELS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SQL["prep_features"] = ("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, "
                        "coalesce(o_totalprice, 0.0) AS o_totalprice, "
                        + ", ".join(f"CASE WHEN o_orderpriority = '{lv}' THEN 1.0 ELSE 0.0 END AS \"o_orderpriority_{lv}\""
                                    for lv in _LEVELS)
                        + ", o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL")


@q("train_test_split")
def _split(spark, sf):
    o = table(spark, sf, "orders")
    s = M.split_train_test(o, ["o_orderkey"], "o_orderstatus")
    return s.groupBy("o_orderstatus", "is_test").agg(F.count(F.lit(1)).alias("n"))


SQL["train_test_split"] = """
WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1)
SELECT o_orderstatus, TRUE AS is_test, CAST(ceil(n * 0.2) AS BIGINT) AS n FROM c
UNION ALL SELECT o_orderstatus, FALSE, n - CAST(ceil(n * 0.2) AS BIGINT) FROM c"""


@q("train_row_cap")
def _cap(spark, sf):
    li = table(spark, sf, "lineitem")
    return M.hash_sample(li, M.ROW_SAMPLE_THRESHOLD, li.columns).agg(F.count(F.lit(1)).alias("n"))


SQL["train_row_cap"] = f"SELECT least(count(*), {M.ROW_SAMPLE_THRESHOLD}) AS n FROM lineitem"


def _pred_events(spark, sf):
    e = event_labels(spark, sf)
    return e.select(F.col("judge").alias("actual"), F.when(F.col("value") > 140, "NG").otherwise("OK").alias("predicted"),
                    F.col("value").alias("s"))


@q("classification_metrics")
def _cls_metrics(spark, sf):
    m = M.classification_metrics(_pred_events(spark, sf), "actual", "predicted", "s", "NG")
    return m.select("n", F.round("accuracy", 4).alias("accuracy"), F.round("f1_weighted", 4).alias("f1_weighted"),
                    F.round("auc", 4).alias("auc"))


_P = f"WITH e AS ({EVENT_LABEL_SQL}), p AS (SELECT judge AS actual, CASE WHEN value > 140 THEN 'NG' ELSE 'OK' END AS predicted, value AS s FROM e)"
SQL["classification_metrics"] = _P + """,
cm AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY ALL),
cls AS (SELECT actual AS c FROM cm UNION SELECT predicted FROM cm),
per AS (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE actual = c AND predicted = c), 0) AS tp,
               coalesce((SELECT sum(n) FROM cm WHERE actual = c), 0) AS support,
               coalesce((SELECT sum(n) FROM cm WHERE predicted = c), 0) AS npred FROM cls),
f AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS prec, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM per),
f1 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM f),
g AS (SELECT s, count(CASE WHEN actual = 'NG' THEN 1 END) AS pos, count(CASE WHEN actual <> 'NG' THEN 1 END) AS neg FROM p GROUP BY s),
c2 AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le FROM g),
auc AS (SELECT (sum(pos * (neg_le - neg)) + 0.5 * sum(pos * neg)) / (sum(pos) * sum(neg)) AS auc FROM c2)
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 4) AS accuracy,
       round(sum(f1 * support) / sum(support), 4) AS f1_weighted, round((SELECT auc FROM auc), 4) AS auc FROM f1"""


@q("confusion_matrix")
def _cm(spark, sf):
    return M.confusion(_pred_events(spark, sf), "actual", "predicted")


SQL["confusion_matrix"] = _P + " SELECT actual, predicted, count(*) AS n FROM p GROUP BY ALL"


def _metrics_row(res):
    m = res["metrics"]
    return m.select(*[F.round(c, 4).alias(c) if c != "n" else F.col(c) for c in m.columns]).withColumn(
        "n_train", F.lit(res["n_train"]).cast("long")).withColumn("n_test", F.lit(res["n_test"]).cast("long"))


@q("train_rf_reg")
def _rf_reg(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                                             "l_returnflag", "l_extendedprice")
    res = M.train_model(li, "RandomForestRegressor", "l_extendedprice", li.columns, {"n_estimators": 20, "max_depth": 8})
    return _metrics_row(res)


@q("train_rf_cls")
def _rf_cls(spark, sf):
    e = event_labels(spark, sf).select("user_id", "event_type", "value", "judge")
    res = M.train_model(e, "RandomForestClassifier", "judge", ["user_id", "event_type", "value"],
                        {"n_estimators": 20, "max_depth": 6})
    return _metrics_row(res)


@q("train_gbt_cls")
def _gbt(spark, sf):
    e = event_labels(spark, sf).select("user_id", "event_type", "value", "judge")
    res = M.train_model(e, "XGBoostClassifier", "judge", ["user_id", "event_type", "value"],
                        {"n_estimators": 20, "max_depth": 4, "learning_rate": 0.1})
    return _metrics_row(res)


@q("feature_importance")
def _imp(spark, sf):
    e = event_labels(spark, sf).select("user_id", "event_type", "value", "judge")
    res = M.train_model(e, "RandomForestClassifier", "judge", ["user_id", "event_type", "value"],
                        {"n_estimators": 20, "max_depth": 6})
    return res["importances"]


@q("isolation_forest")
def _iforest(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    res = M.train_model(li, "IsolationForest", None, li.columns, {"n_estimators": 50, "contamination": 0.05})
    return res["stats"].withColumn("anomaly_ratio", F.round(F.col("n_anomaly") / F.col("n_total"), 4)).withColumn(
        "contamination", F.lit(res["contamination"]))
