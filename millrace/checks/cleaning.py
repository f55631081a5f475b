"""Registered queries: profiling and cleaning transforms (D1-D8, B3, B6,
F1-F4, J1-J5, J9, B22, C11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.checks.common import (EVENT_LABEL_SQL, MESSY_LINEITEM_SQL, event_labels,
                                    messy_lineitem)
from millrace.functions.scalars import slug, try_to_double
from millrace.operators import profile as P
from millrace.operators import transforms as X
from millrace.session import table

Q: dict = {}
SQL: dict = {}

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INF_RE = r"^\s*[+-]?(inf|infinity)\s*$"


def duck_to_double(x: str) -> str:
    """DuckDB twin of try_to_double."""
    return (f"CASE WHEN regexp_matches(CAST({x} AS VARCHAR), '{NUM_RE}') "
            f"OR regexp_matches(lower(CAST({x} AS VARCHAR)), '{INF_RE}') "
            f"THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END")


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


M = f"WITH m AS ({MESSY_LINEITEM_SQL})"
MESSY_COLS = [("l_orderkey", "integer"), ("l_linenumber", "integer"), ("l_quantity", "float"),
              ("l_extendedprice", "float"), ("qty_txt", "text"), ("l_discount", "float"),
              ("l_tax", "float"), ("l_returnflag", "text"), ("l_linestatus", "text")]


# --- D1 ---------------------------------------------------------------------
@q("profile_columns")
def _profile_columns(spark, sf):
    return P.profile_columns(messy_lineitem(spark, sf), approx=False).withColumn("ordinal", F.col("ordinal").cast("bigint"))


SQL["profile_columns"] = M + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST({i} AS BIGINT) AS ordinal, '{t}' AS dtype, count(*) AS n_rows, "
    f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique FROM m"
    for i, (c, t) in enumerate(MESSY_COLS))


@q("profile_numeric_only")
def _profile_numeric_only(spark, sf):
    """B2: the profile restricted to numeric columns (slim metadata)."""
    prof = P.profile_columns(messy_lineitem(spark, sf), approx=False)
    return (prof.filter(F.col("dtype").isin("integer", "float", "boolean"))
            .select("name", F.col("ordinal").cast("bigint").alias("ordinal"), "dtype", "null_count"))


SQL["profile_numeric_only"] = M + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST({i} AS BIGINT) AS ordinal, '{t}' AS dtype, count(*) - count({c}) AS null_count FROM m"
    for i, (c, t) in enumerate(MESSY_COLS) if t in ("integer", "float"))


# --- D2 ---------------------------------------------------------------------
@q("mixed_dtype")
def _mixed(spark, sf):
    return P.mixed_dtype(messy_lineitem(spark, sf))


SQL["mixed_dtype"] = M + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, round(CASE WHEN count({c}) > 0 THEN count({duck_to_double(c)}) / count({c}) ELSE 0.0 END, 3) "
    f"AS numeric_ratio, (count({duck_to_double(c)}) > 0 AND count({duck_to_double(c)}) < count({c})) AS mixed FROM m"
    for c, t in MESSY_COLS if t == "text")


# --- D3 ---------------------------------------------------------------------
@q("class_imbalance")
def _imb(spark, sf):
    return P.class_imbalance(event_labels(spark, sf))


SQL["class_imbalance"] = f"""
WITH e AS ({EVENT_LABEL_SQL}), c AS (SELECT judge, count(*) AS n FROM e GROUP BY judge)
SELECT 'judge' AS name, count(*) AS n_classes, round(min(n) / sum(n), 4) AS minority_ratio,
       (count(*) = 2 AND min(n) / sum(n) < 0.1) AS imbalanced FROM c"""


# --- D5 ---------------------------------------------------------------------
ORDERS_COLS = [("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True),
               ("o_orderdate", False), ("o_orderpriority", False)]


@q("compute_stats")
def _stats(spark, sf):
    return P.column_stats(table(spark, sf, "orders"), approx=False)


SQL["compute_stats"] = " UNION ALL ".join(
    (f"SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, "
     f"round(min({c}), 3) AS min, round(max({c}), 3) AS max, count(DISTINCT {c}) AS \"unique\" FROM orders")
    if num else
    (f"SELECT '{c}' AS name, count({c}) AS count, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
     f"CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, count(DISTINCT {c}) AS \"unique\" FROM orders")
    for c, num in ORDERS_COLS)


# --- D8 ---------------------------------------------------------------------
CUSTOMER_COLS = [("c_custkey", "integer", True), ("c_name", "text", False), ("c_nationkey", "integer", True),
                 ("c_acctbal", "float", True), ("c_mktsegment", "text", False)]


@q("eda_profile")
def _eda(spark, sf):
    p = P.eda_profile(table(spark, sf, "customer"), approx=False)
    return p.select("name", F.col("ordinal").cast("bigint").alias("ordinal"), "dtype", "n_rows", "null_count",
                    "n_unique", "is_numeric", F.round("range_min", 4).alias("range_min"),
                    F.round("range_max", 4).alias("range_max"), F.round("mean", 4).alias("mean"),
                    F.round("std", 4).alias("std"), "top_values")


def _eda_sql():
    parts = []
    for i, (c, t, num) in enumerate(CUSTOMER_COLS):
        base = (f"SELECT '{c}' AS name, CAST({i} AS BIGINT) AS ordinal, '{t}' AS dtype, count(*) AS n_rows, "
                f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique, {str(num).upper()} AS is_numeric, ")
        if num:
            parts.append(base + f"round(min({c}), 4) AS range_min, round(max({c}), 4) AS range_max, "
                                f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
                                f"CAST(NULL AS VARCHAR) AS top_values FROM customer")
        else:
            parts.append(base + "CAST(NULL AS DOUBLE) AS range_min, CAST(NULL AS DOUBLE) AS range_max, "
                                "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
                                f"(SELECT string_agg(v || ':' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, v) FROM "
                                f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL "
                                f"GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top_values FROM customer")
    return " UNION ALL ".join(parts)


SQL["eda_profile"] = _eda_sql()


# --- J1 ---------------------------------------------------------------------
@q("clean_masking")
def _mask(spark, sf):
    df = X.clean_masking(messy_lineitem(spark, sf), ["qty_txt"])
    return df.select("l_orderkey", "l_linenumber", "qty_txt")


MASK_LIST = "('*', '**', '***', '-', 'N/A', 'n/a', 'null', 'NULL', '')"
SQL["clean_masking"] = (M + f" SELECT l_orderkey, l_linenumber, CASE WHEN trim(qty_txt) IN {MASK_LIST} THEN NULL "
                        f"ELSE {duck_to_double('qty_txt')} END AS qty_txt FROM m")


# --- J2 ---------------------------------------------------------------------
@q("fill_missing_median")
def _fill_med(spark, sf):
    df = X.fill_missing(messy_lineitem(spark, sf), ["l_discount", "l_tax"])
    return df.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


SQL["fill_missing_median"] = (M + " SELECT l_orderkey, l_linenumber, "
                              "coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM m)) AS l_discount, "
                              "coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM m)) AS l_tax FROM m")


@q("fill_missing_median_wide")
def _fill_med_wide(spark, sf):
    """Exact median of a column with many different values."""
    df = messy_lineitem(spark, sf).withColumn(
        "l_extendedprice", F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_extendedprice")))
    vals = X.medians(df, ["l_extendedprice"])
    df = X.fill_missing(df, ["l_extendedprice"], vals)
    return df.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 4).alias("l_extendedprice"))


SQL["fill_missing_median_wide"] = (
    M + ", w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS p FROM m) "
    "SELECT l_orderkey, l_linenumber, round(coalesce(p, (SELECT quantile_cont(p, 0.5) FROM w)), 4) AS l_extendedprice FROM w")


@q("fill_missing_mode")
def _fill_mode(spark, sf):
    df = X.fill_missing(messy_lineitem(spark, sf), ["l_returnflag"])
    return df.select("l_orderkey", "l_linenumber", "l_returnflag")


SQL["fill_missing_mode"] = (M + ", md AS (SELECT l_returnflag AS v, count(*) AS n FROM m WHERE l_returnflag IS NOT NULL "
                            "GROUP BY 1 ORDER BY n DESC, v LIMIT 1) "
                            "SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, (SELECT v FROM md)) AS l_returnflag FROM m")


# --- J3 ---------------------------------------------------------------------
@q("normalize_group")
def _norm_group(spark, sf):
    df, _ = X.normalize_group(messy_lineitem(spark, sf), ["l_extendedprice", "l_discount", "l_tax"], "profile_group")
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in ("l_extendedprice", "l_discount", "l_tax")])


SQL["normalize_group"] = (M + ", cells AS (SELECT l_extendedprice AS x FROM m UNION ALL SELECT l_discount FROM m "
                          "UNION ALL SELECT l_tax FROM m), s AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM cells) "
                          "SELECT l_orderkey, l_linenumber, round((l_extendedprice - mu) / sd, 4) AS l_extendedprice, "
                          "round((l_discount - mu) / sd, 4) AS l_discount, round((l_tax - mu) / sd, 4) AS l_tax FROM m, s")


@q("normalize_zscore")
def _norm_z(spark, sf):
    df, _ = X.normalize_group(messy_lineitem(spark, sf), ["l_quantity", "l_tax", "qty_txt"], "single_zscore")
    return df.select("l_orderkey", "l_linenumber", F.round("l_quantity", 4).alias("l_quantity"),
                     F.round("l_tax", 4).alias("l_tax"), "qty_txt")


SQL["normalize_zscore"] = (M + ", s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_tax) AS mt, "
                           "stddev_samp(l_tax) AS st FROM m) SELECT l_orderkey, l_linenumber, "
                           "round((l_quantity - mq) / sq, 4) AS l_quantity, round((l_tax - mt) / st, 4) AS l_tax, qty_txt FROM m, s")


# --- B3 / B6 -------------------------------------------------------------------
@q("remove_outlier")
def _rm_outlier(spark, sf):
    df = X.remove_outlier(messy_lineitem(spark, sf), "qty_txt", [5, 40])
    return df.select("l_orderkey", "l_linenumber", "qty_txt")


SQL["remove_outlier"] = (M + f" SELECT l_orderkey, l_linenumber, qty_txt FROM m WHERE {duck_to_double('qty_txt')} IS NULL "
                         f"OR ({duck_to_double('qty_txt')} >= 5 AND {duck_to_double('qty_txt')} <= 40)")


@q("outlier_preview")
def _outlier_preview(spark, sf):
    return X.outlier_preview(messy_lineitem(spark, sf), "qty_txt", {"min": 5, "max": None})


SQL["outlier_preview"] = (M + f" SELECT 'qty_txt' AS column, count(CASE WHEN {duck_to_double('qty_txt')} < 5 THEN 1 END) "
                          "AS removed, count(*) AS total FROM m")


# --- D6 / D7 / J5 ---------------------------------------------------------------------
@q("class_weights")
def _weights(spark, sf):
    return X.class_weights(table(spark, sf, "events"), "event_type")


SQL["class_weights"] = """
WITH c AS (SELECT event_type AS class, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1),
t AS (SELECT sum(count) AS total, count(*) AS k FROM c)
SELECT class, count, round(count / total, 4) AS ratio, round(total / (k * count), 4) AS weight FROM c, t"""


@q("balance_preview")
def _bal_prev(spark, sf):
    return X.balance_preview(event_labels(spark, sf), "judge")


SQL["balance_preview"] = f"""
WITH e AS ({EVENT_LABEL_SQL}), c AS (SELECT judge, count(*) AS n FROM e GROUP BY judge),
s AS (SELECT count(CASE WHEN judge IS NOT NULL THEN 1 END) AS k, max(CASE WHEN judge IS NOT NULL THEN n END) AS mx,
      min(CASE WHEN judge IS NOT NULL THEN n END) AS mn, coalesce(sum(CASE WHEN judge IS NOT NULL THEN n END), 0) AS nn,
      coalesce(sum(n), 0) AS n_rows FROM c),
o AS (SELECT 'class_weight' AS option, n_rows AS rows_after, k, n_rows FROM s
      UNION ALL SELECT 'smote', n_rows - nn + mx * k, k, n_rows FROM s
      UNION ALL SELECT 'random_under', n_rows - nn + mn * k, k, n_rows FROM s
      UNION ALL SELECT 'skip', n_rows, k, n_rows FROM s)
SELECT option, k AS n_classes, n_rows AS rows_before, rows_after, rows_after - n_rows AS delta, k >= 2 AS applicable FROM o"""


@q("balance_under")
def _bal_under(spark, sf):
    df = X.balance_under(table(spark, sf, "events"), "event_type", ["event_id"], seed=42)
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


SQL["balance_under"] = """
WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1)
SELECT event_type, (SELECT min(n) FROM c) AS n FROM c"""


@q("balance_weight_column")
def _bal_w(spark, sf):
    df = X.balance_weight_column(table(spark, sf, "events"), "event_type")
    return df.select("event_id", "event_type", "class_weight")


SQL["balance_weight_column"] = """
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
SELECT e.event_id, e.event_type, round(t.total / (t.k * c.n), 4) AS class_weight FROM events e JOIN c USING (event_type), t"""


# --- declared-only operations --------------------------------------------------------
@q("drop_column")
def _drop(spark, sf):
    return X.drop_column(table(spark, sf, "customer"), ["c_name", "c_acctbal", "not_there"])


SQL["drop_column"] = "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"


@q("create_feature")
def _feature(spark, sf):
    df = X.create_feature(table(spark, sf, "lineitem"), "revenue", "round(l_extendedprice * (1 - l_discount), 4)")
    return df.select("l_orderkey", "l_linenumber", "revenue")


SQL["create_feature"] = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem"


@q("relabel")
def _relabel(spark, sf):
    df = X.relabel(table(spark, sf, "orders"), "o_orderstatus", {"F": "FINISHED", "O": "OPEN"})
    return df.select("o_orderkey", "o_orderstatus")


SQL["relabel"] = ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'OPEN' "
                  "ELSE o_orderstatus END AS o_orderstatus FROM orders")


@q("merge_external")
def _merge(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return X.merge_external(o, c, ["o_custkey"], "left")


SQL["merge_external"] = ("SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_mktsegment FROM orders o "
                         "LEFT JOIN customer c ON o.o_custkey = c.c_custkey")


# --- F1 / F4 -------------------------------------------------------------------------
TO_NUM_INPUTS = [
    ("a", "CAST(p_size AS STRING)"),
    ("b", "p_brand"),
    ("c", "concat(' ', CAST(p_size AS STRING), 'e1 ')"),
    ("d", "concat(CAST(p_size AS STRING), 'd')"),
    ("e", "concat('-.', CAST(p_size AS STRING))"),
    ("f", "CASE WHEN p_size > 45 THEN '-Infinity' WHEN p_size < 3 THEN 'nan' ELSE '1,000' END"),
]


@q("to_numeric")
def _to_num(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", *[f"{e} AS {a}" for a, e in TO_NUM_INPUTS])
    return p.select("p_partkey", *[try_to_double(a).alias(a) for a, _ in TO_NUM_INPUTS])


SQL["to_numeric"] = ("WITH p AS (SELECT p_partkey, " + ", ".join(f"{e} AS {a}" for a, e in TO_NUM_INPUTS) + " FROM part) "
                     "SELECT p_partkey, " + ", ".join(f"{duck_to_double(a)} AS {a}" for a, _ in TO_NUM_INPUTS) + " FROM p")


@q("slug")
def _slug(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", slug(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("slug"))


SQL["slug"] = ("SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(concat_ws(' ', p_name, p_brand, p_type))), "
               "'[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")


EV_TXT = ["event_id", "CASE WHEN event_type = 'error' THEN '*' ELSE CAST(value AS STRING) END AS v_txt",
          "CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind"]


@q("mixed_dtype_head")
def _mixed_head(spark, sf):
    """D2 with the reference's sample: the first 200 non-null values per text
    column in event_id order (distributed in-column rank)."""
    e = table(spark, sf, "events").selectExpr(*EV_TXT)
    return P.mixed_dtype(e, ["v_txt", "kind"], order_by=["event_id"], head_rows=200)


SQL["mixed_dtype_head"] = (
    "WITH e AS (SELECT " + ", ".join(x.replace("AS STRING", "AS VARCHAR") for x in EV_TXT) + " FROM events), "
    + ", ".join(f"h_{c} AS (SELECT {c} AS v FROM e WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 200)" for c in ("v_txt", "kind"))
    + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS name, round(CASE WHEN count(v) > 0 THEN count({duck_to_double('v')}) / count(v) ELSE 0.0 END, 3) "
        f"AS numeric_ratio, (count({duck_to_double('v')}) > 0 AND count({duck_to_double('v')}) < count(v)) AS mixed FROM h_{c}"
        for c in ("v_txt", "kind")))


@q("balance_smote")
def _smote(spark, sf):
    """Rows and key sums by class: the original rows, and the synthetic ones."""
    from millrace.operators.smote import balance_smote
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "NG").when(F.col("o_orderkey") % 77 != 0, "OK").alias("judge"), "o_totalprice", "o_orderstatus")
    out = balance_smote(o, "judge", ["o_orderkey"], ["o_totalprice"])
    return out.groupBy("judge", "is_synthetic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"),
                                                    F.sum(F.when(~F.col("is_synthetic"), F.col("o_orderkey"))).alias("keys"))


SQL["balance_smote"] = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'NG' WHEN o_orderkey % 77 <> 0 THEN 'OK' END AS judge FROM orders),
c AS (SELECT judge, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o GROUP BY 1)
SELECT judge, FALSE AS is_synthetic, n, n AS n_keys, keys FROM c
UNION ALL SELECT judge, TRUE, (SELECT max(n) FROM c WHERE judge IS NOT NULL) - n, least(n, (SELECT max(n) FROM c WHERE judge IS NOT NULL) - n), NULL FROM c
WHERE judge IS NOT NULL AND n < (SELECT max(n) FROM c WHERE judge IS NOT NULL)"""
