"""Registered queries: rules, plans, gate, pre-check, run and validation
(J10-J14, C4, C5, D16-D20, B5, B18, B19, J13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.checks.cleaning import duck_to_double
from millrace.checks.common import MESSY_LINEITEM_SQL, messy_lineitem
from millrace.flagship import FLAGSHIP_CONSTRAINTS, PRICE_GROUP, flagship_plan, run_flagship
from millrace.functions.small import small
from millrace.operators import profile as P
from millrace.operators import transforms as X
from millrace.operators import validate as V
from millrace.plans import rules as R
from millrace.session import table
from millrace.sources.tables import rebalance

Q: dict = {}
SQL: dict = {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def _case_chain(expr: str, rules, idx: int) -> str:
    parts = " ".join(f"WHEN regexp_matches({expr}, '{p}') THEN '{r[idx]}'" for p, *r in rules)
    return f"CASE {parts} ELSE '{R.UNKNOWN_GROUP[idx]}' END"


# --- J10 ----------------------------------------------------------------------
@q("semantic_groups")
def _groups(spark, sf):
    """The semantic groups of every dataset's columns."""
    from millrace.checks.catalog import columns_meta
    names = columns_meta(spark, sf).select(F.col("datalake_id").alias("table_name"), "name", "ordinal")
    g, s = R.classify_expr(F.col("name"))
    cls = names.withColumn("semantic_group", g).withColumn("strategy", s)
    return (cls.groupBy("table_name", "semantic_group", "strategy")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]),
                              ",").alias("members"),
                 F.count(F.lit(1)).alias("count")))


_NAME = "lower(trim(name))"


def _groups_sql() -> str:
    from millrace.checks.catalog import COLS_D
    rules = [(p, g, s) for p, g, s in R.SEMANTIC_RULES]
    return f"""
WITH c AS (SELECT datalake_id AS table_name, name, ordinal, {_case_chain(_NAME, rules, 0)} AS semantic_group, {_case_chain(_NAME, rules, 1)} AS strategy FROM ({COLS_D}))
SELECT table_name, semantic_group, strategy, string_agg(name, ',' ORDER BY ordinal) AS members, count(*) AS count FROM c GROUP BY table_name, semantic_group, strategy"""


SQL["semantic_groups"] = _groups_sql()


# --- J11 / J12 ----------------------------------------------------------------
def suggested_plan(spark, sf):
    df = rebalance(messy_lineitem(spark, sf), persist=True)
    prof, mixed, imb = P.profile_pass(df)
    groups = small(R.semantic_groups(R.names_frame(spark, df.columns)))
    cons = R.constraints_frame(spark, FLAGSHIP_CONSTRAINTS)
    return small(R.suggest_steps(prof, mixed, imb, groups, cons)), df, prof


def _plan_out(plan):
    return plan.select("order", "operation", "target_column", "permission_level", "semantic_group",
                       F.array_join("group_members", ",").alias("members"), "strategy", "step_key")


@q("suggest_steps")
def _suggest(spark, sf):
    plan, _, _ = suggested_plan(spark, sf)
    return _plan_out(plan)


_MESSY_TEXT = ["qty_txt", "l_returnflag", "l_linestatus"]
_MESSY_ALL = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "qty_txt", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus"]
_PERM_CASE = "CASE operation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.OPERATION_PERMISSION.items()) + " ELSE 'L3' END"


def _prof_sql() -> str:
    rows = []
    for i, c in enumerate(_MESSY_ALL):
        mixed = (f"(count({duck_to_double(c)}) > 0 AND count({duck_to_double(c)}) < count({c}))"
                 if c in _MESSY_TEXT else "FALSE")
        rows.append(f"SELECT '{c}' AS name, {i} AS ordinal, count(*) AS n_rows, count(*) - count({c}) AS nulls, "
                    f"{mixed} AS mixed FROM m")
    return " UNION ALL ".join(rows)


def _imb_sql() -> str:
    rows = []
    for i, c in enumerate(_MESSY_ALL):
        rows.append(f"SELECT '{c}' AS name, {i} AS ordinal, count(*) AS k, min(n) * 1.0 / sum(n) AS r "
                    f"FROM (SELECT {c} AS v, count(*) AS n FROM m WHERE {c} IS NOT NULL GROUP BY 1)")
    return " UNION ALL ".join(rows)


PLAN_CTE = f"""
m AS ({MESSY_LINEITEM_SQL}),
prof AS ({_prof_sql()}),
imb AS ({_imb_sql()}),
steps AS (
  SELECT 2 AS stage, ordinal AS minor, 'clean_masking' AS operation, name AS target_column FROM prof WHERE mixed
  UNION ALL SELECT 3, ordinal, 'fill_missing', name FROM prof WHERE nulls > 0 AND NOT mixed
  UNION ALL SELECT 4, ordinal, 'balance_classes', name FROM imb WHERE k = 2 AND round(r, 4) < 0.1
  UNION ALL SELECT 6, 0, 'remove_outlier', name FROM prof WHERE lower(name) = 'l_quantity'
  UNION ALL SELECT 7, 0, 'compute_stats', NULL),
plan AS (SELECT CAST(row_number() OVER (ORDER BY stage, minor) AS INTEGER) AS "order", operation, target_column,
                {_PERM_CASE} AS permission_level, CAST(NULL AS VARCHAR) AS semantic_group, CAST(NULL AS VARCHAR) AS members,
                CAST(NULL AS VARCHAR) AS strategy, operation || ':' || coalesce(target_column, 'global') AS step_key
         FROM steps)"""

SQL["suggest_steps"] = "WITH " + PLAN_CTE + " SELECT * FROM plan"


# --- C4 / C5 / B18 / D19 ----------------------------------------------------------
def _plan2(spark, sf):
    """The suggested plan reordered by step key, plus drop_column steps for
    columns with more than 10 % NULLs (data-derived)."""
    plan, df, prof = suggested_plan(spark, sf)
    drops = (prof.filter(F.col("null_count") > 0.1 * F.col("n_rows"))
             .select(F.lit(None).cast("int").alias("order"), F.lit("drop_column").alias("operation"),
                     F.col("name").alias("target_column"), F.lit(None).cast("string").alias("permission_level"),
                     F.lit(None).cast("string").alias("semantic_group"), F.lit(None).cast("array<string>").alias("group_members"),
                     F.lit(None).cast("string").alias("strategy"),
                     F.concat(F.lit("drop_column:"), F.col("name")).alias("step_key")))
    both = plan.unionByName(drops)
    from pyspark.sql import Window
    w = Window.orderBy("step_key")  # one row per step
    both = both.withColumn("order", F.row_number().over(w).cast("int"))
    return small(R.plan_permissions(both)), prof


PLAN2_CTE = PLAN_CTE + """,
drops AS (SELECT 'drop_column' AS operation, name AS target_column FROM prof WHERE nulls > 0.1 * n_rows),
both_ AS (SELECT operation, target_column FROM plan UNION ALL SELECT operation, target_column FROM drops),
plan2 AS (SELECT CAST(row_number() OVER (ORDER BY operation || ':' || coalesce(target_column, 'global')) AS INTEGER) AS "order",
                 operation, target_column, """ + _PERM_CASE + """ AS permission_level,
                 operation || ':' || coalesce(target_column, 'global') AS step_key FROM both_)"""


@q("plan_permissions")
def _perms(spark, sf):
    p, _ = _plan2(spark, sf)
    return p.select("order", "operation", "target_column", "permission_level", "step_key")


SQL["plan_permissions"] = "WITH " + PLAN2_CTE + " SELECT * FROM plan2"


@q("plan_approval_gate")
def _gate(spark, sf):
    plan, _, prof = suggested_plan(spark, sf)
    ok_cols = prof.filter(F.col("null_count") <= 0.1 * F.col("n_rows")).select(F.col("name").alias("target_column"))
    approved = plan.join(ok_cols, "target_column", "left_semi").select("step_key")
    return R.approval_gate(plan, approved).select("order", "step_key", "permission_level", "gate")


SQL["plan_approval_gate"] = "WITH " + PLAN_CTE + """,
ok AS (SELECT name FROM prof WHERE nulls <= 0.1 * n_rows),
appr AS (SELECT step_key FROM plan WHERE target_column IN (SELECT name FROM ok))
SELECT "order", step_key, permission_level,
       CASE WHEN permission_level = 'L1' OR step_key IN (SELECT step_key FROM appr) THEN 'run' ELSE 'awaiting_approval' END AS gate
FROM plan"""


@q("plan_filter")
def _pfilter(spark, sf):
    p, _ = _plan2(spark, sf)
    return R.plan_filter(p, "event-log").select("order", "operation", "target_column", "step_key")


SQL["plan_filter"] = "WITH " + PLAN2_CTE + """
SELECT "order", operation, target_column, step_key FROM plan2
WHERE operation IN ('balance_classes', 'fill_missing', 'compute_stats', 'remove_outlier')"""


@q("plan_precheck")
def _precheck(spark, sf):
    p, _ = _plan2(spark, sf)
    return R.plan_precheck(p)


_RANK_CASE = "CASE operation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.ORDER_RANK.items()) + f" ELSE {R.UNKNOWN_RANK} END"
SQL["plan_precheck"] = "WITH " + PLAN2_CTE + f""",
rk AS (SELECT *, {_RANK_CASE} AS rank FROM plan2),
pm AS (SELECT *, coalesce(max(CASE WHEN operation <> 'compute_stats' THEN rank END)
                   OVER (ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev_max_rank FROM rk)
SELECT "order", 'plan_order' AS kind, 'medium' AS severity, operation, target_column, rank, prev_max_rank FROM pm
WHERE operation <> 'compute_stats' AND rank < prev_max_rank
UNION ALL
SELECT "order", 'plan_conflict', 'high', operation, target_column, NULL, NULL FROM plan2
WHERE operation <> 'drop_column' AND target_column IN (SELECT target_column FROM plan2 WHERE operation = 'drop_column')
UNION ALL
SELECT "order", 'plan_l3_notice', 'low', operation, target_column, NULL, NULL FROM plan2 WHERE permission_level = 'L3'"""


# --- B19 ----------------------------------------------------------------------
_REQ_EXPRS = [
    "user_id AS session", "event_id AS pos",
    "CASE event_type WHEN 'view' THEN 'histogram' WHEN 'click' THEN 'pareto' WHEN 'error' THEN 'fft_spectrum' "
    "WHEN 'purchase' THEN 'word_cloud' ELSE 'scatter' END AS chart_type",
    "CASE WHEN user_id < 50 THEN 'timeseries' WHEN user_id < 100 THEN 'order' WHEN user_id < 150 THEN 'event-log' "
    "ELSE 'inspection-image' END AS modality",
]


@q("chart_filter")
def _chart_filter(spark, sf):
    req = table(spark, sf, "events").selectExpr(*_REQ_EXPRS)
    return R.chart_filter(req).select("session", "pos", "chart_type", "modality")


_CHART_VALUES = ", ".join(f"('{ct}', '{m}')" for ct, mods in R.CHART_MODALITIES.items() for m in mods)
SQL["chart_filter"] = f"""
WITH req AS (SELECT {", ".join(_REQ_EXPRS)} FROM events),
allowed AS (SELECT * FROM (VALUES {_CHART_VALUES}) t(chart_type, modality)),
ok AS (SELECT r.* FROM req r JOIN allowed a ON r.chart_type = a.chart_type AND r.modality = a.modality)
SELECT session, min(pos) AS pos, chart_type, modality FROM ok GROUP BY session, chart_type, modality"""


# --- J13 ----------------------------------------------------------------------
@q("profile_flags")
def _flags(spark, sf):
    from millrace.operators.context import profile_flags
    df = messy_lineitem(spark, sf)
    return profile_flags(P.profile_columns(df, approx=True), P.mixed_dtype(df), P.class_imbalance(df),
                         modality="event-log")


SQL["profile_flags"] = "WITH " + PLAN_CTE + """
SELECT 'mixed_dtype' AS flag, name AS column, CAST(NULL AS VARCHAR) AS detail FROM prof WHERE mixed
UNION ALL SELECT 'class_imbalance', name, printf('%.2f', round(r, 4) * 100) FROM imb WHERE k = 2 AND round(r, 4) < 0.1
UNION ALL SELECT 'missing_values', name, CAST(nulls AS VARCHAR) FROM prof WHERE nulls > 0"""


# --- B5 / D16 / D17 ---------------------------------------------------------------
VIOL_CONS = {"L_QUANTITY": [5, 40], "l_discount": {"min": 0.02, "max": None}, "no_such_column": [0, 1],
             "l_tax": [None, 0.05], "l_extendedprice": {"min": None, "max": None}}


@q("constraint_violations")
def _viol(spark, sf):
    df = table(spark, sf, "lineitem")
    cdf = R.constraints_frame(spark, VIOL_CONS)
    return V.constraint_violations(df, cdf, removed_columns=["l_tax"])


SQL["constraint_violations"] = """
SELECT 'L_QUANTITY' AS key, 'l_quantity' AS column, count(CASE WHEN l_quantity < 5 OR l_quantity > 40 THEN 1 END) AS n_violations,
       count(l_quantity) AS n_total,
       CASE WHEN count(CASE WHEN l_quantity < 5 OR l_quantity > 40 THEN 1 END) > 0 THEN 'medium' END AS severity, FALSE AS removed
FROM lineitem
UNION ALL SELECT 'l_discount', 'l_discount', count(CASE WHEN l_discount < 0.02 THEN 1 END), count(l_discount),
       CASE WHEN count(CASE WHEN l_discount < 0.02 THEN 1 END) > 0 THEN 'medium' END, FALSE FROM lineitem
UNION ALL SELECT 'no_such_column', NULL, 0, 0, 'low', FALSE
UNION ALL SELECT 'l_tax', 'l_tax', count(CASE WHEN l_tax > 0.05 THEN 1 END), count(l_tax),
       CASE WHEN count(CASE WHEN l_tax > 0.05 THEN 1 END) > 0 THEN 'low' END, TRUE FROM lineitem"""


@q("output_health")
def _health(spark, sf):
    df = table(spark, sf, "lineitem")
    out, info = X.normalize_group(df, ["l_quantity", "l_discount"], "sequence_preserve")
    out = out.withColumn("l_tax", F.col("l_tax") * F.lit(1e308) * F.lit(10.0)).withColumn("l_linenumber", F.lit(3))
    return V.output_health(out, touched=["l_quantity", "l_discount", "l_linenumber", "l_tax"],
                           groups=[("qty_disc", ["l_quantity", "l_discount"]), ("price", ["l_extendedprice", "l_suppkey"])])


SQL["output_health"] = """
WITH cells AS (SELECT l_quantity AS x FROM lineitem UNION ALL SELECT l_discount FROM lineitem),
s AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM cells),
pc AS (SELECT l_extendedprice AS x FROM lineitem UNION ALL SELECT CAST(l_suppkey AS DOUBLE) FROM lineitem),
ps AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM pc),
out AS (SELECT (l_quantity - s.mu) / s.sd AS q, (l_discount - s.mu) / s.sd AS d, l_tax * 1e308 * 10.0 AS t FROM lineitem, s)
SELECT 'output_health' AS kind, 'high' AS severity, CAST(NULL AS INTEGER) AS step_order, 'l_tax' AS target, 'inf' AS detail
FROM out HAVING max(CASE WHEN abs(t) = 'Infinity'::DOUBLE THEN 1 ELSE 0 END) = 1
UNION ALL SELECT 'output_health', 'high', NULL, 'l_linenumber', 'zero_std' FROM lineitem HAVING count(*) > 1
UNION ALL SELECT 'output_health', 'medium', NULL, 'price',
       'group_mean=' || printf('%.4f', mu) || ',group_std=' || printf('%.4f', sd) FROM ps
WHERE abs(mu) > 0.1 OR abs(sd - 1.0) > 0.1"""


@q("row_loss")
def _row_loss(spark, sf):
    df = table(spark, sf, "lineitem")
    out = X.remove_outlier(df, "l_quantity", [10, 12])
    a = df.agg(F.count(F.lit(1)).alias("n_before"))
    b = out.agg(F.count(F.lit(1)).alias("n_after"))
    from millrace.functions.small import attach_row
    r = attach_row(a, b)
    loss = V.row_loss(F.col("n_before"), F.col("n_after"))
    return r.select("n_before", "n_after", F.round(loss, 4).alias("loss"),
                    F.when(loss > V.ROW_LOSS_LIMIT, "high").alias("severity"))


SQL["row_loss"] = """
WITH a AS (SELECT count(*) AS n_before FROM lineitem),
b AS (SELECT count(*) AS n_after FROM lineitem WHERE l_quantity IS NULL OR (l_quantity >= 10 AND l_quantity <= 12))
SELECT n_before, n_after, round((n_before - n_after) * 1.0 / n_before, 4) AS loss,
       CASE WHEN (n_before - n_after) * 1.0 / n_before > 0.5 THEN 'high' END AS severity FROM a, b"""


# --- J14 / D18 / D20 ----------------------------------------------------------------
@q("run_plan")
def _run(spark, sf):
    """Statistics of the run's output, with exact distinct counts (the run itself
    estimates them)."""
    from millrace.operators.profile import column_stats
    df = rebalance(messy_lineitem(spark, sf), persist=True)
    return column_stats(run_flagship(df).output, approx=False)


def _run_sql() -> str:
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "qty_txt", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]
    stats = []
    for c in cols:
        if c in ("l_returnflag", "l_linestatus"):
            stats.append(f"SELECT '{c}' AS name, count({c}) AS count, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
                         f"CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, count(DISTINCT {c}) AS \"unique\" FROM o")
        else:
            stats.append(f"SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, "
                         f"round(min({c}), 3) AS min, round(max({c}), 3) AS max, count(DISTINCT {c}) AS \"unique\" FROM o")
    return "WITH " + _run_cte() + " " + " UNION ALL ".join(stats)


def _run_cte(with_m: bool = True) -> str:
    """CTE chain m -> a (masked) -> b (filled) -> c (outliers removed) -> o
    (price block normalised): the flagship run expressed in SQL."""
    gm = PRICE_GROUP[1]
    mask = ("('*', '**', '***', '-', 'N/A', 'n/a', 'null', 'NULL', '')")
    head = f"m AS ({MESSY_LINEITEM_SQL})," if with_m else ""
    return head + f"""
a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
             CASE WHEN trim(qty_txt) IN {mask} THEN NULL ELSE {duck_to_double('qty_txt')} END AS qty_txt,
             l_discount, l_tax, l_returnflag, l_linestatus FROM m),
md AS (SELECT l_returnflag AS v, count(*) AS n FROM a WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1),
b AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, qty_txt,
             coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM a)) AS l_discount,
             coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM a)) AS l_tax,
             coalesce(l_returnflag, (SELECT v FROM md)) AS l_returnflag, l_linestatus FROM a),
c AS (SELECT * FROM b WHERE l_quantity IS NULL OR (l_quantity >= 1 AND l_quantity <= 45)),
cells AS ({" UNION ALL ".join(f"SELECT {g} AS x FROM c" for g in gm)}),
s AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM cells),
o AS (SELECT l_orderkey, l_linenumber, l_quantity, (l_extendedprice - mu) / sd AS l_extendedprice, qty_txt,
             (l_discount - mu) / sd AS l_discount, (l_tax - mu) / sd AS l_tax, l_returnflag, l_linestatus FROM c, s)"""


SQL["run_plan"] = _run_sql()


@q("step_checks")
def _step_checks(spark, sf):
    df = rebalance(messy_lineitem(spark, sf), persist=True)
    plan = flagship_plan(df)
    keys = [r["step_key"] for r in plan.select("step_key").collect()]
    from millrace.plans.runner import run_plan
    r = run_plan(df, plan, approved_keys=keys, constraints=FLAGSHIP_CONSTRAINTS, validate=False)
    return V.step_checks(r.steps, plan)


SQL["step_checks"] = "WITH " + PLAN_CTE + f"""
SELECT 'integrity' AS kind, 'low' AS severity, "order" AS step_order, target_column AS target,
       'also in group normalisation' AS detail
FROM plan WHERE operation IN ('clean_masking', 'fill_missing')
AND target_column IN ({", ".join(f"'{m}'" for m in PRICE_GROUP[1])})"""


_NUM_OUT = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "qty_txt", "l_discount", "l_tax"]
_TOUCHED = ["qty_txt", "l_discount", "l_tax", "l_quantity"] + list(PRICE_GROUP[1])


def _report_sql() -> str:
    inf = " + ".join(f"max(CASE WHEN abs({c}) = 'Infinity'::DOUBLE THEN 1 ELSE 0 END)" for c in _NUM_OUT)
    zero = " + ".join(f"CASE WHEN count({c}) > 1 AND stddev_pop({c}) = 0 THEN 1 ELSE 0 END" for c in dict.fromkeys(_TOUCHED))
    members = ", ".join(f"'{m}'" for m in PRICE_GROUP[1])
    return "WITH " + PLAN_CTE + ", " + _run_cte(with_m=False) + f""",
h AS (SELECT {inf} AS n_inf, {zero} AS n_zero FROM o),
gc AS ({" UNION ALL ".join(f"SELECT {g} AS x FROM o" for g in PRICE_GROUP[1])}),
gh AS (SELECT CASE WHEN abs(avg(x)) > 0.1 OR abs(stddev_pop(x) - 1.0) > 0.1 THEN 1 ELSE 0 END AS n_group FROM gc),
ov AS (SELECT count(*) AS n_overlap FROM plan WHERE operation IN ('clean_masking', 'fill_missing') AND target_column IN ({members})),
cv AS (SELECT CASE WHEN count(CASE WHEN l_quantity < 1 OR l_quantity > 45 THEN 1 END) > 0 THEN 1 ELSE 0 END AS n_con FROM m),
rl AS (SELECT CASE WHEN ((SELECT count(*) FROM m) - (SELECT count(*) FROM o)) * 1.0 / (SELECT count(*) FROM m) > 0.5
                   THEN 1 ELSE 0 END AS n_loss),
t AS (SELECT (SELECT count(*) FROM plan) + 1 AS n_done, n_inf + n_zero + n_loss AS n_high, n_group AS n_medium,
             n_overlap + n_con AS n_low, n_inf + n_zero + n_group AS n_health, n_overlap, n_con, n_loss FROM h, gh, ov, cv, rl)
SELECT n_done, CAST(0 AS BIGINT) AS n_failed, CAST(0 AS BIGINT) AS n_pending, CAST(n_high AS BIGINT) AS n_high,
       CAST(n_medium AS BIGINT) AS n_medium, CAST(n_low AS BIGINT) AS n_low,
       TRUE AS check_compliance, TRUE AS check_transform, n_overlap = 0 AS check_integrity, n_loss = 0 AS check_regression,
       n_con = 0 AS check_constraint, n_health = 0 AS check_output_health, n_high = 0 AS passed,
       CASE WHEN n_high > 0 THEN 'retry_or_human' WHEN n_medium > 0 THEN 'review_recommended' ELSE 'ready_for_ml' END AS next_action
FROM t"""


SQL["validation_report"] = _report_sql()


@q("validation_report")
def _report(spark, sf):
    df = rebalance(messy_lineitem(spark, sf), persist=True)
    r = run_flagship(df)
    return r.report
