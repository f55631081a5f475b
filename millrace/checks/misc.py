"""Registered queries: ad-hoc guard, streaming, render rules, stages,
registration, reference checks and lineage (X1, 2.13, B1, F9, F11, B19, C7,
C9, C10, J15, L7, L8)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.checks.common import MESSY_LINEITEM_EXPRS, messy_lineitem
from millrace.checks.plans import PLAN_CTE, suggested_plan
from millrace.flagship import FLAGSHIP_CONSTRAINTS
from millrace.operators import render as RD
from millrace.operators.adhoc import guarded_query
from millrace.plans import rules as R
from millrace.plans import stages as ST
from millrace.session import scratch_path, table

Q: dict = {}
SQL: dict = {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def _dir(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


# --- X1 ---------------------------------------------------------------------------
ADHOC_SQL = ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS avg_qty, "
             "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM t GROUP BY l_returnflag, l_linestatus")


@q("guarded_query")
def _guarded(spark, sf):
    r = guarded_query(table(spark, sf, "lineitem"), ADHOC_SQL, "lineitem")
    if not r.ok:
        raise RuntimeError(r.reason)
    return r.result


SQL["guarded_query"] = ADHOC_SQL.replace("FROM t", "FROM lineitem")

REFUSED = [
    "DROP TABLE t",
    "SELECT * FROM lineitem",
    "SELECT my_udf(l_quantity) FROM t",
    "INSERT INTO t SELECT * FROM t",
    "SELECT * FROM t JOIN orders ON l_orderkey = o_orderkey",
    "SELECT " + "1 + " * 3000 + "1 FROM t",
    "SELECT l_orderkey, l_quantity FROM t",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM t",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME') FROM t",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM t",
    "SELECT * FROM parquet.`/data/other`",
    "WITH big AS (SELECT l_orderkey FROM t WHERE l_quantity > 49) SELECT count(*) AS n FROM big",
    "SELECT " + ", ".join(f"l_orderkey AS c{i}" for i in range(30)) + ", reflect('java.lang.System', 'getProperty', 'user.home') AS x FROM t",
    "SELECT TRANSFORM(l_orderkey) USING 'cat' AS (x string) FROM t",
    "SELECT * FROM (SELECT TRANSFORM(l_orderkey) USING 'cat' AS (x string) FROM t) s",
    "SELECT * FROM t WHERE l_orderkey IN (SELECT max(l_orderkey) FROM t WHERE l_tax = (SELECT java_method('java.lang.Math', 'random') FROM t LIMIT 1))",
    "SELECT l_orderkey FROM t WHERE EXISTS (SELECT 1 FROM (SELECT 1 AS a FROM customer) c)",
    "SELECT count(*) OVER (ORDER BY input_file_name()) FROM t",
    "SELECT l_orderkey FROM IDENTIFIER('lineitem')",
    "SELECT * FROM range(10)",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT * FROM r",
    "SELECT * FROM (WITH orders AS (SELECT 1 AS a) SELECT * FROM orders) x, orders",
    "WITH t AS (SELECT 1 AS a) SELECT * FROM t",
    "SELECT * FROM t WITH (`header` = 'true')",
    "SELECT * FROM t TABLESAMPLE (10 PERCENT)",
    "SELECT transform(array(1, 2), x -> reflect('java.lang.Math', 'abs', x)) FROM t",
    "SET spark.sql.shuffle.partitions = 1",
    "WITH a AS (SELECT l_linenumber AS n, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS big FROM t), b AS (SELECT n, sum(big) * 2 - 1 AS k FROM a GROUP BY n HAVING count(*) > 0) "
    "SELECT n, k, rank() OVER (ORDER BY k DESC) AS r FROM b WHERE k IN (SELECT max(k) FROM b) OR k BETWEEN -1 AND 100000000 UNION ALL SELECT 0, 0, 0 ORDER BY n LIMIT 5",
]


@q("guarded_query_rules")
def _guard_rules(spark, sf):
    """Each statement of a fixed refusal suite against the lineitem view:
    refused or run, reason, rows returned (capped at 200) and total."""
    li = table(spark, sf, "lineitem")
    rows = []
    for i, s in enumerate(REFUSED):
        r = guarded_query(li, s, "lineitem")
        rows.append((i, r.ok, (r.reason or "")[:80], r.result.count() if r.ok else None, r.total, r.truncated))
    return spark.createDataFrame(rows, "case int, ok boolean, reason string, returned bigint, total bigint, truncated boolean")


# --- 2.13 streaming ------------------------------------------------------------------
@q("stream_clean_filter")
def _stream(spark, sf):
    from millrace.streaming.clean_stream import run_available_now
    src = _dir(spark, "stream-src")
    messy = messy_lineitem(spark, sf)
    messy.write.mode("overwrite").parquet(src)
    out = run_available_now(spark, src, messy.schema, _dir(spark, "stream-sink"), _dir(spark, "stream-ckpt"),
                            mask_cols=["qty_txt"], bounds={"l_quantity": (1, 45)},
                            normalize={"l_extendedprice": (38000.0, 23000.0)})
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("qty_txt").alias("qty_non_null"),
                   F.round(F.max("l_quantity"), 4).alias("max_qty"))


from millrace.checks.cleaning import MASK_LIST, duck_to_double  # noqa: E402
from millrace.checks.common import MESSY_LINEITEM_SQL  # noqa: E402

SQL["stream_clean_filter"] = (f"WITH m AS ({MESSY_LINEITEM_SQL}), k AS (SELECT * FROM m WHERE l_quantity IS NULL OR "
                              f"(l_quantity >= 1 AND l_quantity <= 45)) SELECT count(*) AS n, count(CASE WHEN trim(qty_txt) "
                              f"IN {MASK_LIST} THEN NULL ELSE {duck_to_double('qty_txt')} END) AS qty_non_null, "
                              f"round(max(l_quantity), 4) AS max_qty FROM k")


# --- B1 / F9 / F11 -----------------------------------------------------------------
@q("sample_head")
def _head(spark, sf):
    return RD.sample_head(table(spark, sf, "orders"), ["o_orderkey"], 5).drop("o_orderdate")


SQL["sample_head"] = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders "
                      "ORDER BY o_orderkey LIMIT 5")


@q("flatten_struct")
def _flatten(spark, sf):
    from millrace.functions.rowindex import rank_in_group
    e = table(spark, sf, "events")
    # the three smallest user ids per type: distributed in-group rank, then a 3-element list
    first3 = (rank_in_group(e.select("event_type", "user_id"), ["event_type"], ["user_id"], "rk")
              .filter(F.col("rk") < 3).groupBy("event_type")
              .agg(F.array_sort(F.collect_list(F.struct("rk", "user_id"))).alias("pairs")))
    stats = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"),
                                        F.max("value").alias("max"))
    nested = stats.join(first3, "event_type", "left").select("event_type", F.struct(
        "n", F.struct("mean", "max").alias("stats"), F.transform("pairs", lambda x: x["user_id"]).alias("first_users"),
        F.transform("pairs", lambda x: F.struct(x["user_id"].alias("user"), F.array(x["rk"], x["rk"] + 1).alias("ranks"))).alias("pairs")).alias("v"))
    return RD.flatten_struct(nested, "event_type", "v")


SQL["flatten_struct"] = """
WITH g AS (SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS mx,
                  list_sort(list(user_id))[1:3] AS fu FROM events GROUP BY event_type)
SELECT event_type || ' · n' AS label, CAST(n AS VARCHAR) AS value FROM g
UNION ALL SELECT event_type || ' · stats · mean', CAST(mean AS VARCHAR) FROM g
UNION ALL SELECT event_type || ' · stats · max', CAST(mx AS VARCHAR) FROM g
UNION ALL SELECT event_type || ' · first_users[' || CAST(i - 1 AS VARCHAR) || ']', CAST(fu[i] AS VARCHAR)
FROM g, range(1, 4) r(i) WHERE i <= len(fu)
UNION ALL SELECT event_type || ' · pairs[' || CAST(i - 1 AS VARCHAR) || '] · user', CAST(fu[i] AS VARCHAR) FROM g, range(1, 4) r(i) WHERE i <= len(fu)
UNION ALL SELECT event_type || ' · pairs[' || CAST(i - 1 AS VARCHAR) || '] · ranks[' || CAST(j AS VARCHAR) || ']', CAST(i - 1 + j AS VARCHAR)
FROM g, range(1, 4) r(i), range(0, 2) s(j) WHERE i <= len(fu)"""


@q("spec_summary")
def _spec_summary(spark, sf):
    from millrace.checks.catalog import specs
    return specs(spark, sf).select("datalake_id", "column_name", RD.spec_summary(F.col("spec")).alias("summary"))


def _spec_summary_sql():
    from millrace.checks.catalog import SPECS_D
    g = lambda k: f"json_extract_string(spec, '$.{k}')"
    sfx = f"CASE WHEN {g('unit')} IS NOT NULL AND {g('unit')} <> '' THEN ' ' || {g('unit')} ELSE '' END"
    t = g("type")
    return (f"SELECT datalake_id, column_name, CASE WHEN spec IS NULL THEN '(none)' "
            f"WHEN {t} = 'range' THEN coalesce({g('min')}, '-inf') || ' ~ ' || coalesce({g('max')}, '+inf') || {sfx} "
            f"WHEN {t} = 'aggregate' THEN {g('metric')} || ' ' || {g('op')} || ' ' || {g('value')} || {sfx} "
            f"WHEN {t} = 'single_value' THEN {g('value')} || {sfx} ELSE spec END AS summary FROM ({SPECS_D})")


SQL["spec_summary"] = _spec_summary_sql()


# --- B19 fallback / C7 / C9 --------------------------------------------------------
NODE_OF_REGION = ("CASE r_name WHEN 'AFRICA' THEN 'injection_molding' WHEN 'AMERICA' THEN 'cnc_cutting' "
                  "WHEN 'ASIA' THEN 'press_forming' WHEN 'EUROPE' THEN 'semiconductor_inspect' ELSE 'pdm' END")
FUNC_OF_REGION = ("CASE r_regionkey WHEN 0 THEN 'process' WHEN 1 THEN 'quality' WHEN 2 THEN 'maintenance' "
                  "WHEN 3 THEN 'reference' ELSE 'process' END")


@q("chart_fallback")
def _fallback(spark, sf):
    rows = table(spark, sf, "region").selectExpr("r_regionkey", f"{FUNC_OF_REGION} AS function_axis").collect()
    out = None
    for r in rows:  # one row per region
        for mod in ("timeseries", "event-log", "order"):
            f = R.fallback_charts(spark, r["function_axis"], mod).select(
                F.lit(r["r_regionkey"]).alias("r_regionkey"), F.lit(mod).alias("modality"), "rank", "chart_type")
            out = f if out is None else out.unionByName(f)
    return out


def _fallback_sql():
    guide = []
    for axis, (prim, sec) in R.FUNCTION_CHART_GUIDE.items():
        for i, ct in enumerate(list(prim) + list(sec)):
            guide.append(f"('{axis}', {i}, '{ct}')")
    allowed = ", ".join(f"('{ct}', '{m}')" for ct, ms in R.CHART_MODALITIES.items() for m in ms)
    return f"""
WITH reg AS (SELECT r_regionkey, {FUNC_OF_REGION} AS function_axis FROM region),
mods AS (SELECT * FROM (VALUES ('timeseries'), ('event-log'), ('order')) t(modality)),
guide AS (SELECT * FROM (VALUES {", ".join(guide)}) t(function_axis, pos, chart_type)),
allowed AS (SELECT * FROM (VALUES {allowed}) t(chart_type, modality)),
c AS (SELECT reg.r_regionkey, mods.modality, guide.chart_type, guide.pos FROM reg, mods
      JOIN guide ON guide.function_axis = reg.function_axis
      JOIN allowed ON allowed.chart_type = guide.chart_type AND allowed.modality = mods.modality),
rk AS (SELECT *, row_number() OVER (PARTITION BY r_regionkey, modality ORDER BY pos) AS rank FROM c)
SELECT r_regionkey, modality, CAST(rank AS INTEGER) AS rank, chart_type FROM rk WHERE rank <= {R.FALLBACK_CHARTS}"""


SQL["chart_fallback"] = _fallback_sql()


@q("model_pool")
def _pool(spark, sf):
    stages = table(spark, sf, "region").selectExpr("r_regionkey AS stage_order", f"{NODE_OF_REGION} AS node_id")
    return ST.model_pool(stages)


SQL["model_pool"] = f"""
WITH st AS (SELECT DISTINCT {NODE_OF_REGION} AS node_id FROM region),
cat AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{m}', '{t}')" for n, ms in ST.NODE_MODELS.items() for m, t in ms)}) t(node_id, name, task))
SELECT cat.node_id, cat.name, cat.task, cat.name IN {tuple(ST.ADVISORY_MODELS)!r} AS advisory_only,
       NOT (cat.name IN {tuple(ST.ADVISORY_MODELS)!r}) AS fallback_ok FROM cat JOIN st USING (node_id)"""


@q("referential_check")
def _refcheck(spark, sf):
    hinted = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    known = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("id"))
    excluded = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    missing = ST.referential_check(hinted, known, excluded).withColumn("side", F.lit("hinted_unknown"))
    lines = ST.set_equality(table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("id")),
                            table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id")))
    return missing.select(F.col("id").cast("long").alias("id"), "side").unionByName(lines)


SQL["referential_check"] = """
WITH h AS (SELECT DISTINCT o_custkey AS id FROM orders),
k AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
a AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS id FROM customer), b AS (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS id FROM nation)
SELECT id, 'hinted_unknown' AS side FROM h WHERE id NOT IN (SELECT id FROM k)
UNION ALL SELECT id, 'only_left' FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT id, 'only_right' FROM b WHERE id NOT IN (SELECT id FROM a)"""


# --- L8 / C10 / J15 / L7 -----------------------------------------------------------
def _suggested_runs(spark, sf):
    """Two runs committed to one log: all steps approved, then none."""
    from millrace.plans.commits import CommitLog
    from millrace.plans.runner import run_plan
    plan, df, _ = suggested_plan(spark, sf)
    keys = [r["step_key"] for r in plan.select("step_key").collect()]
    log = CommitLog(spark, _dir(spark, "runs"))
    first = run_plan(df, plan, approved_keys=keys, constraints=FLAGSHIP_CONSTRAINTS, dataset_id="lineitem",
                     run_id="suggested", validate=False, log=log)
    run_plan(first.output, plan, approved_keys=[], constraints=FLAGSHIP_CONSTRAINTS, dataset_id="lineitem",
             run_id="again", validate=False, log=log)
    return log


@q("lineage_chain")
def _lineage(spark, sf):
    """The lineage of two runs as the log holds it, in the order of application."""
    from millrace.operators.catalog import lineage_chain
    chain = lineage_chain(_suggested_runs(spark, sf).appended("lineitem", "lineage"), "lineitem")
    place = F.row_number().over(Window.partitionBy("dataset_id").orderBy("version", "applied_at", "step_order")).cast("long")
    return chain.select("id", "version", place.alias("place"), "step_order", "transformation_type", "source_column", "result_column", "user_approval_id",
                        F.col("applied_at").rlike(r"^\d{4}-\d\d-\d\dT[0-9:]{8}\.\d{6}Z$").alias("timed"))


SQL["lineage_chain"] = "WITH " + PLAN_CTE + """
,
runs AS (SELECT 1 AS version, 'suggested' AS run_id, * FROM plan UNION ALL SELECT 2, 'again', * FROM plan WHERE permission_level = 'L1')
SELECT sha256('lineitem' || chr(31) || run_id || chr(31) || step_key || chr(31) || CAST("order" AS VARCHAR)) AS id, version,
       row_number() OVER (ORDER BY version, "order") AS place, "order" AS step_order, operation AS transformation_type, target_column AS source_column,
       target_column AS result_column, CASE WHEN version = 1 THEN 'ui-' || step_key END AS user_approval_id, TRUE AS timed FROM runs"""


@q("lineage_session")
def _lineage_session(spark, sf):
    log = _suggested_runs(spark, sf)
    modules = spark.createDataFrame([("lineitem",), (None,)], "datalake_id string")
    return ST.lineage_session(log.read("lineitem", "lineage", 1), modules, log.read("lineitem", "steps", 1))


SQL["lineage_session"] = "WITH " + PLAN_CTE + """,
rm AS (SELECT count(*) AS r FROM m WHERE NOT (l_quantity IS NULL OR (l_quantity >= 1 AND l_quantity <= 45)))
SELECT 'lineitem' AS dataset_id, row_number() OVER (ORDER BY "order") AS place, "order" AS step_order, operation AS transformation_type, target_column AS source_column,
       CASE WHEN operation = 'remove_outlier' THEN (SELECT r FROM rm) END AS removed_rows, TRUE AS approved FROM plan"""


@q("run_stages")
def _stages(spark, sf):
    """Regions as stages, nations as modules. The first call has approvals for
    region 0 and the first nations of region 1 and stops at the next one; the
    second has all and goes on there. Status rows, previews, and what each module's
    output holds."""
    from millrace.plans.commits import CommitLog
    from millrace.plans.stage_runs import run_stages
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").cast("int").alias("stage_order"), F.col("n_nationkey").cast("int").alias("module_index"),
                                                F.concat(F.lit("nation_"), F.col("n_nationkey")).alias("datalake_id"), F.col("n_nationkey").alias("c_nationkey"))
    modules = nations.drop("c_nationkey").unionByName(spark.createDataFrame([(0, 99, None)], "stage_order int, module_index int, datalake_id string"))
    customers = table(spark, sf, "customer")

    def load(stage):
        key = F.col("c_custkey")
        return customers.join(nations.filter(F.col("stage_order") == stage), "c_nationkey").select(
            "datalake_id", "c_custkey", F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
            F.when(key % 7 == 0, "N/A").otherwise(key.cast("string")).alias("bal_txt"), F.when(key % 23 == 0, "NG").otherwise("OK").alias("judge"),
            (key % 50).alias("packpressure1"), (key % 30 * 2).alias("packpressure2"))

    bounds = nations.select("datalake_id", F.lit("C_ACCTBAL").alias("column_name"), F.lit(0.0).alias("lo"), F.lit(9000.0).alias("hi"))
    every = spark.createDataFrame([(k,) for k in STAGE_KEYS], "step_key string")
    second = nations.filter("stage_order = 1").orderBy("module_index").select("module_index").limit(3).agg(F.max("module_index")).first()[0]
    some = every.crossJoin(F.broadcast(nations.filter((F.col("stage_order") == 0) | (F.col("stage_order") == 1) & (F.col("module_index") < second)).select("datalake_id")))
    log = CommitLog(spark, _dir(spark, "stages"))
    first = run_stages(log, "s", modules, load, some, bounds)
    last = run_stages(log, "s", modules, load, every, bounds)
    status = first.status.withColumn("call", F.lit(1)).unionByName(last.status.withColumn("call", F.lit(2)))
    previews = first.previews.select(F.lit("preview").alias("kind"), F.lit(1).alias("call"), "step_key", "option", "rows_before", "rows_after")
    out = log.appended("s", "output").groupBy("datalake_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("bal_txt").alias("n_bal"), F.round(F.sum("c_acctbal"), 3).alias("acctbal"), F.round(F.sum(F.col("bal_txt").cast("double")), 3).alias("bal"),
        F.round(F.sum(F.abs("packpressure1")), 3).alias("z1"), F.round(F.sum(F.abs("packpressure2")), 3).alias("z2"))
    steps = log.appended("s", "steps").select(F.lit("step").alias("kind"), "datalake_id", "order", "step_key", "before_nulls", "after_nulls", "rows_before", "rows_after")
    frames = [status.withColumn("kind", F.lit("status")), previews, out.withColumn("kind", F.lit("output")), steps]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("stage_order", "module_index", "call", "order")})


STAGE_KEYS = ["balance_classes:judge", "clean_masking:bal_txt", "fill_missing:c_acctbal", "normalize_group:pack_pressure_profile", "remove_outlier:c_acctbal"]

SQL["run_stages"] = """
WITH b AS (SELECT n_regionkey AS stage_order, n_nationkey AS module_index, 'nation_' || n_nationkey AS datalake_id, c_custkey AS k,
                  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal, c_custkey % 7 = 0 AS na, c_custkey % 23 = 0 AS ng, c_custkey % 50 AS p1, c_custkey % 30 * 2 AS p2
           FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT stage_order, module_index, datalake_id, count(*) AS n, count(*) - count(bal) AS nulls, quantile_cont(bal, 0.5) AS med, count(CASE WHEN na THEN 1 END) AS n_na,
             count(CASE WHEN ng THEN 1 END) AS n_ng, sum(p1 + p2) / (2.0 * count(*)) AS mu, sum(p1 * p1 + p2 * p2) / (2.0 * count(*)) AS sq FROM b GROUP BY ALL),
f AS (SELECT b.*, coalesce(bal, med) AS filled, (p1 - mu) / sqrt(sq - mu * mu) AS z1, (p2 - mu) / sqrt(sq - mu * mu) AS z2 FROM b JOIN m USING (datalake_id)),
r AS (SELECT datalake_id, count(*) AS kept FROM f WHERE filled <= 9000 GROUP BY 1),
s AS (SELECT datalake_id, 2 AS st, 'clean_masking:bal_txt' AS step_key, 0 AS before_nulls, n_na AS after_nulls, NULL AS rows_before, NULL AS rows_after FROM m WHERE n_na > 0 AND n_na < n
      UNION ALL SELECT datalake_id, 3, 'fill_missing:c_acctbal', nulls, 0, NULL, NULL FROM m WHERE nulls > 0
      UNION ALL SELECT datalake_id, 4, 'balance_classes:judge', NULL, NULL, NULL, NULL FROM m WHERE n_ng > 0 AND n_ng < n AND round(least(n_ng, n - n_ng) * 1.0 / n, 4) < 0.1
      UNION ALL SELECT datalake_id, 5, 'normalize_group:pack_pressure_profile', NULL, NULL, NULL, NULL FROM m
      UNION ALL SELECT datalake_id, 6, 'remove_outlier:c_acctbal', NULL, NULL, n, coalesce(kept, 0) FROM m LEFT JOIN r USING (datalake_id)
      UNION ALL SELECT datalake_id, 7, 'compute_stats:global', NULL, NULL, NULL, NULL FROM m),
stop AS (SELECT module_index FROM m WHERE stage_order = 1 ORDER BY module_index LIMIT 1 OFFSET 2),
w AS (SELECT datalake_id, string_agg(step_key, ',' ORDER BY step_key) AS waiting FROM s WHERE st < 7 GROUP BY 1),
status AS (
  SELECT 'status' AS kind, CASE WHEN stage_order = 0 OR (stage_order = 1 AND module_index < (SELECT * FROM stop)) THEN 1 ELSE 2 END AS call, stage_order, module_index, datalake_id,
         'done' AS status, 'ready_for_ml' AS detail FROM m
  UNION ALL SELECT 'status', 1, stage_order, module_index, datalake_id, 'awaiting_approval', waiting FROM m JOIN w USING (datalake_id) WHERE module_index = (SELECT * FROM stop)),
held AS (SELECT m.*, coalesce(kept, 0) AS kept FROM m LEFT JOIN r USING (datalake_id) WHERE module_index = (SELECT * FROM stop)),
raw AS (SELECT count(CASE WHEN bal IS NULL OR bal <= 9000 THEN 1 END) AS stays FROM b WHERE module_index = (SELECT * FROM stop)),
opts AS (SELECT unnest(['class_weight', 'smote', 'random_under', 'skip']) AS option),
p AS (SELECT step_key, option, n AS rows_before, CASE option WHEN 'smote' THEN 2 * greatest(n_ng, n - n_ng) WHEN 'random_under' THEN 2 * least(n_ng, n - n_ng) ELSE n END AS rows_after
      FROM held JOIN s USING (datalake_id), opts WHERE step_key = 'balance_classes:judge'
      UNION ALL SELECT step_key, NULL, n, CASE WHEN st = 6 THEN (SELECT stays FROM raw) END FROM held JOIN s USING (datalake_id) WHERE st IN (2, 3, 5, 6))
SELECT kind, CAST(call AS BIGINT) AS call, CAST(stage_order AS BIGINT) AS stage_order, CAST(module_index AS BIGINT) AS module_index, datalake_id, status, detail, CAST(NULL AS VARCHAR) AS step_key,
       CAST(NULL AS VARCHAR) AS option, CAST(NULL AS BIGINT) AS rows_before, CAST(NULL AS BIGINT) AS rows_after, CAST(NULL AS BIGINT) AS n_rows, CAST(NULL AS BIGINT) AS n_bal,
       CAST(NULL AS DOUBLE) AS acctbal, CAST(NULL AS DOUBLE) AS bal, CAST(NULL AS DOUBLE) AS z1, CAST(NULL AS DOUBLE) AS z2, CAST(NULL AS BIGINT) AS "order",
       CAST(NULL AS BIGINT) AS before_nulls, CAST(NULL AS BIGINT) AS after_nulls FROM status
UNION ALL SELECT 'preview', 1, NULL, NULL, NULL, NULL, NULL, step_key, option, rows_before, rows_after, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p
UNION ALL SELECT 'output', NULL, NULL, NULL, datalake_id, NULL, NULL, NULL, NULL, NULL, NULL, count(*), count(CASE WHEN NOT na THEN 1 END), round(sum(filled), 3),
       round(CAST(sum(CASE WHEN NOT na THEN k END) AS DOUBLE), 3), round(sum(abs(z1)), 3), round(sum(abs(z2)), 3), NULL, NULL, NULL FROM f WHERE filled <= 9000 GROUP BY datalake_id
UNION ALL SELECT 'step', NULL, NULL, NULL, datalake_id, NULL, NULL, step_key, NULL, rows_before, rows_after, NULL, NULL, NULL, NULL, NULL, NULL,
       row_number() OVER (PARTITION BY datalake_id ORDER BY st), before_nulls, after_nulls FROM s"""


@q("register_dataset")
def _register(spark, sf):
    """Registrations from CSV folders against a catalog with an entry a document:
    what each answers, and the catalog as it is afterwards."""
    from millrace.checks.catalog import entries
    from millrace.plans.commits import CommitLog
    from millrace.sources.files import write_csv
    log = CommitLog(spark, _dir(spark, "lake"))
    log.commit(ST.CATALOG, "load", {"entries": entries(spark, sf)})
    out = []
    for name, t, modality, fn in REGISTRATIONS:
        path = write_csv(table(spark, sf, t), _dir(spark, f"csv-{t}"))
        r = ST.register_dataset(log, name, path, modality, fn)
        rows = log.read(r["datalake_id"], "source").count() if r["status"] == "registered" else None
        out.append((name, r["datalake_id"], r["status"], r["reason"], r["n_columns"], rows, r["version"]))
    results = spark.createDataFrame(out, "name string, datalake_id string, status string, reason string, n_columns int, n_rows bigint, version int")
    now = log.read(ST.CATALOG, "entries").groupBy("modality").agg(F.count(F.lit(1)).alias("n_rows"))
    named = F.array_sort(F.collect_list(F.struct("ordinal", "name")))
    names = log.read(ST.CATALOG, "columns").groupBy("datalake_id").agg(
        F.array_join(F.transform(named, lambda c: c["name"]), ",").alias("reason"), F.count(F.lit(1)).cast("int").alias("n_columns"))
    return (results.unionByName(now.select(F.lit("entries").alias("name"), F.col("modality").alias("datalake_id"), "n_rows"), allowMissingColumns=True)
            .unionByName(names.select(F.lit("columns").alias("name"), "datalake_id", "reason", "n_columns"), allowMissingColumns=True))


REGISTRATIONS = [("Customer Master!", "customer", "order", "reference"), ("doc_1", "orders", "order", None), ("Orders 2024", "orders", "spreadsheet", None),
                 ("Events Log", "events", "event-log", "quality"), ("customer  MASTER", "nation", "order", None), ("Lines", "supplier", "order", "cooking")]

_REGISTERED = (("customer_master", "customer"), ("events_log", "events"))
SQL["register_dataset"] = """
WITH doc AS (SELECT count(*) > 0 AS taken FROM documents WHERE doc_id = 1),
nc AS (SELECT table_name, CAST(count(*) AS INTEGER) AS n, string_agg(column_name, ',' ORDER BY ordinal_position) AS names FROM information_schema.columns
       WHERE table_name IN ('customer', 'events') GROUP BY table_name),
e AS (SELECT CASE lang WHEN 'en' THEN 'timeseries' WHEN 'de' THEN 'event-log' WHEN 'fr' THEN 'order' ELSE 'inspection-image' END AS modality FROM documents
      UNION ALL SELECT 'order' UNION ALL SELECT 'event-log')
SELECT 'Customer Master!' AS name, 'customer_master' AS datalake_id, 'registered' AS status, CAST(NULL AS VARCHAR) AS reason,
       (SELECT n FROM nc WHERE table_name = 'customer') AS n_columns, (SELECT count(*) FROM customer) AS n_rows, 2 AS version
UNION ALL SELECT 'doc_1', 'doc_1', 'refused', 'id already registered', NULL, NULL, 2 FROM doc WHERE taken
UNION ALL SELECT 'Orders 2024', 'orders_2024', 'refused', 'modality not allowed: spreadsheet', NULL, NULL, 2
UNION ALL SELECT 'Events Log', 'events_log', 'registered', NULL, (SELECT n FROM nc WHERE table_name = 'events'), (SELECT count(*) FROM events), 3
UNION ALL SELECT 'customer  MASTER', 'customer_master', 'refused', 'id already registered', NULL, NULL, 3
UNION ALL SELECT 'Lines', 'lines', 'refused', 'function not allowed: cooking', NULL, NULL, 3
UNION ALL SELECT 'entries', modality, NULL, NULL, NULL, count(*), NULL FROM e GROUP BY modality
UNION ALL """ + " UNION ALL ".join(f"SELECT 'columns', '{d}', NULL, names, n, NULL, NULL FROM nc WHERE table_name = '{t}'" for d, t in _REGISTERED)


SQL["guarded_query_rules"] = """
SELECT * FROM (VALUES (0, FALSE, 'only a SELECT query is allowed', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), FALSE),
                      (1, FALSE, 'relation not allowed: [''lineitem'']', NULL, NULL, FALSE),
                      (2, FALSE, 'function not allowed: [''my_udf'']', NULL, NULL, FALSE),
                      (3, FALSE, 'only a SELECT query is allowed', NULL, NULL, FALSE),
                      (4, FALSE, 'relation not allowed: [''orders'']', NULL, NULL, FALSE),
                      (5, FALSE, 'too long', NULL, NULL, FALSE)) t("case", ok, reason, returned, total, truncated)
UNION ALL
SELECT 6, TRUE, '', least(count(*), 200), count(*), count(*) > 200 FROM lineitem
UNION ALL SELECT * FROM (VALUES (7, FALSE, 'function not allowed: [''reflect'']', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), FALSE),
                                (8, FALSE, 'function not allowed: [''java_method'']', NULL, NULL, FALSE),
                                (9, FALSE, 'function not allowed: [''try_reflect'']', NULL, NULL, FALSE),
                                (10, FALSE, 'relation not allowed: [''parquet./data/other'']', NULL, NULL, FALSE),
                                (11, TRUE, '', 1, 1, FALSE),
                                (12, FALSE, 'function not allowed: [''reflect'']', NULL, NULL, FALSE),
                                (13, FALSE, 'syntax not allowed: ScriptTransformation', NULL, NULL, FALSE),
                                (14, FALSE, 'syntax not allowed: ScriptTransformation', NULL, NULL, FALSE),
                                (15, FALSE, 'function not allowed: [''java_method'']', NULL, NULL, FALSE),
                                (16, FALSE, 'relation not allowed: [''customer'']', NULL, NULL, FALSE),
                                (17, FALSE, 'function not allowed: [''input_file_name'']', NULL, NULL, FALSE),
                                (18, FALSE, 'syntax not allowed: PlanWithUnresolvedIdentifier', NULL, NULL, FALSE),
                                (19, FALSE, 'table-valued functions are not allowed', NULL, NULL, FALSE),
                                (20, FALSE, 'recursive queries are not allowed', NULL, NULL, FALSE),
                                (21, FALSE, 'relation not allowed: [''orders'']', NULL, NULL, FALSE),
                                (22, FALSE, 't can''t be redefined', NULL, NULL, FALSE),
                                (23, FALSE, 'options are not allowed', NULL, NULL, FALSE),
                                (24, FALSE, 'syntax not allowed: Sample', NULL, NULL, FALSE),
                                (25, FALSE, 'function not allowed: [''reflect'']', NULL, NULL, FALSE),
                                (26, FALSE, 'only a SELECT query is allowed', NULL, NULL, FALSE)) t("case", ok, reason, returned, total, truncated)
UNION ALL
SELECT 27, TRUE, '', least(5, count(DISTINCT l_linenumber) + 1), least(5, count(DISTINCT l_linenumber) + 1), FALSE FROM lineitem"""
