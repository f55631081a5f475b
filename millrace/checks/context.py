"""Registered queries: multi-module run context.

The pipeline structure is derived from the tables: one stage per region, one
module per nation (index = nationkey div 5); a module has data when its
nation has at least 50 customers, and its rows are the orders of those
customers. Every module is profiled, planned, run and validated in grouped
aggregates (one pass for all modules, not a loop per module)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import context as CX
from millrace.session import table

Q: dict = {}
SQL: dict = {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


K = ["stage_order", "module_index", "module_function"]
_FUNC = ("CASE n.n_regionkey WHEN 0 THEN 'process' WHEN 1 THEN 'quality' WHEN 2 THEN 'maintenance' "
         "WHEN 3 THEN 'reference' ELSE 'process' END")
MODULES_SQL = f"""
SELECT n.n_regionkey AS stage_order, CAST(floor(n.n_nationkey / 5) AS INT) AS module_index, r.r_name AS node_id,
       {_FUNC} AS module_function,
       CASE WHEN c.nc >= 50 THEN concat('nation_', CAST(n.n_nationkey AS STRING)) END AS datalake_id,
       n.n_nationkey AS nation,
       CASE WHEN n.n_regionkey IN (0, 2) THEN 1 ELSE 0 END AS n_constraints,
       CASE WHEN n.n_regionkey = 3 THEN 'inspection-image' ELSE 'timeseries' END AS modality,
       concat('line_', CAST(r.r_regionkey AS STRING)) AS line_id,
       CASE WHEN floor(n.n_nationkey / 5) = 4 THEN 'line_x' WHEN floor(n.n_nationkey / 5) = 3 THEN NULL
            ELSE concat('line_', CAST(r.r_regionkey AS STRING)) END AS client_vid
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY c_nationkey) c ON c.c_nationkey = n.n_nationkey"""

ROWS_SQL = f"""
SELECT m.stage_order, m.module_index, m.module_function,
       CASE WHEN o.o_orderpriority = '5-LOW' AND cu.c_nationkey < 10 THEN '*' ELSE CAST(o.o_orderkey AS STRING) END AS price_txt,
       NULLIF(o.o_orderstatus, 'P') AS status,
       CASE WHEN o.o_totalprice > 485000 THEN 'Y' ELSE 'N' END AS big,
       o.o_totalprice
FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey
JOIN ({MODULES_SQL}) m ON m.nation = cu.c_nationkey
WHERE m.datalake_id IS NOT NULL"""


def _views(spark, sf):
    for t in ("nation", "region", "customer", "orders"):
        table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(MODULES_SQL), spark.sql(ROWS_SQL)


def _module_results(spark, sf):
    mods, rows = _views(spark, sf)
    prof = CX.grouped_profile(rows, K, ["price_txt", "status", "big", "o_totalprice"], ["price_txt", "status", "big"])
    imb = CX.grouped_minority(rows, K, "big")
    null_s = F.lit(None).cast("string")
    flags = (prof.filter("mixed").select(*K, F.lit("mixed_dtype").alias("flag"), F.col("name").alias("column"),
                                         null_s.alias("detail"))
             .unionByName(imb.filter((F.col("n_classes") == 2) & (F.col("minority_ratio") < 0.1)).select(
                 *K, F.lit("class_imbalance").alias("flag"), F.lit("big").alias("column"),
                 F.format_string("minority %.2f%%", F.col("minority_ratio") * 100).alias("detail"))))
    mixed_cols = prof.filter("mixed").select(*K, F.col("name").alias("target_column"))
    steps = (mixed_cols.select(*K, F.lit("clean_masking").alias("operation"), "target_column",
                               F.lit(None).cast("long").alias("before_nulls"))
             .unionByName(prof.filter((F.col("null_count") > 0) & ~F.col("mixed")).select(
                 *K, F.lit("fill_missing").alias("operation"), F.col("name").alias("target_column"),
                 F.col("null_count").alias("before_nulls")))
             .unionByName(imb.filter((F.col("n_classes") == 2) & (F.col("minority_ratio") < 0.1)).select(
                 *K, F.lit("balance_classes").alias("operation"), F.lit("big").alias("target_column"),
                 F.lit(None).cast("long").alias("before_nulls")))
             .withColumn("status", F.lit("done")).withColumn("semantic_group", null_s))
    viol = rows.groupBy(*K).agg(F.count(F.when(F.col("o_totalprice") > 400000, 1)).alias("nv"))
    issues = viol.filter(F.col("nv") > 0).select(*K, F.lit("constraint").alias("kind"), F.when(F.col("nv") % 3 == 0, "high").otherwise("medium").alias("severity"),
                                                 F.lit("o_totalprice").alias("target"))
    return mods, flags, steps, issues


@q("key_findings")
def _findings(spark, sf):
    _, flags, steps, issues = _module_results(spark, sf)
    return CX.key_findings(flags, steps, issues)


_KD = "stage_order, module_index, module_function"
_KF_CTE = f"""rws AS ({ROWS_SQL.replace("AS STRING", "AS VARCHAR")}),
mix AS (SELECT {_KD}, 'price_txt' AS name, count(price_txt) AS nn,
               count(CASE WHEN regexp_matches(price_txt, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN 1 END) AS nm
        FROM rws GROUP BY ALL),
imb AS (SELECT {_KD}, count(*) AS k, round(min(n) / sum(n), 4) AS r FROM (SELECT {_KD}, big, count(*) AS n FROM rws GROUP BY ALL) GROUP BY ALL),
nul AS (SELECT {_KD}, count(*) - count(status) AS nb FROM rws GROUP BY ALL),
vio AS (SELECT {_KD}, count(CASE WHEN o_totalprice > 400000 THEN 1 END) AS nv FROM rws GROUP BY ALL)"""
_KF_SELECT = f"""
SELECT {_KD}, 'dtype_mixed' AS type, CAST(NULL AS VARCHAR) AS column, 'medium' AS severity, 'mixed_dtype:price_txt' AS detail
FROM mix WHERE nm > 0 AND nm < nn
UNION ALL
SELECT {_KD}, 'class_imbalance', NULL, CASE WHEN r * 100 < 5.0 THEN 'high' ELSE 'medium' END,
       'class_imbalance:big:minority ' || printf('%.2f', r * 100) || '%' FROM imb WHERE k = 2 AND r < 0.1
UNION ALL
SELECT {_KD}, 'transformation_applied', 'price_txt', 'low', 'clean_masking:price_txt' FROM mix WHERE nm > 0 AND nm < nn
UNION ALL
SELECT {_KD}, 'missing_values', 'status', CASE WHEN nb > 1000 THEN 'high' WHEN nb > 100 THEN 'medium' ELSE 'low' END,
       'fill_missing:status:' || CAST(nb AS VARCHAR) FROM nul WHERE nb > 0
UNION ALL
SELECT {_KD}, 'class_imbalance', 'big', 'high', 'balance_classes:big' FROM imb WHERE k = 2 AND r < 0.1
UNION ALL
SELECT {_KD}, 'constraint_violation', NULL, 'medium', 'constraint:o_totalprice' FROM vio WHERE nv > 0"""
SQL["key_findings"] = "WITH " + _KF_CTE + _KF_SELECT


@q("stage_chain")
def _chain(spark, sf):
    mods, flags, steps, issues = _module_results(spark, sf)
    stages = mods.select("stage_order", "node_id").distinct()
    chain = CX.stage_chain(CX.key_findings(flags, steps, issues), stages)
    return chain.withColumn("main_findings", F.array_join("main_findings", "|"))


@q("function_axis")
def _axis(spark, sf):
    _, flags, steps, issues = _module_results(spark, sf)
    return CX.function_axis(CX.key_findings(flags, steps, issues))


SQL["function_axis"] = f"WITH {_KF_CTE}, f AS ({_KF_SELECT}) SELECT module_function, severity, count(*) AS n FROM f GROUP BY ALL"

_RANK_D = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CX.SEVERITY_RANK.items()) + " ELSE 0 END"
_TMPL_D = "CASE type " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in CX.IMPLICATION_TEMPLATES.items()) + " END"
SQL["stage_chain"] = f"""
WITH {_KF_CTE}, f AS ({_KF_SELECT}),
st AS (SELECT DISTINCT stage_order, node_id FROM ({MODULES_SQL.replace('AS STRING', 'AS VARCHAR')})),
nf AS (SELECT stage_order, string_agg(type || '(' || severity || ')' || coalesce(': ' || "column", ''), '|' ORDER BY module_index, type, coalesce("column", '')) AS found FROM f GROUP BY stage_order),
ty AS (SELECT stage_order, type, max({_RANK_D}) AS r FROM f GROUP BY stage_order, type),
im AS (SELECT stage_order, string_agg({_TMPL_D}, ' ' ORDER BY -r, type) AS txt FROM ty GROUP BY stage_order)
SELECT st.stage_order, st.node_id, coalesce(nf.found, '') AS main_findings,
       coalesce(nullif(im.txt, ''), '{CX.NO_FINDING_IMPLICATION}') AS downstream_implication
FROM st LEFT JOIN nf USING (stage_order) LEFT JOIN im USING (stage_order)"""

SQL["agent_records"] = f"""
WITH {_KF_CTE},
mods AS ({MODULES_SQL.replace('AS STRING', 'AS VARCHAR')}),
fl AS (SELECT stage_order, module_index, string_agg(x, '|' ORDER BY x) AS flags FROM (
         SELECT stage_order, module_index, 'mixed_dtype:price_txt' AS x FROM mix WHERE nm > 0 AND nm < nn
         UNION ALL SELECT stage_order, module_index, 'class_imbalance:big' FROM imb WHERE k = 2 AND r < 0.1) GROUP BY ALL),
sp AS (SELECT stage_order, module_index, string_agg(x, '|' ORDER BY x) AS steps FROM (
         SELECT stage_order, module_index, 'clean_masking:price_txt' AS x FROM mix WHERE nm > 0 AND nm < nn
         UNION ALL SELECT stage_order, module_index, 'fill_missing:status' FROM nul WHERE nb > 0
         UNION ALL SELECT stage_order, module_index, 'balance_classes:big' FROM imb WHERE k = 2 AND r < 0.1) GROUP BY ALL),
iss AS (SELECT stage_order, module_index, count(CASE WHEN nv % 3 = 0 THEN 1 END) AS n_high, count(CASE WHEN nv % 3 <> 0 THEN 1 END) AS n_medium FROM vio WHERE nv > 0 GROUP BY ALL)
SELECT m.stage_order, m.module_index, m.module_function, m.datalake_id, m.modality, fl.flags, sp.steps,
       coalesce(iss.n_high, 0) AS n_high, coalesce(iss.n_medium, 0) AS n_medium, coalesce(iss.n_high, 0) = 0 AS passed
FROM mods m LEFT JOIN fl USING (stage_order, module_index) LEFT JOIN sp USING (stage_order, module_index)
LEFT JOIN iss USING (stage_order, module_index) WHERE m.datalake_id IS NOT NULL"""


@q("agent_records")
def _records(spark, sf):
    return CX.agent_records(*_module_results(spark, sf)).select(
        "stage_order", "module_index", "module_function", "datalake_id", "modality", "flags", "steps", "n_high", "n_medium", "passed")


@q("module_counts")
def _counts(spark, sf):
    mods, _ = _views(spark, sf)
    return CX.module_counts(mods)


SQL["module_counts"] = (f"SELECT count(*) AS modules_total, count(datalake_id) AS modules_with_data, "
                        f"count(CASE WHEN n_constraints > 0 THEN 1 END) AS modules_with_constraints "
                        f"FROM ({MODULES_SQL.replace('AS STRING', 'AS VARCHAR')})")


@q("missing_module_alarm")
def _alarm(spark, sf):
    mods, _ = _views(spark, sf)
    return CX.missing_module_alarm(mods)


SQL["missing_module_alarm"] = (f"SELECT stage_order, array_to_string(list_sort(list(CAST(module_index AS VARCHAR))), ',') "
                               f"AS missing_modules, count(*) AS n_missing FROM ({MODULES_SQL.replace('AS STRING', 'AS VARCHAR')}) "
                               f"WHERE datalake_id IS NULL GROUP BY stage_order")


@q("pick_target")
def _pick(spark, sf):
    mods, _ = _views(spark, sf)
    return CX.pick_target(mods)


SQL["pick_target"] = (f"SELECT stage_order, module_index, datalake_id, modality FROM ({MODULES_SQL.replace('AS STRING', 'AS VARCHAR')}) "
                      "WHERE datalake_id IS NOT NULL AND modality <> 'inspection-image' ORDER BY stage_order, module_index LIMIT 1")


@q("vid_propagation")
def _vid(spark, sf):
    mods, _ = _views(spark, sf)
    return CX.vid_propagation(mods)


SQL["vid_propagation"] = (f"SELECT stage_order, module_index, line_id, client_vid, coalesce(client_vid, line_id) AS vid, "
                          "(client_vid IS NOT NULL AND line_id IS NOT NULL AND client_vid <> line_id) AS mismatch "
                          f"FROM ({MODULES_SQL.replace('AS STRING', 'AS VARCHAR')})")


_PURPOSE_EXPR = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'anomaly_detection' WHEN '2-HIGH' THEN 'quality_classification' "
                 "WHEN '3-MEDIUM' THEN 'process_optimization' WHEN '4-NOT SPECIFIED' THEN 'demand_forecasting' "
                 "ELSE 'statistical_comparison' END")
_NODE_EXPR = ("CASE o_orderstatus WHEN 'F' THEN 'surface_inspect' WHEN 'O' THEN 'order_planning' ELSE 'press_line' END")


@q("axis_lookup")
def _axis_lookup(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_PURPOSE_EXPR} AS purpose", f"{_NODE_EXPR} AS node_id",
                                              "CASE WHEN o_totalprice > 480000 THEN 'event-log' END AS explicit_modality")
    return CX.axis_lookup(o, "purpose", "node_id", "explicit_modality").select("o_orderkey", "purpose", "function_axis", "modality")


SQL["axis_lookup"] = f"""
WITH o AS (SELECT o_orderkey, {_PURPOSE_EXPR} AS purpose, {_NODE_EXPR} AS node_id,
                  CASE WHEN o_totalprice > 480000 THEN 'event-log' END AS explicit_modality FROM orders)
SELECT o_orderkey, purpose,
       CASE purpose {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CX.PURPOSE_FUNCTION.items())} END AS function_axis,
       coalesce(explicit_modality, CASE node_id {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CX.NODE_MODALITY.items())} END,
                '{CX.DEFAULT_MODALITY}') AS modality
FROM o"""
