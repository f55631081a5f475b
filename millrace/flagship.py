"""The end-to-end request: profile -> suggest -> gate -> run -> validate.

Used by ``entry`` (sf0.001), the ``run_plan`` query and ``bench.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.checks.common import messy_lineitem
from millrace.operators.profile import profile_pass
from millrace.plans.rules import resolve_constraints, semantic_groups_local, suggest_steps
from millrace.plans.runner import RunResult, run_plan
from millrace.functions.small import attach_row, small
from millrace.sources.tables import rebalance

# The request the flagship answers: a range constraint on the quantity and a
# pooled normalisation of the price block.
FLAGSHIP_CONSTRAINTS = {"L_QUANTITY": [1, 45]}
PRICE_GROUP = ("price_block", ["l_extendedprice", "l_discount", "l_tax"], "profile_group")


def flagship_plan(df: DataFrame, with_profile: bool = False):
    """Rule plan for ``df`` plus the user's group request. Profiling costs
    two passes (see profile_pass); the rule tables are tiny local frames."""
    spark = df.sparkSession
    prof, mixed, imb = profile_pass(df)
    groups = semantic_groups_local(spark, df.columns)  # schema metadata: no job
    cons = resolve_constraints(spark, FLAGSHIP_CONSTRAINTS, df.columns)  # names resolved once, on the driver
    plan = suggest_steps(prof, None, None, groups, cons)
    rows = [r.asDict() for r in plan.collect()]  # one row per step
    # the user's own group request is one more normalize step before the stats
    gname, members, strategy = PRICE_GROUP
    stats_order = max(r["order"] for r in rows)
    for r in rows:
        if r["operation"] == "compute_stats":
            r["order"] += 1
    rows.append(dict(order=stats_order, operation="normalize_group", target_column=None, permission_level="L2",
                     semantic_group=gname, group_members=members, strategy=strategy,
                     step_key=f"normalize_group:{gname}"))
    out = spark.createDataFrame([tuple(r[f.name] for f in plan.schema.fields) for r in rows], plan.schema)
    if with_profile:
        return out, prof
    return out


def run_flagship(df: DataFrame, approve_all: bool = True) -> RunResult:
    plan = flagship_plan(df)
    keys = [r["step_key"] for r in plan.select("step_key").collect()] if approve_all else []
    return run_plan(df, plan, approved_keys=keys, constraints=FLAGSHIP_CONSTRAINTS,
                    dataset_id="lineitem", run_id="flagship")


def flagship_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation report joined to the step results (one row per step)."""
    df = rebalance(messy_lineitem(spark, sf_dir), persist=True)
    r = run_flagship(df)
    rep = r.report.select("n_done", "n_failed", "n_pending", "n_high", "n_medium", "n_low", "passed", "next_action")
    steps = r.steps.select("order", "operation", "target_column", "semantic_group", "status",
                           "before_nulls", "after_nulls", "rows_before", "rows_after")
    # the report is a single row: attach its values to every step row (no join)
    return attach_row(steps, rep)
