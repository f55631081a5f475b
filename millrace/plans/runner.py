"""Run a plan on one lazy DataFrame.

Transforms are chained on a single DataFrame. Row-removing steps only *tag*
rows (``__rm`` = order of the first step that removed it) so that one final
aggregate yields every step's before/after counts; data-dependent parameters
(medians, modes, pooled moments) cost one job per dependency level, on the
rows still alive at that point. Lineage rows are emitted for done steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import clean_mask, try_to_double, utc_now
from millrace.operators import transforms as X
from millrace.operators import validate as V
from millrace.operators.profile import column_stats, value_of
from millrace.plans.commits import Commit, CommitLog
from millrace.plans.rules import OPERATION_PERMISSION, constraints_frame

RM = "__rm"

STEP_SCHEMA = T.StructType([
    T.StructField("order", T.IntegerType()),
    T.StructField("operation", T.StringType()),
    T.StructField("target_column", T.StringType()),
    T.StructField("permission_level", T.StringType()),
    T.StructField("semantic_group", T.StringType()),
    T.StructField("group_members", T.ArrayType(T.StringType())),
    T.StructField("step_key", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("lineage_id", T.StringType()),
    T.StructField("can_rollback", T.BooleanType()),
    T.StructField("normalized", T.IntegerType()),
    T.StructField("has_stats", T.BooleanType()),
    T.StructField("applied_option", T.StringType()),
])

LINEAGE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("source_column", T.StringType()),
    T.StructField("transformation_type", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("result_column", T.StringType()),
    T.StructField("step_order", T.IntegerType()),
    T.StructField("applied_by_agent", T.StringType()),
    T.StructField("user_approval_id", T.StringType()),
    T.StructField("can_rollback", T.BooleanType()),
    T.StructField("applied_at", T.StringType()),
])


@dataclass
class RunResult:
    output: DataFrame
    backup: DataFrame
    steps: DataFrame
    lineage: DataFrame
    stats: DataFrame | None = None
    issues: DataFrame | None = None
    report: DataFrame | None = None
    step_counts: DataFrame | None = None
    extras: dict = field(default_factory=dict)
    commit: Commit | None = None


def _lineage_id(dataset_id: str, run_id: str, step_key: str, order: int) -> str:
    import hashlib
    return hashlib.sha256(f"{dataset_id}\x1f{run_id}\x1f{step_key}\x1f{order}".encode()).hexdigest()


def _plan_rows(plan) -> list[dict]:
    if isinstance(plan, DataFrame):
        rows = [r.asDict() for r in plan.orderBy("order").collect()]  # one row per step
    else:
        rows = [dict(s) for s in plan]
    out = []
    for i, s in enumerate(rows, start=1):
        s.setdefault("order", i)
        s.setdefault("permission_level", OPERATION_PERMISSION.get(s["operation"], "L3"))
        tgt = s.get("semantic_group") or s.get("target_column") or "global"
        s.setdefault("step_key", f"{s['operation']}:{tgt}")
        s["group_members"] = list(s.get("group_members") or [])
        out.append(s)
    return out


_CHANGES_ROWS_OR_VALUES = ("clean_masking", "normalize_group", "remove_outlier", "balance_classes",
                           "drop_column")


def _fill_batch(steps: list[dict], start: int, approved: set, columns: set) -> list[str]:
    """Columns of consecutive approved fill steps from ``start`` on, stopping at
    the first step that changes rows or values other fills depend on."""
    out = []
    for s in steps:
        o = int(s["order"])
        if o < start:
            continue
        runs = s["permission_level"] == "L1" or s["step_key"] in approved
        if s["operation"] == "fill_missing":
            if runs and s.get("target_column") in columns and s["target_column"] not in out:
                out.append(s["target_column"])
            continue
        if runs and s["operation"] in _CHANGES_ROWS_OR_VALUES:
            break
    return out


def run_plan(df: DataFrame, plan, approved_keys: Iterable[str] = (), constraints: Mapping | None = None,
             selected_options: Mapping[str, str] | None = None, dataset_id: str = "dataset",
             run_id: str = "run-1", validate: bool = True, apply_resampling: bool = False,
             resample_keys: Sequence[str] | None = None, log: CommitLog | None = None) -> RunResult:
    """Run the approved steps of ``plan`` over ``df``.

    With ``log``, the untouched rows, the output, the steps, the lineage and the
    report are written and published as one version of ``dataset_id``; the result's
    frames then read that version. A run that fails has published nothing."""
    spark: SparkSession = df.sparkSession
    steps = _plan_rows(plan)
    approved = set(approved_keys)
    options = dict(selected_options or {})
    cons = dict(constraints or {})
    lower_cons = {str(k).lower(): v for k, v in cons.items()}

    chain = df.withColumn(RM, F.lit(None).cast("int"))
    # constraints are checked on the untouched values: keep them as hidden columns
    lower_cols = {}
    for c in df.columns:
        lower_cols.setdefault(c.lower(), c)
    cons_cols = []
    for i, (key, spec) in enumerate(cons.items()):
        lo, hi = X.bounds_of(spec)
        if lo is None and hi is None:
            continue
        actual = lower_cols.get(str(key).lower())
        cons_cols.append((key, lo, hi, actual))
        if actual is not None and validate:
            chain = chain.withColumn(f"__orig{len(cons_cols) - 1}", try_to_double(F.col(f"`{actual}`")))
    alive = F.col(RM).isNull()
    results: list[dict] = []
    probes: list[tuple[int, str]] = []      # (order, column) whose null counts are tracked
    removers: list[int] = []
    touched: list[str] = []
    norm_groups: list[tuple[str, list[str]]] = []
    removed_cols: list[str] = []
    extras: dict = {}
    fill_cache: dict = {}

    def res(s, status, detail="", lineage=False, normalized=None, has_stats=None, option=None):
        lid = _lineage_id(dataset_id, run_id, s["step_key"], s["order"]) if lineage else None
        results.append(dict(order=int(s["order"]), operation=s["operation"], target_column=s.get("target_column"),
                            permission_level=s["permission_level"], semantic_group=s.get("semantic_group"),
                            group_members=s["group_members"] or None, step_key=s["step_key"], status=status,
                            detail=detail, lineage_id=lid, can_rollback=bool(lineage),
                            normalized=normalized, has_stats=has_stats, applied_option=option))

    for s in steps:
        op, col, o = s["operation"], s.get("target_column"), int(s["order"])
        if s["permission_level"] in ("L2", "L3") and s["step_key"] not in approved:
            res(s, "awaiting_approval", "approval required")
            continue
        cols = chain.columns
        if op == "normalize_group":
            present = [m for m in s["group_members"] if m in cols]
            if not present:
                res(s, "failed", "no group member present")
                continue
            info = X.normalize_params(chain.filter(alive), present, s.get("strategy") or "single_zscore")
            chain = X.apply_normalize(chain, info["params"])
            info["normalized"] = len(info["members"])
            touched += info["members"]
            norm_groups.append((s.get("semantic_group") or "?", info["members"]))
            res(s, "done", f"members={len(present)};normalized={info['normalized']}", lineage=True,
                normalized=info["normalized"])
            continue
        if op == "remove_outlier":
            spec = cons.get(col) if col in cons else lower_cons.get(str(col).lower())
            lo, hi = X.bounds_of(spec)
            if not col or col not in cols or (lo is None and hi is None):
                res(s, "skipped", "no column or bounds")
                continue
            keep = X.in_bounds(F.col(f"`{col}`"), lo, hi, chain.schema[col].dataType)
            chain = chain.withColumn(RM, F.when(alive & ~keep, F.lit(o)).otherwise(F.col(RM)))
            removers.append(o)
            removed_cols.append(col)
            touched.append(col)
            res(s, "done", f"bounds=[{lo},{hi}]", lineage=True)
            continue
        if op == "compute_stats":
            res(s, "done", "stats", lineage=True, has_stats=True)
            continue
        if op in ("clean_masking", "fill_missing", "balance_classes", "drop_column"):
            if not col or col not in cols:
                res(s, "failed", f"column not found: {col}")
                continue
        if op == "clean_masking":
            chain = chain.withColumn(f"__b{o}", value_of(chain, col).isNull())
            chain = chain.withColumn(col, clean_mask(F.col(f"`{col}`")))
            chain = chain.withColumn(f"__a{o}", F.col(f"`{col}`").isNull())
            probes.append((o, col))
            touched.append(col)
            res(s, "done", "masked cells -> null, parsed as numbers", lineage=True, has_stats=True)
        elif op == "fill_missing":
            if col not in fill_cache:
                # parameters of this and every later approved fill step whose column is not
                # touched in between come from one job set on the rows alive now
                batch = _fill_batch(steps, o, approved, set(chain.columns))
                live = chain.filter(alive)
                fill_cache.update(X.fill_values(live, batch))
            val = fill_cache.pop(col, None)
            chain = chain.withColumn(f"__b{o}", value_of(chain, col).isNull())
            if val is not None:
                lit = val if not isinstance(val, (int, float, str, bool)) else F.lit(val)
                chain = chain.withColumn(col, F.coalesce(value_of(chain, col), lit.cast(chain.schema[col].dataType)))
            chain = chain.withColumn(f"__a{o}", value_of(chain, col).isNull())
            probes.append((o, col))
            touched.append(col)
            res(s, "done", "filled", lineage=True, has_stats=True)
        elif op == "balance_classes":
            opt = options.get(s["step_key"])
            if apply_resampling and opt == "random_under":
                keys = list(resample_keys or [c for c in cols if c != RM])
                live = chain.filter(alive).drop(RM)
                chain = X.balance_under(live, col, keys).withColumn(RM, F.lit(None).cast("int"))
            extras[f"class_weights:{col}"] = X.class_weights(chain.filter(alive), col)
            res(s, "done", f"strategy={opt or 'analyse'}", lineage=True, option=opt)
        elif op == "drop_column":
            chain = chain.drop(col)
            res(s, "done", "dropped", lineage=True)
        else:
            res(s, "skipped", f"'{op}' is applied at read time or needs inputs not given")

    # --- one aggregate for every step's counters -------------------------------
    # --- ONE aggregate: step counters, output health (alive rows) and the
    # constraint check on the untouched values (kept as hidden columns) -------
    aggs = [F.count(F.lit(1)).alias("n_input"), F.count(F.when(alive, 1)).alias("n_output")]
    for o, c in probes:
        before_alive = F.col(RM).isNull() | (F.col(RM) >= o)
        aggs += [F.count(F.when(before_alive & F.col(f"__b{o}"), 1)).alias(f"bn{o}"),
                 F.count(F.when(before_alive & F.col(f"__a{o}"), 1)).alias(f"an{o}")]
    for o in removers:
        aggs += [F.count(F.when(F.col(RM).isNull() | (F.col(RM) >= o), 1)).alias(f"rb{o}"),
                 F.count(F.when(F.col(RM).isNull() | (F.col(RM) > o), 1)).alias(f"ra{o}")]
    health_interpret = None
    viol_meta = []
    if validate:
        visible = chain.drop(*[c for c in chain.columns if c.startswith("__")])
        h_aggs, health_interpret = V.output_health_aggs(visible, touched, norm_groups, cond=alive)
        aggs += h_aggs
        for i, (key, lo, hi, actual) in enumerate(cons_cols):
            if actual is None:
                viol_meta.append((i, key, actual))
                continue
            x = F.col(f"__orig{i}")
            viol = F.lit(False)
            if lo is not None:
                viol = viol | (x < F.lit(lo))
            if hi is not None:
                viol = viol | (x > F.lit(hi))
            aggs += [F.count(F.when(viol, 1)).alias(f"cv{i}"), F.count(x).alias(f"ct{i}")]
            viol_meta.append((i, key, actual))
    agg_row = chain.agg(*aggs).first()  # the single pass over the data

    helpers = [c for c in chain.columns if c.startswith("__b") or c.startswith("__a") or c.startswith("__orig") or c == RM]
    output = chain.filter(alive).drop(*helpers)

    cnt_rows = []
    for r in results:
        o = r["order"]
        probe = (o, r["target_column"]) in probes
        cnt_rows.append((o, agg_row[f"bn{o}"] if probe else None, agg_row[f"an{o}"] if probe else None,
                         agg_row[f"rb{o}"] if o in removers else None, agg_row[f"ra{o}"] if o in removers else None,
                         agg_row["n_input"], agg_row["n_output"]))
    step_counts = spark.createDataFrame(
        cnt_rows, "order int, before_nulls bigint, after_nulls bigint, rows_before bigint, rows_after bigint, "
                  "n_input bigint, n_output bigint")
    # step results and their counters are both driver-side rows: one local relation, no join
    by_order = {c[0]: c[1:5] for c in cnt_rows}
    full_schema = T.StructType(STEP_SCHEMA.fields + [T.StructField(n, T.LongType()) for n in
                                                     ("before_nulls", "after_nulls", "rows_before", "rows_after")])
    steps_full = spark.createDataFrame(
        [tuple(r[f.name] for f in STEP_SCHEMA.fields) + tuple(by_order.get(r["order"], (None,) * 4)) for r in results],
        full_schema)

    lin_rows = []
    for r in results:
        if r["status"] != "done":
            continue
        ttype = r["operation"]
        if ttype == "normalize_group":
            ttype = f"normalize_group:{next((s.get('strategy') for s in steps if int(s['order']) == r['order']), '')}"
        params = {"permission_level": r["permission_level"]}
        if r["semantic_group"]:
            params["semantic_group"] = r["semantic_group"]
        if r["applied_option"]:
            params["selected_option"] = r["applied_option"]
        members = r["group_members"] or []
        src = r["target_column"] or (",".join(members[:3]) + ("..." if len(members) > 3 else "") if members else None)
        lin_rows.append((r["lineage_id"], dataset_id, src, ttype, params, r["target_column"], r["order"], "executor",
                         ("ui-" + r["step_key"]) if r["step_key"] in approved else None, True, None))
    lineage = spark.createDataFrame(lin_rows, LINEAGE_SCHEMA).withColumn("applied_at", utc_now())

    result = RunResult(output=output, backup=df, steps=steps_full, lineage=lineage, step_counts=step_counts,
                       extras=extras)
    if any(r["operation"] == "compute_stats" and r["status"] == "done" for r in results):
        result.stats = column_stats(output)
    if validate:
        issues = V.step_checks(steps_full, None)
        rows = list(health_interpret(agg_row)) if health_interpret else []
        viol_rows = []
        removed = set(removed_cols)
        for i, key, actual in viol_meta:
            if actual is None:
                viol_rows.append((key, None, 0, 0, "low", False))
                continue
            nv, nt = agg_row[f"cv{i}"], agg_row[f"ct{i}"]
            if nv > 0:
                viol_rows.append((key, actual, nv, nt, "low" if actual in removed else "medium", actual in removed))
        for key, actual, nv, nt, sev, rem in viol_rows:
            rows.append(("constraint", sev, None, actual or key, f"{nv}/{nt}"))
        n_in, n_out = agg_row["n_input"], agg_row["n_output"]
        if n_in and (n_in - n_out) / n_in > V.ROW_LOSS_LIMIT:
            rows.append(("regression", "high", None, None, f"{n_in}->{n_out}"))
        issues = issues.unionByName(spark.createDataFrame(rows, V.ISSUE_SCHEMA))
        result.extras["constraint_violations"] = spark.createDataFrame(
            viol_rows, "key string, column string, n_violations bigint, n_total bigint, severity string, removed boolean")
        result.issues = issues
        result.report = V.report(issues, steps_full)
    if log is not None:
        _commit(result, log, dataset_id, run_id)
    return result


def _commit(result: RunResult, log: CommitLog, dataset_id: str, run_id: str) -> None:
    """Publish the run's tables together, and read them back."""
    names = ("backup", "output", "steps", "lineage", "stats", "issues", "report")
    tables = {n: getattr(result, n) for n in names if getattr(result, n) is not None}
    result.commit = log.commit(dataset_id, run_id, tables)
    for n in tables:
        setattr(result, n, log.read(dataset_id, n, result.commit.version))

