"""Resumable runs over stages of many modules.

All modules of a stage are one DataFrame with a ``datalake_id``: profiled by one
grouped aggregate, planned by rules as one table of steps, gated together, run with
each module's parameters joined to its rows, checked by one more grouped aggregate,
and committed as one version. The loop is over stages; the number of jobs does not
depend on the number of modules.

A stage runs its modules up to the first one, by index, whose plan has a conflict or
waits for an approval. What ran is committed; the next call, with more approvals,
goes on where this one stopped. The modules that are done, the steps, the lineage
and the reports of a session are read from its log.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.quantiles import exact_quantiles
from millrace.functions.rowindex import quoted, written
from millrace.functions.scalars import clean_mask, is_number, try_to_double, utc_now
from millrace.operators import validate as V
from millrace.operators.profile import IMBALANCE_MINORITY_LIMIT, dtype_name, is_numeric_type, text_columns, value_of
from millrace.plans import rules as R
from millrace.plans.commits import CommitLog

KEY = "datalake_id"
#: Modules whose parameters are broadcast to the rows; more are joined by a shuffle.
BROADCAST_MODULES = 20_000
_POOLED = ("sequence_preserve", "profile_group")
STATUS = ("stage_order", "module_index", KEY, "status", "detail")


def _beside(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_MODULES else small


def _cells(df: DataFrame, names: list[str], kind: str, when: Callable[[str], Column] | None = None) -> DataFrame:
    """(datalake_id, name, value) of the named columns, NULLs left out."""
    parts = [F.struct(F.lit(c).alias("name"), (F.when(when(c), value_of(df, c)) if when else value_of(df, c)).cast(kind).alias("value")) for c in names]
    return df.select(KEY, F.explode(F.array(*parts)).alias("r")).select(KEY, "r.*").filter(F.col("value").isNotNull())


def profile_modules(df: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """One row per module and column: name, ordinal, dtype, n_rows, null_count,
    n_unique (estimated), mixed, imbalanced. ``columns`` (datalake_id, name) says
    which columns a module has; without it, all."""
    names = [c for c in df.columns if c != KEY]
    texts = set(text_columns(df))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        v = value_of(df, c)
        aggs += [F.count(v).alias(f"nn{i}"), F.approx_count_distinct(v).alias(f"nd{i}"), (F.count(F.when(is_number(v), 1)) if c in texts else F.lit(0)).alias(f"nm{i}")]
    rows = [F.struct(F.lit(c).alias("name"), F.lit(i).alias("ordinal"), F.lit(dtype_name(df.schema[c].dataType)).alias("dtype"), F.col("n").alias("n_rows"),
                     (F.col("n") - F.col(f"nn{i}")).alias("null_count"), F.col(f"nd{i}").alias("n_unique"),
                     ((F.col(f"nm{i}") > 0) & (F.col(f"nm{i}") < F.col(f"nn{i}"))).alias("mixed")) for i, c in enumerate(names)]
    prof = df.groupBy(KEY).agg(*aggs).select(KEY, F.explode(F.array(*rows)).alias("r")).select(KEY, "r.*")
    if columns is not None:
        prof = prof.join(columns.select(KEY, "name"), [KEY, "name"], "left_semi")
    prof = written(prof, "module-profile")
    few = prof.filter("n_unique between 1 and 3")
    candidates = [r["name"] for r in few.select("name").distinct().collect()]  # names of columns
    if not candidates:
        return prof.withColumn("imbalanced", F.lit(False))
    counts = _cells(df, candidates, "string").groupBy(KEY, "name", "value").agg(F.count(F.lit(1)).alias("c"))
    classes = counts.groupBy(KEY, "name").agg(F.count(F.lit(1)).alias("k"), (F.min("c") / F.sum("c")).alias("share"))
    rare = classes.filter((F.col("k") == 2) & (F.round("share", 4) < IMBALANCE_MINORITY_LIMIT)).select(KEY, "name", F.lit(True).alias("rare"))
    return written(prof.join(rare, [KEY, "name"], "left").withColumn("imbalanced", F.coalesce("rare", F.lit(False))).drop("rare"), "module-profile")


def plan_modules(profile: DataFrame, constraints: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """The suggested steps of every module, numbered in rule order. ``constraints``:
    datalake_id, column_name, lo, hi; ``extra``: datalake_id, operation,
    target_column, put at the end."""
    none, members = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def steps(rows: DataFrame, stage: int, operation: Column, target: Column, minor: Column, group: Column = none, of: Column = members, strategy: Column = none,
              lo: Column = F.lit(None), hi: Column = F.lit(None)) -> DataFrame:
        return rows.select(KEY, F.lit(stage).alias("stage"), minor.cast("int").alias("minor"), operation.alias("operation"), target.alias("target_column"), group.alias("semantic_group"),
                           of.alias("group_members"), strategy.alias("strategy"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    name, at = F.col("name"), F.col("ordinal")
    parts = [steps(profile.filter("mixed"), 2, F.lit("clean_masking"), name, at), steps(profile.filter("null_count > 0 and not mixed"), 3, F.lit("fill_missing"), name, at),
             steps(profile.filter("imbalanced"), 4, F.lit("balance_classes"), name, at)]
    group, strategy = R.classify_expr(name)
    named = profile.filter(F.col("dtype").isin("integer", "float")).select(KEY, "name", "ordinal", group.alias("g"), strategy.alias("s"))
    named = named.filter(~F.col("s").isin("passthrough", "label") & ~F.col("g").isin("unknown", "metadata", "label"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "name")))  # a module's columns of one kind
    groups = named.groupBy(KEY, "g", "s").agg(F.min("ordinal").alias("ordinal"), F.transform(ordered, lambda x: x["name"]).alias("m"))
    parts.append(steps(groups, 5, F.lit("normalize_group"), none, at, F.col("g"), F.col("m"), F.col("s")))
    if constraints is not None:
        bound = constraints.filter(F.col("lo").isNotNull() | F.col("hi").isNotNull()).select(F.col(KEY).alias("k"), F.col("column_name").alias("key"), "lo", "hi")
        exact = F.col("key") == name
        hits = profile.join(bound, (F.col(KEY) == F.col("k")) & (F.lower("key") == F.lower(name)))
        best = hits.groupBy(KEY, "key").agg(F.min_by(F.struct("name", "ordinal", "lo", "hi"), F.struct(~exact, at)).alias("b")).select(KEY, "b.*")
        parts.append(steps(best.dropDuplicates([KEY, "name"]), 6, F.lit("remove_outlier"), name, at, lo=F.col("lo"), hi=F.col("hi")))
    parts.append(steps(profile.select(KEY).distinct(), 7, F.lit("compute_stats"), none, F.lit(0)))
    if extra is not None:
        parts.append(steps(extra, 8, F.col("operation"), F.col("target_column"), F.lit(0)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    turn = Window.partitionBy(KEY).orderBy("stage", "minor", "operation", "target_column")  # one module's steps
    every = every.withColumn("order", F.row_number().over(turn)).drop("stage", "minor")
    return (every.withColumn("permission_level", R.permission_expr(F.col("operation")))
            .withColumn("step_key", R.step_key_expr(F.col("operation"), F.col("semantic_group"), F.col("target_column"))))


def precheck_modules(plan: DataFrame) -> DataFrame:
    """D19 for every module: datalake_id, order, kind, severity."""
    ranks = F.create_map(*[F.lit(x) for kv in R.ORDER_RANK.items() for x in kv])
    rank = F.coalesce(ranks[F.col("operation")], F.lit(R.UNKNOWN_RANK))
    earlier = Window.partitionBy(KEY).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)  # one module's steps
    on_column = Window.partitionBy(KEY, "target_column")
    seen = plan.withColumn("rank", rank).withColumn("before", F.max(F.when(F.col("operation") != "compute_stats", F.col("rank"))).over(earlier))
    seen = seen.withColumn("dropped", F.col("target_column").isNotNull() & F.max(F.col("operation") == "drop_column").over(on_column))
    kinds = F.array_compact(F.array(
        F.when((F.col("operation") != "compute_stats") & (F.col("rank") < F.col("before")), F.struct(F.lit("plan_order").alias("kind"), F.lit("medium").alias("severity"))),
        F.when(F.col("dropped") & (F.col("operation") != "drop_column"), F.struct(F.lit("plan_conflict").alias("kind"), F.lit("high").alias("severity"))),
        F.when(F.col("permission_level") == "L3", F.struct(F.lit("plan_l3_notice").alias("kind"), F.lit("low").alias("severity")))))
    return seen.select(KEY, "order", F.explode(kinds).alias("k")).select(KEY, "order", "k.*")


@dataclass
class _Grouped:
    """The frames of one stage's run."""
    output: DataFrame
    steps: DataFrame
    lineage: DataFrame
    issues: DataFrame
    report: DataFrame


def _targets(plan: DataFrame) -> dict[str, list[str]]:
    """Columns by operation, over all modules (the driver sees names of columns)."""
    out: dict[str, list[str]] = {}
    for operation, name in plan.select("operation", F.explode(F.coalesce("group_members", F.array("target_column"))).alias("c")).distinct().collect():
        if name is not None:
            out.setdefault(operation, []).append(name)
    return {k: sorted(v) for k, v in out.items()}


def _fills(df: DataFrame, names: list[str], of: Callable[[str], Column]) -> DataFrame:
    """Medians and most frequent values of each module's columns to fill, as two
    maps a module."""
    nums = [c for c in names if is_numeric_type(df.schema[c].dataType, bool_numeric=False)]
    texts = [c for c in names if c not in nums]
    rows = []
    if nums:
        q = exact_quantiles(_cells(df, nums, "double", of), "value", [0.5], [KEY, "name"])
        rows.append(q.select(KEY, "name", F.col("q").alias("number"), F.lit(None).cast("string").alias("text")))
    if texts:
        counts = _cells(df, texts, "string", of).groupBy(KEY, "name", "value").agg(F.count(F.lit(1)).alias("c"))
        best = counts.groupBy(KEY, "name").agg(F.min(F.struct(-F.col("c"), F.col("value"))).alias("b"))
        rows.append(best.select(KEY, "name", F.lit(None).cast("double").alias("number"), F.col("b.value").alias("text")))
    every = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    pairs = F.collect_list(F.struct("name", F.struct("number", "text")))  # one a column
    return written(every.groupBy(KEY).agg(F.map_from_entries(pairs).alias("fill")), "module-fills")


def run_modules(df: DataFrame, plan: DataFrame, run_id: str) -> _Grouped:
    """Run every step of every module of ``plan`` over the modules' rows."""
    targets = _targets(plan)
    schema = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in schema if c != KEY and is_numeric_type(schema[c], bool_numeric=False)]
    masks, fills, outliers, drops = ([c for c in targets.get(op, []) if c in schema] for op in ("clean_masking", "fill_missing", "remove_outlier", "drop_column"))
    grouped = [c for c in targets.get("normalize_group", []) if c in numeric]

    # --- each module's parameters, one row a module ---------------------------
    spec = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "operation", "target_column"), F.struct("order", "lo", "hi"))))  # its steps
    members = F.flatten(F.collect_list(F.transform(F.coalesce("group_members", F.array().cast("array<string>")), lambda m: F.struct(m, F.struct("semantic_group", "strategy")))))
    params = written(plan.groupBy(KEY).agg(spec.alias("step"), F.map_from_entries(members).alias("in_group")), "module-parameters")
    rows = df.join(_beside(params), KEY)

    def step(operation: str, c: str) -> Column:
        return F.col("step")[F.lit(f"{operation}:{c}")]

    # --- masks, then fills -----------------------------------------------------
    for i, c in enumerate(masks):
        rows = rows.withColumn(f"__m{i}", F.when(step("clean_masking", c).isNotNull(), clean_mask(quoted(c))))
    if fills:
        found = _fills(rows, fills, lambda c: step("fill_missing", c).isNotNull())
        rows = rows.join(_beside(found), KEY, "left")
    for i, c in enumerate(fills):
        value = F.col("fill")[F.lit(c)]["number" if c in numeric else "text"]
        rows = rows.withColumn(f"__b{i}", value_of(rows, c).isNull())
        rows = rows.withColumn(c, F.when(step("fill_missing", c).isNotNull(), F.coalesce(value_of(rows, c), value.cast(schema[c]))).otherwise(quoted(c)))

    # --- groups: pooled or single moments of the filled values ------------------
    if grouped:
        aggs = []
        for i, c in enumerate(grouped):
            x = value_of(rows, c).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.stddev_samp(x).alias(f"s{i}")]
        cells = [F.struct(F.lit(c).alias("name"), *[F.col(f"{k}{i}").alias(k) for k in "nmvs"]) for i, c in enumerate(grouped)]
        each = rows.groupBy(KEY).agg(*aggs, F.first("in_group").alias("in_group")).select(KEY, "in_group", F.explode(F.array(*cells)).alias("c")).select(KEY, "c.*", F.col("in_group")[F.col("c.name")].alias("g"))
        each = each.filter(F.col("g").isNotNull() & (F.col("n") > 0))
        whole = Window.partitionBy(KEY, "g.semantic_group")  # a module's columns of one group
        mean = F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
        each = each.withColumn("mu", mean)
        spread = F.sqrt(F.sum(F.col("n") * F.col("v") + F.col("n") * F.pow(F.col("m") - F.col("mu"), 2)).over(whole) / F.sum("n").over(whole))
        pooled = F.col("g.strategy").isin(*_POOLED)
        scale = F.struct(F.when(pooled, F.col("mu")).otherwise(F.col("m")).alias("mu"), F.when(pooled, F.col("sd")).otherwise(F.col("s")).alias("sd"))
        scales = each.withColumn("sd", spread).groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("name", scale))).alias("scale"))  # one a column
        rows = rows.join(_beside(written(scales, "module-scales")), KEY, "left")
        for c in grouped:
            s = F.col("scale")[F.lit(c)]
            rows = rows.withColumn(c, F.when(s.isNotNull() & ~F.isnan(s["sd"]) & (s["sd"] != 0), (value_of(rows, c).cast("double") - s["mu"]) / s["sd"]).otherwise(quoted(c).cast("double")))

    # --- outliers: rows are tagged with the step that removes them ---------------
    gone = F.lit(None).cast("int")
    for c in outliers:
        s, x = step("remove_outlier", c), try_to_double(quoted(c))
        out = s.isNotNull() & (F.coalesce(x < s["lo"], F.lit(False)) | F.coalesce(x > s["hi"], F.lit(False)))
        gone = F.least(gone, F.when(out, s["order"]))
    rows = rows.withColumn("__gone", gone)
    alive = F.col("__gone").isNull()

    # --- one aggregate a module: counters, health, violations --------------------
    n = F.count(F.lit(1))
    aggs = [n.alias("n_input"), F.count(F.when(alive, 1)).alias("n_output"), F.first("step").alias("step")]
    counters, number = [], {}

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    def counted(operation: str, c: str, **values: Column) -> None:
        """Counters of one step, under its key."""
        k = number[operation, c] = len(counters)
        aggs.extend(v.alias(f"{name}_{k}") for name, v in values.items())
        counters.append(F.struct(F.lit(f"{operation}:{c}").alias("step_key"), *[(F.col(f"{name}_{k}") if name in values else F.lit(None)).cast("long").alias(name)
                                                                               for name in ("before_nulls", "after_nulls", "rows_before", "rows_after")]))
    for i, c in enumerate(masks):
        held = alive | (F.col("__gone") >= step("clean_masking", c)["order"])
        counted("clean_masking", c, before_nulls=count(held & quoted(c).isNull()), after_nulls=count(held & F.col(f"__m{i}").isNull()))
    for i, c in enumerate(fills):
        held = alive | (F.col("__gone") >= step("fill_missing", c)["order"])
        counted("fill_missing", c, before_nulls=count(held & F.col(f"__b{i}")), after_nulls=count(held & value_of(rows, c).isNull()))
    for c in outliers:
        at = step("remove_outlier", c)["order"]
        counted("remove_outlier", c, rows_before=count(alive | (F.col("__gone") >= at)), rows_after=count(alive | (F.col("__gone") > at)))
    issues = []

    def issue(cond: Column, kind: str, severity: str, target: str | None, detail: Column) -> None:
        issues.append(F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(target).cast("string").alias("target"), detail.alias("detail"))))

    touched = {c: rows.schema[c].dataType for c in dict.fromkeys([*fills, *outliers, *grouped]) if c in numeric}
    for i, c in enumerate(numeric):
        x = F.when(alive, quoted(c).cast("double"))
        aggs.append(F.max(F.abs(x) == float("inf")).alias(f"inf{i}"))
        issue(F.coalesce(F.col(f"inf{i}"), F.lit(False)), "output_health", "high", c, F.lit("inf"))
    for i, c in enumerate(touched):
        x = F.when(alive, value_of(rows, c).cast("double"))
        aggs += [F.count(x).alias(f"tn{i}"), F.stddev_pop(x).alias(f"ts{i}")]
        worked = F.lit(False)
        for op in ("fill_missing", "remove_outlier"):
            worked = worked | step(op, c).isNotNull()
        issue(worked & (F.col(f"tn{i}") > 1) & (F.col(f"ts{i}") == 0), "output_health", "high", c, F.lit("zero_std"))
    issue((F.col("n_input") - F.col("n_output")) / F.col("n_input") > V.ROW_LOSS_LIMIT, "regression", "high", None, F.concat_ws("->", F.col("n_input").cast("string"), F.col("n_output").cast("string")))
    for c in outliers:
        k = number["remove_outlier", c]
        lost = F.col(f"rows_before_{k}") - F.col(f"rows_after_{k}")
        issue(step("remove_outlier", c).isNotNull() & (lost > 0), "constraint", "low", c, F.concat_ws("/", lost.cast("string"), F.col("n_input").cast("string")))
    made = written(rows.groupBy(KEY).agg(*aggs).select(KEY, "n_input", "n_output", F.array(*counters).alias("counters") if counters else F.array().cast(
        "array<struct<step_key:string,before_nulls:bigint,after_nulls:bigint,rows_before:bigint,rows_after:bigint>>").alias("counters"), F.array_compact(F.array(*issues)).alias("issues")), "module-counters")

    counts = made.select(KEY, F.explode("counters").alias("c")).select(KEY, "c.*")
    lineage_id = F.sha2(F.concat_ws("\u001f", KEY, F.lit(run_id), "step_key", F.col("order").cast("string")), 256)
    steps = plan.join(counts, [KEY, "step_key"], "left").join(made.select(KEY), KEY, "left_semi").withColumn("status", F.lit("done")).withColumn("lineage_id", lineage_id)
    bad_fill = steps.filter((F.col("operation") == "fill_missing") & (F.col("after_nulls") >= F.col("before_nulls")))
    in_groups = plan.filter("operation = 'normalize_group'").select(KEY, F.explode("group_members").alias("target_column"))
    overlap = plan.filter(F.col("operation").isin("clean_masking", "fill_missing")).join(in_groups, [KEY, "target_column"], "left_semi")
    found = made.select(KEY, F.explode("issues").alias("i")).select(KEY, "i.*")
    for rows_, kind, severity, detail in ((bad_fill, "transform", "high", "nulls not reduced"), (overlap, "integrity", "low", "also in group normalisation")):
        found = found.unionByName(rows_.select(KEY, F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col("target_column").alias("target"), F.lit(detail).alias("detail")))
    levels = [F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s}") for s in ("high", "medium", "low")]
    report = made.select(KEY, "n_input", "n_output").join(steps.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_done")), KEY).join(found.groupBy(KEY).agg(*levels), KEY, "left").fillna(0)
    report = report.withColumn("passed", F.col("n_high") == 0).withColumn("next_action", F.when(F.col("n_high") > 0, "retry_or_human").when(F.col("n_medium") > 0, "review_recommended").otherwise("ready_for_ml"))
    lineage = steps.select(F.col("lineage_id").alias("id"), F.col(KEY).alias("dataset_id"), F.coalesce("target_column", F.array_join("group_members", ",")).alias("source_column"),
                           F.col("operation").alias("transformation_type"), F.col("target_column").alias("result_column"), F.col("order").alias("step_order"),
                           F.when(F.col("permission_level") != "L1", F.concat(F.lit("ui-"), "step_key")).alias("user_approval_id")).withColumn("applied_at", utc_now())

    # --- the rows that stay; a masked column is a number where every module masks it
    columns = [quoted(KEY)]
    every = plan.select(KEY).distinct().count()
    masked = {r["target_column"]: r["c"] for r in plan.filter("operation = 'clean_masking'").groupBy("target_column").agg(F.count(F.lit(1)).alias("c")).collect()}  # names of columns
    for c in df.columns:
        if c == KEY:
            continue
        value = quoted(c)
        if c in masks:
            m = F.col(f"__m{masks.index(c)}")
            value = m if masked[c] == every else F.when(step("clean_masking", c).isNotNull(), m.cast("string")).otherwise(value)
        columns.append((F.when(step("drop_column", c).isNull(), value) if c in drops else value).alias(c))
    return _Grouped(rows.filter(alive).select(*columns), steps, lineage, found, report)


@dataclass
class StageRun:
    """What one call did: the status of the modules it met and, where it stopped for
    an approval, what the waiting steps would do."""
    status: DataFrame
    previews: DataFrame | None = None
    versions: list[int] = field(default_factory=list)


def _previews(df: DataFrame, waiting: DataFrame) -> DataFrame:
    """Of each waiting step: rows before, and after it (per option, if it has any)."""
    rows = {r["step_key"]: r for r in waiting.collect()}  # the steps of one module
    shown = waiting.select("step_key", "order", "operation", "permission_level", "target_column")
    out = [df.agg(F.count(F.lit(1)).alias("rows_before")).select(F.explode(F.array(*[F.lit(k) for k in rows])).alias("step_key"), F.lit(None).cast("string").alias("option"), "rows_before",
                                                                F.lit(None).cast("long").alias("rows_after")).filter(F.col("step_key").isin([k for k, r in rows.items() if r["operation"] not in ("remove_outlier", "balance_classes")]))]
    for k, r in rows.items():
        if r["operation"] == "remove_outlier":
            x = try_to_double(quoted(r["target_column"]))
            stays = ~(F.coalesce(x < F.lit(r["lo"]), F.lit(False)) | F.coalesce(x > F.lit(r["hi"]), F.lit(False)))
            out.append(df.agg(F.count(F.lit(1)).alias("rows_before"), F.count(F.when(stays, 1)).alias("rows_after")).select(F.lit(k).alias("step_key"), F.lit(None).cast("string").alias("option"), "rows_before", "rows_after"))
        elif r["operation"] == "balance_classes":
            from millrace.operators.transforms import balance_preview
            out.append(balance_preview(df, r["target_column"]).select(F.lit(k).alias("step_key"), "option", "rows_before", "rows_after"))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return shown.join(every, "step_key")


def run_stages(log: CommitLog, session: str, modules: DataFrame, load: Callable[[int], DataFrame], approved: DataFrame | None = None, constraints: DataFrame | None = None,
               columns: DataFrame | None = None, extra: DataFrame | None = None) -> StageRun:
    """Run what is left of a session's modules (``stage_order, module_index,
    datalake_id``; those without an id are left out), stage by stage.

    ``load(stage_order)`` gives the rows of a stage's modules with ``datalake_id``;
    ``approved``: ``step_key`` and, where approvals differ by dataset, ``datalake_id`` (NULL:
    any). ``constraints``, ``columns`` and ``extra`` as for planning. A module without rows
    is done without steps. Failures to read are raised; what is done before them stays."""
    spark = log.spark
    named = modules.filter(F.col(KEY).isNotNull()).select("stage_order", "module_index", KEY)
    done = log.appended(session, "modules")
    todo = written(named if done is None else named.join(done.select("stage_order", "module_index"), ["stage_order", "module_index"], "left_anti"), "modules")
    result: list[DataFrame] = []
    previews, versions = None, []
    for stage, in todo.select("stage_order").distinct().orderBy("stage_order").collect():  # one row a stage
        own = todo.filter(F.col("stage_order") == stage)
        rows = load(stage).join(_beside(own.select(KEY)), KEY, "left_semi")
        plan = written(plan_modules(profile_modules(rows, columns), constraints, None if extra is None else extra.join(own.select(KEY), KEY, "left_semi")), "module-plan")
        gated = plan
        if approved is not None:
            allowed = approved.select("step_key", (F.col(KEY) if KEY in approved.columns else F.lit(None).cast("string")).alias("for_id")).distinct()
            fits = (plan["step_key"] == allowed["step_key"]) & (allowed["for_id"].isNull() | (allowed["for_id"] == plan[KEY]))
            gated = plan.join(allowed, fits, "left_anti")
        waits = gated.filter(F.col("permission_level").isin("L2", "L3")).groupBy(KEY).agg(F.concat_ws(",", F.array_sort(F.collect_set("step_key"))).alias("waiting"))
        conflicts = precheck_modules(plan).filter(F.col("severity") == "high").select(KEY).distinct().withColumn("conflict", F.lit(True))
        state = written(own.join(waits, KEY, "left").join(conflicts, KEY, "left"), "module-state")
        stop = state.filter("conflict or waiting is not null").agg(F.min("module_index")).first()[0]
        ready = state if stop is None else state.filter(F.col("module_index") < stop)
        if stop is None or ready.limit(1).count():
            ids = ready.select(KEY)
            ran = run_modules(rows.join(_beside(ids), KEY, "left_semi"), plan.join(ids, KEY, "left_semi"), session)
            finished = ready.select("stage_order", "module_index", KEY)
            commit = log.commit(session, f"stage {stage}", {"modules": finished, "output": ran.output, "steps": ran.steps, "lineage": ran.lineage, "issues": ran.issues, "report": ran.report})
            versions.append(commit.version)
            actions = log.read(session, "report", commit.version).select(KEY, F.col("next_action").alias("detail"))
            result.append(finished.join(actions, KEY, "left").withColumn("status", F.lit("done")).select(*STATUS))
        if stop is not None:
            at = state.filter(F.col("module_index") == stop)
            blocked = F.coalesce("conflict", F.lit(False))
            result.append(at.withColumn("status", F.when(blocked, "blocked").otherwise("awaiting_approval")).withColumn("detail", F.when(blocked, "plan conflict").otherwise(F.col("waiting"))).select(*STATUS))
            held = at.filter(~blocked).select(KEY)
            waiting = written(gated.filter(F.col("permission_level").isin("L2", "L3")).join(held, KEY, "left_semi"), "waiting")
            if waiting.limit(1).count():
                previews = _previews(rows.join(F.broadcast(held), KEY, "left_semi"), waiting)
            break
    status = result[0] if result else spark.createDataFrame([], "stage_order int, module_index int, datalake_id string, status string, detail string")
    for r in result[1:]:
        status = status.unionByName(r)
    return StageRun(status, previews, versions)
