"""Registered queries: catalog, columns metadata, constraints and history
(A17-A19, B7, B13, B15-B17, B20, B21, C2, C3, D15, D24, D25, L1-L5, W5, W6, F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.checks.common import messy_lineitem, MESSY_LINEITEM_SQL
from millrace.functions.rowindex import written
from millrace.operators import catalog as K
from millrace.operators import constraints as CN
from millrace.operators import profile as P
from millrace.session import table

Q: dict = {}
SQL: dict = {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


# --- entries derived from `documents` (one registered dataset per document) ----------
_ENTRY_COMMON = [
    "concat('doc_', CAST(doc_id AS STRING)) AS datalake_id",
    "source",
    "concat('document ', CAST(doc_id AS STRING)) AS name",
    "CASE lang WHEN 'en' THEN 'timeseries' WHEN 'de' THEN 'event-log' WHEN 'fr' THEN 'order' "
    "ELSE 'inspection-image' END AS modality",
    "CASE WHEN n_chars < 1000 THEN 'process' WHEN n_chars < 10000 THEN 'quality' "
    "WHEN n_chars < 50000 THEN 'maintenance' ELSE 'reference' END AS function",
    "source AS site", "lang AS vid", "n_chars AS size_bytes", "'utf-8' AS encoding", "'csv' AS format",
    "concat('/lake/', source, '/', CAST(doc_id AS STRING)) AS data_path",
    "n_chars > 5000 AS reusable_flag",
    "concat('company_', substr(source, 4)) AS company",
]
ENTRY_SPARK = _ENTRY_COMMON + ["timestamp_seconds(1704067200 + doc_id) AS registered_at"]
ENTRY_DUCK = "SELECT " + ", ".join(_ENTRY_COMMON) + ", make_timestamp((CAST(1704067200 AS BIGINT) + doc_id) * 1000000) AS registered_at FROM documents"
EPOCH_S = "CAST(unix_timestamp(registered_at) AS BIGINT)"
EPOCH_D = "CAST(epoch(registered_at) AS BIGINT)"


def entries(spark, sf):
    return table(spark, sf, "documents").selectExpr(*ENTRY_SPARK)


def _out(df):
    return df.select("datalake_id", "modality", "function", "site", "company",
                     F.expr(EPOCH_S).alias("registered_epoch"))


OUT_D = "datalake_id, modality, function, site, company, " + EPOCH_D + " AS registered_epoch"


@q("cat_lookup")
def _lookup(spark, sf):
    e = entries(spark, sf)
    biggest = e.orderBy(F.desc("size_bytes"), F.asc("datalake_id")).select("datalake_id").first()[0]
    return K.lookup(e, biggest)


SQL["cat_lookup"] = (f"WITH e AS ({ENTRY_DUCK}) SELECT datalake_id, data_path, modality FROM e "
                     "WHERE datalake_id = (SELECT datalake_id FROM e ORDER BY size_bytes DESC, datalake_id LIMIT 1)")


@q("cat_datasets")
def _datasets(spark, sf):
    return K.datasets_by_modality(entries(spark, sf))


SQL["cat_datasets"] = f"WITH e AS ({ENTRY_DUCK}) SELECT DISTINCT modality, datalake_id FROM e"


@q("cat_filter")
def _filter(spark, sf):
    return _out(K.list_entries(entries(spark, sf), modality="timeseries", function="quality"))


SQL["cat_filter"] = f"WITH e AS ({ENTRY_DUCK}) SELECT {OUT_D} FROM e WHERE modality = 'timeseries' AND function = 'quality'"


@q("distinct_values")
def _distinct(spark, sf):
    return entries(spark, sf).select("company").distinct().orderBy("company")


SQL["distinct_values"] = f"WITH e AS ({ENTRY_DUCK}) SELECT DISTINCT company FROM e"


@q("manifest_summary")
def _manifest_summary(spark, sf):
    """Load-plan counts by vid and modality with roll-up totals."""
    e = entries(spark, sf)
    return (e.rollup("vid", "modality").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))
            .select(F.coalesce("vid", F.lit("*")).alias("vid"), F.coalesce("modality", F.lit("*")).alias("modality"),
                    "n", "bytes"))


SQL["manifest_summary"] = (f"WITH e AS ({ENTRY_DUCK}) SELECT coalesce(vid, '*') AS vid, coalesce(modality, '*') AS modality, "
                           "count(*) AS n, sum(size_bytes) AS bytes FROM e GROUP BY ROLLUP (vid, modality)")


# --- L1: re-registration of labelled documents ----------------------------------
def _new_records(spark, sf):
    lab = table(spark, sf, "labels")
    e = entries(spark, sf).join(lab.selectExpr("concat('doc_', CAST(doc_id AS STRING)) AS datalake_id", "quality", "toxic"),
                                "datalake_id")
    return e.select(
        "datalake_id", "source", "name",
        F.when(F.col("quality") == 1, "order").otherwise(F.col("modality")).alias("modality"),
        F.lit("quality").alias("function"), F.lit(None).cast("string").alias("site"), "vid", "size_bytes",
        "encoding", "format", "data_path", (F.col("toxic") == 0).alias("reusable_flag"),
        F.lit(None).cast("string").alias("company"), F.expr("timestamp_seconds(1767225600)").alias("registered_at"))


NEW_D = (f"SELECT e.datalake_id, e.source, e.name, CASE WHEN l.quality = 1 THEN 'order' ELSE e.modality END AS modality, "
         "'quality' AS function, CAST(NULL AS VARCHAR) AS site, e.vid, e.size_bytes, e.encoding, e.format, e.data_path, "
         "l.toxic = 0 AS reusable_flag, CAST(NULL AS VARCHAR) AS company, make_timestamp(CAST(1767225600 AS BIGINT) * 1000000) AS registered_at "
         f"FROM ({ENTRY_DUCK}) e JOIN labels l ON e.datalake_id = 'doc_' || CAST(l.doc_id AS VARCHAR)")


@q("upsert_full_record")
def _upsert(spark, sf):
    return _out(K.upsert_full(entries(spark, sf), _new_records(spark, sf)))


SQL["upsert_full_record"] = f"""
WITH e AS ({ENTRY_DUCK}), n AS ({NEW_D}),
u AS (SELECT n.datalake_id, n.modality, n.function, n.site, n.company, coalesce(e.registered_at, n.registered_at) AS registered_at
      FROM n LEFT JOIN e USING (datalake_id)
      UNION ALL SELECT datalake_id, modality, function, site, company, registered_at FROM e
      WHERE datalake_id NOT IN (SELECT datalake_id FROM n))
SELECT {OUT_D} FROM u"""


@q("snapshot_compare")
def _snap(spark, sf):
    a = entries(spark, sf)
    b = K.upsert_full(a, _new_records(spark, sf))
    return K.snapshot_compare({"entries": a}, {"entries": b})


SQL["snapshot_compare"] = f"""
WITH a AS ({ENTRY_DUCK}), n AS ({NEW_D}),
b AS (SELECT n.datalake_id, n.source, n.name, n.modality, n.function, n.site, n.vid, n.size_bytes, n.encoding, n.format,
             n.data_path, n.reusable_flag, n.company, coalesce(a.registered_at, n.registered_at) AS registered_at
      FROM n LEFT JOIN a USING (datalake_id)
      UNION ALL SELECT * FROM a WHERE datalake_id NOT IN (SELECT datalake_id FROM n))
SELECT 'entries' AS "table", 'a' AS side, (SELECT count(*) FROM a) AS n
UNION ALL SELECT 'entries', 'b', (SELECT count(*) FROM b)
UNION ALL SELECT 'entries', 'only_a', (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b))
UNION ALL SELECT 'entries', 'only_b', (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))"""


# --- columns metadata: one registered dataset per customer, one column per order --------
_COLUMN_EXPRS = [
    "concat('cust_', CAST(o_custkey AS STRING)) AS datalake_id",
    "concat('c', CAST(o_orderkey AS STRING), '_', CASE o_orderkey % 8 WHEN 0 THEN 'part_key' WHEN 1 THEN 'injection pressure' WHEN 2 THEN 'unit_name' WHEN 3 THEN 'ship_status' "
    "WHEN 4 THEN 'free_text' WHEN 5 THEN 'temperature' WHEN 6 THEN 'wave' ELSE 'cycletime' END) AS name",
    "CASE WHEN o_orderkey % 8 = 6 THEN 'array' WHEN o_orderkey % 11 = 0 THEN 'datetime' WHEN o_orderkey % 8 IN (0, 7) THEN 'integer' WHEN o_orderkey % 8 IN (1, 5) THEN 'float' ELSE 'text' END AS dtype",
    "CASE WHEN o_orderkey % 8 = 6 THEN 'group' ELSE 'scalar' END AS column_kind",
    "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS ordinal",
]
COLS_D = "SELECT " + ", ".join(_COLUMN_EXPRS).replace("AS STRING)", "AS VARCHAR)") + " FROM orders"


def columns_meta(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(*_COLUMN_EXPRS)
    return rows.select("datalake_id", "name", "dtype", "column_kind", F.lit(None).cast("string").alias("group_desc"), "ordinal",
                       F.lit(None).cast("double").alias("stat_min"), F.lit(None).cast("double").alias("stat_max"))


def _ids(cond: str):
    """Datasets by their number, as a filter both engines read."""
    return f"datalake_id LIKE '%{cond}'"


@q("column_ordinals")
def _ordinals(spark, sf):
    """The header of every dataset, unfolded; its ordinals are those of the source."""
    named = F.array_sort(F.collect_list(F.struct("ordinal", "name")))  # one dataset's columns
    heads = columns_meta(spark, sf).groupBy("datalake_id").agg(F.transform(named, lambda c: c["name"]).alias("header"))
    return K.column_ordinals(heads)


SQL["column_ordinals"] = f"SELECT datalake_id, name, CAST(row_number() OVER (PARTITION BY datalake_id ORDER BY ordinal) - 1 AS INTEGER) AS ordinal FROM ({COLS_D})"


def _replaced(spark, sf):
    old = columns_meta(spark, sf)
    # a tenth of the datasets registered again with ordinals halved (introduces duplicates)
    new = old.filter(_ids("7")).withColumn("ordinal", (F.col("ordinal") / 2).cast("int"))
    return K.replace_columns(old, new)


@q("replace_columns")
def _replace(spark, sf):
    return _replaced(spark, sf).select("datalake_id", "name", "dtype", "column_kind", "ordinal")


REPLACED_D = (f"SELECT datalake_id, name, dtype, column_kind, CASE WHEN {_ids('7')} "
              f"THEN CAST(ordinal // 2 AS INTEGER) ELSE ordinal END AS ordinal FROM ({COLS_D})")
SQL["replace_columns"] = REPLACED_D


@q("ordinal_integrity")
def _integrity(spark, sf):
    return K.ordinal_integrity(_replaced(spark, sf))


SQL["ordinal_integrity"] = f"""
WITH c AS ({REPLACED_D}),
d AS (SELECT datalake_id, count(*) AS dup_ordinals FROM (SELECT datalake_id, ordinal FROM c WHERE ordinal IS NOT NULL
      GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT c.datalake_id, count(CASE WHEN ordinal IS NULL THEN 1 END) AS null_ordinals, count(*) AS n_columns,
       coalesce(max(d.dup_ordinals), 0) AS dup_ordinals,
       count(CASE WHEN ordinal IS NULL THEN 1 END) = 0 AND coalesce(max(d.dup_ordinals), 0) = 0 AS ok
FROM c LEFT JOIN d USING (datalake_id) GROUP BY c.datalake_id"""


@q("schema_drift")
def _drift(spark, sf):
    src = columns_meta(spark, sf).select("datalake_id", "name")
    # the catalog stored some datasets' names upper-cased and dropped a column of others
    cat = (src.withColumn("name", F.when(F.expr(_ids("4")), F.upper("name")).otherwise(F.col("name")))
           .filter(~(F.expr(_ids("8")) & F.col("name").rlike("^c[0-9]*2_"))))
    return K.schema_drift(src, cat)


SQL["schema_drift"] = f"""
WITH src AS (SELECT datalake_id, name FROM ({COLS_D})),
cat AS (SELECT datalake_id, CASE WHEN {_ids('4')} THEN upper(name) ELSE name END AS name FROM src
        WHERE NOT ({_ids('8')} AND regexp_matches(name, '^c[0-9]*2_')))
SELECT datalake_id, name, 'missing_in_catalog' AS drift FROM (SELECT * FROM src EXCEPT SELECT * FROM cat)
UNION ALL SELECT datalake_id, name, 'missing_in_source' FROM (SELECT * FROM cat EXCEPT SELECT * FROM src)"""


@q("stat_minmax")
def _minmax(spark, sf):
    """Observed bounds of every lineitem column, put into the catalog's columns."""
    path = f"{sf.rstrip('/')}/lineitem.parquet"
    stats = K.stat_minmax_of_files(spark, path, "lineitem")
    fields = spark.read.parquet(path).schema.fields
    own = spark.createDataFrame([("lineitem", f.name, f.dataType.simpleString(), "scalar", None, i, None, None) for i, f in enumerate(fields)], K.COLUMNS_SCHEMA)
    meta = K.apply_minmax(own.unionByName(columns_meta(spark, sf)), stats)
    return meta.filter("datalake_id = 'lineitem'").select("datalake_id", "name", "stat_min", "stat_max", F.col("stat_min").isNull().alias("all_null"))


_LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _minmax_sql():
    from millrace.checks.cleaning import duck_to_double
    parts = []
    for c in _LI_ALL:
        x = duck_to_double(f"CAST({c} AS VARCHAR)") if c != "l_shipdate" else "CAST(NULL AS DOUBLE)"
        if c in ("l_returnflag", "l_linestatus"):
            x = duck_to_double(c)
        parts.append(f"SELECT 'lineitem' AS datalake_id, '{c}' AS name, min({x}) AS stat_min, max({x}) AS stat_max, "
                     f"min({x}) IS NULL AS all_null FROM lineitem")
    return " UNION ALL ".join(parts)


SQL["stat_minmax"] = _minmax_sql()


# --- constraint specs derived from the columns metadata ------------------------------
# One spec per column, chosen from the column's kind, type and name so that
# every acceptance rule is exercised: group -> aggregate; *key -> extra field;
# dates -> both bounds null; *name -> boolean value; *type / *status ->
# unknown metric; *text -> deferred type; numbers -> a valid range.
_SPEC_RULE = (
    "CASE "
    "WHEN column_kind = 'group' THEN '{\"type\": \"aggregate\", \"metric\": \"rms\", \"op\": \"<=\", \"value\": 1.5}' "
    "WHEN name LIKE '%key' THEN '{\"type\": \"range\", \"min\": 1, \"max\": 9, \"extra\": true}' "
    "WHEN dtype = 'datetime' THEN '{\"type\": \"range\", \"min\": null, \"max\": null}' "
    "WHEN name LIKE '%name' THEN '{\"type\": \"single_value\", \"value\": true}' "
    "WHEN name LIKE '%type' OR name LIKE '%status' THEN '{\"type\": \"aggregate\", \"metric\": \"median\", \"op\": \"<=\", \"value\": 1}' "
    "WHEN name LIKE '%text' THEN '{\"type\": \"ratio\", \"value\": 0.5}' "
    "WHEN dtype IN ('integer', 'float') THEN concat('{\"type\": \"range\", \"min\": ', CAST(ordinal AS STRING), "
    "', \"max\": null, \"unit\": \"mm\"}') "
    "ELSE '{\"type\": \"single_value\", \"value\": \"42\"}' END")


def specs(spark, sf):
    cm = columns_meta(spark, sf)
    return cm.select("datalake_id", F.col("name").alias("column_name"), F.expr(_SPEC_RULE).alias("spec"))


SPECS_D = f"SELECT datalake_id, name AS column_name, {_SPEC_RULE.replace('AS STRING', 'AS VARCHAR')} AS spec FROM ({COLS_D})"


def _kind_d(field: str) -> str:
    first = f"regexp_extract(spec, '\"{field}\"\\s*:\\s*(\\S)', 1)"
    return (f"(CASE WHEN {first} = '' THEN 'missing' WHEN {first} = '\"' THEN 'string' "
            f"WHEN regexp_matches({first}, '[-0-9]') THEN 'number' WHEN {first} IN ('t', 'f') THEN 'boolean' "
            f"WHEN {first} = 'n' THEN 'null' ELSE 'other' END)")


def _spec_error_d() -> str:
    t = "json_extract_string(spec, '$.type')"
    allowed = ("CASE " + " ".join(f"WHEN {t} = '{k}' THEN {list(v)!r}" for k, v in CN.CANONICAL_FIELDS.items()) + " END")
    extra = f"list_sort(list_filter(json_keys(spec), lambda k: NOT list_contains({allowed}, k)))"
    metric, op = "json_extract_string(spec, '$.metric')", "json_extract_string(spec, '$.op')"
    num_or_null = lambda f: f"{_kind_d(f)} IN ('number', 'null', 'missing')"
    return (f"CASE WHEN {t} IS NULL OR {t} NOT IN {tuple(CN.CONSTRAINT_TYPES)!r} THEN 'unknown type' "
            f"WHEN {t} IN {tuple(CN.DEFERRED_TYPES)!r} THEN 'deferred type' "
            f"WHEN len({extra}) > 0 THEN 'extra fields: ' || array_to_string({extra}, ',') "
            f"WHEN {_kind_d('unit')} NOT IN ('string', 'null', 'missing') THEN 'unit must be text or null' "
            f"WHEN {t} = 'range' AND NOT ({num_or_null('min')}) THEN 'range: min must be a number or null' "
            f"WHEN {t} = 'range' AND NOT ({num_or_null('max')}) THEN 'range: max must be a number or null' "
            f"WHEN {t} = 'range' AND {_kind_d('min')} IN ('null', 'missing') AND {_kind_d('max')} IN ('null', 'missing') "
            f"THEN 'range: min or max required' "
            f"WHEN {t} = 'single_value' AND {_kind_d('value')} <> 'number' THEN 'single_value: value must be a number' "
            f"WHEN {t} = 'aggregate' AND ({metric} IS NULL OR {metric} NOT IN {tuple(CN.AGG_METRICS)!r}) THEN 'aggregate: bad metric' "
            f"WHEN {t} = 'aggregate' AND ({op} IS NULL OR {op} NOT IN {tuple(CN.AGG_OPS)!r}) THEN 'aggregate: bad op' "
            f"WHEN {t} = 'aggregate' AND {_kind_d('value')} <> 'number' THEN 'aggregate: value must be a number' END")


@q("constraint_spec_check")
def _spec_check(spark, sf):
    cm = columns_meta(spark, sf)
    return CN.check_specs(specs(spark, sf), cm, cm.select("datalake_id").distinct())


SQL["constraint_spec_check"] = f"""
WITH s AS ({SPECS_D}), c AS ({COLS_D})
SELECT s.datalake_id, s.column_name, s.spec,
       coalesce({_spec_error_d()},
                CASE WHEN json_extract_string(spec, '$.type') = 'aggregate' AND c.column_kind <> 'group'
                     THEN 'aggregate needs a group column' END) AS error,
       coalesce({_spec_error_d()},
                CASE WHEN json_extract_string(spec, '$.type') = 'aggregate' AND c.column_kind <> 'group'
                     THEN 'aggregate needs a group column' END) IS NULL AS accepted
FROM s JOIN c ON s.datalake_id = c.datalake_id AND s.column_name = c.name"""


@q("constraint_downconvert")
def _downconvert(spark, sf):
    ok = CN.check_specs(specs(spark, sf)).filter("accepted")
    engine, excluded = CN.downconvert(ok)
    return (engine.select("column_name", F.lit("engine").alias("kind"), "lo", "hi", F.lit(None).cast("string").alias("type"))
            .unionByName(excluded.select("column_name", F.lit("excluded").alias("kind"), F.lit(None).cast("double").alias("lo"),
                                         F.lit(None).cast("double").alias("hi"), "type")))


SQL["constraint_downconvert"] = f"""
WITH s AS (SELECT * FROM ({SPECS_D}) WHERE ({_spec_error_d()}) IS NULL)
SELECT column_name, 'engine' AS kind, TRY_CAST(json_extract_string(spec, '$.min') AS DOUBLE) AS lo,
       TRY_CAST(json_extract_string(spec, '$.max') AS DOUBLE) AS hi, CAST(NULL AS VARCHAR) AS type
FROM s WHERE json_extract_string(spec, '$.type') = 'range'
UNION ALL
SELECT column_name, 'excluded', NULL, NULL, json_extract_string(spec, '$.type') FROM s
WHERE json_extract_string(spec, '$.type') IS DISTINCT FROM 'range'"""


@q("constraint_merge")
def _merge(spark, sf):
    """Session specs on every dataset's float columns (plus a key with no column in
    some), stored specs on all numeric columns: floats resolve to the session
    value, integers to the stored suggestion, text stays blank."""
    cm = columns_meta(spark, sf)
    typed = specs(spark, sf).join(cm.select("datalake_id", F.col("name").alias("column_name"), "dtype"), ["datalake_id", "column_name"])
    session = typed.filter(F.col("dtype") == "float").select("datalake_id", "column_name", "spec")
    gone = cm.filter(_ids("9")).select("datalake_id", F.lit("no_such_column").alias("column_name"), F.lit('{"type": "range", "min": 0}').alias("spec")).distinct()
    stored = typed.filter(F.col("dtype").isin("integer", "float")).select("datalake_id", "column_name", "spec", F.lit("planner").alias("approved_by"))
    return CN.merge_view(cm.select("datalake_id", "name"), session.unionByName(gone), stored, by=["datalake_id"])


SQL["constraint_merge"] = f"""
WITH c AS (SELECT datalake_id, name, dtype FROM ({COLS_D})),
sp AS (SELECT * FROM ({SPECS_D})),
ses AS (SELECT sp.datalake_id, sp.column_name, sp.spec FROM sp JOIN c ON sp.datalake_id = c.datalake_id AND sp.column_name = c.name WHERE c.dtype = 'float'
        UNION ALL SELECT DISTINCT datalake_id, 'no_such_column', '{{"type": "range", "min": 0}}' FROM c WHERE {_ids('9')}),
sto AS (SELECT sp.datalake_id, sp.column_name, sp.spec, 'planner' AS approved_by FROM sp JOIN c ON sp.datalake_id = c.datalake_id AND sp.column_name = c.name
        WHERE c.dtype IN ('integer', 'float'))
SELECT c.datalake_id, c.name AS column_name, CASE WHEN ses.spec IS NOT NULL THEN 'session' WHEN sto.spec IS NOT NULL THEN 'prefill' ELSE 'blank' END AS source,
       ses.spec AS spec, ses.spec IS NOT NULL AS applied, sto.spec AS prefill_spec, sto.approved_by AS prefill_by, FALSE AS stale
FROM c LEFT JOIN ses ON c.datalake_id = ses.datalake_id AND c.name = ses.column_name LEFT JOIN sto ON c.datalake_id = sto.datalake_id AND c.name = sto.column_name
UNION ALL
SELECT ses.datalake_id, ses.column_name, 'session', ses.spec, TRUE, NULL, NULL, TRUE FROM ses ANTI JOIN c ON c.datalake_id = ses.datalake_id AND c.name = ses.column_name"""


# --- L3 / L4 / L5 ------------------------------------------------------------------------
def _history_flow(spark, sf):
    """Constraints and history after two rounds, each written as a version, since every later step reads them."""
    ok = written(CN.check_specs(specs(spark, sf)).filter("accepted").select("datalake_id", "column_name", "spec"), "accepted-specs")
    t1 = F.expr("timestamp_seconds(1735689600)")
    t2 = F.expr("timestamp_seconds(1735776000)")
    v1 = ok.select("datalake_id", "column_name", F.col("spec").alias("constraint_spec"), t1.alias("approved_at"),
                   F.lit("alice").alias("approved_by"))
    cur0 = spark.createDataFrame([], K.CONSTRAINT_SCHEMA)
    hist0 = spark.createDataFrame([], K.HISTORY_SCHEMA)
    cur1, hist1 = K.constraint_upsert(cur0, hist0, v1)
    v2 = (v1.filter(_ids("1"))
          .withColumn("constraint_spec", F.regexp_replace("constraint_spec", '"unit": "mm"', '"unit": "cm"'))
          .withColumn("approved_at", t2).withColumn("approved_by", F.lit("bob")))
    cur2, hist2 = K.constraint_upsert(cur1, hist1, v2)
    return written(cur2, "constraints"), written(hist2, "constraint-history")


_OK_SPECS_D = f"SELECT * FROM ({SPECS_D}) WHERE ({_spec_error_d()}) IS NULL"


@q("constraint_upsert_history")
def _upsert_hist(spark, sf):
    cur, hist = _history_flow(spark, sf)
    return hist.select("datalake_id", "column_name", "constraint_spec", "approved_by", "action")


SQL["constraint_upsert_history"] = f"""
WITH ok AS ({_OK_SPECS_D})
SELECT datalake_id, column_name, spec AS constraint_spec, 'alice' AS approved_by, 'create' AS action FROM ok
UNION ALL
SELECT datalake_id, column_name, replace(spec, '"unit": "mm"', '"unit": "cm"'), 'bob', 'update' FROM ok
WHERE {_ids('1')}"""


@q("constraint_delete_history")
def _delete_hist(spark, sf):
    cur, hist = _history_flow(spark, sf)
    # remove every constraint of integer columns of some datasets, plus keys that do not exist
    some = columns_meta(spark, sf).filter(_ids("1") + " OR " + _ids("2"))
    keys = (some.filter(F.col("dtype") == "integer").select("datalake_id", F.col("name").alias("column_name"))
            .unionByName(some.select("datalake_id", F.lit("no_such_column").alias("column_name")).distinct()))
    cur3, hist3 = K.constraint_delete(cur, hist, keys, "carol", F.expr("timestamp_seconds(1735862400)"))
    return hist3.filter(F.col("action") == "delete").select("datalake_id", "column_name", "constraint_spec", "approved_by", "action")


SQL["constraint_delete_history"] = f"""
WITH ok AS ({_OK_SPECS_D}),
cur AS (SELECT datalake_id, column_name, CASE WHEN {_ids('1')}
             THEN replace(spec, '"unit": "mm"', '"unit": "cm"') ELSE spec END AS constraint_spec FROM ok)
SELECT cur.datalake_id, cur.column_name, cur.constraint_spec, 'carol' AS approved_by, 'delete' AS action
FROM cur JOIN ({COLS_D}) c ON cur.datalake_id = c.datalake_id AND cur.column_name = c.name
WHERE (c.{_ids('1')} OR c.{_ids('2')}) AND c.dtype = 'integer'"""


@q("entry_delete_cascade")
def _cascade(spark, sf):
    cur, hist = _history_flow(spark, sf)
    cm = columns_meta(spark, sf)
    ents = written(cm.select("datalake_id").distinct(), "catalog-entries")
    ids = ents.filter(_ids("1") + " OR " + _ids("3"))
    e2, c2, cur2, h2 = K.entry_delete_cascade(ents, cm, cur, hist, ids, F.expr("timestamp_seconds(1735862400)"))
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("relation"), "n")
    dels = h2.filter(F.col("action") == "delete").groupBy("approved_by").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("history_delete_by_"), F.col("approved_by")).alias("relation"), "n")
    return count(e2, "entries").unionByName(count(c2, "columns")).unionByName(count(cur2, "constraints")).unionByName(
        count(h2, "history")).unionByName(dels)


_GONE_D = _ids("1") + " OR " + _ids("3")
SQL["entry_delete_cascade"] = f"""
WITH ok AS ({_OK_SPECS_D}), c AS ({COLS_D}),
upd AS (SELECT * FROM ok WHERE {_ids('1')})
SELECT 'entries' AS relation, count(DISTINCT datalake_id) AS n FROM c WHERE NOT ({_GONE_D})
UNION ALL SELECT 'columns', count(*) FROM c WHERE NOT ({_GONE_D})
UNION ALL SELECT 'constraints', count(*) FROM ok WHERE NOT ({_GONE_D})
UNION ALL SELECT 'history', (SELECT count(*) FROM ok) + (SELECT count(*) FROM upd)
          + (SELECT count(*) FROM ok WHERE {_GONE_D})
UNION ALL SELECT 'history_delete_by_' || CASE WHEN {_ids('1')} THEN 'bob' ELSE 'alice' END,
          count(*) FROM ok WHERE {_GONE_D} GROUP BY 1"""


# --- B21 / B20 / B13 / B15 ----------------------------------------------------------------
@q("constrainable_columns")
def _constrainable(spark, sf):
    return CN.constrainable_columns(columns_meta(spark, sf)).select("datalake_id", "name", "dtype", "column_kind")


SQL["constrainable_columns"] = (f"SELECT datalake_id, name, dtype, column_kind FROM ({COLS_D}) "
                                "WHERE column_kind = 'group' OR (column_kind = 'scalar' AND dtype IN ('integer', 'float'))")


@q("target_candidates")
def _targets(spark, sf):
    prof = P.profile_columns(table(spark, sf, "orders"), approx=False)
    num = F.col("dtype").isin("integer", "float", "boolean")
    return prof.select("name", num.alias("regression_ok"), ((~num) | (F.col("n_unique") <= 10)).alias("classification_ok"))


SQL["target_candidates"] = " UNION ALL ".join(
    f"SELECT '{c}' AS name, {num} AS regression_ok, (NOT {num}) OR count(DISTINCT {c}) <= 10 AS classification_ok FROM orders"
    for c, num in [("o_orderkey", "TRUE"), ("o_custkey", "TRUE"), ("o_orderstatus", "FALSE"), ("o_totalprice", "TRUE"),
                   ("o_orderdate", "FALSE"), ("o_orderpriority", "FALSE")])


@q("check_required_nulls")
def _required(spark, sf):
    from millrace.operators.checks import required_and_nulls
    return required_and_nulls(P.profile_columns(messy_lineitem(spark, sf)), ["l_orderkey", "l_comment", "qty_txt"], 0.1)


SQL["check_required_nulls"] = f"""
WITH m AS ({MESSY_LINEITEM_SQL}),
p AS (SELECT 'l_discount' AS name, count(*) AS n, count(*) - count(l_discount) AS nulls FROM m
      UNION ALL SELECT 'l_tax', count(*), count(*) - count(l_tax) FROM m
      UNION ALL SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag) FROM m)
SELECT 'missing_required' AS kind, 'l_comment' AS column, CAST(NULL AS DOUBLE) AS null_ratio
UNION ALL SELECT 'null_ratio', name, round(nulls * 1.0 / greatest(n, 1), 4) FROM p WHERE nulls * 1.0 / greatest(n, 1) > 0.1"""


@q("check_min_class")
def _min_class(spark, sf):
    from millrace.operators.checks import min_class_ratio
    return min_class_ratio(table(spark, sf, "conversations"), "role", 0.2)


SQL["check_min_class"] = """
WITH c AS (SELECT role AS label, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS total FROM c)
SELECT label, n AS count, round(n * 1.0 / total, 4) AS share, n * 1.0 / total < 0.2 AS below FROM c, t"""


@q("check_image_rules")
def _image_rules(spark, sf):
    """B14 on documents: items whose language is not the required one (count
    and three examples) and classes (sources) with fewer than k items."""
    from millrace.operators.checks import attribute_rules
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"),
                                             F.col("lang").alias("mode"), F.col("source").alias("label"))
    return attribute_rules(d, "mode", "en", "label", 40)


SQL["check_image_rules"] = """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS file, lang AS mode, source AS label FROM documents),
bad AS (SELECT count(*) AS n, list_sort(list(file))[1:3] AS ex FROM d WHERE mode IS DISTINCT FROM 'en')
SELECT 'mode_mismatch' AS kind, CAST(NULL AS VARCHAR) AS label, n AS count, array_to_string(ex, ',') AS examples FROM bad WHERE n > 0
UNION ALL
SELECT 'class_too_few', label, count(*), CAST(NULL AS VARCHAR) FROM d WHERE label IS NOT NULL GROUP BY label HAVING count(*) < 40"""


# --- F8 ---------------------------------------------------------------------------------------
@q("json_schema")
def _json_schema(spark, sf):
    """The JSON type of every column of every dataset in the catalog."""
    from millrace.operators.checks import json_types
    return json_types(columns_meta(spark, sf))


SQL["json_schema"] = (f"SELECT datalake_id AS dataset, name AS property, CASE WHEN dtype = 'integer' THEN 'integer' "
                      f"WHEN dtype = 'float' THEN 'number' WHEN dtype = 'boolean' THEN 'boolean' "
                      f"WHEN dtype = 'array' THEN 'array' ELSE 'string' END AS json_type FROM ({COLS_D})")


@q("json_props")
def _json_props(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
                    F.to_json(F.struct("event_type", "value")).alias("payload"))


SQL["json_props"] = ("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
                     "to_json(struct_pack(event_type := event_type, value := value))::VARCHAR AS payload FROM events")
