"""Registered queries: constraint lists and histories, snapshots, processed
data, timestamps and externally ranked plans (L2, L6, A15, A19, T3, T6, F10),
all derived from table rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions.scalars import iso_utc, parse_time
from millrace.operators import catalog as K
from millrace.plans.rules import order_by_ranking
from millrace.session import scratch_path, table
from millrace.sources.sinks import read_processed, write_backup_pair

Q: dict = {}
SQL: dict = {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


# --- L6: one constraint per customer and priority, from even and then odd orders -----
_SPEC = "concat('{\"type\":\"range\",\"max\":', cast(cast(round(max(o_totalprice)) AS bigint) AS string), '}')"


def _constraints(spark, sf, odd):
    rows = table(spark, sf, "orders").filter(F.col("o_orderkey") % 2 == odd)
    return rows.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("datalake_id"), F.col("o_orderpriority").alias("column_name")).agg(
        F.expr(_SPEC).alias("constraint_spec"), F.lit(f"user{odd}").alias("approved_by"), F.lit(f"2024-01-0{odd + 1}").alias("approved_at"))


def _upserted(spark, sf):
    empty = _constraints(spark, sf, 0).limit(0).select(F.lit("").alias("history_id"), "datalake_id", "column_name", "constraint_spec", "approved_by", "approved_at", F.lit("").alias("action"))
    first = _constraints(spark, sf, 0)
    current, history = K.constraint_upsert(first.limit(0), empty, first)
    return K.constraint_upsert(current, history, _constraints(spark, sf, 1))


@q("constraint_list")
def _list(spark, sf):
    return K.list_constraints(_upserted(spark, sf)[0]).select("datalake_id", "column_name", "constraint_spec", "approved_by")


@q("constraint_versions")
def _versions(spark, sf):
    return K.constraint_history(_upserted(spark, sf)[1]).select("datalake_id", "column_name", "version", "action", "approved_by")


_C = """WITH c AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS datalake_id, o_orderpriority AS column_name, o_orderkey % 2 AS odd,
  '{"type":"range","max":' || CAST(CAST(round(max(o_totalprice)) AS BIGINT) AS VARCHAR) || '}' AS constraint_spec FROM orders GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY datalake_id, column_name ORDER BY odd) AS version,
  count(*) OVER (PARTITION BY datalake_id, column_name) AS n FROM c)"""
SQL["constraint_list"] = _C + " SELECT datalake_id, column_name, constraint_spec, 'user' || CAST(odd AS VARCHAR) AS approved_by FROM v WHERE version = n"
SQL["constraint_versions"] = _C + """ SELECT datalake_id, column_name, version, CASE WHEN version = 1 THEN 'create' ELSE 'update' END AS action,
  'user' || CAST(odd AS VARCHAR) AS approved_by FROM v"""


# --- L2: single columns -----------------------------------------------------------
@q("upsert_column")
def _upsert_column(spark, sf):
    """Column records per source and language; every third is sent again."""
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("datalake_id"), F.col("lang").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    again = d.filter(F.col("first") % 3 == 0).withColumn("n", -F.col("n"))
    return K.upsert_column(d, again)


SQL["upsert_column"] = """SELECT source AS datalake_id, lang AS name, CASE WHEN min(doc_id) % 3 = 0 THEN -count(*) ELSE count(*) END AS n, min(doc_id) AS first
FROM documents GROUP BY source, lang"""


# --- A19 / T6 / A15 -----------------------------------------------------------------
@q("snapshot_roundtrip")
def _snapshot(spark, sf):
    names = ["region", "nation", "customer", "orders"]
    live = {n: table(spark, sf, n) for n in names}
    keys = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"]}
    root = scratch_path(spark, f"snapshot-{uuid.uuid4().hex}")
    K.dump_snapshot(live, keys, root)
    dumped = K.restore_snapshot(spark, root, names)
    # one table lacks rows, so that the comparison has something to find
    dumped["orders"] = dumped["orders"].filter("o_orderkey % 10 <> 0")
    return K.verify_snapshot(live, dumped)


SQL["snapshot_roundtrip"] = """
SELECT 'region' AS "table", count(*) AS n_live, count(*) AS n_dump, 0 AS n_differ FROM region
UNION ALL SELECT 'nation', count(*), count(*), 0 FROM nation UNION ALL SELECT 'customer', count(*), count(*), 0 FROM customer
UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_orderkey % 10 <> 0), count(*) FILTER (o_orderkey % 10 = 0) FROM orders"""


@q("processed_reader")
def _processed(spark, sf):
    root = scratch_path(spark, f"processed-{uuid.uuid4().hex}")
    o = table(spark, sf, "orders")
    write_backup_pair(o, o.filter("o_totalprice <= 200000"), root, "orders")
    found = read_processed(spark, root, "orders")
    absent = read_processed(spark, root, "lineitem") is None
    return found.select("o_orderkey", "o_totalprice").withColumn("other_absent", F.lit(absent))


SQL["processed_reader"] = "SELECT o_orderkey, o_totalprice, TRUE AS other_absent FROM orders WHERE o_totalprice <= 200000"


# --- F10 ---------------------------------------------------------------------------
@q("timestamp_text")
def _times(spark, sf):
    """Event times as text in four forms, one of them no time, and read again."""
    form = F.col("event_id") % 4
    text = (F.when(form == 0, iso_utc(F.col("ts"))).when(form == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .when(form == 2, F.date_format("ts", "yyyy/MM/dd HH:mm")).otherwise(F.concat(F.lit("at "), F.date_format("ts", "HH:mm"))))
    e = table(spark, sf, "events").select("event_id", text.alias("written"))
    return e.select("event_id", "written", F.unix_micros(parse_time(F.col("written"))).alias("micros"))


SQL["timestamp_text"] = """
WITH w AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 2 THEN strftime(ts, '%Y/%m/%d %H:%M') ELSE 'at ' || strftime(ts, '%H:%M') END AS written FROM events)
SELECT event_id, written, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(date_trunc('minute', ts)) END AS micros FROM w"""


# --- T3 ----------------------------------------------------------------------------
@q("plan_external_rank")
def _ranked(spark, sf):
    """One plan per customer: its order priorities, ranked by how often each
    stands in the table; two priorities are left out of the ranking."""
    o = table(spark, sf, "orders")
    steps = o.groupBy(F.col("o_custkey").alias("dataset_id"), F.col("o_orderpriority").alias("operation")).agg(F.min("o_orderkey").alias("position"))
    ranking = o.filter(~F.col("o_orderpriority").rlike("^[35]")).groupBy(F.col("o_orderpriority").alias("operation")).agg(F.count(F.lit(1)).alias("rank"))
    return order_by_ranking(steps, ranking).select("dataset_id", "operation", "order")


SQL["plan_external_rank"] = """
WITH s AS (SELECT o_custkey AS dataset_id, o_orderpriority AS operation, min(o_orderkey) AS position FROM orders GROUP BY ALL),
r AS (SELECT o_orderpriority AS operation, count(*) AS rank FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[35]') GROUP BY 1)
SELECT dataset_id, operation, row_number() OVER (PARTITION BY dataset_id ORDER BY rank NULLS LAST, position) AS "order" FROM s LEFT JOIN r USING (operation)"""
