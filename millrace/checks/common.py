"""Shared derived inputs for the registered queries.

The driver's tables hold no NULLs and no masked text, so the queries derive
"messy" views from them with SQL expressions that Spark SQL and DuckDB both
accept; the Spark side and the oracle side are therefore the same relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import table

# Expressions over `lineitem` producing masked text, NULLs and a label.
MESSY_LINEITEM_EXPRS = [
    "l_orderkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "CASE WHEN l_linenumber = 1 THEN '*' WHEN l_linenumber = 2 THEN '**' "
    "WHEN l_linenumber = 7 THEN 'N/A' ELSE CAST(l_quantity AS STRING) END AS qty_txt",
    "NULLIF(l_discount, 0.0) AS l_discount",
    "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_tax END AS l_tax",
    "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_linestatus",
]
MESSY_LINEITEM_SQL = "SELECT " + ", ".join(MESSY_LINEITEM_EXPRS) + " FROM lineitem"


def messy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*MESSY_LINEITEM_EXPRS)


# `documents` left-joined with `labels`: NULL labels for unlabeled documents.
DOC_LABELS_SQL = (
    "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")


# `events` with an error label that is rare (value > 150 among errors).
EVENT_LABEL_EXPRS = [
    "event_id", "user_id", "event_type", "value",
    "CASE WHEN event_type = 'error' AND value > 150 THEN 'NG' ELSE 'OK' END AS judge",
]
EVENT_LABEL_SQL = "SELECT " + ", ".join(EVENT_LABEL_EXPRS) + " FROM events"


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*EVENT_LABEL_EXPRS)
