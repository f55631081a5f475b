"""Guarded ad-hoc query over a read-only view of a processed table.

The user writes one Spark SQL SELECT over the view ``t``. Before running it
the statement is parsed (not analysed) with the session's parser, and every node
of the tree is visited. It is refused when it is too long, is not a query, holds a
clause, expression or value that is not on the lists below (whatever is unknown is
refused), reads a relation other than ``t`` or a name that a WITH clause in reach
defines, or calls a function that is not listed: built-in functions reach the JVM,
files and the session too, and a script transform runs commands. The
query runs under a job group, cancelled after a time limit where one is given;
the result is capped at 200 rows with the total and a truncated flag; success
and failure both produce a lineage row.
"""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------
MAX_CHARS = 10_000
ROW_CAP = 200
VIEW = "t"
#: Functions that compute on values and nothing else.
ALLOWED_FUNCTIONS = frozenset("""
abs acos aggregate any any_value approx_count_distinct array array_contains array_distinct array_join array_max array_min array_size array_sort asin atan avg
between bool_and bool_or bround cardinality cast cbrt ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if
covar_pop covar_samp cume_dist current_date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear
dense_rank element_at endswith every exp explode extract filter first first_value floor forall greatest hour if ifnull initcap instr isnan isnotnull isnull kurtosis lag
last last_value lcase lead least left len length ln locate log log10 log2 lower lpad ltrim make_date max max_by mean median min min_by minute mod mode
month months_between named_struct nanvl ntile nullif nvl nvl2 percent_rank percentile percentile_approx pmod position posexplode pow power quarter rank
regexp_count regexp_extract regexp_like regexp_replace regr_r2 regr_slope replace reverse right rlike round row_number rpad rtrim second sequence sign
sin size skewness slice sort_array split sqrt startswith std stddev stddev_pop stddev_samp struct substr substring sum tan timestampdiff to_date
to_timestamp transform translate trim trunc try_cast try_divide try_to_number typeof ucase upper var_pop var_samp variance weekofyear when width_bucket window year
""".split())
# ---------------------------------------------------------------------------

#: Parts of a query: relations and clauses.
ALLOWED_PLANS = frozenset("""
Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sort SubqueryAlias
Union Unpivot UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition
""".split())
#: Expressions that name no function; ``UnresolvedFunction`` is looked up by name.
ALLOWED_EXPRESSIONS = frozenset("""
Add Alias And AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce Concat CreateNamedStruct Cube CurrentDate CurrentRow$
Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual GroupingSets ILike In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction
LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal MultiAlias Multiply Not NotLikeAll NotLikeAny Or Overlay RLike Remainder Rollup
ScalarSubquery ShiftLeft ShiftRight ShiftRightUnsigned SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimBoth StringTrimLeft
StringTrimRight Substring Subtract UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute
UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar
UnresolvedStarExceptOrReplace UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition
""".split())
#: What nodes hold besides other nodes: plain values, types and settings.
ALLOWED_VALUES = frozenset("""
AliasIdentifier Ascending$ Cross$ Decimal Descending$ ExprId FullOuter$ FunctionIdentifier GenericInternalRow Inner$ JoinHint LeftAnti$ LeftOuter$ LeftSemi$
Metadata NaturalJoin NullsFirst$ NullsLast$ NumericEvalContext RangeFrame$ RightOuter$ RowFrame$ UTF8String UsingJoin Val CalendarInterval
WindowSpecReference
""".split())
# ---------------------------------------------------------------------------

_CATALYST = "org.apache.spark.sql.catalyst."
_WITH = re.compile(r"(?is)\s*with\b(?!\s+recursive\b)")


@dataclass
class GuardResult:
    ok: bool
    reason: str | None
    result: DataFrame | None = None
    total: int | None = None
    truncated: bool = False
    lineage: DataFrame | None = None


class _Refused(Exception):
    """Why a statement may not run."""


class _Tree:
    """A parsed statement, node by node: each node's own fields are followed,
    whatever they hold, so nothing lies outside the walk. Printed forms of the
    plan, which Spark shortens, are never read."""

    def __init__(self, spark: SparkSession) -> None:
        self.gateway = spark.sparkContext._gateway

    def _is(self, item, name: str) -> bool:
        return is_instance_of(self.gateway, item, name)

    @staticmethod
    def _items(item) -> list:
        found = []
        while item.hasNext():
            found.append(item.next())
        return found

    def fields(self, item) -> list:
        return self._items(item.productIterator())

    def check(self, plan) -> None:
        """Walk every node with the WITH names that it sees."""
        waiting: list[tuple] = [(plan, frozenset())]
        while waiting:
            item, names = waiting.pop()
            if not isinstance(item, JavaObject):  # text, numbers, true and false, nothing
                continue
            if self._is(item, f"{_CATALYST}trees.TreeNode"):
                waiting += self._node(item, names)
            elif self._is(item, "scala.Option") or self._is(item, "scala.collection.Iterable"):
                waiting += [(x, names) for x in self._items(item.iterator())]
            elif self._is(item, "scala.Tuple2") or self._is(item, "scala.Tuple3"):
                waiting += [(x, names) for x in self.fields(item)]
            elif self._is(item, "org.apache.spark.sql.types.DataType"):
                continue
            elif self._is(item, "org.apache.spark.sql.util.CaseInsensitiveStringMap"):
                if not item.isEmpty():
                    raise _Refused("options are not allowed")
            elif self._short(item) not in ALLOWED_VALUES:
                raise _Refused(f"syntax not allowed: {self._short(item)}")

    @staticmethod
    def _short(item) -> str:
        return item.getClass().getName().rsplit(".", 1)[-1].rsplit("$", 1)[-1] or item.getClass().getName().rsplit(".", 1)[-1]

    def _node(self, node, names: frozenset) -> list[tuple]:
        path = node.getClass().getName()
        kind = path.rsplit(".", 1)[-1]
        plan = self._is(node, f"{_CATALYST}plans.logical.LogicalPlan")
        if not path.startswith(_CATALYST) or kind not in (ALLOWED_PLANS if plan else ALLOWED_EXPRESSIONS):
            if kind == "UnresolvedTableValuedFunction":
                raise _Refused("table-valued functions are not allowed")
            raise _Refused(f"syntax not allowed: {kind}")
        if kind == "UnresolvedWith":
            return self._with(node, names)
        if kind == "UnresolvedRelation":
            parts = [str(p).lower() for p in self._items(node.multipartIdentifier().iterator())]
            if parts != [VIEW] and (len(parts) > 1 or parts[0] not in names):  # a view or WITH name has one part
                raise _Refused(f"relation not allowed: {['.'.join(parts)]}")
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = ".".join(str(p) for p in self._items(node.nameParts().iterator())) if kind == "UnresolvedFunction" else node.name().unquotedString()
            if name.lower() not in ALLOWED_FUNCTIONS:
                raise _Refused(f"function not allowed: {[name.lower()]}")
        return [(x, names) for x in self.fields(node)]

    def _with(self, node, names: frozenset) -> list[tuple]:
        """Each relation sees the names before it, the query all of them."""
        if node.allowRecursion():
            raise _Refused("recursive queries are not allowed")
        waiting = []
        for relation in self._items(node.cteRelations().iterator()):
            name, body, *rest = self.fields(relation)
            if name.lower() == VIEW:
                raise _Refused(f"{VIEW} can't be redefined")
            waiting += [(x, names) for x in (body, *rest)]
            names = names | {name.lower()}
        return [*waiting, (node.child(), names)]


def check_sql(spark: SparkSession, sql: str) -> str | None:
    """Reason the statement is refused, or None when it may run."""
    if len(sql) > MAX_CHARS:
        return "too long"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001 - parser errors are reported, not raised
        return f"parse error: {str(e).splitlines()[0][:200]}"
    tree = _Tree(spark)
    if any(tree._is(plan, f"{_CATALYST}plans.logical.{kind}") for kind in ("Command", "ParsedStatement")):
        return "only a SELECT query is allowed"
    try:
        tree.check(plan)
    except _Refused as e:
        return str(e)
    return None


def guarded_query(df: DataFrame, sql: str, dataset_id: str = "dataset", time_limit: float | None = None,
                  count_total: bool = True) -> GuardResult:
    spark = df.sparkSession
    reason = check_sql(spark, sql)
    lid = uuid.uuid5(uuid.NAMESPACE_URL, f"{dataset_id}:{sql}").hex
    if reason:
        lin = spark.createDataFrame([(lid, dataset_id, "adhoc_query", "refused", reason)],
                                    "id string, dataset_id string, transformation_type string, status string, detail string")
        return GuardResult(False, reason, lineage=lin)
    view = f"{VIEW}_{uuid.uuid4().hex}"  # another call's view is another view
    df.createOrReplaceTempView(view)
    opening = _WITH.match(sql)
    bound = f"WITH {VIEW} AS (SELECT * FROM {view})" + (f", {sql[opening.end():]}" if opening else f" {sql}")
    sc = spark.sparkContext
    group = f"millrace-adhoc-{lid[:12]}"
    sc.setJobGroup(group, "guarded ad-hoc query", interruptOnCancel=True)
    timer = threading.Timer(time_limit, lambda: sc.cancelJobGroup(group)) if time_limit else None
    if timer:
        timer.start()
    try:
        res = spark.sql(bound)
        head = res.limit(ROW_CAP + 1).collect()  # at most 201 rows reach the driver
        total = res.count() if (count_total and len(head) > ROW_CAP) else len(head)
        status, detail = "done", f"rows={total}"
    except Exception as e:  # noqa: BLE001 - failures are recorded in lineage
        head, total, status, detail = [], None, "failed", str(e).splitlines()[0][:200]
    finally:
        if timer:
            timer.cancel()
        spark.catalog.dropTempView(view)
        sc.setLocalProperty("spark.jobGroup.id", None)
    lin = spark.createDataFrame([(lid, dataset_id, "adhoc_query", status, detail)],
                                "id string, dataset_id string, transformation_type string, status string, detail string")
    if status != "done":
        return GuardResult(False, detail, lineage=lin)
    out = spark.createDataFrame(head[:ROW_CAP], res.schema) if head else spark.createDataFrame([], res.schema)
    return GuardResult(True, None, result=out, total=total, truncated=len(head) > ROW_CAP, lineage=lin)
