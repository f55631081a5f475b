"""Registered queries: charts, junk columns, picks, row guard and signals
(D9-D14, B8-B10, W1-W4, G1-G3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import charts as C
from millrace.operators import signals as S
from millrace.operators.profile import junk_columns
from millrace.session import table

Q: dict = {}
SQL: dict = {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


# --- D9 -----------------------------------------------------------------------
@q("histogram")
def _hist(spark, sf):
    h = C.histogram(table(spark, sf, "orders"), "o_totalprice")
    return h.select("column", "bin", F.round("bin_lo", 4).alias("bin_lo"), F.round("bin_hi", 4).alias("bin_hi"), "count")


SQL["histogram"] = """
WITH x AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)),
s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM x),
w AS (SELECT *, (hi - lo) / (log2(CAST(n AS DOUBLE)) + 1.0) AS sturges,
             2.0 * (q3 - q1) * pow(CAST(n AS DOUBLE), CAST(-1 AS DOUBLE) / 3) AS fd FROM s),
b AS (SELECT *, CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END AS width FROM w),
p AS (SELECT CASE WHEN hi = lo THEN 1 ELSE CAST(ceil((hi - lo) / width) AS BIGINT) END AS nb,
             CASE WHEN hi = lo THEN lo - 0.5 ELSE lo END AS first, CASE WHEN hi = lo THEN hi + 0.5 ELSE hi END AS last FROM b),
bins AS (SELECT unnest(range(nb)) AS bin FROM p),
cnt AS (SELECT CAST(least(greatest(floor((x - first) * nb / (last - first)), 0), nb - 1) AS BIGINT) AS bin, count(*) AS c
        FROM x, p GROUP BY 1)
SELECT 'o_totalprice' AS \"column\", CAST(bins.bin AS INTEGER) AS bin,
       round(first + bins.bin * ((last - first) / nb), 4) AS bin_lo,
       round(CASE WHEN bins.bin = nb - 1 THEN last ELSE first + (bins.bin + 1) * ((last - first) / nb) END, 4) AS bin_hi,
       coalesce(cnt.c, 0) AS count
FROM bins CROSS JOIN p LEFT JOIN cnt ON bins.bin = cnt.bin"""


# --- D10 ----------------------------------------------------------------------
@q("boxplot_by_label")
def _box(spark, sf):
    b = C.boxplot_by_label(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return b.select("label", *[F.round(c, 4).alias(c) for c in ("min", "q1", "median", "q3", "max")], "n")


SQL["boxplot_by_label"] = """
WITH top AS (SELECT o_orderpriority AS label, count(*) AS c FROM orders WHERE o_orderpriority IS NOT NULL
             GROUP BY 1 ORDER BY c DESC, label LIMIT 30)
SELECT o_orderpriority AS label, round(min(o_totalprice), 4) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
       round(max(o_totalprice), 4) AS max, count(o_totalprice) AS n
FROM orders WHERE o_orderpriority IN (SELECT label FROM top) AND o_totalprice IS NOT NULL GROUP BY 1"""


@q("boxplot_many_labels")
def _box_many(spark, sf):
    """More labels than are shown: the others are counted."""
    b = C.boxplot_by_label(table(spark, sf, "orders"), "o_totalprice", "o_custkey")
    return b.select("label", *[F.round(c, 4).alias(c) for c in ("min", "q1", "median", "q3", "max")], "n")


SQL["boxplot_many_labels"] = """
WITH top AS (SELECT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 30)
SELECT CAST(o_custkey AS VARCHAR) AS label, round(min(o_totalprice), 4) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
       round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(max(o_totalprice), 4) AS max, count(o_totalprice) AS n FROM orders WHERE o_custkey IN (SELECT k FROM top) GROUP BY 1
UNION ALL SELECT '__others__', NULL, NULL, NULL, NULL, NULL, count(o_totalprice) FROM orders WHERE o_custkey NOT IN (SELECT k FROM top) HAVING count(o_totalprice) > 0"""


@q("boxplot_by_label_wide")
def _box_wide(spark, sf):
    """Quartiles of a high-cardinality column per label."""
    from millrace.functions.quantiles import exact_quantiles
    li = table(spark, sf, "lineitem")
    labels = C.top_labels(li, "l_returnflag", 30).select("label")
    data = li.select(F.col("l_returnflag").alias("label"), F.col("l_extendedprice").alias("x")).join(
        F.broadcast(labels), "label", "left_semi")
    qs = exact_quantiles(data, "x", [0.0, 0.25, 0.5, 0.75, 1.0], ["label"])
    return qs.select("label", "p", "n", F.round("q", 4).alias("q"))


SQL["boxplot_by_label_wide"] = " UNION ALL ".join(
    f"SELECT l_returnflag AS label, CAST({p} AS DOUBLE) AS p, count(*) AS n, "
    f"round(quantile_cont(l_extendedprice, {p}), 4) AS q FROM lineitem "
    f"WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY l_returnflag"
    for p in ("0.0", "0.25", "0.5", "0.75", "1.0"))


# --- D11 / D12 ----------------------------------------------------------------
@q("class_distribution")
def _dist(spark, sf):
    return C.class_distribution(table(spark, sf, "lineitem"), "l_suppkey")


_DIST_CTE = """
WITH vc AS (SELECT l_suppkey AS label, count(*) AS count FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1),
top AS (SELECT label, count, row_number() OVER (ORDER BY count DESC, label) AS rank FROM vc ORDER BY count DESC, label LIMIT 50),
oth AS (SELECT '__others__' AS label, (SELECT sum(count) FROM vc) - (SELECT sum(count) FROM top) AS count, 51 AS rank),
dist AS (SELECT CAST(label AS VARCHAR) AS label, count, rank FROM top UNION ALL SELECT label, count, rank FROM oth WHERE count > 0)"""
SQL["class_distribution"] = _DIST_CTE + " SELECT label, count, rank FROM dist"


@q("pareto")
def _pareto(spark, sf):
    p = C.pareto(table(spark, sf, "lineitem"), "l_suppkey")
    return p.select("label", "count", "rank", F.round("cumulative_pct", 4).alias("cumulative_pct"))


SQL["pareto"] = _DIST_CTE + """
SELECT label, count, rank,
       round(sum(count) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100.0
             / (SELECT sum(count) FROM dist), 4) AS cumulative_pct
FROM dist WHERE label <> '__others__'"""


# --- D13 ----------------------------------------------------------------------
LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@q("correlation_bar")
def _corr(spark, sf):
    c = C.correlation_bar(table(spark, sf, "lineitem"))
    return c.select("target_column", "column", F.round("value", 4).alias("value"), "rank")


SQL["correlation_bar"] = (
    "WITH sd AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, stddev_samp({c}) AS s FROM lineitem" for c in LI_NUM) + "), "
    "tgt AS (SELECT arg_max(c, s) AS t FROM sd), "
    "cr AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", abs(corr({c}, l_extendedprice)) AS value FROM lineitem" for c in LI_NUM
        if c != "l_extendedprice") + ") "
    "SELECT (SELECT t FROM tgt) AS target_column, \"column\", round(value, 4) AS value, "
    "row_number() OVER (ORDER BY value DESC NULLS LAST, \"column\") AS rank FROM cr ORDER BY rank LIMIT 20")


# --- D14 / B10 ----------------------------------------------------------------
@q("scatter_points")
def _scatter(spark, sf):
    return C.scatter_points(table(spark, sf, "orders"), ["o_orderkey"], "o_totalprice", "o_custkey")


SQL["scatter_points"] = """
WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y
           FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL),
n AS (SELECT count(*) AS n FROM p)
SELECT idx, 'o_totalprice' AS x_column, 'o_custkey' AS y_column, x, y FROM p, n
WHERE n.n <= 5000 OR idx % (n.n // 5000) = 0"""


@q("scatter_default")
def _scatter_default(spark, sf):
    """Columns picked by spread; the row key, which grows with the order, is no candidate."""
    return C.scatter_points(table(spark, sf, "orders"), ["o_orderkey"])


SQL["scatter_default"] = SQL["scatter_points"]


@q("stride_sample")
def _stride(spark, sf):
    s = C.stride_sample(table(spark, sf, "orders"), ["o_orderkey"], every_nth=7)
    return s.select("idx", "o_orderkey", "o_totalprice")


SQL["stride_sample"] = """
WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey, o_totalprice FROM orders)
SELECT idx, o_orderkey, o_totalprice FROM p WHERE idx % 7 = 0"""


# --- B8 / B9 ------------------------------------------------------------------
@q("junk_columns")
def _junk(spark, sf):
    return junk_columns(table(spark, sf, "events"), order_by="event_id")


SQL["junk_columns"] = """
WITH s AS (SELECT event_id, user_id, value, lag(event_id) OVER w AS pe, lag(user_id) OVER w AS pu, lag(value) OVER w AS pv
           FROM events WINDOW w AS (ORDER BY event_id)),
m AS (SELECT count(event_id) >= 3 AND count(CASE WHEN event_id <= pe THEN 1 END) = 0 AS e,
             count(user_id) >= 3 AND count(CASE WHEN user_id <= pu THEN 1 END) = 0 AS u,
             count(value) >= 3 AND count(CASE WHEN value <= pv THEN 1 END) = 0 AS v FROM s),
r AS (SELECT 'event_id' AS name, CASE WHEN e THEN 'monotonic' END AS reason FROM m
      UNION ALL SELECT 'ts', 'time'
      UNION ALL SELECT 'user_id', CASE WHEN u THEN 'monotonic' END FROM m
      UNION ALL SELECT 'event_type', NULL
      UNION ALL SELECT 'value', CASE WHEN v THEN 'monotonic' END FROM m
      UNION ALL SELECT 'props', NULL)
SELECT name, reason, reason IS NOT NULL AS junk FROM r"""


@q("pick_columns")
def _picks(spark, sf):
    return C.pick_columns(table(spark, sf, "events"), order_by="event_id")


SQL["pick_columns"] = """
SELECT 'user_id' AS numeric_pick,
       CASE WHEN (SELECT count(DISTINCT event_type) FROM events) <= (SELECT count(DISTINCT props) FROM events)
            THEN 'event_type' ELSE 'props' END AS categorical_pick"""


# --- G1-G3 / W4 ---------------------------------------------------------------
_SIG = """
WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value AS x FROM events WHERE value IS NOT NULL),
c AS (SELECT count(*) AS n FROM s)"""
_WM = _SIG + """,
wm AS (SELECT CASE WHEN c.n <= 4096 THEN idx ELSE idx % 4096 END AS pos, avg(x) AS value FROM s, c
       WHERE c.n <= 4096 OR idx < (c.n // 4096) * 4096 GROUP BY 1)"""


@q("window_mean_signal")
def _wm(spark, sf):
    w = S.window_mean_signal(table(spark, sf, "events"), "value", ["event_id"])
    return w.select(F.col("pos").cast("long").alias("pos"), F.round("value", 4).alias("value"))


SQL["window_mean_signal"] = _WM + " SELECT pos, round(value, 4) AS value FROM wm"


@q("fft_spectrum")
def _fft(spark, sf):
    f = S.fft_spectrum(table(spark, sf, "events"), "value", ["event_id"])
    return f.select("k", F.round("freq", 6).alias("freq"), F.round("magnitude", 3).alias("magnitude"),
                    "window_len", F.round("peak_freq", 6).alias("peak_freq"))


SQL["fft_spectrum"] = _WM + """,
nn AS (SELECT count(*) AS n FROM wm),
ks AS (SELECT unnest(range(0, n // 2 + 1)) AS k, n // 2 + 1 AS nbins FROM nn),
sel AS (SELECT k FROM ks WHERE nbins <= 512 OR k % (nbins // 512) = 0),
dft AS (SELECT k, sqrt(pow(sum(value * cos(2 * pi() * ((pos * k) % n) / n)), 2)
                     + pow(sum(value * sin(2 * pi() * ((pos * k) % n) / n)), 2)) AS magnitude
        FROM sel, wm, nn GROUP BY k),
pk AS (SELECT arg_max(k, magnitude) AS kmax FROM dft)
SELECT k, round(k / n, 6) AS freq, round(magnitude, 3) AS magnitude, n AS window_len, round(kmax / n, 6) AS peak_freq
FROM dft, nn, pk"""


@q("rms_trend")
def _rms(spark, sf):
    r = S.rms_trend(table(spark, sf, "events"), "value", ["event_id"])
    return r.select("win", F.round("rms", 4).alias("rms"), "window_size")


SQL["rms_trend"] = _SIG + """,
p AS (SELECT greatest(8, n // 64) AS w, n // greatest(8, n // 64) AS nwin FROM c)
SELECT idx // w AS win, round(sqrt(avg(x * x)), 4) AS rms, w AS window_size FROM s, p
WHERE idx < nwin * w GROUP BY idx // w, w"""


@q("fft_spectrum_by_key")
def _fft_by_key(spark, sf):
    """G2 for many signals at once: one spectrum per event type (value in
    event_id order); every signal is reduced to its window mean by
    distributed group-bys before a Python worker sees at most 4096 points."""
    f = S.multi_signal_spectrum(table(spark, sf, "events"), ["event_type"], "value", "event_id")
    return f.select("event_type", "k", F.round("freq", 6).alias("freq"), F.round("magnitude", 3).alias("magnitude"),
                    "window_len", F.round("peak_freq", 6).alias("peak_freq"))


SQL["fft_spectrum_by_key"] = """
WITH s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, value AS x
           FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
c AS (SELECT event_type, count(*) AS n FROM s GROUP BY event_type),
wm AS (SELECT s.event_type, CASE WHEN c.n <= 4096 THEN idx ELSE idx % 4096 END AS pos, avg(x) AS value
       FROM s JOIN c USING (event_type) WHERE c.n <= 4096 OR idx < (c.n // 4096) * 4096 GROUP BY 1, 2),
nn AS (SELECT event_type, count(*) AS n FROM wm GROUP BY event_type HAVING count(*) >= 8),
ks AS (SELECT event_type, n, unnest(range(0, n // 2 + 1)) AS k, n // 2 + 1 AS nbins FROM nn),
sel AS (SELECT event_type, n, k FROM ks WHERE nbins <= 512 OR k % (nbins // 512) = 0),
dft AS (SELECT sel.event_type, sel.k, sel.n,
               sqrt(pow(sum(value * cos(2 * pi() * ((pos * sel.k) % sel.n) / sel.n)), 2)
                    + pow(sum(value * sin(2 * pi() * ((pos * sel.k) % sel.n) / sel.n)), 2)) AS magnitude
        FROM sel JOIN wm USING (event_type) GROUP BY sel.event_type, sel.k, sel.n),
pk AS (SELECT event_type, arg_max(k, magnitude) AS kmax FROM dft GROUP BY event_type)
SELECT event_type, k, round(k / n, 6) AS freq, round(magnitude, 3) AS magnitude, n AS window_len,
       round(kmax / n, 6) AS peak_freq FROM dft JOIN pk USING (event_type)"""
