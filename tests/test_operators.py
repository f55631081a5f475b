"""Operators on Spark: semantics against numpy/pandas on small fixtures
generated here with a fixed seed, and the invariants the reference tests."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.quantiles import exact_quantiles, from_ordered_bits, ordered_bits
from millrace.functions.rowindex import cumulative_sum, global_index, rank_in_group, running_sum
from millrace.functions.scalars import try_to_double
from millrace.operators import charts as C
from millrace.operators import constraints as CN
from millrace.operators import profile as P
from millrace.operators import transforms as X


def test_try_to_double(spark):
    vals = ["1", " 2.5 ", "-3e2", ".5", "1d", "0x10", "1,000", "1_000", "abc", None, "inf", "NaN", "*"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(try_to_double("s")).collect()]
    assert got[:4] == [1.0, 2.5, -300.0, 0.5]
    assert got[4:10] == [None] * 6
    assert got[10] == float("inf") and got[11] is None and got[12] is None


def test_global_index_dense_with_hot_key(spark):
    # a third of the rows share one key: the tie-break still spreads them
    rows = [(i, 7 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k long")
    idx = global_index(df, ["k"]).select("idx").collect()
    assert sorted(r[0] for r in idx) == list(range(3000))


def test_index_depends_on_values_only(spark):
    """Replanned twice, in other partitions, each row has the same number."""
    rows = [(i, 7 if i % 3 == 0 else None if i % 50 == 1 else i % 900, f"s{i % 13}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k long, s string")
    one = {r["id"]: r["idx"] for r in global_index(df, ["k", "s"]).collect()}
    two = {r["id"]: r["idx"] for r in global_index(df.repartition(7), ["k", "s"]).collect()}
    assert one == two and sorted(one.values()) == list(range(3000))
    ranked = sorted(rows, key=lambda r: one[r[0]])
    keys = [(r[1] is not None, r[1] or 0, r[2]) for r in ranked]
    assert keys == sorted(keys)


def test_index_of_millions_after_releasing_caches(spark):
    n = 3_000_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000).alias("k"))
    idx = global_index(df, ["k"])
    for _ in range(2):
        spark.catalog.clearCache()
        r = idx.agg(F.count_distinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        assert (r["d"], r["lo"], r["hi"], r["n"]) == (n, 0, n - 1, n)


def test_running_sums(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "o long, v double")
    got = {r["o"]: r["cum"] for r in cumulative_sum(df, "o", "v").collect()}
    assert got == {i: sum(float(j % 7) for j in range(i + 1)) for i in range(500)}


@pytest.fixture
def many_partitions(spark):
    """Small range partitions that adaptive execution leaves apart."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_sums_of_groups_over_many_partitions(spark, many_partitions):
    """Groups that fill many partitions, single rows, NULL groups and values."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 400}", None if i % 11 == 0 else i % 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = {r["id"]: r["s"] for r in running_sum(df, ["g"], ["id"], "v", "s", True).collect()}
    seen = {}
    for i, g, v in rows:
        assert got[i] == seen.get(g, 0), (i, g)
        seen[g] = seen.get(g, 0) + (v or 0)
    ranks = {r["id"]: r["rk"] for r in rank_in_group(df, ["g"], ["id"]).collect()}
    place = {}
    for i, g, _ in rows:
        if g is not None:
            assert ranks.pop(i) == place.get(g, 0)
            place[g] = place.get(g, 0) + 1
    assert not ranks
    assert sorted(r["idx"] for r in global_index(df, ["g"]).select("idx").collect()) == list(range(4000))


def test_index_of_odd_columns(spark, many_partitions):
    """Names with dots, quotes and clashes; maps, which Spark doesn't hash."""
    df = spark.sql("SELECT id AS `k.z`, id % 3 AS `g``s`, map('a', id) AS m, array(map('b', id)) AS n, struct(id AS x) AS part, 1 AS v, 2 AS place, 'x' AS idx2 FROM range(300)")
    got = rank_in_group(df, ["g`s"], ["k.z"], "rk")
    assert got.columns == [*df.columns, "rk"]
    assert all(r["rk"] == r["k.z"] // 3 and r["m"] == {"a": r["k.z"]} for r in got.collect())
    assert sorted(r["idx"] for r in global_index(df, ["v"]).collect()) == list(range(300))
    assert global_index(df.limit(0), ["v"]).count() == 0


def test_plans_hold_no_list_that_grows_with_rows(spark):
    def plan(n):
        return len(global_index(spark.range(n).select((F.col("id") % 97).alias("k"), "id"), ["k"])._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(200_000) - plan(2_000)) < 100


def test_ordered_bits(spark):
    """Every power of two, its neighbours, subnormals, infinities, NaN, zeros."""
    powers = 2.0 ** np.arange(-1074, 1024)
    x = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), np.random.default_rng(1).normal(size=500), [0.0, np.inf, 1e308, 5e-324]])
    x = np.concatenate([x, -x])
    df = spark.createDataFrame([(float(v),) for v in [*x, float("nan")]], "x double").select("x", ordered_bits(F.col("x")).alias("k")).select("x", "k", from_ordered_bits(F.col("k")).alias("y"))
    rows = df.collect()
    bits = np.abs(x).view(np.int64)
    for r, v, b in zip(rows, x, bits, strict=False):
        assert r["k"] == (-int(b) if v < 0 else int(b)) and r["y"] == v
    assert math.isnan(rows[-1]["y"]) and rows[-1]["k"] == max(r["k"] for r in rows)

def test_balance_keeps_rows_without_a_class(spark):
    df = spark.createDataFrame([(i, "A" if i < 10 else "B" if i < 14 else None) for i in range(20)], "id long, c string")
    got = X.balance_under(df, "c", ["id"]).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {"A": 4, "B": 4, None: 6}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(42)
    g = np.where(rng.random(5000) < 0.34, "hot", rng.choice(["a", "b", "c"], 5000))
    x = rng.normal(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x}))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, "x", probs, ["g"]).collect()}
    for k in ("hot", "a", "b", "c"):
        exp = np.percentile(x[g == k], [p * 100 for p in probs])
        for p, e in zip(probs, exp):
            assert math.isclose(got[(k, p)], e, rel_tol=1e-12, abs_tol=1e-12)


def test_exact_quantiles_need_all_digits(spark):
    """Values that differ in their last bits only, ties, one value, no value."""
    base = np.float64(3.0).view(np.int64)
    x = np.concatenate([(base + np.arange(301)).view(np.float64), np.repeat(3.0, 77), [-3.0, -3.5, 0.0, 5e-324]])
    rows = [(1, float(v)) for v in x] + [(2, 4.5), (3, None), (None, 1.0)]
    df = spark.createDataFrame(rows, "`g.h` int, `x y` double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["g.h"], r["p"]): r["q"] for r in exact_quantiles(df, "x y", probs, ["g.h"]).collect()}
    assert got == {**{(1, p): float(np.quantile(x, p)) for p in probs}, **{(2, p): 4.5 for p in probs}}
    assert exact_quantiles(df.filter("`x y` > 100"), "x y", probs).count() == 0


def test_rank_in_group(spark):
    df = spark.createDataFrame([(("a" if i < 700 else "b"), i * 7 % 1000) for i in range(1000)], "g string, v long")
    r = rank_in_group(df, ["g"], ["v"], "rk").toPandas()
    for key, sub in r.groupby("g"):
        assert sorted(sub["rk"]) == list(range(len(sub)))
        assert list(sub.sort_values("rk")["v"]) == sorted(sub["v"])


def test_histogram_counts_and_bins(spark):
    rng = np.random.default_rng(42)
    x = rng.gamma(2.0, 2.0, 2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    h = C.histogram(df, "x").orderBy("bin").toPandas()
    counts, edges = np.histogram(x, bins=np.linspace(x.min(), x.max(), len(h) + 1))
    assert h["count"].sum() == len(x)
    assert list(h["count"]) == list(counts)
    # the reference test case: x = 0..99
    d = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    hh = C.histogram(d, "x").toPandas()
    assert hh["count"].sum() == 100 and hh["bin_lo"].min() == 0 and hh["bin_hi"].max() == 99
    # the picker refuses the strictly increasing column when a row order is known
    picks = C.pick_columns(d.withColumn("row", F.monotonically_increasing_id()), order_by="row").first()
    assert picks["numeric_pick"] is None


def test_class_distribution_labels(spark):
    df = spark.createDataFrame([(v,) for v in "aabccc"], "label string")
    got = {r["label"]: r["count"] for r in C.class_distribution(df, "label").collect()}
    assert got == {"a": 2, "b": 1, "c": 3}


def test_junk_columns(spark):
    pdf = pd.DataFrame({"idx": range(10), "Cycle_Time": np.arange(10) * 1.5, "TimeStamp": ["t"] * 10,
                        "mono": np.arange(10) * 2, "val": [3, 1, 2, 5, 4, 6, 7, 9, 8, 0]})
    df = spark.createDataFrame(pdf).withColumn("row", F.monotonically_increasing_id())
    j = {r["name"]: r["reason"] for r in P.junk_columns(df, order_by="row").collect()}
    assert j["idx"] == "index_name" and j["TimeStamp"] == "time"
    assert j["mono"] == "monotonic" and j["Cycle_Time"] == "monotonic" and j["val"] is None


def test_masking_then_filling(spark):
    vals = ["*", "**", "1.5", " - ", "N/A", "3", "x", None, "2.0", "***"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v string")
    m = X.clean_masking(df, ["v"])
    assert [r[0] for r in m.orderBy("id").select("v").collect()] == [None, None, 1.5, None, None, 3.0, None, None, 2.0, None]
    f = X.fill_missing(m, ["v"])
    got = [r[0] for r in f.orderBy("id").select("v").collect()]
    assert got == [2.0, 2.0, 1.5, 2.0, 2.0, 3.0, 2.0, 2.0, 2.0, 2.0]  # median of 1.5, 2, 3
    # mode: most frequent, lowest on ties; all-null stays null
    t = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert [r[0] for r in X.fill_missing(t, ["s"]).collect()].count("a") == 3
    n = spark.createDataFrame([(None,), (None,)], "s string")
    assert X.fill_missing(n, ["s"]).filter("s is null").count() == 2


def test_normalize_group_pooled(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"a": rng.normal(5, 2, 300), "b": rng.normal(10, 3, 300), "c": ["t"] * 300})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    out, info = X.normalize_group(df, ["a", "b", "c", "missing"], "sequence_preserve")
    block = np.concatenate([pdf["a"].dropna().to_numpy(), pdf["b"].to_numpy()])
    assert math.isclose(info["mean"], block.mean(), rel_tol=1e-12)
    assert math.isclose(info["std"], block.std(ddof=0), rel_tol=1e-12)
    o = out.toPandas()
    cells = np.concatenate([o["a"].dropna().to_numpy(), o["b"].to_numpy()])
    assert abs(cells.mean()) < 1e-9 and abs(cells.std() - 1) < 1e-9
    assert info["members"] == ["a", "b"]
    # constant group: unchanged
    k = spark.createDataFrame([(1.0, 1.0)] * 5, "a double, b double")
    o2, i2 = X.normalize_group(k, ["a", "b"], "profile_group")
    assert i2["params"] == {} and o2.collect() == k.collect()


def test_remove_outlier_keeps_unparseable(spark):
    df = spark.createDataFrame([("5",), ("50",), ("x",), (None,), ("10",)], "v string")
    out = X.remove_outlier(df, "v", [5, 10])
    assert sorted([r[0] or "" for r in out.collect()]) == ["", "10", "5", "x"]
    assert X.remove_outlier(df, "v", {"min": None, "max": None}).count() == 5


def test_class_weights_and_preview(spark):
    df = spark.createDataFrame([("Y",)] * 5 + [("N",)] * 95, "y string")
    w = {r["class"]: (r["ratio"], r["weight"]) for r in X.class_weights(df, "y").collect()}
    assert w["Y"] == (0.05, 10.0) and w["N"] == (0.95, round(100 / 190, 4))
    p = {r["option"]: r["rows_after"] for r in X.balance_preview(df, "y").collect()}
    assert p == {"class_weight": 100, "smote": 190, "random_under": 10, "skip": 100}
    u = X.balance_under(df.withColumn("id", F.monotonically_increasing_id()), "y", ["id"])
    assert {r["y"]: r["count"] for r in u.groupBy("y").count().collect()} == {"Y": 5, "N": 5}


def test_constraint_specs(spark):
    cases = [
        ('{"type": "range", "min": 10, "max": null, "unit": "°C"}', None),
        ('{"type": "single_value", "value": 42}', None),
        ('{"type": "aggregate", "metric": "rms", "op": "<=", "value": 1.5}', None),
        ('{"type": "ratio", "value": 0.5}', "deferred type"),
        ('{"type": "list", "value": [1]}', "deferred type"),
        ('{"type": "text", "value": "x"}', "deferred type"),
        ('{"type": "range", "min": null, "max": null}', "range: min or max required"),
        ('{"type": "range", "min": 1, "extra": 2}', "extra fields: extra"),
        ('{"type": "range", "min": "10"}', "range: min must be a number or null"),
        ('{"type": "single_value", "value": true}', "single_value: value must be a number"),
        ('{"type": "single_value"}', "single_value: value must be a number"),
        ('{"type": "aggregate", "metric": "median", "op": "<=", "value": 1}', "aggregate: bad metric"),
        ('{"type": "aggregate", "metric": "rms", "op": "<", "value": 1}', "aggregate: bad op"),
        ('{"type": "range", "min": 1, "unit": 5}', "unit must be text or null"),
    ]
    df = spark.createDataFrame([(s,) for s, _ in cases], "spec string")
    got = [r[0] for r in df.select(CN.spec_error(F.col("spec"))).collect()]
    assert got == [e for _, e in cases]
    specs = spark.createDataFrame([("a", '{"type": "range", "min": 10, "max": 90}'), ("b", '{"type": "range", "min": 10, "max": null}'),
                                   ("c", '{"type": "aggregate", "metric": "rms", "op": "<=", "value": 1}'),
                                   ("d", '{"type": "single_value", "value": 4}')], "column_name string, spec string")
    eng, exc = CN.downconvert(specs)
    assert sorted(tuple(r) for r in eng.collect()) == [("a", 10.0, 90.0), ("b", 10.0, None)]
    assert sorted(tuple(r) for r in exc.collect()) == [("c", "aggregate"), ("d", "single_value")]


def test_merge_view_precedence(spark):
    cols = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    session = spark.createDataFrame([("x", "S1"), ("gone", "S2")], "column_name string, spec string")
    stored = spark.createDataFrame([("x", "P1", "u"), ("y", "P2", "u")], "column_name string, spec string, approved_by string")
    v = {r["column_name"]: r for r in CN.merge_view(cols, session, stored).collect()}
    assert v["x"]["source"] == "session" and v["x"]["applied"] and v["x"]["prefill_spec"] == "P1"
    assert v["y"]["source"] == "prefill" and not v["y"]["applied"] and v["y"]["spec"] is None
    assert v["z"]["source"] == "blank"
    assert v["gone"]["stale"]


def test_semantic_rules_same_in_spark_and_driver(spark):
    from millrace.plans.rules import classify_columns, classify_names, names_frame
    names = [f"{i}{'st' if i == 1 else 'nd' if i == 2 else 'rd' if i == 3 else 'th'} INJECTION VELOCITY" for i in range(1, 11)]
    names += [f"{i}th INJECTION SWITCH POS" for i in range(1, 10)] + [f"PACK PRESSURE {i}" for i in range(1, 7)]
    names += [f"PACK TIME {i}" for i in range(1, 7)] + ["LOT No.", "TimeStamp", "EQP_ID", "BACK PRESSURE"]
    local = {n: (g, s) for n, _, g, s in classify_names(names)}
    remote = {r["name"]: (r["semantic_group"], r["strategy"]) for r in classify_columns(names_frame(spark, names)).collect()}
    assert local == remote
    groups = {g for g, _ in local.values()}
    # 35 columns -> 6 groups (metadata included), no unknown
    assert len(names) == 35 and "unknown" not in groups and len(groups) == 6


def test_mixed_dtype_first_rows(spark):
    # numbers first, masks only after the 200th non-null value
    vals = [str(i) for i in range(250)] + ["*"] * 50
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "row long, c string")
    full = P.mixed_dtype(df, ["c"]).first()
    head = P.mixed_dtype(df, ["c"], order_by=["row"], head_rows=200).first()
    assert full["mixed"] and full["numeric_ratio"] == round(250 / 300, 3)
    assert not head["mixed"] and head["numeric_ratio"] == 1.0


def test_profile_pass_agrees_with_profile_columns(spark):
    from tests.conftest import SF_SMALL
    from millrace.checks.common import messy_lineitem
    df = messy_lineitem(spark, SF_SMALL)
    prof, mixed, imb = P.profile_pass(df)
    exact = {r["name"]: (r["null_count"], r["n_unique"]) for r in P.profile_columns(df, approx=False).collect()}
    fast = {r["name"]: (r["null_count"], r["n_unique"], r["mixed"]) for r in prof.collect()}
    for name, (nulls, nu) in exact.items():
        assert fast[name][0] == nulls
        assert abs(fast[name][1] - nu) <= max(2, 0.15 * nu)   # HyperLogLog estimate (rsd 0.05, 3 sigma)
    assert fast["qty_txt"][2] and not fast["l_returnflag"][2]
    assert {r["name"] for r in mixed.collect()} == {"qty_txt", "l_returnflag", "l_linestatus"}


def test_fill_values(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"x": rng.normal(size=3000), "s": rng.choice(["u", "v", "w", "v"], 3000)})
    pdf.loc[::5, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    got = X.fill_values(df, ["x", "s", "absent"])
    assert math.isclose(got["x"], float(pdf["x"].median()), rel_tol=1e-12)
    assert got["s"] == pdf["s"].value_counts().idxmax() and set(got) == {"x", "s"}


def test_multiset_difference(spark):
    from millrace.functions.rowsets import compare, multiset_difference
    nan = float("nan")
    rows = [(1, None, "a", nan, [1, None]), (1, None, "a", nan, [1, None]), (None, 1, "a", 0.5, None), (2, 3, None, None, []), (2, 3, None, None, [])] + [(i, i, "x", 1.0, [i]) for i in range(9, 50)]
    schema = "`a.b` int, c int, s string, x double, l array<int>"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([rows[0], (1, None, "a", nan, [None, 1]), (1, None, "a", nan, [1]), (None, 1, "a", 0.5, None), *rows[9:30], *rows[9:12]], schema)
    for x, y in ((a, b), (b, a), (a, a), (a, b.limit(0))):
        got = sorted(map(repr, multiset_difference(x, y).collect()))
        assert got == sorted(map(repr, x.exceptAll(y).collect()))
    assert compare(a, b).first().asDict() == {"n_a": a.count(), "n_b": b.count(), "only_a": a.exceptAll(b).count(), "only_b": b.exceptAll(a).count()}
    assert compare(a.limit(0), a.limit(0)).first().asDict() == {"n_a": 0, "n_b": 0, "only_a": 0, "only_b": 0}


def test_bounds_from_footers(spark, tmp_path):
    from millrace.operators import catalog as K
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(i, i / 3, f"{i}" if i % 2 else "x", None) for i in range(1000)], "a long, b double, c string, d int")
    df.write.parquet(path)
    got = {r["name"]: (r["stat_min"], r["stat_max"], r["all_null"]) for r in K.stat_minmax_of_files(spark, path, "t").collect()}
    assert got == {"a": (0.0, 999.0, False), "b": (0.0, 333.0, False), "c": (1.0, 999.0, False), "d": (None, None, True)}
    assert K.stat_minmax_of_files(spark, path, "t").count() == 4
    whole = f"file://{tmp_path}/whole"
    df.drop("d").write.parquet(whole)  # without a column of NULLs the footers tell all numbers
    assert {r["name"]: (r["stat_min"], r["stat_max"]) for r in K.stat_minmax_of_files(spark, whole, "t").collect()} == {k: v[:2] for k, v in got.items() if k != "d"}
    meta = spark.createDataFrame([("t", n, "x", "scalar", None, i, None, None) for i, n in enumerate("abcd")] + [("u", "z", "x", "scalar", None, 0, 1.0, 2.0)], K.COLUMNS_SCHEMA)
    stats = K.stat_minmax_of_files(spark, path, "t")
    done = {(r["datalake_id"], r["name"]): r["stat_max"] for r in K.apply_minmax(meta, stats).collect()}
    assert done == {("t", "a"): 999.0, ("t", "b"): 333.0, ("t", "c"): 999.0, ("t", "d"): None, ("u", "z"): 2.0}
    for odd in (meta.filter("name <> 'b'"), meta.unionByName(meta.filter("name = 'b'").withColumn("name", F.lit("more")))):
        with pytest.raises(K.ColumnMismatch):
            K.apply_minmax(odd, stats)
