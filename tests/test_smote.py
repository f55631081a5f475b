"""Synthetic rows: counts, neighbours against brute force, replays."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import transforms as X
from millrace.operators.smote import balance_smote, class_neighbours


def _rows(spark, n=600):
    rng = np.random.default_rng(2)
    rows = [(i, "A" if i < n else "B" if i < n + 90 else "C" if i < n + 91 else None, float(rng.normal()), float(rng.normal(5, 3)), None if i % 50 == 3 else int(rng.integers(0, 40)), f"t{i}") for i in range(n + 100)]
    return spark.createDataFrame(rows, "id long, `c l` string, x double, `y.z` double, q int, t string"), rows


def test_counts_are_those_announced(spark):
    df, rows = _rows(spark)
    out = balance_smote(df, "c l", ["id"]).cache()
    announced = {r["option"]: r["rows_after"] for r in X.balance_preview(df, "c l").collect()}
    assert out.count() == announced["smote"]
    assert {r["c l"]: r["count"] for r in out.groupBy("c l").count().collect()} == {"A": 600, "B": 600, "C": 600, None: 9}
    assert out.filter("not is_synthetic").drop("is_synthetic").exceptAll(df).count() == 0 and out.filter("not is_synthetic").count() == df.count()
    made = out.filter("is_synthetic").collect()
    box = {c: [(min(v), max(v)) for v in zip(*[(r[2], r[3]) for r in rows if r[1] == c], strict=True)] for c in "BC"}
    for r in made:  # between rows of its own class, text of the base row
        for v, (lo, hi) in zip((r["x"], r["y.z"]), box[r["c l"]], strict=True):
            assert lo - 1e-9 <= v <= hi + 1e-9
        assert r["t"] == f"t{r['id']}" and (r["q"] is None) == (r["id"] % 50 == 3)
    uses = {}
    for r in made:
        if r["c l"] == "B":
            uses[r["id"]] = uses.get(r["id"], 0) + 1
    assert set(uses.values()) <= {5, 6} and len(uses) == 90
    assert out.exceptAll(balance_smote(df.repartition(3), "c l", ["id"])).count() == 0


def test_nothing_to_do(spark):
    df, _ = _rows(spark, 60)
    assert balance_smote(df.filter("`c l` = 'A'"), "c l", ["id"]).filter("is_synthetic").count() == 0
    assert balance_smote(df.limit(0), "c l", ["id"]).count() == 0
    assert balance_smote(df.filter("`c l` is null"), "c l", ["id"]).count() == 9


def test_neighbours_against_brute_force(spark):
    """Recall of the nearest five over blocks much smaller than the class; with
    one block, all of them."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 4))
    rows = spark.createDataFrame([(i, "m" if i % 3 else "n", x[i].tolist()) for i in range(len(x))], "row long, class string, x array<double>")
    true = {}
    for c in (0, 1):
        own = [i for i in range(len(x)) if (i % 3 == 0) == (c == 0)]
        far = ((x[own][:, None] - x[own][None]) ** 2).sum(axis=2)
        np.fill_diagonal(far, np.inf)
        for a, line in zip(own, far, strict=True):
            true[a] = {own[b] for b in np.argsort(line)[:5]}
    for search, least in (({"block_rows": 2000, "margin_rows": 1, "projections": 1}, 1.0), ({"block_rows": 128, "margin_rows": 64, "projections": 8}, 0.9)):
        found = {}
        for r in class_neighbours(rows, **search).collect():
            found.setdefault(r["row"], set()).add(r["near"])
        recall = sum(len(true[a] & found.get(a, set())) for a in true) / (5 * len(true))
        assert recall >= least, recall
        assert all((a % 3 == 0) == (b % 3 == 0) for a, bs in found.items() for b in bs)
