"""Boosted trees against a plain search, forests of parts, least squares, and the registered learners with few trees."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import boosting, features, learning
from tidewheel.operators.boosting import Boosting
from tidewheel.plans import catalog, reports

NAMES = list("abcd")
LEVELS = Boosting("logistic", trees=4, rate=0.3, depth=3, l2=5.0, l1=0.1, least_hessian=1.0, bins=64)
LEAVES = Boosting("squared", trees=4, rate=0.3, leaves=7, l2=1.0, least_hessian=1e-3, least_rows=10, bins=64)


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 30, (n, 4)).astype(float)
    y = ((x[:, 0] - 15) * (x[:, 1] - 15) + rng.normal(0, 20, n) > 0).astype(float)
    return pd.DataFrame(x, columns=NAMES).assign(y=y, k=np.arange(n))


def plain_trees(x, y, p):
    """Trees by a search over all values of all columns, row by row; returns the margins after each tree."""
    margin = np.full(len(y), y.mean() if p.loss == "squared" else np.log(y.mean() / (1 - y.mean())))
    out = []
    for _ in range(p.trees):
        if p.loss == "squared":
            g, h = margin - y, np.ones(len(y))
        else:
            q = 1 / (1 + np.exp(-margin))
            g, h = q - y, q * (1 - q)

        def soft(v):
            return np.sign(v) * max(abs(v) - p.l1, 0)

        def score(rows):
            return soft(g[rows].sum()) ** 2 / (h[rows].sum() + p.l2)

        def best(rows):
            found = None
            for c in range(x.shape[1]):
                for v in np.unique(x[rows, c])[:-1]:
                    a, b = rows[x[rows, c] <= v], rows[x[rows, c] > v]
                    if min(h[a].sum(), h[b].sum()) < p.least_hessian or min(len(a), len(b)) < p.least_rows:
                        continue
                    gain = score(a) + score(b) - score(rows)
                    if found is None or gain > found[0] + 1e-9:
                        found = (gain, a, b)
            return found if found and found[0] > boosting.LEAST_GAIN else None

        leaves = [(np.arange(len(y)), 0)]
        while True:
            open_ = [(i, best(rows)) for i, (rows, depth) in enumerate(leaves) if p.depth is None or depth < p.depth]
            open_ = [(i, c) for i, c in open_ if c]
            if not open_ or (p.leaves and len(leaves) >= p.leaves):
                break
            i, cut = max(open_, key=lambda o: o[1][0])
            depth = leaves[i][1] + 1
            leaves[i : i + 1] = [(cut[1], depth), (cut[2], depth)]
        for rows, _ in leaves:
            margin[rows] -= soft(g[rows].sum()) / (h[rows].sum() + p.l2) * p.rate if len(leaves) > 1 else 0.0
        out.append(margin.copy())
    return out


@pytest.mark.parametrize("p", [LEVELS, LEAVES], ids=["levels", "leaves"])
def test_boosting_equals_a_plain_search(spark, p):
    d = data()
    cuts = [np.arange(29.0)] * 4  # each value is a bin
    model = boosting.fit(spark.createDataFrame(d), NAMES, "y", "k", p, cuts=cuts)
    got = spark.createDataFrame(d).withColumn("m", model.margin()).toPandas().sort_values("k")["m"].to_numpy()
    assert np.allclose(got, plain_trees(d[NAMES].to_numpy(), d["y"].to_numpy(), p)[-1], atol=1e-4)


@pytest.mark.parametrize("p", [replace(LEVELS, trees=2, rows=0.8, columns=0.5), replace(LEAVES, trees=2)], ids=["levels", "leaves"])
def test_jobs_and_one_task_make_equal_trees(spark, p, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN_TREES", 1)
    rows = spark.createDataFrame(data())
    cuts = [np.arange(29.0)] * 4
    a = boosting.fit(rows, NAMES, "y", "k", p, cuts=cuts)
    b = boosting.fit(rows.orderBy(F.rand(1)), NAMES, "y", "k", p, part_rows=150, cuts=cuts)
    assert [(t.feature, t.bin, t.left) for t in a.trees] == [(t.feature, t.bin, t.left) for t in b.trees]
    assert all(np.allclose(x.value, y.value) for x, y in zip(a.trees, b.trees, strict=True))
    assert a.trees[0].left[0] > 0


def test_boosting_ends_early_and_is_read_back(spark):
    rng = np.random.default_rng(2)
    noise = data(300).assign(y=rng.normal(size=300))
    rows = spark.createDataFrame(noise)
    model = boosting.fit(rows, NAMES, "y", "k", replace(LEAVES, trees=60, patience=3, stop_from=100, hold_out=0.3))
    assert 3 < len(model.trees) < 60
    again = boosting.read_model(model.table(spark), NAMES)
    both = rows.select(model.margin().alias("x"), again.margin().alias("y"))
    assert both.where("x != y").isEmpty()


def test_boosting_edge_cases(spark):
    empty = boosting.fit(spark.createDataFrame(data(5)).where("false"), NAMES, "y", "k", LEVELS)
    assert empty.trees == [] and empty.start == 0.0
    rows = spark.createDataFrame([(1, 1.0, None, 1.0), (2, 1.0, 2.0, 1.0), (3, 1.0, 2.0, 1.0)], "k long, a double, b double, y double")
    same = boosting.fit(rows, ["a", "b"], "y", "k", LEVELS)  # nothing to cut, and one row without a feature
    assert all(t.left == [-1] for t in same.trees)
    assert same.predict(rows.na.drop(), "p").agg(F.min("p")).first()[0] > 0.999


def test_held_out_rows_and_samples_have_their_shares():
    ids = np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)
    u = boosting.shares(ids, 42, 3)
    assert abs((u < 0.85).mean() - 0.85) < 0.01 and abs(np.corrcoef(u, boosting.shares(ids, 42, 4))[0, 1]) < 0.03
    assert len(boosting.columns_of(learning.RISK, 89, 0)) == 71


def test_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 24)) * rng.uniform(0.01, 1000, 24) + rng.uniform(-1e4, 1e4, 24)
    y = x @ rng.normal(size=24) + 7 + rng.normal(size=500)
    names = [f"x{i}" for i in range(24)]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y)).repartition(5)
    intercept, slopes = learning.least_squares(rows, names, "y")
    want = np.linalg.lstsq(np.column_stack([np.ones(500), x]), y, rcond=None)[0]
    assert np.allclose([slopes[n] for n in names], want[1:], rtol=1e-6) and intercept == pytest.approx(want[0], rel=1e-6)
    twice = rows.withColumn("z", F.col("x0"))
    both = learning.least_squares(twice, [*names, "z"], "y")[1]
    assert both["x0"] == pytest.approx(both["z"]) and both["x0"] + both["z"] == pytest.approx(want[1], rel=1e-5)
    assert learning.least_squares(rows.where("false"), names, "y")[0] == 0.0


def test_parts_average_to_one_forest(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(spark.createDataFrame(data(120))).withColumnRenamed("y", "label")
    parts = learning.forest(rows, trees=5, part=2, depth=4)
    assert [m.getNumTrees for m in parts] == [2, 2, 1]
    got = learning.forest_mean(rows, parts).orderBy("k").toPandas()["prediction"].to_numpy()
    trees = [t for m in parts for t in m.trees]
    first = rows.orderBy("k").first()["features"]
    assert len(trees) == 5 and got[0] == pytest.approx(np.mean([t.predict(first) for t in trees]))


def test_learners_have_the_stated_sizes():
    r, w = learning.RISK, learning.WORKLOAD
    assert (r.trees, r.depth, r.rate, r.l2, r.l1, r.least_hessian, r.rows, r.columns) == (350, 6, 0.05, 5.0, 0.1, 5.0, 0.85, 0.8)
    assert (w.trees, w.leaves, w.rate, w.l2, w.least_rows, w.patience, w.stop_from) == (80, 31, 0.07, 1.0, 30, 10, 10_000)
    assert (learning.FOREST_TREES, learning.FOREST_DEPTH) == (300, 30)


@pytest.fixture
def small(spark, monkeypatch):
    """Learners of few trees on short frames of random features."""
    monkeypatch.setattr(learning, "RISK", replace(learning.RISK, trees=2))
    monkeypatch.setattr(learning, "WORKLOAD", replace(learning.WORKLOAD, trees=2))
    monkeypatch.setattr(learning, "FOREST_TREES", 3)
    names = features.failure_feature_names()
    n = 400
    minute = spark.range(n).select(F.col("id").alias("minute"), (F.rand(5) < 0.4).cast("int").alias("failure"), *(F.rand(i).alias(c) for i, c in enumerate(names)))
    monkeypatch.setattr(catalog, "_risk_rows", lambda *_: catalog.settled(catalog.with_split(minute, "minute"), "risk-rows"))
    workload = features.workload_feature_names(True)
    bucket = spark.range(n).select(F.col("id").alias("bucket"), F.floor(F.rand(1) * 90).alias("target_next_5min"), *(F.rand(i).alias(c) for i, c in enumerate(workload)))
    monkeypatch.setattr(catalog, "_workload", lambda _, __, cp: (catalog.settled(catalog.with_split(bucket), "workload-rows"), features.workload_feature_names(cp)))


@pytest.mark.parametrize("name", ["forecast_gbt", "forecast_cp_gbt", "forecast_rf", "forecast_ols"])
def test_forecast_queries(spark, small, name):
    rows = catalog.QUERIES[name](spark, "").toPandas()
    assert len(rows) == 400 and rows["forecast"].ge(0).all() and set(rows["split"]) == {"train", "calibration", "test"}


def test_risk_queries(spark, small):
    rows = catalog.QUERIES["failure_gbt"](spark, "").toPandas()
    assert len(rows) == 400 and rows["probability_of_failure"].between(0, 1).all()
    assert set(rows["split"]) == {"train", "validation", "calibration", "test"}
    found = {r.features: r.n for r in catalog.QUERIES["risk_ablation"](spark, "").collect()}
    assert found == {"full": 64, "ablated": 64}


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_learned_path(spark, monkeypatch):
    monkeypatch.setattr(learning, "RISK", replace(learning.RISK, trees=2))
    monkeypatch.setattr(learning, "WORKLOAD", replace(learning.WORKLOAD, trees=2))
    rows = reports.learned_rows(spark, "/root/testdata/sf0.001")
    assert rows.where("hgb IS NULL OR cp_hgb IS NULL OR risk_signal NOT BETWEEN 0 AND 1").isEmpty()
    assert rows.count() == rows.select("bucket").distinct().count() > 5000
