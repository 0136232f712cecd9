"""Paired tests of policies against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import inference
from tidewheel.plans import catalog


def test_paired_tests_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, m, float(rng.integers(0, 9) + k), float(rng.normal())) for i in range(60) for k, m in enumerate("abc")]
    long = spark.createDataFrame(rows, "key long, model string, x double, y double")
    got = inference.paired_tests(inference.paired_differences(long, "key", "model", ["x", "y"]), replicates=2000).collect()
    assert len(got) == 6
    for r in got:
        of = {(i, m): v[r.metric == "y"] for i, m, *v in rows}
        d = np.array([of[i, r.model_a] - of[i, r.model_b] for i in range(60)])
        nz = d[d != 0]
        size = np.abs(nz)
        rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
        n, k = len(nz), np.unique(size, return_counts=True)[1]
        stat = min(rank[nz > 0].sum(), rank[nz < 0].sum())
        z = (stat - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (k**3 - k).sum() / 48)
        assert r.statistic == stat and r.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
        low, high = np.percentile(d[rng.integers(0, 60, (20_000, 60))].mean(axis=1), [2.5, 97.5])
        assert (r.ci_low, r.ci_high) == pytest.approx((low, high), abs=0.1 * d.std())
    for metric in "xy":
        own = sorted((r.p_value, r.p_holm) for r in got if r.metric == metric)
        assert [h for _, h in own] == pytest.approx(np.minimum(1, np.maximum.accumulate([(3 - i) * p for i, (p, _) in enumerate(own)])))


def test_equal_models_do_not_differ(spark):
    long = spark.range(5).select(F.col("id").alias("key"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), F.lit(1.0).alias("x"))
    r = inference.paired_tests(inference.paired_differences(long, "key", "model", ["x"]), replicates=10).first()
    assert (r.statistic, r.p_value, r.p_holm, r.ci_low, r.ci_high) == (0.0, 1.0, 1.0, 0.0, 0.0)


def test_query_asks_for_all_metrics(spark, monkeypatch):
    rows = [(i, p, float(i + k), float(k), float(i), 1.0) for i in range(8) for k, p in enumerate(catalog.FORECASTS)]
    monkeypatch.setattr(catalog, "forecast_long", lambda *_: spark.createDataFrame(rows, "bucket long, policy string, shortage double, unused double, provisioned double, absolute_error double"))
    assert len(catalog.QUERIES["paired_policy_tests"](spark, "").collect()) == 12


def test_bootstraps_deal_groups_over_parts(spark):
    rng = np.random.default_rng(9)
    groups = {"plain": rng.normal(size=500), "tied": np.where(rng.random(4000) < 0.5, 0.0, rng.integers(1, 400, 4000)), "one": np.array([2.5])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("plain", None)]
    df = spark.createDataFrame(rows, "g string, d double")
    for part_values in (20, 1 << 14):
        got = inference.iid_bootstraps(df, ["g"], "d", replicates=1500, part_values=part_values).toPandas()
        assert got.groupby("g")["replicate"].nunique().to_dict() == dict.fromkeys(groups, 1500)
        for g, v in groups.items():
            means, error = got[got.g == g]["mean"], v.std() / math.sqrt(len(v))
            assert means.mean() == pytest.approx(v.mean(), abs=0.12 * error + 1e-12)
            assert means.std(ddof=0) == pytest.approx(error, rel=0.08, abs=1e-12)


def test_draws_by_weight(spark):
    rng = np.random.default_rng(10)
    values, weights = np.array([1.0, 5.0, 9.0]), np.array([1, 2, 1])
    for many in (np.full(4000, 6), np.full(4000, 5000)):
        sums = inference.draw_sums(values, weights, many, rng)
        assert sums.mean() / many[0] == pytest.approx(5.0, rel=0.02)
        assert sums.std() == pytest.approx(math.sqrt(8.0 * many[0]), rel=0.05)
    assert inference.draw_sums(values, weights, np.array([0, 0]), rng).tolist() == [0.0, 0.0]
