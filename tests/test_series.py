import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import changepoint, control, features, learning
from tidewheel.operators.windows import Blocks


def series(spark, values):
    return spark.createDataFrame([(i + 3, int(v)) for i, v in enumerate(values)], "bucket long, total_tokens long")


def test_blocks_do_not_change_windows(spark):
    df = series(spark, range(100))
    for rows in (7, 13, 1000):
        b = Blocks(df, "bucket", 5, ahead=1, block_rows=rows)
        out = b.result("bucket", b.past(F.sum("total_tokens"), "total_tokens", 5).alias("s"), b.lead("total_tokens").alias("n")).orderBy("bucket").collect()
        assert len(out) == 100
        assert [r.s for r in out] == [None] * 5 + [sum(range(i - 5, i)) for i in range(5, 100)]
        assert [r.n for r in out] == [*range(1, 100), None]


def test_past_sum_equals_rolling_sum(spark):
    df = series(spark, np.random.default_rng(0).integers(0, 50, 200))
    b = Blocks(df, "bucket", 30, block_rows=32)
    b.running("total_tokens")
    out = b.result("bucket", b.past_sum("total_tokens", 30).alias("a"), b.past(F.sum("total_tokens"), "total_tokens", 30).alias("b"))
    assert out.where("NOT a <=> b").count() == 0


def test_feature_counts_and_causality(spark):
    df = series(spark, np.arange(400) ** 2 % 97)
    assert len(features.workload_feature_names()) == 24 and len(features.workload_feature_names(True)) == 28
    assert len(features.failure_feature_names()) == 89 and len(features.failure_feature_names(False)) == 72
    longer = series(spark, [*(np.arange(400) ** 2 % 97), 5000])
    a = features.workload_features(df).where("bucket < 402").drop("target_next_5min")
    b = features.workload_features(longer).where("bucket < 402").drop("target_next_5min")
    assert a.exceptAll(b).isEmpty()
    full = features.drop_warm_up(features.workload_features(df), features.workload_feature_names())
    assert full.agg(F.min("bucket")).first()[0] == 3 + 288


def brute_scores(y, s, n):
    z = np.log1p(y)
    out = [None] * len(z)
    for t in range(s + n - 1, len(z)):
        short, past = z[t - s + 1 : t + 1].mean(), z[t - s - n + 1 : t - s + 1]
        q25, q50, q75 = np.percentile(past, [25, 50, 75])
        scale, shift = (q75 - q25) / 1.349, abs(short - q50)
        out[t] = shift / scale if scale > 0 else (math.inf if shift > 0 else 0.0)
    return out


def test_change_scores_equal_loop(spark):
    y = np.random.default_rng(1).integers(0, 40, 120)
    got = [r.change_score for r in changepoint.change_scores(series(spark, y), 4, 20).orderBy("bucket").collect()]
    want = brute_scores(y, 4, 20)
    assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b)) for a, b in zip(got, want, strict=True))


def test_constant_past_scores_infinity_or_zero(spark):
    got = [r.change_score for r in changepoint.change_scores(series(spark, [7] * 12 + [9]), 2, 6).orderBy("bucket").collect()]
    assert got[7:12] == [0.0] * 5 and got[12] == math.inf


def test_alarms_keep_their_gap(spark):
    c = spark.createDataFrame([(0, i) for i in range(0, 700)], "s int, position long")
    assert sorted(r.position for r in changepoint.greedy_alarms(c, "position", 288, ["s"]).collect()) == [0, 288, 576]


def test_elapsed_counts_from_the_alarm_before(spark):
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.integers(5, 9, 80), rng.integers(500, 900, 40), rng.integers(5, 9, 80)])
    d = changepoint.Detector(short=3, long=30, gap=10, quantile=0.5)
    rows = changepoint.change_points(series(spark, y), d).orderBy("position").collect()
    last = changepoint.NEVER
    for r in rows:
        if r.change_score is not None:
            assert r.elapsed_since_alarm == r.position - last
        if r.change_alarm:
            last = r.position
    assert sum(r.change_alarm for r in rows) > 1


def test_band_match(spark):
    a = spark.createDataFrame([(1, 100), (2, 112), (3, 113)], "config_id int, position long")
    got = {r.config_id: r.matched for r in changepoint.alarm_match_rates(a, 1).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


@pytest.mark.parametrize(("outcome", "end"), [(1, 0.50), (0, 0.99)])
def test_threshold_stays_in_bounds(spark, outcome, end):
    risk = spark.createDataFrame([(i, 0.9, outcome) for i in range(200)], "minute long, risk double, failure int")
    last = control.adaptive_threshold(risk, 0.5, "minute").orderBy(F.desc("minute")).first()
    assert last.threshold_after_update == pytest.approx(end)


def test_threshold_waits_and_stays_when_equal(spark):
    risk = spark.createDataFrame([(i, 0.9, i % 2) for i in range(60)], "minute long, risk double, failure int")
    got = control.adaptive_threshold(risk, 0.5, "minute").agg(F.min("threshold_after_update"), F.max("threshold_after_update")).first()
    assert got[0] == got[1] == 0.9591


def test_first_threshold_and_largest_risk(spark):
    m = spark.createDataFrame([(5, 0.1, 0.9), (6, 0.7, 0.8), (9, 0.2, 0.6)], "minute long, risk double, threshold_before_update double")
    assert control.to_five_minutes(m).collect() == [(1, 0.7, 0.9)]


def test_policy_four_overrides_on_alarms(spark):
    rows = spark.createDataFrame([(0, 10.0, 10.0, 0.97, 0.98, 1), (1, 10.0, 10.0, 0.97, 0.98, 0)], "bucket long, actual_workload double, forecast_workload double, risk_signal double, adaptive_threshold double, change_alarm int")
    got = control.policies(rows).orderBy("bucket").collect()
    assert [(r.V3_trigger, r.V4_trigger) for r in got] == [(0, 1), (0, 0)]
    assert got[0].V4_capacity == pytest.approx(11.0)
    m = control.capacity_metrics(control.long_policies(control.policies(rows))).collect()
    assert len(m) == 4 and all(x.mean_shortage == 0 for x in m)


def test_baselines_and_fits(spark):
    df = series(spark, np.arange(900) % 300 + 5)
    base = learning.causal_baselines(df)
    assert base.where("seasonal_naive IS NOT NULL").count() == 900 - 287
    rows = features.workload_features(df).withColumn("split", F.when(F.col("bucket") < 700, "train").otherwise("test"))
    out = learning.forecast(rows, features.workload_feature_names(), "gbt", trees=3)
    assert out.count() == 900 - 288 - 1 and out.where("forecast < 0").count() == 0
