import math

import numpy as np
import pytest

from tidewheel.functions import metrics
from tidewheel.operators import inference


def test_holm(spark):
    t = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,)], "p double")
    got = {r.p: r.p_holm for r in inference.holm(t).collect()}
    assert got == pytest.approx({0.01: 0.03, 0.04: 0.06, 0.03: 0.06, 0.005: 0.02})


def test_block_bootstrap_cuts_the_last_block(spark):
    rng = np.random.default_rng(0)
    d = rng.normal(size=700)
    pairs = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "k long, d double")
    got = {r.replicate: r.mean for r in inference.block_bootstrap(pairs, "k", "d", replicates=5, block=288).collect()}
    a, c, m = inference.LCG
    for rep in range(5):
        parts = []
        for k in range(3):
            start = ((((rep * 3 + k + 1) * 48271 % m) * a + c) % m) % (700 - 288 + 1)
            parts.append(d[start : start + min(288, 700 - 288 * k)])
        sample = np.concatenate(parts)
        assert len(sample) == 700 and got[rep] == pytest.approx(sample.mean())


def test_wilcoxon_against_brute_force(spark):
    d = [3.0, -1.0, 2.0, 2.0, -2.0, 0.0, 5.0]
    r = inference.wilcoxon(spark.createDataFrame([(x,) for x in d], "d double"), "d").first()
    assert (r.n, r.w_plus, r.w_minus) == (6, 5 + 3 + 3 + 6, 1 + 3)
    zero = inference.wilcoxon(spark.createDataFrame([(0.0,)], "d double"), "d").first()
    assert (zero.statistic, zero.p_value) == (0.0, 1.0)


def test_iid_bootstrap_is_centred(spark):
    pairs = spark.createDataFrame([(float(i),) for i in range(100)], "d double")
    s = inference.bootstrap_summary(inference.iid_bootstrap(pairs, "d", replicates=1000)).first()
    assert s.ci_low < 49.5 < s.ci_high


def test_scores_with_ties(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (1.0, 1), (0.1, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    pairs = [(a, b) for a, ya in rows for b, yb in rows if ya == 1 and yb == 0]
    auc = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs])
    assert metrics.roc_auc(df, "s", "y").first()[0] == pytest.approx(auc, abs=1e-6)
    ap = (1 * 1 + 1 * 1 + 3 / 4 * 1 + 4 / 6 * 1) / 4
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx(ap, abs=1e-6)


def test_roc_auc_of_one_class(spark):
    def auc(*rows):
        return metrics.roc_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()[0]

    assert math.isnan(auc((0.1, 1), (0.4, 1))) and math.isnan(auc((0.1, 0), (0.4, 0)))
    assert auc() is None
    assert auc((0.1, 0), (0.4, 1)) == 1.0


@pytest.mark.parametrize("failure", [0, 1])
def test_risk_table_of_one_class(spark, failure):
    from tidewheel.plans.reports import risk_table

    test = spark.createDataFrame([(0.5, 0.25, failure), (0.75, 0.5, failure)], "risk double, calibrated double, failure int")
    got = risk_table(test, "risk", "calibrated").first()
    assert got.test_rows == 2 and got.failure_prevalence_percent == 100.0 * failure
    assert math.isnan(got.ROC_AUC)
    assert got.Average_Precision == 1.0 if failure else math.isnan(got.Average_Precision)
    assert (got.Precision, got.Recall, got.F1) == (0.0, 0.0, 0.0)


def test_bins_are_closed_on_the_left(spark):
    df = spark.createDataFrame([(0.1, 1), (1.0, 1), (0.0, 0)], "s double, y int")
    assert sorted(r.bin for r in metrics.ece_bins(df, "s", "y").collect()) == [1, 2, 10]


def test_smape_leaves_out_zero_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0)], "a double, p double")
    from pyspark.sql import functions as F

    assert df.agg(*metrics.forecast_errors(F.col("a"), F.col("p"))).first()["smape_percent"] == pytest.approx(200 / 3, abs=1e-5)
