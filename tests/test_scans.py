"""Running totals, the controller's scan, alarms and bootstraps against plain loops; files and models that are read back."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import changepoint, control, inference, learning, windows
from tidewheel.sources import shared, trace


def test_running_totals(spark):
    rng = np.random.default_rng(0)
    rows = [(str(g), int(k), int(rng.integers(0, 9))) for g in range(3) for k in rng.permutation(200)[: 50 + 40 * g]]
    got = windows.running_totals(spark.createDataFrame(rows, "g string, k long, x long"), "k", ["x"], ["g"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r._before_x == sum(x for g, k, x in rows if g == r.g and k < r.k)


@pytest.mark.parametrize("block_rows", [60, 97, 1 << 14])
def test_threshold_scan_is_the_loop(spark, block_rows):
    rng = np.random.default_rng(1)
    y = (rng.random(700) < np.repeat(rng.random(14) * 0.3, 50)).astype(int)
    p = rng.random(700)
    rows = spark.createDataFrame(pd.DataFrame({"minute": np.arange(100, 800), "risk": p, "failure": y})).orderBy(F.rand(3))
    c = control.Controller(step=0.03)
    got = control.adaptive_threshold(rows, 0.1, "minute", controller=c, block_rows=block_rows).orderBy("minute").toPandas()
    theta, want = c.start, []
    for i in range(700):
        before = theta
        if i >= c.window - 1:
            rate = y[i - c.window + 1 : i + 1].mean()
            if rate != 0.1:
                theta = min(c.high, max(c.low, theta + (c.step if rate < 0.1 else -c.step)))
        want.append((before, int(p[i] > before), theta))
    before, trigger, after = zip(*want, strict=True)
    assert np.allclose(got.threshold_before_update, before) and np.allclose(got.threshold_after_update, after)
    assert got.reserve_trigger.tolist() == list(trigger)
    assert got.threshold_after_update.min() == c.low and got.threshold_after_update.max() == c.high
    assert control.adaptive_threshold(rows.where("false"), 0.1, "minute").count() == 0


def test_alarms_keep_their_gap(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(p), 7 + 5 * g) for g in range(3) for p in np.flatnonzero(rng.random(300) < 0.2)]
    got = defaultdict(list)
    for r in changepoint.greedy_alarms(spark.createDataFrame(rows, "g int, p long, gap int"), "p", "gap", ["g"]).collect():
        got[r.g].append(r.p)
    for g in range(3):
        want = []
        for _, p, gap in sorted(r for r in rows if r[0] == g):
            if not want or p - want[-1] >= gap:
                want.append(p)
        assert sorted(got[g]) == want


def test_match_rates_have_every_configuration(spark):
    alarms = spark.createDataFrame([(1, 10), (1, 50), (2, 15), (2, 90)], "config_id int, position long")
    got = {r.config_id: tuple(r)[1:] for r in changepoint.alarm_match_rates(alarms, 1, configs=[1, 2, 3]).collect()}
    assert got == {1: (2, 2, 2, 1.0, 1.0), 2: (2, 2, 1, 0.5, 0.5), 3: (0, 2, 0, 0.0, None)}


def test_iid_bootstrap_draws_as_numpy_does(spark):
    d = np.random.default_rng(4).normal(size=400)
    means = inference.iid_bootstrap(spark.createDataFrame(pd.DataFrame({"d": d})), "d", replicates=3000).toPandas()["mean"].to_numpy()
    assert len(means) == 3000 and abs(means.mean() - d.mean()) < 0.01
    assert means.std() == pytest.approx(d.std() / 20, rel=0.08)


def test_block_bootstraps_of_several_series(spark):
    rng = np.random.default_rng(5)
    series = {"a": rng.normal(size=90), "b": rng.normal(size=40), "c": rng.normal(size=5)}
    rows = [(t, i, float(x)) for t, d in series.items() for i, x in enumerate(d)]
    got = inference.block_bootstraps(spark.createDataFrame(rows, "t string, k long, d double"), ["t"], "k", "d", 50, 12).collect()
    assert len(got) == 150
    a, c, m = inference.LCG
    for r in got:
        d = series[r.t]
        n, size = len(d), min(12, len(d))
        blocks = -(-n // size)
        drawn = []
        for k in range(blocks):
            lo = ((((r.replicate * blocks + k + 1) * 48271 % m) * a + c) % m) % (n - size + 1)
            drawn += d[lo : lo + size].tolist()
        assert r["mean"] == pytest.approx(np.mean(drawn[:n]))


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x long, y string")
    trace.write_json(df, f"file://{tmp_path}/j")
    assert {(r.x, r.y) for r in trace.read_json(spark, f"file://{tmp_path}/j").collect()} == {(1, "a"), (2, None)}
    assert trace.numeric_columns(df) == ["x"]


def test_fits_get_few_partitions(spark):
    assert learning.for_fit(spark.range(50).repartition(9)).rdd.getNumPartitions() == 1


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())
