"""Each check of a stored run fails on the fault planted for it, and on no other."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import control, inference, manifest
from tidewheel.plans import reports

MODELS = ["a", "b", "c"]


def results(spark):
    forecasts = spark.range(40).select(F.col("id").alias("bucket"), (100.0 + F.col("id") % 7).alias("actual_workload"), *((100.0 + F.col("id") % k).alias(m) for k, m in ((3, "a"), (5, "b"), (11, "c"))))
    rows = forecasts.withColumn("risk_signal", F.lit(0.8)).withColumn("adaptive_threshold", F.when(F.col("bucket") < 10, 0.7).otherwise(0.9))
    long = control.forecast_control(rows, MODELS, 1.1, adaptive=True).select("bucket", "policy", "actual_workload", "trigger", "capacity")
    tests = inference.paired_tests(inference.paired_differences(reports.control_costs(long), "bucket", "policy", reports.COMPARED), replicates=50)
    return {"forecasts": forecasts, "control": long, "metrics": control.capacity_metrics(long), "tests": tests}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    held = {}
    for name, df in results(spark).items():
        path = f"file://{tmp_path_factory.mktemp('held')}/{name}"
        df.write.parquet(path)
        held[name] = spark.read.parquet(path)
    return held


def audit(spark, run, folder, **changed):
    root = f"file://{folder}/run"
    manifest.store(run | changed, root)
    return root, failed(spark, root)


def failed(spark, root):
    return {r.check: r.violations for r in reports.audit_stored(spark, root, MODELS).collect() if not r.passed}


def test_a_good_run_passes(spark, run, tmp_path):
    root, bad = audit(spark, run, tmp_path)
    assert bad == {}
    rows = {r.check: r.rows for r in reports.audit_stored(spark, root, MODELS).collect()}
    assert rows == {"as_listed: forecasts": 40, "as_listed: control": 120, "as_listed: metrics": 3, "as_listed: tests": 12, "forecasts": 40, "models": 120, "interval_pairing": 40, "shared_activation": 3, "inference": 12, "metrics_recomputed": 3}


def test_changed_lost_and_added_files(spark, run, tmp_path):
    root, _ = audit(spark, run, tmp_path)
    folder = Path(tmp_path) / "run" / "stages" / "tests"
    one = next(folder.glob("*.parquet"))
    copy = folder / "part-more.parquet"
    copy.write_bytes(one.read_bytes())
    bad = failed(spark, root)
    assert bad["as_listed: tests"] == 2 and set(bad) == {"as_listed: tests", "inference"}  # one more file, more rows
    copy.unlink()
    (folder / f".{one.name}.crc").unlink(missing_ok=True)
    run["tests"].coalesce(1).withColumn("w_plus", F.col("w_plus") + 1).write.mode("overwrite").parquet(f"{root}/stages/tests")
    assert set(failed(spark, root)) == {"as_listed: tests"}


def test_planted_faults(spark, run, tmp_path):
    f, c, m, t = (run[k] for k in ("forecasts", "control", "metrics", "tests"))
    faults = [
        ({"forecasts": f.unionByName(f.where("bucket = 3"))}, {"forecasts": 1}),
        ({"forecasts": f.withColumn("b", F.when(F.col("bucket") == 4, float("nan")).otherwise(F.col("b")))}, {"forecasts": 1}),
        ({"forecasts": f.where("bucket <> 5")}, {"interval_pairing": 1}),
        ({"control": c.withColumn("policy", F.when(F.col("policy") == "c", "d").otherwise(F.col("policy")))}, {"models": 41, "metrics_recomputed": 2}),
        ({"control": c.withColumn("bucket", F.when((F.col("policy") == "c") & (F.col("bucket") == 7), 99).otherwise(F.col("bucket")))}, {"interval_pairing": 2}),
        ({"metrics": m.withColumn("mean_shortage", F.col("mean_shortage") + F.when(F.col("policy") == "b", 1e-3).otherwise(0.0))}, {"metrics_recomputed": 1}),
        ({"tests": t.withColumn("p_value", F.lit(2.0))}, {"inference": 12}),
        ({"tests": t.limit(11)}, {"inference": 1}),
    ]
    for i, (changed, want) in enumerate(faults):
        folder = tmp_path / str(i)
        folder.mkdir()
        assert audit(spark, run, folder, **changed)[1] == want, i


def test_activation_must_be_shared(spark, run, tmp_path):
    flipped = run["control"].withColumn("trigger", F.when((F.col("policy") == "b") & (F.col("bucket") == 30), 1).otherwise(F.col("trigger")))
    bad = audit(spark, run, tmp_path, control=flipped)[1]
    assert bad == {"shared_activation": 1, "metrics_recomputed": 1}


def test_significance_on_demand(spark, run):
    weak = run["tests"].where("p_holm >= 0.05").count()
    assert manifest.inference_faults(run["tests"], 3, 4, alpha=0.05).first().violations == weak
