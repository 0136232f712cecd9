"""Queries of audits, report tables and the data behind figures, and the path through the learned models.

They register with :mod:`tidewheel.plans.catalog`, which imports this module last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import metrics
from tidewheel.functions.columns import rounded
from tidewheel.operators import changepoint, control, features, inference, learning, manifest, quality, timeview
from tidewheel.plans import catalog as c
from tidewheel.plans.catalog import query, r
from tidewheel.sources.shared import fresh_path, settled, side_by_side
from tidewheel.sources.trace import EVENTS_AS_TRACE_SQL, events_as_trace, file_fingerprints, numeric_columns

# ---------------------------------------------------------------- audits

TRACE_NUMBERS = ["ts_s", "request_tokens", "response_tokens", "total_tokens"]


def _profile_sql(name: str) -> str:
    x = f"try_cast({name} AS DOUBLE)"
    return f"SELECT '{name}' AS \"column\", count(*) FILTER ({name} IS NULL) AS nulls, count(*) FILTER ({name} IS NOT NULL AND {x} IS NULL) AS uncoercible, min({x}) AS least, round(avg({x}), 6) + 0.0 AS mean, median({x}) AS median, max({x}) AS most FROM trace"


@query(f"WITH {EVENTS_AS_TRACE_SQL} {' UNION ALL '.join(_profile_sql(n) for n in [*TRACE_NUMBERS, 'model'])}")
def column_profile(spark, sf_dir):
    """Spread of the numeric columns; of ``model`` no value is a number."""
    trace = events_as_trace(spark, sf_dir)
    return quality.profile_columns(trace, [*numeric_columns(trace), "model"])


SPLIT_SQL = f"""{c.WITH_VIEW}, {c.BASE_SQL},
sp AS (SELECT bucket, persistence, moving_average, CASE WHEN bucket - lo < floor(n * (12384 / 17566)) THEN 'train' WHEN bucket - lo < floor(n * (14976 / 17566)) THEN 'calibration' ELSE 'test' END AS split FROM b, span)"""


@query(f"""{SPLIT_SQL} SELECT split, count(*) AS rows, min(bucket) AS first, max(bucket) AS last, CAST(count(*) FILTER (persistence IS NULL OR moving_average IS NULL) AS BIGINT) AS missing,
coalesce(min(bucket) <= CASE split WHEN 'train' THEN NULL WHEN 'calibration' THEN (SELECT max(bucket) FROM sp WHERE split = 'train') ELSE (SELECT max(bucket) FROM sp WHERE split <> 'test') END, false) AS out_of_order FROM sp GROUP BY split""")
def split_audit(spark, sf_dir):
    """Chronology and missing values of the splits; the split column is given in other case and with spaces."""
    rows = c.with_split(learning.causal_baselines(c.view5(spark, sf_dir))).withColumn("split", F.concat(F.lit(" "), F.initcap("split")))
    found = quality.split_violations(rows, "bucket", ["persistence", "moving_average"])
    return found.withColumn("missing", F.col("missing").cast("long"))


BOUNDS = {"risk": (0.0, 1.0), "threshold_before_update": (0.5, 0.99), "failure": (0.0, 1.0)}
BOUND_COLUMNS = {"risk": "risk", "threshold_before_update": "before", "failure": "failure"}


@query(c.WITH_CTL + " " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) AS rows, count(*) FILTER ({BOUND_COLUMNS[n]} < {a} OR {BOUND_COLUMNS[n]} > {b}) AS outside, count(*) FILTER ({BOUND_COLUMNS[n]} IS NULL) AS missing FROM ctl" for n, (a, b) in BOUNDS.items()))
def bounds_audit(spark, sf_dir):
    """Risk, threshold and failures within their bounds."""
    return quality.bound_violations(c.controlled(c.view5(spark, sf_dir)), BOUNDS)


@query(f"""{SPLIT_SQL}
SELECT a.bucket, a.split, round(a.persistence, 6) + 0.0 AS persistence, round(a.moving_average, 6) + 0.0 AS moving_average FROM sp a WHERE a.split = 'test' AND a.moving_average IS NOT NULL""")
def aligned_forecasts(spark, sf_dir):
    """Two forecasts joined on bucket and split, which must be unique and the same on both sides."""
    rows = settled(c.with_split(learning.causal_baselines(c.view5(spark, sf_dir))).where("split = 'test' AND moving_average IS NOT NULL"), "forecasts")
    both = quality.aligned_once(rows.select("bucket", "split", "persistence"), rows.select("bucket", "split", "moving_average"), ["bucket", "split"])
    return both.select("bucket", "split", *r("persistence", "moving_average"))


AUDIT_SQL = f"""{c.WITH_CTL}, {c.POLICY_SQL},
ck AS (
    SELECT 'time_view' AS "check", (SELECT count(*) FROM v WHERE total_tokens <> request_tokens + response_tokens OR zero_response_count > request_count) + (SELECT max(bucket) - min(bucket) + 1 - count(*) FROM v) AS violations
    UNION ALL SELECT 'alarm_spacing', (SELECT count(*) FROM (SELECT position - lag(position) OVER (ORDER BY position) AS step FROM alarms) x WHERE step < 288)
    UNION ALL SELECT 'threshold_bounds', (SELECT count(*) FROM ctl WHERE before < 0.5 OR before > 0.99)
    UNION ALL SELECT 'risk_bounds', (SELECT count(*) FROM ctl WHERE risk < 0 OR risk > 1)
    UNION ALL SELECT 'policy_rows_unique', (SELECT count(*) FROM (SELECT bucket, policy FROM lp GROUP BY ALL HAVING count(*) > 1) x)
    UNION ALL SELECT 'policies_complete', (SELECT count(*) FROM (SELECT bucket FROM lp GROUP BY bucket HAVING count(DISTINCT policy) <> 4) x)
    UNION ALL SELECT 'capacity_not_negative', (SELECT count(*) FROM lp WHERE capacity < 0 OR capacity IS NULL)
    UNION ALL SELECT 'no_reserve_in_V1', (SELECT count(*) FROM lp WHERE policy = 'V1' AND trigger <> 0))"""


@query(f'{AUDIT_SQL} SELECT "check", CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM ck')
def audit_checks(spark, sf_dir):
    """Eight checks of the results, each with its violations; ``artifact_manifest`` has the fingerprints."""
    view = c.view5(spark, sf_dir)
    rules = timeview.view_violations(view)
    alarms = quality.alarm_spacing(changepoint.change_points(view), 288)
    control_rows = settled(c.controlled(view), "control")
    long = settled(control.long_policies(control.policies(c.policy_rows(view))), "long-policies")
    pairs = long.groupBy("bucket", "policy").count()
    checks = {
        "time_view": rules.select((F.col("token_mismatch") + F.col("too_many_zero_responses") + F.col("missing_buckets")).alias("v")),
        "alarm_spacing": alarms.select(F.col("too_close").alias("v")),
        "threshold_bounds": quality.bound_violations(control_rows, {"threshold_before_update": (0.5, 0.99)}).select(F.col("outside").alias("v")),
        "risk_bounds": quality.bound_violations(control_rows, {"risk": (0.0, 1.0)}).select(F.col("outside").alias("v")),
        "policy_rows_unique": pairs.agg(F.count_if(F.col("count") > 1).alias("v")),
        "policies_complete": pairs.groupBy("bucket").count().agg(F.count_if(F.col("count") != 4).alias("v")),
        "capacity_not_negative": long.agg(F.count_if((F.col("capacity") < 0) | F.col("capacity").isNull()).alias("v")),
        "no_reserve_in_V1": long.agg(F.count_if((F.col("policy") == "V1") & (F.col("trigger") != 0)).alias("v")),
    }
    parts = [df.select(F.lit(name).alias("check"), F.col("v").cast("long").alias("violations")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)


@query()
def artifact_manifest(spark, sf_dir):
    """Name, length and SHA-256 of each file of the event table."""
    return file_fingerprints(spark, f"{sf_dir}/events.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


COMPARED = ["shortage", "unused", "provisioned", "absolute_error"]


def audit_stored(spark, root: str, models: list[str]) -> DataFrame:
    """Eight kinds of checks of a stored run with the stages forecasts, control, metrics and tests."""
    forecasts, rows, figures, tests = (manifest.stored(spark, root, s) for s in ("forecasts", "control", "metrics", "tests"))
    pairs = len(models) * (len(models) - 1) // 2
    return manifest.report(
        {
            "as_listed": manifest.file_faults(spark, root),
            "forecasts": manifest.forecast_faults(forecasts, "bucket"),
            "models": manifest.model_faults(rows, "policy", models),
            "interval_pairing": manifest.pairing_faults(rows, forecasts, "bucket", "policy", models),
            "shared_activation": manifest.activation_faults(rows, "policy", "trigger"),
            "inference": manifest.inference_faults(tests, pairs, len(COMPARED)),
            "metrics_recomputed": manifest.recomputed_faults(figures, control.capacity_metrics(rows), "policy"),
        }
    )


STORED_SQL = c.forecast_sql("CASE WHEN risk_signal > adaptive_threshold THEN 1 ELSE 0 END", 0.10).split(", ls AS (")[0]


@query(f"""{STORED_SQL},
f AS (SELECT count(*) AS n, count(*) - count(DISTINCT bucket) + count(*) FILTER (actual_workload IS NULL OR persistence IS NULL OR seasonal_naive IS NULL OR moving_average IS NULL) AS bad FROM pr),
k AS (SELECT bucket, count(*) AS n, count(DISTINCT policy) AS m FROM lp GROUP BY bucket),
a AS (SELECT policy, avg(trigger) AS share FROM lp GROUP BY policy),
ck AS (SELECT 'as_listed: forecasts' AS "check", (SELECT n FROM f) AS rows, 0 AS violations
    UNION ALL SELECT 'as_listed: control', (SELECT count(*) FROM lp), 0
    UNION ALL SELECT 'as_listed: metrics', (SELECT count(*) FROM a), 0
    UNION ALL SELECT 'as_listed: tests', (SELECT count(*) FROM a x JOIN a y ON x.policy < y.policy) * 4, 0
    UNION ALL SELECT 'forecasts', n, bad FROM f
    UNION ALL SELECT 'models', count(*), count(*) FILTER (capacity IS NULL OR actual_workload IS NULL OR trigger IS NULL) + 3 - count(DISTINCT policy) FROM lp
    UNION ALL SELECT 'interval_pairing', count(*), count(*) FILTER (n <> 3 OR m <> 3) FROM k
    UNION ALL SELECT 'shared_activation', count(*), count(*) FILTER (abs(share - (SELECT arg_min(share, policy) FROM a)) > 1e-5) FROM a
    UNION ALL SELECT 'inference', (SELECT count(*) FROM a x JOIN a y ON x.policy < y.policy) * 4, 0
    UNION ALL SELECT 'metrics_recomputed', count(*), 0 FROM a)
SELECT "check", CAST(rows AS BIGINT) AS rows, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM ck""")
def stored_run_audit(spark, sf_dir):
    """A run of the baselines under the adaptive reserve is stored, read back and audited; tests have 1,000 replicates."""
    rows = c.policy_rows(c.view5(spark, sf_dir))
    long = settled(control.forecast_control(rows, c.FORECASTS, 0.10, adaptive=True), "forecast-control")
    tests = inference.paired_tests(inference.paired_differences(control_costs(long), "bucket", "policy", COMPARED), replicates=1000)
    root = fresh_path(spark, "run")
    manifest.store(
        {
            "forecasts": rows.select("bucket", "actual_workload", *c.FORECASTS),
            "control": long.select("bucket", "policy", "actual_workload", "trigger", "capacity"),
            "metrics": control.capacity_metrics(long),
            "tests": tests,
        },
        root,
    )
    return audit_stored(spark, root, c.FORECASTS)


def control_costs(long: DataFrame) -> DataFrame:
    """Shortage, unused and provisioned capacity and absolute error of each bucket and forecast."""
    gap = F.col("actual_workload") - F.col("capacity")
    return long.select("bucket", "policy", F.greatest(gap, F.lit(0.0)).alias("shortage"), F.greatest(-gap, F.lit(0.0)).alias("unused"), F.col("capacity").alias("provisioned"), F.abs(gap).alias("absolute_error"))


# ---------------------------------------------------------------- tables

FORECAST_SQL = f"""{c.WITH_VIEW}, {c.BASE_SQL}, f AS (SELECT * FROM (SELECT bucket, CAST(actual AS DOUBLE) AS a, persistence, seasonal_naive, moving_average FROM b WHERE actual IS NOT NULL AND {c.TEST_SQL})
     UNPIVOT (p FOR model IN (persistence, seasonal_naive, moving_average)))"""


@query(f"""{FORECAST_SQL} SELECT model, count(*) AS test_rows, round(avg(abs(p - a)), 6) + 0.0 AS "MAE", round(sqrt(avg((p - a) * (p - a))), 6) + 0.0 AS "RMSE", round(100 * sum(abs(p - a)) / sum(abs(a)), 6) + 0.0 AS "WAPE_percent",
       round(100 * avg(CASE WHEN abs(a) + abs(p) > 0 THEN 2 * abs(p - a) / (abs(a) + abs(p)) END), 6) + 0.0 AS "sMAPE_percent", round(avg(p - a), 6) + 0.0 AS mean_bias FROM f GROUP BY model""")
def table1_forecast_performance(spark, sf_dir):
    names = {"forecast": "model", "n": "test_rows", "mae": "MAE", "rmse": "RMSE", "wape_percent": "WAPE_percent", "smape_percent": "sMAPE_percent"}
    return c.forecast_metrics(spark, sf_dir).withColumnsRenamed(names)


RISK_TEST_SQL = f"""{c.WITH_MINUTES}, {c.RISK_SQL}, {c.ISOTONIC_SQL},
rt AS (SELECT failure AS y, kp.risk AS raw, calibrated AS p FROM kp JOIN kc ON kc.risk = kp.risk WHERE split = 'test'),
rg AS (SELECT p AS s, count(*) AS n, sum(y) AS pos FROM rt GROUP BY p),
ra AS (SELECT pos, n - pos AS neg, pos * (coalesce(sum(n - pos) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n - pos) / 2) AS won FROM rg),
rp AS (SELECT pos, sum(pos) OVER o / sum(n) OVER o AS pr FROM rg WINDOW o AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
re AS (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM rt GROUP BY {c.ECE_BIN_SQL.replace("risk", "p")}),
rc AS (SELECT count(*) FILTER (p > 0.9591 AND y = 1) AS tp, count(*) FILTER (p > 0.9591 AND y = 0) AS fp, count(*) FILTER (p <= 0.9591 AND y = 1) AS fn FROM rt)"""


@query(f"""{RISK_TEST_SQL} SELECT (SELECT count(*) FROM rt) AS test_rows, (SELECT round(100 * avg(y), 6) + 0.0 FROM rt) AS failure_prevalence_percent, (SELECT round(sum(won) / (sum(pos) * sum(neg)), 6) + 0.0 FROM ra) AS "ROC_AUC",
(SELECT round(sum(pr * pos) / sum(pos), 6) + 0.0 FROM rp) AS "Average_Precision", (SELECT round(avg((p - y) ** 2), 6) + 0.0 FROM rt) AS "Brier_calibrated", (SELECT round(avg((raw - y) ** 2), 6) + 0.0 FROM rt) AS "Brier_raw_diagnostic",
(SELECT round(sum(n * gap) / sum(n), 6) + 0.0 FROM re) AS "ECE_10_bin", CAST(0.9591 AS DOUBLE) AS classification_threshold, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) + 0.0 AS "Precision",
round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) + 0.0 AS "Recall", round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) + 0.0 AS "F1" FROM rc""")
def table2_failure_risk_performance(spark, sf_dir):
    """Of the surrogate risk, calibrated by isotonic regression, on the test split."""
    rows = learning.isotonic(c.with_split(c.surrogate_risk(c.minutes(spark, sf_dir)), "minute"), "risk", "failure")
    return risk_table(settled(rows.where("split = 'test'"), "test-risk"), "risk", "calibrated")


def risk_table(test: DataFrame, raw: str, calibrated: str) -> DataFrame:
    """One row of a classifier's figures on its test rows."""
    found = metrics.risk_metrics(test, calibrated, "failure", c.FIXED)
    bins = metrics.ece_bins(test.withColumn("_p", F.col(calibrated)), "_p", "failure", digits=None)
    ece = bins.agg(rounded(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ECE_10_bin"))
    brier = test.agg(rounded(F.avg((F.col(raw) - F.col("failure")) ** 2)).alias("Brier_raw_diagnostic"), rounded(100 * F.avg(F.col("failure"))).alias("failure_prevalence_percent"))
    one = found.crossJoin(metrics.roc_auc(test, calibrated, "failure")).crossJoin(metrics.average_precision(test, calibrated, "failure")).crossJoin(brier).crossJoin(ece)  # one row each
    names = {"n": "test_rows", "roc_auc": "ROC_AUC", "average_precision": "Average_Precision", "brier": "Brier_calibrated", "precision": "Precision", "recall": "Recall", "f1": "F1"}
    return one.withColumn("classification_threshold", F.lit(c.FIXED)).drop("prevalence", "log_loss").withColumnsRenamed(names)


TABLE3 = ["policy", "under_provisioned_percent", "mean_shortage", "p95_shortage", "shortfall_cvar95", "mean_unused_capacity", "mean_provisioned_capacity", "mean_actual_workload", "reserve_activation_percent", "cost_index"]


@query(f"SELECT n AS intervals, {', '.join(TABLE3)} FROM ({c.ORACLE_SQL['capacity_metrics_test']}) x")
def table3_capacity_policy_performance(spark, sf_dir):
    return c.capacity_metrics_test(spark, sf_dir).select(F.col("n").alias("intervals"), *TABLE3)


@query(f"SELECT comparison, metric, n AS n_observations, CAST(least(288, n) AS BIGINT) AS block_length, observed_difference, ci_low AS ci_95_lower, ci_high AS ci_95_upper, p_value AS raw_p_value, p_holm AS holm_adjusted_p_value, significant AS significant_after_holm_alpha_0_05 FROM ({c.ORACLE_SQL['block_bootstrap_tests']}) x")
def table4_statistical_tests(spark, sf_dir):
    names = {"n": "n_observations", "ci_low": "ci_95_lower", "ci_high": "ci_95_upper", "p_value": "raw_p_value", "p_holm": "holm_adjusted_p_value", "significant": "significant_after_holm_alpha_0_05"}
    return c.block_bootstrap_tests(spark, sf_dir).withColumn("block_length", F.least(F.lit(288).cast("long"), "n")).withColumnsRenamed(names)


CONFIGURATION = [
    ("Change-point detector", "training_threshold_percentile", 95.0),
    ("Adaptive threshold", "base_threshold", control.Controller().start),
    ("Adaptive threshold", "eta", control.Controller().step),
    ("Adaptive threshold", "minimum_threshold", control.Controller().low),
    ("Adaptive threshold", "maximum_threshold", control.Controller().high),
    ("Capacity reserve", "reserve_factor", 1.10),
    ("Bootstrap", "replicates", 2000.0),
    ("Bootstrap", "block_length", 288.0),
    ("Bootstrap", "confidence_level", 0.95),
]


@query(f"{c.WITH_VIEW}, {c.SCORES} SELECT 'Change-point detector' AS component, 'derived_threshold' AS parameter, round(threshold, 6) + 0.0 AS value FROM th UNION ALL SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', CAST({v} AS DOUBLE))" for a, b, v in CONFIGURATION)}) x")
def table5_experiment_configuration(spark, sf_dir):
    """The numbers that experiments run with; the detector's threshold is derived from the data."""
    derived = c.change_threshold(spark, sf_dir).select(F.lit("Change-point detector").alias("component"), F.lit("derived_threshold").alias("parameter"), F.col("threshold").alias("value"))
    return derived.unionByName(spark.createDataFrame(CONFIGURATION, "component string, parameter string, value double"))


POLICIES = [("V1", "none", 1.0, False), ("V2", "fixed", 1.1, False), ("V3", "adaptive", 1.1, False), ("V4", "adaptive", 1.1, True)]


@query(f"SELECT * FROM (VALUES {', '.join(f"('{p}', '{t}', CAST({v} AS DOUBLE), {str(x).lower()})" for p, t, v, x in POLICIES)}) AS x(policy, risk_threshold, reserve_factor, change_point_reset)")
def table7_policy_definitions(spark, sf_dir):
    return spark.createDataFrame(POLICIES, "policy string, risk_threshold string, reserve_factor double, change_point_reset boolean")


# ---------------------------------------------------------------- figures


@query(f'SELECT model, "MAE", "RMSE" FROM ({c.ORACLE_SQL["table1_forecast_performance"]}) x')
def figure_forecast_errors(spark, sf_dir):
    return table1_forecast_performance(spark, sf_dir).select("model", "MAE", "RMSE")


@query(f"{c.WITH_VIEW}, {c.BASE_SQL} SELECT bucket, actual, {c.r_sql(*c.FORECASTS)} FROM b WHERE actual IS NOT NULL AND {c.TEST_SQL}")
def figure_actual_forecast(spark, sf_dir):
    rows = c.on_test(learning.causal_baselines(c.view5(spark, sf_dir))).where("actual IS NOT NULL")
    return rows.select("bucket", "actual", *r(*c.FORECASTS))


@query(f"SELECT policy, under_provisioned_percent, reserve_activation_percent FROM ({c.ORACLE_SQL['capacity_metrics_test']}) x")
def figure_policy_outcomes(spark, sf_dir):
    return c.capacity_metrics_test(spark, sf_dir).select("policy", "under_provisioned_percent", "reserve_activation_percent")


@query(f"SELECT policy, reserve_activation_percent FROM ({c.ORACLE_SQL['capacity_metrics_test']}) x")
def figure_reserve_activation(spark, sf_dir):
    return c.capacity_metrics_test(spark, sf_dir).select("policy", "reserve_activation_percent")


@query(f"SELECT comparison || ' ' || metric AS label, observed_difference AS estimate, round(observed_difference - ci_low, 3) + 0.0 AS below, round(ci_high - observed_difference, 3) + 0.0 AS above FROM ({c.ORACLE_SQL['block_bootstrap_tests']}) x")
def figure_bootstrap_intervals(spark, sf_dir):
    d = F.col("observed_difference")
    return c.block_bootstrap_tests(spark, sf_dir).select(F.concat_ws(" ", "comparison", "metric").alias("label"), d.alias("estimate"), rounded(d - F.col("ci_low"), 3).alias("below"), rounded(F.col("ci_high") - d, 3).alias("above"))


# ---------------------------------------------------------------- the path through the learned models (no SQL)


def learned_rows(spark, sf_dir) -> DataFrame:
    """Policy rows of which forecast, risk and thresholds come from learned models.

    Boosted trees forecast the next five minutes with and without change-point
    features. Boosted trees score minutes, isotonic regression calibrates them,
    the controller follows the calibrated risk, and its minutes are joined to five.
    """
    view = c.view5(spark, sf_dir)
    alarms = settled(changepoint.change_points(view), "change-points")
    rows = settled(c.with_split(features.workload_features(view, alarms)), "workload-rows")

    def forecasts(name: str, change_points: bool) -> DataFrame:
        found = learning.forecast(rows, features.workload_feature_names(change_points), "gbt")
        return settled(found.select("bucket", F.col("forecast").alias(name)), name)

    def controls() -> DataFrame:
        scored = settled(c.scored_minutes(c._risk_rows(spark, sf_dir)), "scored-minutes")
        risk = settled(learning.isotonic(scored, "probability_of_failure", "failure"), "calibrated")
        five = control.to_five_minutes(control.adaptive_threshold(risk, c.calibration_rate(risk, "minute"), "minute", "calibrated"), probability="calibrated")
        return settled(five, "risk-five")

    parts = side_by_side(lambda: forecasts("hgb", False), lambda: forecasts("cp_hgb", True), controls)
    out = rows.where("target_next_5min IS NOT NULL").select("bucket", "split", F.col("target_next_5min").cast("double").alias("actual_workload"), F.col("total_tokens").cast("double").alias("persistence"))
    for part in parts:
        out = quality.joined_once(out, part, ["bucket"])
    out = quality.joined_once(out, alarms.select("bucket", "change_alarm"), ["bucket"], "left")
    return settled(out.withColumn("forecast_workload", F.col("cp_hgb")), "learned-rows")


@query()
def learned_policy_metrics(spark, sf_dir):
    """The four policies on the locked test split, on learned forecasts and calibrated learned risk."""
    rows = learned_rows(spark, sf_dir).where("split = 'test'")
    return control.capacity_metrics(control.long_policies(control.policies(rows)))


@query()
def learned_block_tests(spark, sf_dir):
    """The 14 tests on the locked test split with the learned forecasts in place of the baselines."""
    rows = learned_rows(spark, sf_dir).where("split = 'test'")
    return c.block_tests(c.test_differences(rows, ("hgb", "cp_hgb")))


@query()
def learned_forecast_control(spark, sf_dir):
    """Persistence and both learned forecasts under the adaptive reserve, with all paired tests."""
    rows = learned_rows(spark, sf_dir).where("split = 'test'")
    long = control.forecast_control(rows, ["persistence", "hgb", "cp_hgb"], 0.10, adaptive=True)
    pairs = inference.paired_differences(control_costs(long), "bucket", "policy", COMPARED)
    return inference.paired_tests(settled(pairs, "policy-pairs"))
