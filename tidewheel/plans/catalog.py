"""Queries over the driver tables and the SQL that states them, by name.

The event table is read as a request trace. Where a learned risk score is out of
reach of SQL, a surrogate stands in: twenty times the share of failures among
the hour before, at most 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import metrics
from tidewheel.functions.columns import rounded, surplus
from tidewheel.operators import boosting, changepoint, control, features, inference, learning, quality, timeview
from tidewheel.operators.selection import exact_quantiles
from tidewheel.operators.windows import Blocks
from tidewheel.sources.shared import settled, side_by_side
from tidewheel.sources.trace import EVENTS_AS_TRACE_SQL, events_as_trace

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TRAIN, CALIBRATION = 12384 / 17566, 14976 / 17566
#: Where the splits of a series end, as shares of its rows: five-minute buckets have no validation split, minutes have one.
BUCKET_SPLITS = (("train", TRAIN), ("calibration", CALIBRATION))
MINUTE_SPLITS = (("train", 0.694), ("validation", 0.694 + 0.074), ("calibration", 0.694 + 0.074 + 0.074))
FIXED = 0.9591
FORECASTS = ["persistence", "seasonal_naive", "moving_average"]


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r(*names: str) -> list:
    return [rounded(F.col(n)).alias(n) for n in names]


def r_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


# ---------------------------------------------------------------- frames and their SQL


def view5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five-minute view, written for all that a query makes of it; a query makes one and hands it on."""
    return settled(timeview.time_view(events_as_trace(spark, sf_dir), 300, trim=True), "view")


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeview.minute_aggregates(events_as_trace(spark, sf_dir))


def view_sql(width: int, name: str, trim: bool) -> str:
    counts = "request_count request_tokens response_tokens total_tokens zero_response_count gpt4_count".split()
    part = ", ".join(f"coalesce({c}, 0) AS {c}" for c in counts)
    share = "CASE WHEN coalesce(request_count, 0) > 0 THEN CAST({0}_count AS DOUBLE) / request_count ELSE 0.0 END AS {0}_share"
    return f"""{name}_a AS (
    SELECT ts_s // {width} AS bucket, count(*) AS request_count, CAST(sum(request_tokens) AS BIGINT) AS request_tokens,
           CAST(sum(response_tokens) AS BIGINT) AS response_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
           count(*) FILTER (response_tokens = 0) AS zero_response_count, count(*) FILTER (model = 'GPT-4') AS gpt4_count,
           count(*) FILTER (log_type = 'API log') AS api_count
    FROM trace GROUP BY 1),
{name} AS (
    SELECT bucket, bucket * {width} AS start_second, (bucket + 1) * {width} AS end_second_exclusive, {part},
           {share.format('gpt4')}, coalesce(api_count, 0) AS api_count, {share.format('api')}
    FROM (SELECT unnest(range((SELECT min(bucket) FROM {name}_a), (SELECT max(bucket) FROM {name}_a) + 1)) AS bucket) g LEFT JOIN {name}_a USING (bucket)
    {f"WHERE (bucket + 1) * {width} - 1 <= (SELECT max(ts_s) FROM trace)" if trim else ""})"""


MINUTES_SQL = """m_a AS (
    SELECT ts_s // 60 AS minute, count(*) AS request_count, CAST(sum(CASE WHEN response_tokens > 0 THEN response_tokens ELSE 0 END) AS BIGINT) AS completed_tokens,
           count(*) FILTER (lower(trim(model)) LIKE '%gpt-4%') AS g, count(*) FILTER (lower(trim(log_type)) LIKE '%api%') AS a,
           count(*) FILTER (response_tokens = 0) AS z
    FROM trace GROUP BY 1),
m AS (
    SELECT minute, coalesce(request_count, 0) AS request_count, coalesce(completed_tokens, 0) AS completed_tokens,
           CASE WHEN coalesce(request_count, 0) > 0 THEN CAST(g AS DOUBLE) / request_count ELSE 0.0 END AS gpt4_share,
           CASE WHEN coalesce(request_count, 0) > 0 THEN CAST(a AS DOUBLE) / request_count ELSE 0.0 END AS api_share,
           coalesce(z, 0) AS zero_response_count, CASE WHEN coalesce(z, 0) > 0 THEN 1 ELSE 0 END AS failure
    FROM (SELECT unnest(range((SELECT min(minute) FROM m_a), (SELECT max(minute) FROM m_a) + 1)) AS minute) g LEFT JOIN m_a USING (minute))"""

WITH_VIEW = f"WITH {EVENTS_AS_TRACE_SQL}, {view_sql(300, 'v', True)}"
WITH_MINUTES = f"WITH {EVENTS_AS_TRACE_SQL}, {MINUTES_SQL}"

# ---------------------------------------------------------------- views and profiles

VIEW_COLUMNS = "bucket start_second end_second_exclusive request_count request_tokens response_tokens total_tokens zero_response_count gpt4_count api_count".split()


@query(f"{WITH_VIEW} SELECT {', '.join(VIEW_COLUMNS)}, {r_sql('gpt4_share', 'api_share')} FROM v")
def time_view_5min(spark, sf_dir):
    return view5(spark, sf_dir).select(*VIEW_COLUMNS, *r("gpt4_share", "api_share"))


@query(f"WITH {EVENTS_AS_TRACE_SQL}, {view_sql(60, 'v', False)} SELECT {', '.join(VIEW_COLUMNS)}, {r_sql('gpt4_share', 'api_share')} FROM v")
def time_view_minute(spark, sf_dir):
    return timeview.time_view(events_as_trace(spark, sf_dir), 60).select(*VIEW_COLUMNS, *r("gpt4_share", "api_share"))


@query(f"""WITH {EVENTS_AS_TRACE_SQL}
SELECT count(*) AS rows, count(*) FILTER (ts_s IS NULL OR model IS NULL OR request_tokens IS NULL OR response_tokens IS NULL OR total_tokens IS NULL OR log_type IS NULL) AS rows_with_null,
       count(*) FILTER (request_tokens < 0 OR response_tokens < 0 OR total_tokens < 0) AS negative_rows,
       count(*) FILTER (total_tokens <> request_tokens + response_tokens) AS token_mismatch,
       count(*) FILTER (response_tokens = 0) AS zero_response_rows, min(ts_s) AS first_second, max(ts_s) AS last_second,
       CAST(sum(request_tokens) AS BIGINT) AS request_tokens, CAST(sum(response_tokens) AS BIGINT) AS response_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM trace""")
def raw_profile(spark, sf_dir):
    return quality.raw_profile(events_as_trace(spark, sf_dir))


@query("SELECT count(*) AS backward_steps FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS was FROM events) x WHERE ts < was")
def backward_steps(spark, sf_dir):
    return quality.backward_steps(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), "event_id", "ts")


@query("""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_duplicate_groups, count(*) AS duplicate_patterns
FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1) x""")
def duplicate_census(spark, sf_dir):
    return quality.duplicate_census(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id", "event_type"])


@query(f"WITH {EVENTS_AS_TRACE_SQL} SELECT 'model' AS \"column\", model AS value, count(*) AS n FROM trace GROUP BY model UNION ALL SELECT 'log_type', log_type, count(*) FROM trace GROUP BY log_type")
def category_counts(spark, sf_dir):
    return quality.category_counts(events_as_trace(spark, sf_dir), ["model", "log_type"])


@query(f"""{WITH_VIEW}
SELECT count(*) AS buckets, count(*) FILTER (least(request_count, request_tokens, response_tokens, total_tokens, zero_response_count, gpt4_count, api_count) < 0) AS negative,
       count(*) FILTER (total_tokens <> request_tokens + response_tokens) AS token_mismatch, count(*) FILTER (zero_response_count > request_count) AS too_many_zero_responses,
       count(*) FILTER (gpt4_share < 0 OR gpt4_share > 1 OR api_share < 0 OR api_share > 1) AS share_out_of_range,
       max(bucket) - min(bucket) + 1 - count(*) AS missing_buckets, count(*) - count(DISTINCT bucket) AS repeated_buckets
FROM v""")
def time_view_violations(spark, sf_dir):
    return timeview.view_violations(view5(spark, sf_dir))


# ---------------------------------------------------------------- features

MINUTE_COLUMNS = "minute request_count completed_tokens zero_response_count failure".split()


@query(f"{WITH_MINUTES} SELECT {', '.join(MINUTE_COLUMNS)}, {r_sql('gpt4_share', 'api_share')} FROM m")
def failure_minute_agg(spark, sf_dir):
    return minutes(spark, sf_dir).select(*MINUTE_COLUMNS, *r("gpt4_share", "api_share"))


def past_sql(f: str, y: str, n: int, order: str) -> str:
    frame = f"OVER (ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({y}) {frame} = {n} THEN {f}({y}) {frame} END"


def phase_sql(f: str, key: str, period: int) -> str:
    return f"round({f}(2 * pi() * ({key} % {period}) / {period}), 6) + 0.0"


LAG_SQL = ", ".join(f"lag(total_tokens, {k}) OVER (ORDER BY bucket) AS lag_{k}" for k in features.WORKLOAD_LAGS)
ROLL_SQL = ", ".join(
    [f"round({past_sql(f, 'total_tokens', n, 'bucket')}, 6) + 0.0 AS rolling_{name}_{n}" for name, f in (("mean", "avg"), ("std", "stddev_samp")) for n in features.ROLLING]
    + [f"{past_sql('max', 'total_tokens', n, 'bucket')} AS rolling_max_{n}" for n in features.ROLLING_MAX]
)
CALENDAR_SQL = f"{phase_sql('sin', 'bucket', 288)} AS daily_sin, {phase_sql('cos', 'bucket', 288)} AS daily_cos, {phase_sql('sin', 'bucket', 2016)} AS weekly_sin, {phase_sql('cos', 'bucket', 2016)} AS weekly_cos"
LAGS = [f"lag_{k}" for k in features.WORKLOAD_LAGS]
ROLLS = [f"rolling_{k}_{n}" for k in ("mean", "std") for n in features.ROLLING]
MAXES = [f"rolling_max_{n}" for n in features.ROLLING_MAX]
CALENDAR = ["daily_sin", "daily_cos", "weekly_sin", "weekly_cos"]


@query(f"{WITH_VIEW} SELECT bucket, {LAG_SQL}, lead(total_tokens) OVER (ORDER BY bucket) AS target_next_5min FROM v")
def workload_lags(spark, sf_dir):
    return features.workload_features(view5(spark, sf_dir)).select("bucket", *LAGS, "target_next_5min")


@query(f"{WITH_VIEW} SELECT bucket, {ROLL_SQL} FROM v")
def workload_rolling(spark, sf_dir):
    return features.workload_features(view5(spark, sf_dir)).select("bucket", *r(*ROLLS), *MAXES)


@query(f"{WITH_VIEW} SELECT bucket, {CALENDAR_SQL} FROM v")
def calendar_features(spark, sf_dir):
    return features.workload_features(view5(spark, sf_dir)).select("bucket", *r(*CALENDAR))


SCORE_SQL = """z AS (SELECT bucket, bucket - min(bucket) OVER () AS position, ln(1.0 + total_tokens) AS z FROM v),
q AS (SELECT bucket, position, avg(z) OVER (ORDER BY bucket ROWS BETWEEN {s1} PRECEDING AND CURRENT ROW) AS sm,
             quantile_cont(z, 0.25) OVER w AS q25, quantile_cont(z, 0.5) OVER w AS q50, quantile_cont(z, 0.75) OVER w AS q75
      FROM z WINDOW w AS (ORDER BY bucket ROWS BETWEEN {far} PRECEDING AND {s} PRECEDING)),
sc AS (SELECT bucket, position, CASE WHEN position >= {far} THEN sm END AS short_level_log, CASE WHEN position >= {far} THEN q50 END AS long_level_log,
              CASE WHEN position >= {far} THEN (q75 - q25) / 1.349 END AS robust_scale, CASE WHEN position >= {far} THEN abs(sm - q50) END AS absolute_log_shift,
              CASE WHEN position >= {far} THEN exp(sm - q50) END AS short_long_ratio,
              CASE WHEN position >= {far} THEN CASE WHEN q75 > q25 THEN abs(sm - q50) / ((q75 - q25) / 1.349) WHEN abs(sm - q50) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END END AS change_score
       FROM q),
th AS (SELECT quantile_cont(change_score, 0.95) AS threshold FROM sc WHERE position < (SELECT floor((max(position) + 1) * (12384 / 17566)) FROM sc) AND change_score IS NOT NULL AND NOT isinf(change_score))"""
SCORES = SCORE_SQL.format(s1=11, s=12, far=287)
CHANGE = ["short_level_log", "long_level_log", "robust_scale", "absolute_log_shift", "change_score", "short_long_ratio"]
ALARM_SQL = """hot AS (SELECT position FROM sc, th WHERE change_score >= threshold AND absolute_log_shift >= 0.1),
al AS (SELECT min(position) AS p FROM hot UNION ALL SELECT (SELECT min(position) FROM hot WHERE position >= al.p + 288) FROM al WHERE al.p IS NOT NULL),
alarms AS (SELECT p AS position FROM al WHERE p IS NOT NULL),
cp AS (SELECT sc.*, CASE WHEN a.position IS NULL THEN 0 ELSE 1 END AS change_alarm,
              CASE WHEN change_score IS NOT NULL THEN sc.position - coalesce(max(a.position) OVER (ORDER BY sc.position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000000) END AS elapsed_since_alarm
       FROM sc LEFT JOIN alarms a ON a.position = sc.position)"""
WITH_CP = f"{WITH_VIEW.replace('WITH ', 'WITH RECURSIVE ', 1)}, {SCORES}, {ALARM_SQL}"


@query(f"{WITH_VIEW}, {SCORES} SELECT bucket, position, {r_sql(*CHANGE)} FROM sc")
def change_scores(spark, sf_dir):
    return changepoint.change_scores(view5(spark, sf_dir)).select("bucket", "position", *r(*CHANGE))


@query(f"{WITH_VIEW}, {SCORES} SELECT {r_sql('threshold')} FROM th")
def change_threshold(spark, sf_dir):
    return changepoint.training_threshold(changepoint.change_scores(view5(spark, sf_dir))).select(*r("threshold"))


@query(f"{WITH_CP} SELECT bucket, change_alarm, elapsed_since_alarm FROM cp")
def change_alarms(spark, sf_dir):
    return changepoint.change_points(view5(spark, sf_dir)).select("bucket", "change_alarm", "elapsed_since_alarm")


@query(f"{WITH_CP} SELECT count(*) AS alarms, min(step) AS least_step, count(*) FILTER (step < 288) AS too_close FROM (SELECT position - lag(position) OVER (ORDER BY position) AS step FROM alarms) x")
def alarm_spacing(spark, sf_dir):
    return quality.alarm_spacing(changepoint.change_points(view5(spark, sf_dir)), 288)


@query(f"""{WITH_CP}
SELECT v.bucket, {LAG_SQL.replace('lag(total', 'lag(v.total').replace('ORDER BY bucket', 'ORDER BY v.bucket')}, {ROLL_SQL.replace('total_tokens', 'v.total_tokens').replace('ORDER BY bucket', 'ORDER BY v.bucket')},
       {CALENDAR_SQL.replace('bucket', 'v.bucket')}, lead(v.total_tokens) OVER (ORDER BY v.bucket) AS target_next_5min, v.total_tokens,
       lag(v.total_tokens, 288) OVER (ORDER BY v.bucket) IS NOT NULL AS has_full_history,
       round(change_score, 6) + 0.0 AS cp_change_score, change_alarm AS cp_change_alarm, round(short_long_ratio, 6) + 0.0 AS cp_short_long_ratio, elapsed_since_alarm AS cp_elapsed_bins
FROM v JOIN cp ON cp.bucket = v.bucket""")
def workload_features(spark, sf_dir):
    view = view5(spark, sf_dir)
    out = features.workload_features(view, changepoint.change_points(view))
    plain = ["bucket", *LAGS, *MAXES, "target_next_5min", "total_tokens", "has_full_history", "cp_change_alarm", "cp_elapsed_bins"]
    return out.select(*plain, *r(*ROLLS, *CALENDAR, "cp_change_score", "cp_short_long_ratio"))


@query(f"""{WITH_VIEW}, f AS (SELECT bucket, {LAG_SQL}, lead(total_tokens) OVER (ORDER BY bucket) AS target_next_5min FROM v)
SELECT count(*) AS rows, count(*) FILTER ({" OR ".join(f"lag_{k} IS DISTINCT FROM (SELECT total_tokens FROM v WHERE v.bucket = f.bucket - {k})" for k in features.WORKLOAD_LAGS)}) AS wrong_lag,
       count(*) FILTER (target_next_5min IS DISTINCT FROM (SELECT total_tokens FROM v WHERE v.bucket = f.bucket + 1)) AS wrong_target FROM f""")
def feature_causality(spark, sf_dir):
    view = view5(spark, sf_dir)
    return quality.causality_violations(features.workload_features(view), view, lags=features.WORKLOAD_LAGS)


FAILURE_SQL = ", ".join(
    sum(
        (
            [f"round(CAST(lag({s}, {k}) OVER (ORDER BY minute) AS DOUBLE), 6) + 0.0 AS {s}_lag_{k}" for k in features.FAILURE_LAGS]
            + [f"round(CAST({past_sql(f, s, n, 'minute')} AS DOUBLE) + 1e-9, 6) AS {s}_{name}_{n}" for n in features.FAILURE_WINDOWS for name, f in (("sum", "sum"), ("mean", "avg"))]
            for s in features.FAILURE_SERIES
        ),
        [],
    )
    + [f"{phase_sql(f, 'minute', p)} AS {n}_{f}" for n, p in (("minute", 1440), ("week", 10080)) for f in ("sin", "cos")]
)


@query(f"{WITH_MINUTES} SELECT minute, failure, {FAILURE_SQL} FROM m")
def failure_features(spark, sf_dir):
    names = features.failure_feature_names()
    # sums of shares end on a half of the last digit now and then; the nudge lets both engines round it alike
    nudge = {n: 1e-9 if "_sum_" in n or "_mean_" in n else 0.0 for n in names}
    return features.failure_features(minutes(spark, sf_dir)).select("minute", "failure", *(rounded(F.col(n).cast("double") + nudge[n]).alias(n) for n in names))


# ---------------------------------------------------------------- baselines and metrics

BASE_SQL = """b AS (SELECT bucket, lead(total_tokens) OVER (ORDER BY bucket) AS actual, CAST(total_tokens AS DOUBLE) AS persistence,
           CAST(lag(total_tokens, 287) OVER (ORDER BY bucket) AS DOUBLE) AS seasonal_naive,
           CASE WHEN count(*) OVER (ORDER BY bucket ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) = 12 THEN avg(total_tokens) OVER (ORDER BY bucket ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END AS moving_average FROM v),
span AS (SELECT min(bucket) AS lo, max(bucket) - min(bucket) + 1 AS n FROM v)"""
TEST_SQL = "bucket >= (SELECT lo + floor(n * (14976 / 17566)) FROM span)"


def with_split(df: DataFrame, key: str = "bucket") -> DataFrame:
    """The chronological split by the key's place in its span; the span is one row. Minutes are split in four, buckets in three."""
    span = df.agg(F.min(key).alias("_lo"), (F.max(key) - F.min(key) + 1).alias("_n"))
    place, split = F.col(key) - F.col("_lo"), F.lit("test")
    for name, end in reversed(MINUTE_SPLITS if key == "minute" else BUCKET_SPLITS):
        split = F.when(place < F.floor(F.col("_n") * end), name).otherwise(split)
    return df.crossJoin(F.broadcast(span)).withColumn("split", split).drop("_lo", "_n")


def minute_split_sql(place: str, n: str) -> str:
    return "CASE " + " ".join(f"WHEN {place} < floor({n} * CAST({end!r} AS DOUBLE)) THEN '{name}'" for name, end in MINUTE_SPLITS) + " ELSE 'test' END"


@query(f"{WITH_VIEW}, {BASE_SQL} SELECT bucket, actual, {r_sql(*FORECASTS)} FROM b")
def baseline_forecasts(spark, sf_dir):
    return learning.causal_baselines(view5(spark, sf_dir)).select("bucket", "actual", *r(*FORECASTS))


@query(f"""{WITH_VIEW}, {BASE_SQL}, f AS (SELECT * FROM (SELECT bucket, CAST(actual AS DOUBLE) AS a, persistence, seasonal_naive, moving_average FROM b WHERE actual IS NOT NULL AND {TEST_SQL})
     UNPIVOT (p FOR forecast IN (persistence, seasonal_naive, moving_average)))
SELECT forecast, count(*) AS n, round(avg(abs(p - a)), 6) + 0.0 AS mae, round(sqrt(avg((p - a) * (p - a))), 6) + 0.0 AS rmse, round(100 * sum(abs(p - a)) / sum(abs(a)), 6) + 0.0 AS wape_percent,
       round(100 * avg(CASE WHEN abs(a) + abs(p) > 0 THEN 2 * abs(p - a) / (abs(a) + abs(p)) END), 6) + 0.0 AS smape_percent, round(avg(p - a), 6) + 0.0 AS mean_bias
FROM f GROUP BY forecast""")
def forecast_metrics(spark, sf_dir):
    rows = with_split(learning.causal_baselines(view5(spark, sf_dir))).where("split = 'test' AND actual IS NOT NULL")
    long = rows.unpivot(["actual"], FORECASTS, "forecast", "p").where("p IS NOT NULL")
    return long.groupBy("forecast").agg(*metrics.forecast_errors(F.col("actual").cast("double"), F.col("p")))


RISK_SQL = """k AS (SELECT minute, failure, CASE WHEN count(*) OVER h = 60 THEN least(1.0, 20 * avg(failure) OVER h) END AS risk FROM m WINDOW h AS (ORDER BY minute ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
kr AS (SELECT * FROM k WHERE risk IS NOT NULL)"""


def surrogate_risk(m: DataFrame, key: str = "minute") -> DataFrame:
    b = Blocks(m, key, 60)
    share = b.past(F.avg("failure"), "failure", 60)
    return b.result(key, "failure", F.when(share.isNotNull(), F.least(F.lit(1.0), 20 * share)).alias("risk")).where("risk IS NOT NULL")


@query(f"""{WITH_MINUTES}, {RISK_SQL}, c AS (SELECT failure AS y, CAST(risk AS DOUBLE) AS p, greatest(1e-7, least(1 - 1e-7, risk)) AS q FROM kr),
t AS (SELECT count(*) FILTER (p > 0.9591 AND y = 1) AS tp, count(*) FILTER (p > 0.9591 AND y = 0) AS fp, count(*) FILTER (p <= 0.9591 AND y = 1) AS fn FROM c)
SELECT (SELECT count(*) FROM c) AS n, (SELECT round(avg(y), 6) + 0.0 FROM c) AS prevalence, (SELECT round(avg((p - y) * (p - y)), 6) + 0.0 FROM c) AS brier,
       (SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) + 0.0 FROM c) AS log_loss,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) + 0.0 AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) + 0.0 AS recall,
       round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) + 0.0 AS f1 FROM t""")
def risk_metrics(spark, sf_dir):
    return metrics.risk_metrics(surrogate_risk(minutes(spark, sf_dir)), "risk", "failure", FIXED)


@query(f"""{WITH_MINUTES}, {RISK_SQL}, g AS (SELECT risk AS s, count(*) AS n, sum(failure) AS pos FROM kr GROUP BY risk),
w AS (SELECT pos, n - pos AS neg, pos * (coalesce(sum(n - pos) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n - pos) / 2) AS won FROM g)
SELECT round(sum(won) / (sum(pos) * sum(neg)), 6) + 0.0 AS roc_auc FROM w""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(surrogate_risk(minutes(spark, sf_dir)), "risk", "failure")


@query(f"""{WITH_MINUTES}, {RISK_SQL}, g AS (SELECT risk AS s, count(*) AS n, sum(failure) AS pos FROM kr GROUP BY risk),
w AS (SELECT pos, sum(pos) OVER o / sum(n) OVER o AS pr FROM g WINDOW o AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(sum(pr * pos) / sum(pos), 6) + 0.0 AS average_precision FROM w""")
def average_precision(spark, sf_dir):
    return metrics.average_precision(surrogate_risk(minutes(spark, sf_dir)), "risk", "failure")


ECE_BIN_SQL = "1 + " + " + ".join(f"CAST(risk >= CAST({e} AS DOUBLE) AS INTEGER)" for e in metrics.EDGES)


@query(f"{WITH_MINUTES}, {RISK_SQL} SELECT {ECE_BIN_SQL} AS bin, count(*) AS n, round(avg(risk), 6) + 0.0 AS confidence, round(avg(failure), 6) + 0.0 AS accuracy FROM kr GROUP BY 1")
def ece_bins(spark, sf_dir):
    return metrics.ece_bins(surrogate_risk(minutes(spark, sf_dir)), "risk", "failure")


@query(f"{WITH_MINUTES}, {RISK_SQL}, e AS (SELECT count(*) AS n, abs(avg(risk) - avg(failure)) AS gap FROM kr GROUP BY {ECE_BIN_SQL}) SELECT round(sum(n * gap) / sum(n), 6) + 0.0 AS ece FROM e")
def expected_calibration_error(spark, sf_dir):
    risk = surrogate_risk(minutes(spark, sf_dir))
    number = F.lit(1)
    for edge in metrics.EDGES:
        number = number + (F.col("risk") >= edge).cast("int")
    bins = risk.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("risk") - F.avg("failure")).alias("gap"))
    return bins.agg(rounded(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


# ---------------------------------------------------------------- controller and policies

FIVE_SQL = """v5 AS (SELECT bucket, CASE WHEN zero_response_count > 0 THEN 1 ELSE 0 END AS failure FROM v),
k5 AS (SELECT bucket, failure, CASE WHEN count(*) OVER h = 60 THEN least(1.0, 2.5 * avg(failure) OVER h) END AS risk FROM v5 WINDOW h AS (ORDER BY bucket ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
r5 AS (SELECT row_number() OVER (ORDER BY bucket) AS i, bucket, failure, CAST(risk AS DOUBLE) AS risk FROM k5 WHERE risk IS NOT NULL),
span5 AS (SELECT min(bucket) AS lo, max(bucket) - min(bucket) + 1 AS n FROM r5),
tgt AS (SELECT avg(failure) AS target FROM r5, span5 WHERE bucket - lo >= floor(n * (12384 / 17566)) AND bucket - lo < floor(n * (14976 / 17566))),
d5 AS (SELECT i, bucket, failure, risk, CASE WHEN count(*) OVER h < 60 THEN 0 WHEN avg(failure) OVER h > target THEN -1 WHEN avg(failure) OVER h < target THEN 1 ELSE 0 END AS s
       FROM r5, tgt WINDOW h AS (ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
th5 AS (SELECT CAST(1 AS BIGINT) AS i, CAST(0.9591 AS DOUBLE) AS before
        UNION ALL SELECT th5.i + 1, CASE s WHEN 0 THEN before ELSE greatest(CAST(0.5 AS DOUBLE), least(CAST(0.99 AS DOUBLE), CASE s WHEN 1 THEN before + CAST(0.01 AS DOUBLE) ELSE before - CAST(0.01 AS DOUBLE) END)) END FROM th5 JOIN d5 ON d5.i = th5.i),
ctl AS (SELECT d5.bucket, d5.failure, d5.risk, th5.before, CASE WHEN d5.risk > th5.before THEN 1 ELSE 0 END AS trig FROM d5 JOIN th5 ON th5.i = d5.i)"""
WITH_CTL = f"{WITH_CP}, {FIVE_SQL}"


def calibration_rate(risk: DataFrame, key: str) -> float:
    """The failure rate of the calibration split, which the controller aims at."""
    return with_split(risk, key).where("split = 'calibration'").agg(F.avg("failure")).first()[0]


def controlled(view: DataFrame) -> DataFrame:
    """The controller over five-minute failures; its target is their rate in the calibration split."""
    rows = view.select("bucket", (F.col("zero_response_count") > 0).cast("int").alias("failure"))
    b = Blocks(rows, "bucket", 60)
    share = b.past(F.avg("failure"), "failure", 60)
    risk = b.result("bucket", "failure", F.when(share.isNotNull(), F.least(F.lit(1.0), 2.5 * share)).alias("risk")).where("risk IS NOT NULL")
    return control.adaptive_threshold(risk, calibration_rate(risk, "bucket"), "bucket")


@query(f"{WITH_CTL} SELECT bucket, failure, round(risk, 6) + 0.0 AS risk, round(before, 6) + 0.0 AS threshold_before_update, trig AS reserve_trigger FROM ctl")
def adaptive_threshold(spark, sf_dir):
    return controlled(view5(spark, sf_dir)).select("bucket", "failure", *r("risk", "threshold_before_update"), "reserve_trigger")


@query()
def adaptive_threshold_minute(spark, sf_dir):
    risk = surrogate_risk(minutes(spark, sf_dir))
    return control.adaptive_threshold(risk, calibration_rate(risk, "minute"), "minute")


@query(f"""{WITH_MINUTES}, {RISK_SQL} SELECT minute // 5 AS bucket, round(max(risk), 6) + 0.0 AS risk_signal, round(arg_min(risk, minute), 6) + 0.0 AS adaptive_threshold FROM kr GROUP BY 1""")
def risk_5min(spark, sf_dir):
    return control.to_five_minutes(surrogate_risk(minutes(spark, sf_dir)), threshold="risk").select("bucket", *r("risk_signal", "adaptive_threshold"))


POLICY_SQL = f"""{BASE_SQL},
pr AS (SELECT b.bucket, CAST(b.actual AS DOUBLE) AS actual_workload, b.persistence, b.seasonal_naive, b.moving_average, b.moving_average AS forecast_workload, ctl.risk AS risk_signal, ctl.before AS adaptive_threshold, coalesce(cp.change_alarm, 0) AS change_alarm
       FROM b JOIN ctl ON ctl.bucket = b.bucket LEFT JOIN cp ON cp.bucket = b.bucket WHERE b.actual IS NOT NULL AND b.moving_average IS NOT NULL AND b.seasonal_naive IS NOT NULL),
pt AS (SELECT *, 0 AS t1, CASE WHEN risk_signal > 0.9591 THEN 1 ELSE 0 END AS t2, CASE WHEN risk_signal > adaptive_threshold THEN 1 ELSE 0 END AS t3,
              CASE WHEN risk_signal > CASE WHEN change_alarm = 1 THEN CAST(0.9591 AS DOUBLE) ELSE adaptive_threshold END THEN 1 ELSE 0 END AS t4 FROM pr),
lp AS (SELECT bucket, actual_workload, 'V' || k AS policy, t AS trigger, CASE WHEN t = 1 THEN forecast_workload * CAST(1.1 AS DOUBLE) ELSE forecast_workload END AS capacity
       FROM (SELECT *, unnest([1, 2, 3, 4]) AS k, unnest([t1, t2, t3, t4]) AS t FROM pt))"""


def policy_rows(view: DataFrame) -> DataFrame:
    """Forecasts, risk, thresholds and alarms of each bucket of a view."""
    base = learning.causal_baselines(view).where("actual IS NOT NULL AND moving_average IS NOT NULL AND seasonal_naive IS NOT NULL")
    risk = controlled(view).select("bucket", F.col("risk").alias("risk_signal"), F.col("threshold_before_update").alias("adaptive_threshold"))
    alarms = changepoint.change_points(view).select("bucket", "change_alarm")
    # every forecast must have its threshold; an alarm may be missing
    rows = quality.finite(quality.joined_once(base, risk, ["bucket"], "left"), ["risk_signal", "adaptive_threshold"], "policies")
    rows = settled(quality.joined_once(rows, alarms, ["bucket"], "left"), "policy-rows")
    return rows.withColumns({"actual_workload": F.col("actual").cast("double"), "forecast_workload": F.col("moving_average")})


def _policy_query(name: str):
    sql = f"{WITH_CTL}, {POLICY_SQL} SELECT bucket, trigger, round(capacity, 6) + 0.0 AS capacity FROM lp WHERE policy = '{name}'"

    def run(spark, sf_dir):
        return control.policies(policy_rows(view5(spark, sf_dir))).select("bucket", F.col(f"{name}_trigger").alias("trigger"), rounded(F.col(f"{name}_capacity")).alias("capacity"))

    QUERIES[f"policy_{name.lower()}"] = run
    ORACLE_SQL[f"policy_{name.lower()}"] = sql


for _name in ("V1", "V2", "V3", "V4"):
    _policy_query(_name)

CAPACITY_SQL = """, ls AS (SELECT policy, actual_workload, capacity, trigger, greatest(actual_workload - capacity, 0.0) AS shortage, greatest(capacity - actual_workload, 0.0) AS unused FROM lp),
lq AS (SELECT policy, quantile_cont(shortage, 0.95) AS p95 FROM ls GROUP BY policy)
SELECT policy, count(*) AS n, round(avg(CASE WHEN shortage > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) + 0.0 AS under_provisioned_percent, round(avg(shortage), 6) + 0.0 AS mean_shortage,
       round(any_value(p95), 6) + 0.0 AS p95_shortage, round(avg(CASE WHEN shortage >= p95 THEN shortage END), 6) + 0.0 AS shortfall_cvar95, round(avg(unused), 6) + 0.0 AS mean_unused_capacity,
       round(avg(capacity), 6) + 0.0 AS mean_provisioned_capacity, round(avg(actual_workload), 6) + 0.0 AS mean_actual_workload, round(sum(shortage), 3) + 0.0 AS total_shortage, round(sum(unused), 3) + 0.0 AS total_unused_capacity, round(avg(trigger) * 100, 6) + 0.0 AS reserve_activation_percent, round(sum(capacity) / sum(actual_workload), 6) + 0.0 AS cost_index
FROM ls JOIN lq USING (policy) GROUP BY policy"""


@query(f"{WITH_CTL}, {POLICY_SQL}{CAPACITY_SQL}")
def capacity_metrics(spark, sf_dir):
    return control.capacity_metrics(control.long_policies(control.policies(policy_rows(view5(spark, sf_dir)))))


def on_test(rows: DataFrame) -> DataFrame:
    """The locked test split."""
    return with_split(rows).where("lower(trim(split)) = 'test'")


PR_SPAN_SQL = "(SELECT min(bucket) + floor((max(bucket) - min(bucket) + 1) * (14976 / 17566)) FROM pr)"


@query(f"{WITH_CTL}, {POLICY_SQL}{CAPACITY_SQL}".replace("AS unused FROM lp)", f"AS unused FROM lp WHERE bucket >= {PR_SPAN_SQL})"))
def capacity_metrics_test(spark, sf_dir):
    return control.capacity_metrics(control.long_policies(control.policies(on_test(policy_rows(view5(spark, sf_dir))))))


def forecast_sql(trigger: str, reserve: float) -> str:
    part = " UNION ALL ".join(f"SELECT bucket, actual_workload, '{f}' AS policy, {trigger} AS trigger, CASE WHEN {trigger} = 1 THEN {f} * CAST({reserve} AS DOUBLE) ELSE {f} END AS capacity FROM pr" for f in FORECASTS)
    return f"{WITH_CTL}, {POLICY_SQL.rsplit('lp AS', 1)[0]}lp AS ({part}){CAPACITY_SQL}"


@query(forecast_sql("1", 1.10))
def fixed_reserve_control(spark, sf_dir):
    return control.capacity_metrics(control.forecast_control(policy_rows(view5(spark, sf_dir)), FORECASTS, 1.10, adaptive=False))


@query(forecast_sql("CASE WHEN risk_signal > adaptive_threshold THEN 1 ELSE 0 END", 0.10))
def adaptive_control_by_forecast(spark, sf_dir):
    """With the multiplier 0.10 that published results were made with; 1.10 would add a reserve instead."""
    return control.capacity_metrics(control.forecast_control(policy_rows(view5(spark, sf_dir)), FORECASTS, 0.10, adaptive=True))


# ---------------------------------------------------------------- inference

PAIR_SQL = f"""{WITH_CTL}, {POLICY_SQL},
pd AS (SELECT row_number() OVER (ORDER BY bucket) AS i, greatest(actual_workload - moving_average, 0.0) - greatest(actual_workload - persistence, 0.0) AS d FROM pr)"""


def shortage_pairs(spark, sf_dir) -> DataFrame:
    rows = policy_rows(view5(spark, sf_dir))

    def short(f: str):
        return F.greatest(F.col("actual_workload") - F.col(f), F.lit(0.0))

    return rows.select("bucket", (short("moving_average") - short("persistence")).alias("d"))


@query("""WITH t AS (SELECT event_type AS family, CAST(user_id % 10 AS BIGINT) AS test, least(1.0, count(*) / 1000.0) AS p FROM events GROUP BY 1, 2),
h AS (SELECT family, test, p, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p AS raw, row_number() OVER (PARTITION BY family ORDER BY p, test) AS k FROM t)
SELECT family, test, round(p, 6) + 0.0 AS p, round(least(1.0, max(raw) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0 AS p_holm FROM h""")
def holm(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tests = events.groupBy(F.col("event_type").alias("family"), (F.col("user_id") % 10).alias("test")).agg(F.least(F.lit(1.0), F.count("*") / 1000.0).alias("p"))
    return inference.holm(tests, "p", ["family"]).select("family", "test", *r("p", "p_holm"))


BLOCK_SQL = f"""{PAIR_SQL}, n AS (SELECT count(*) AS n FROM pd), c AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS c UNION ALL SELECT i, sum(d) OVER (ORDER BY i) FROM pd),
st AS (SELECT rep AS replicate, k, ((((rep * nb + k + 1) * 48271 % 2147483648) * 1103515245 + 12345) % 2147483648) % (n - 288 + 1) AS lo, n, nb
       FROM (SELECT unnest(range(2000)) AS rep), (SELECT n, CAST(ceil(n / 288) AS BIGINT) AS nb FROM n), LATERAL (SELECT unnest(range(nb)) AS k)),
bb AS (SELECT replicate, sum(h.c - l.c) / any_value(n) AS mean FROM st JOIN c l ON l.i = lo JOIN c h ON h.i = lo + least(288, n - k * 288) GROUP BY replicate)"""


@query(f"{BLOCK_SQL} SELECT replicate, round(mean, 6) + 0.0 AS mean FROM bb")
def block_bootstrap(spark, sf_dir):
    return inference.block_bootstrap(shortage_pairs(spark, sf_dir), "bucket", "d").select("replicate", *r("mean"))


@query(f"""{BLOCK_SQL} SELECT round(quantile_cont(mean, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(mean, 0.975), 6) + 0.0 AS ci_high,
round(least(1.0, 2 * least(avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END))), 6) + 0.0 AS p_value FROM bb""")
def block_bootstrap_summary(spark, sf_dir):
    return inference.bootstrap_summary(inference.block_bootstrap(shortage_pairs(spark, sf_dir), "bucket", "d"))


TESTS_SQL = f"""{WITH_CTL}, {POLICY_SQL},
wide AS (SELECT bucket, policy, greatest(actual_workload - capacity, 0.0) AS shortage, greatest(capacity - actual_workload, 0.0) AS unused, capacity, CAST(trigger AS DOUBLE) AS trigger FROM lp WHERE bucket >= {PR_SPAN_SQL}),
td AS (SELECT bucket, a.policy || ' - ' || b.policy AS comparison, unnest(['Mean_Shortage', 'Mean_Unused_Capacity', 'Mean_Provisioned_Capacity', 'Reserve_Activation']) AS metric,
              unnest([a.shortage - b.shortage, a.unused - b.unused, a.capacity - b.capacity, a.trigger - b.trigger]) AS d
       FROM wide a JOIN wide b USING (bucket) WHERE (a.policy, b.policy) IN (('V1', 'V2'), ('V2', 'V3'), ('V3', 'V4'))
       UNION ALL
       SELECT bucket, 'persistence - moving_average', unnest(['MAE', 'Squared_Error']),
              unnest([abs(actual_workload - persistence) - abs(actual_workload - moving_average), (actual_workload - persistence) ** 2 - (actual_workload - moving_average) ** 2]) FROM pr WHERE bucket >= {PR_SPAN_SQL}),
ti AS (SELECT comparison, metric, d, row_number() OVER (PARTITION BY comparison, metric ORDER BY bucket) AS i FROM td),
tn AS (SELECT comparison, metric, count(*) AS n, least(288, count(*)) AS size, CAST(ceil(count(*) / least(288, count(*))) AS BIGINT) AS nb, avg(d) AS observed FROM td GROUP BY ALL),
tc AS (SELECT comparison, metric, 0 AS i, CAST(0 AS DOUBLE) AS c FROM tn UNION ALL SELECT comparison, metric, i, sum(d) OVER (PARTITION BY comparison, metric ORDER BY i) FROM ti),
ts AS (SELECT comparison, metric, rep, n, size, k, ((((rep * nb + k + 1) * 48271 % 2147483648) * 1103515245 + 12345) % 2147483648) % (n - size + 1) AS lo
       FROM (SELECT unnest(range(2000)) AS rep), tn, LATERAL (SELECT unnest(range(nb)) AS k)),
tb AS (SELECT comparison, metric, rep, sum(h.c - l.c) / any_value(n) AS mean FROM ts JOIN tc l USING (comparison, metric) JOIN tc h USING (comparison, metric) WHERE l.i = lo AND h.i = lo + least(size, n - k * size) GROUP BY ALL),
tp AS (SELECT comparison, metric, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high,
              round(least(1.0, 2 * least(avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END))), 6) AS p_value FROM tb GROUP BY ALL),
tk AS (SELECT *, row_number() OVER (ORDER BY p_value, comparison, metric) AS k, count(*) OVER () AS m FROM tp),
hol AS (SELECT *, least(1.0, max((m - k + 1) * p_value) OVER (ORDER BY k)) AS p_holm FROM tk)"""


def test_differences(rows: DataFrame, forecasts: tuple[str, str], policies=("V1", "V2", "V3", "V4")) -> DataFrame:
    """comparison, metric, bucket, d: four differences of each policy and the next, and two errors of the two forecasts."""
    held = settled(control.policies(rows), "policies")

    def gap(a: str, b: str):
        return surplus(F.col(a), F.col(b))

    parts = []
    for a, b in zip(policies, policies[1:], strict=False):
        x, y, w = f"{a}_capacity", f"{b}_capacity", "actual_workload"
        each = {
            "Mean_Shortage": gap(w, x) - gap(w, y),
            "Mean_Unused_Capacity": gap(x, w) - gap(y, w),
            "Mean_Provisioned_Capacity": F.col(x) - F.col(y),
            "Reserve_Activation": F.col(f"{a}_trigger").cast("double") - F.col(f"{b}_trigger"),
        }
        parts += [(f"{a} - {b}", m, d) for m, d in each.items()]
    e = [F.col("actual_workload") - F.col(f) for f in forecasts]
    parts += [(f"{forecasts[0]} - {forecasts[1]}", "MAE", F.abs(e[0]) - F.abs(e[1])), (f"{forecasts[0]} - {forecasts[1]}", "Squared_Error", e[0] * e[0] - e[1] * e[1])]
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("comparison"), F.lit(m).alias("metric"), d.cast("double").alias("d")) for c, m, d in parts))).alias("p")
    return held.select("bucket", rows).select("p.comparison", "p.metric", "bucket", "p.d")


test_differences.__test__ = False  # not a test of this library


def block_tests(differences: DataFrame) -> DataFrame:
    """Observed difference, interval, p and Holm's p over all tests as one family."""
    held, by = settled(differences, "differences"), ["comparison", "metric"]
    means = inference.block_bootstraps(held, by, "bucket", "d")
    found = inference.bootstrap_summary(means, by=by)
    plain = held.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("observed_difference"))
    return inference.holm(plain.join(found, by), "p_value").withColumn("significant", F.col("p_holm") < 0.05)


@query(f"{TESTS_SQL} SELECT comparison, metric, n, round(observed, 3) + 0.0 AS observed_difference, round(ci_low, 3) + 0.0 AS ci_low, round(ci_high, 3) + 0.0 AS ci_high, p_value + 0.0 AS p_value, round(p_holm, 6) + 0.0 AS p_holm, p_holm < 0.05 AS significant FROM hol JOIN tn USING (comparison, metric)")
def block_bootstrap_tests(spark, sf_dir):
    """The 14 tests on the locked test split, with Holm's adjustment over all of them."""
    found = block_tests(test_differences(on_test(policy_rows(view5(spark, sf_dir))), ("persistence", "moving_average")))
    return found.select("comparison", "metric", "n", *(rounded(F.col(c), 3).alias(c) for c in ("observed_difference", "ci_low", "ci_high")), *r("p_value", "p_holm"), "significant")


@query(f"""{PAIR_SQL}, w AS (SELECT abs(d) AS a, count(*) AS n, count(*) FILTER (d > 0) AS up FROM pd WHERE d <> 0 GROUP BY 1),
rk AS (SELECT n, up, coalesce(sum(n) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM w)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(up * rank), 3) + 0.0 AS w_plus, round(sum((n - up) * rank), 3) + 0.0 AS w_minus, round(least(sum(up * rank), sum((n - up) * rank)), 3) + 0.0 AS statistic FROM rk""")
def wilcoxon_stat(spark, sf_dir):
    return inference.wilcoxon(shortage_pairs(spark, sf_dir), "d").select("n", *(rounded(F.col(c), 3).alias(c) for c in ("w_plus", "w_minus", "statistic")))


@query(f"""{PAIR_SQL}, w AS (SELECT abs(d) AS a, count(*) AS n, count(*) FILTER (d > 0) AS up FROM pd WHERE d <> 0 GROUP BY 1),
rk AS (SELECT n, up, coalesce(sum(n) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM w),
sm AS (SELECT CAST(sum(n) AS DOUBLE) AS n, least(sum(up * rank), sum((n - up) * rank)) AS w, sum(CAST(n AS DOUBLE) ** 3 - n) AS ties FROM rk)
SELECT CAST(n AS BIGINT) AS n, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) + 0.0 AS z FROM sm""")
def wilcoxon_z(spark, sf_dir):
    return inference.wilcoxon(shortage_pairs(spark, sf_dir), "d").select("n", "z")


@query()
def wilcoxon_test(spark, sf_dir):
    return inference.wilcoxon(shortage_pairs(spark, sf_dir), "d")


@query()
def iid_bootstrap_ci(spark, sf_dir):
    return inference.bootstrap_summary(inference.iid_bootstrap(shortage_pairs(spark, sf_dir), "d"))


@query(f"{PAIR_SQL} SELECT count(*) AS n, round(avg(d), 6) + 0.0 AS mean_difference, round(quantile_cont(d, 0.5), 6) + 0.0 AS median_difference, count(*) FILTER (d > 0) AS worse, count(*) FILTER (d < 0) AS better FROM pd")
def paired_summary(spark, sf_dir):
    d, pairs = F.col("d"), settled(shortage_pairs(spark, sf_dir), "pairs")
    middle = exact_quantiles(pairs, [], "d", [0.5], written=True).select(rounded(F.col("quantiles")[0]).alias("median_difference"))
    counts = pairs.agg(F.count("*").alias("n"), rounded(F.avg(d)).alias("mean_difference"), F.count_if(d > 0).alias("worse"), F.count_if(d < 0).alias("better"))
    return counts.join(middle, how="left")  # one row each


def forecast_long(spark, sf_dir) -> DataFrame:
    """A row for each bucket and forecast with shortage, unused and provisioned capacity and absolute control error under the always-on reserve."""
    long = control.forecast_control(policy_rows(view5(spark, sf_dir)), FORECASTS, 1.10, adaptive=False)
    gap = F.col("actual_workload") - F.col("capacity")
    return long.select("bucket", "policy", F.greatest(gap, F.lit(0.0)).alias("shortage"), F.greatest(-gap, F.lit(0.0)).alias("unused"), F.col("capacity").alias("provisioned"), F.abs(gap).alias("absolute_error"))


PAIRS_SQL = f"""{forecast_sql("1", 1.10).rsplit(', ls AS', 1)[0]},
fl AS (SELECT bucket, policy, greatest(actual_workload - capacity, 0.0) AS shortage, greatest(capacity - actual_workload, 0.0) AS unused FROM lp),
df AS (SELECT a.policy AS model_a, b.policy AS model_b, unnest(['shortage', 'unused']) AS metric, unnest([a.shortage - b.shortage, a.unused - b.unused]) AS difference
       FROM fl a JOIN fl b ON a.bucket = b.bucket AND a.policy < b.policy)"""


@query(f"""{PAIRS_SQL},
sz AS (SELECT model_a, model_b, metric, abs(difference) AS d, count(*) AS k, count(*) FILTER (difference > 0) AS up FROM df WHERE difference <> 0 GROUP BY ALL),
rk AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY model_a, model_b, metric ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS rank FROM sz),
ws AS (SELECT model_a, model_b, metric, round(sum(up * rank), 3) + 0.0 AS w_plus, round(sum((k - up) * rank), 3) + 0.0 AS w_minus FROM rk GROUP BY ALL)
SELECT model_a, model_b, metric, n, mean_difference, median_difference, coalesce(w_plus, 0.0) AS w_plus, coalesce(w_minus, 0.0) AS w_minus
FROM (SELECT model_a, model_b, metric, count(*) AS n, round(avg(difference), 6) + 0.0 AS mean_difference, round(quantile_cont(difference, 0.5), 6) + 0.0 AS median_difference FROM df GROUP BY ALL)
LEFT JOIN ws USING (model_a, model_b, metric)""")
def paired_policy_statistics(spark, sf_dir):
    return inference.paired_statistics(inference.paired_differences(forecast_long(spark, sf_dir), "bucket", "policy", ["shortage", "unused"]))


@query()
def paired_policy_tests(spark, sf_dir):
    """All four metrics with p-values, bootstrap intervals and Holm's adjustment; what SQL can state of them is in paired_policy_statistics."""
    pairs = inference.paired_differences(forecast_long(spark, sf_dir), "bucket", "policy", ["shortage", "unused", "provisioned", "absolute_error"])
    return inference.paired_tests(settled(pairs, "policy-pairs"))


@query(f"""{PAIRS_SQL}, pg AS (SELECT bucket, policy, count(*) AS n FROM fl GROUP BY ALL), pm AS (SELECT count(DISTINCT policy) AS m FROM fl),
pk AS (SELECT bucket, count(*) AS have, count(*) FILTER (n > 1) AS repeated FROM pg GROUP BY bucket)
SELECT CAST(coalesce(sum(repeated), 0) AS BIGINT) AS repeated, count(*) FILTER (have <> m) AS incomplete_keys FROM pk, pm""")
def pairing_contract(spark, sf_dir):
    return inference.pairing_violations(forecast_long(spark, sf_dir), "bucket", "policy")


# ---------------------------------------------------------------- sensitivity

GRID = changepoint.detector_grid()
BASE_CONFIG = next(i for i, s, n, shift, gap in GRID if (s, n, shift, gap) == (12, 276, 0.10, 288))


def grid_sql(grid: list[tuple]) -> str:
    """CTE galarm (config_id, position, change_score, threshold, absolute_log_shift): the alarms of a grid."""
    parts, pairs = [], sorted({(s, n) for _, s, n, _, _ in grid})
    for s, n in pairs:
        names = {k: f"{k}_{s}_{n}" for k in ("z", "q", "sc", "th")}
        part = SCORE_SQL.format(s1=s - 1, s=s, far=s + n - 1)
        for old, new in names.items():
            part = part.replace(f"{old} AS (", f"{new} AS (").replace(f"FROM {old} ", f"FROM {new} ").replace(f"FROM {old})", f"FROM {new})").replace(f"FROM {old}\n", f"FROM {new}\n")
        parts.append(part)
    every = " UNION ALL ".join(f"SELECT {s} AS s, {n} AS n, position, change_score, absolute_log_shift, threshold FROM sc_{s}_{n}, th_{s}_{n} WHERE change_score >= threshold AND NOT isinf(change_score)" for s, n in pairs)
    rows = ", ".join(str(c) for c in grid)
    return f"""{", ".join(parts)}, cfg(config_id, s, n, shift, gap) AS (VALUES {rows}), every AS ({every}),
ghot AS (SELECT config_id, gap, position, change_score, absolute_log_shift, threshold FROM every JOIN cfg USING (s, n) WHERE absolute_log_shift >= shift),
gal AS (SELECT config_id, gap, min(position) AS p FROM ghot GROUP BY ALL UNION ALL SELECT g.config_id, g.gap, min(h.position) FROM gal g JOIN ghot h ON h.config_id = g.config_id AND h.position >= g.p + g.gap GROUP BY ALL),
galarm AS (SELECT ghot.config_id, position, change_score, threshold, absolute_log_shift FROM ghot JOIN gal ON gal.config_id = ghot.config_id AND gal.p = ghot.position)"""


WITH_GRID = f"{WITH_VIEW.replace('WITH ', 'WITH RECURSIVE ', 1)}, {grid_sql(GRID)}"


@query(f"{WITH_GRID} SELECT config_id, position, round(change_score, 6) + 0.0 AS change_score, round(threshold, 6) + 0.0 AS threshold, round(absolute_log_shift, 6) + 0.0 AS absolute_log_shift FROM galarm")
def cp_sensitivity_grid(spark, sf_dir):
    return changepoint.sensitivity(view5(spark, sf_dir), GRID).select("config_id", "position", *r("change_score", "threshold", "absolute_log_shift"))


@query(f"""{WITH_CP.replace('change_score >= threshold', 'change_score >= threshold AND NOT isinf(change_score)')} SELECT {BASE_CONFIG} AS config_id, sc.position, round(change_score, 6) + 0.0 AS change_score, round(threshold, 6) + 0.0 AS threshold, round(absolute_log_shift, 6) + 0.0 AS absolute_log_shift
FROM sc JOIN alarms USING (position), th""")
def cp_sensitivity_base(spark, sf_dir):
    grid = [c for c in GRID if c[0] == BASE_CONFIG]
    return changepoint.sensitivity(view5(spark, sf_dir), grid).select("config_id", "position", *r("change_score", "threshold", "absolute_log_shift"))


@query(f"""{WITH_GRID}, gbase AS (SELECT position AS b FROM galarm WHERE config_id = {BASE_CONFIG}),
gnum AS (SELECT c.config_id, (SELECT count(*) FROM galarm g WHERE g.config_id = c.config_id) AS alarms, (SELECT count(*) FROM gbase) AS base_alarms,
                (SELECT count(*) FROM gbase WHERE EXISTS (SELECT 1 FROM galarm g WHERE g.config_id = c.config_id AND abs(g.position - b) <= 12)) AS bm,
                (SELECT count(*) FROM galarm g WHERE g.config_id = c.config_id AND EXISTS (SELECT 1 FROM gbase WHERE abs(g.position - b) <= 12)) AS om FROM cfg c)
SELECT config_id, alarms, base_alarms, least(bm, om) AS matched, round(CASE WHEN base_alarms > 0 THEN bm / base_alarms END, 6) AS base_rate, round(CASE WHEN alarms > 0 THEN om / alarms END, 6) AS own_rate FROM gnum""")
def alarm_match_rates(spark, sf_dir):
    alarms = changepoint.sensitivity(view5(spark, sf_dir), GRID).select("config_id", "position")
    found = changepoint.alarm_match_rates(alarms, BASE_CONFIG, configs=[c[0] for c in GRID])
    return found.select("config_id", "alarms", "base_alarms", "matched", F.round("base_rate", 6).alias("base_rate"), F.round("own_rate", 6).alias("own_rate"))


BASE_PARAMETERS = next(c for c in GRID if c[0] == BASE_CONFIG)[1:]
NEAR = [c for c in GRID if sum(a != b for a, b in zip(c[1:], BASE_PARAMETERS, strict=True)) <= 1]
DELTAS = ["mean_shortage", "mean_unused_capacity", "reserve_activation_percent"]


@query(f"""{WITH_CTL}, {POLICY_SQL}, {grid_sql(NEAR)},
nv AS (SELECT cfg.config_id, pr.bucket, actual_workload, forecast_workload, CASE WHEN risk_signal > CASE WHEN ga.position IS NOT NULL THEN CAST(0.9591 AS DOUBLE) ELSE adaptive_threshold END THEN 1 ELSE 0 END AS trigger
       FROM pr CROSS JOIN cfg LEFT JOIN galarm ga ON ga.config_id = cfg.config_id AND ga.position = pr.bucket - (SELECT min(bucket) FROM v)),
nc AS (SELECT config_id, actual_workload, trigger, CASE WHEN trigger = 1 THEN forecast_workload * CAST(1.1 AS DOUBLE) ELSE forecast_workload END AS capacity FROM nv),
nm AS (SELECT config_id, round(avg(greatest(actual_workload - capacity, 0.0)), 6) + 0.0 AS mean_shortage, round(avg(greatest(capacity - actual_workload, 0.0)), 6) + 0.0 AS mean_unused_capacity, round(avg(trigger) * 100, 6) + 0.0 AS reserve_activation_percent FROM nc GROUP BY ALL)
SELECT nm.config_id, {", ".join(f"nm.{n}, round(nm.{n} - b.{n}, 6) + 0.0 AS {n}_delta" for n in DELTAS)} FROM nm, nm b WHERE b.config_id = {BASE_CONFIG}""")
def cp_downstream_robustness(spark, sf_dir):
    """Policy V4 under the base configuration and the eight that differ from it in one parameter, as differences from the base."""
    near = NEAR
    view = view5(spark, sf_dir)
    low = view.agg(F.min("bucket").alias("_low"))
    alarms = changepoint.sensitivity(view, near).crossJoin(F.broadcast(low)).select("config_id", (F.col("position") + F.col("_low")).alias("bucket"), F.lit(1).alias("change_alarm"))
    # nine configurations
    configs = F.broadcast(spark.createDataFrame([(c[0],) for c in near], "config_id int"))
    rows = settled(policy_rows(view).drop("change_alarm"), "policy-rows").crossJoin(configs).join(settled(alarms, "alarms"), ["config_id", "bucket"], "left")
    v4 = control.policies(rows).select("config_id", "actual_workload", F.col("V4_trigger").alias("trigger"), F.col("V4_capacity").alias("capacity"))
    found = control.capacity_metrics(v4, by="config_id")
    names = DELTAS
    own = found.where(F.col("config_id") == BASE_CONFIG).select(*(F.col(n).alias(f"_{n}") for n in names))
    return found.crossJoin(F.broadcast(own)).select("config_id", *names, *(rounded(F.col(n) - F.col(f"_{n}")).alias(f"{n}_delta") for n in names))


# ---------------------------------------------------------------- learning (no SQL: iterative fits)


def _workload(spark, sf_dir, change_points: bool) -> tuple[DataFrame, list[str]]:
    view = view5(spark, sf_dir)
    rows = features.workload_features(view, changepoint.change_points(view) if change_points else None)
    return settled(with_split(rows), "workload-rows"), features.workload_feature_names(change_points)


def _forecast_query(name: str, kind: str, change_points: bool, trees: int | None = None, log_target: bool = True):
    def run(spark, sf_dir):
        rows, names = _workload(spark, sf_dir, change_points)
        return learning.forecast(rows, names, kind, trees=trees, log_target=log_target).select("bucket", "split", "target_next_5min", *r("forecast"))

    QUERIES[name] = run


_forecast_query("forecast_gbt", "gbt", False)
_forecast_query("forecast_cp_gbt", "gbt", True)
_forecast_query("forecast_rf", "forest", False)
_forecast_query("forecast_ols", "ols", False, log_target=False)


@query(f"{WITH_VIEW}, {BASE_SQL} SELECT round(regr_intercept(actual, persistence), 6) + 0.0 AS intercept, round(regr_slope(actual, persistence), 6) + 0.0 AS slope FROM b WHERE actual IS NOT NULL")
def ols_by_sums(spark, sf_dir):
    rows = learning.causal_baselines(view5(spark, sf_dir)).where("actual IS NOT NULL")
    return learning.ols_by_sums(rows, "persistence", "actual").select(*r("intercept", "slope"))


HALVES_SQL = """h AS (SELECT bucket // 288 AS day, sum(CASE WHEN bucket % 288 < 144 THEN total_tokens ELSE -total_tokens END) AS d FROM v GROUP BY 1),
rk AS (SELECT d, row_number() OVER (ORDER BY abs(d)) AS rank FROM h WHERE d <> 0),
w AS (SELECT count(*) AS n, least(coalesce(sum(rank) FILTER (d > 0), 0), coalesce(sum(rank) FILTER (d < 0), 0)) AS statistic FROM rk),
pt AS (SELECT CAST(0 AS BIGINT) AS k, list_transform(range(0, (SELECT n * (n + 1) // 2 + 1 FROM w)), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c
       UNION ALL SELECT k + 1, list_transform(range(0, len(c)), lambda s: c[s + 1] + CASE WHEN s > k THEN c[s - k] ELSE 0.0 END) FROM pt WHERE k < (SELECT n FROM w))"""


@query(f"""{WITH_VIEW.replace('WITH ', 'WITH RECURSIVE ', 1)}, {HALVES_SQL}
SELECT n, CAST(statistic AS DOUBLE) AS statistic, round(least(1.0, 2 * list_sum(c[1:CAST(statistic AS BIGINT) + 1]) / pow(2, n)), 6) + 0.0 AS p_value FROM w, pt WHERE k = n""")
def daily_signed_rank(spark, sf_dir):
    """The exact signed-rank test of whether the first half of a day has as many tokens as the second."""
    view = view5(spark, sf_dir)
    sign = F.when(F.col("bucket") % 288 < 144, F.col("total_tokens")).otherwise(-F.col("total_tokens"))
    days = view.groupBy(F.floor(F.col("bucket") / 288).alias("day")).agg(F.sum(sign).alias("d"))
    return inference.wilcoxon(days, "d").select("n", F.col("statistic").cast("double").alias("statistic"), "p_value")


TWO_SQL = """x AS (SELECT CAST(actual AS DOUBLE) AS y, persistence AS a, moving_average AS b FROM b WHERE actual IS NOT NULL AND moving_average IS NOT NULL),
c AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ya, covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x),
s AS (SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS sa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS sb, ma, mb, my FROM c)"""


@query(f"{WITH_VIEW}, {BASE_SQL}, {TWO_SQL} SELECT round(my - sa * ma - sb * mb, 6) + 0.0 AS intercept, round(sa, 6) + 0.0 AS persistence, round(sb, 6) + 0.0 AS moving_average FROM s")
def ols_two_regressors(spark, sf_dir):
    """The linear regression of the next value on the last one and the mean of the last hour."""
    rows = learning.causal_baselines(view5(spark, sf_dir)).where("actual IS NOT NULL AND moving_average IS NOT NULL")
    intercept, slopes = learning.least_squares(rows, ["persistence", "moving_average"], "actual")
    return spark.createDataFrame([(intercept, *slopes.values())], "intercept double, persistence double, moving_average double").select(*r("intercept", "persistence", "moving_average"))


#: Edges of the one round that SQL states: powers of two.
EDGES = [2.0**k for k in range(18)]


@query(f"""{WITH_VIEW}, {BASE_SQL}, t AS (SELECT CAST(actual AS DOUBLE) AS y, persistence, seasonal_naive, moving_average FROM b WHERE actual IS NOT NULL AND seasonal_naive IS NOT NULL AND moving_average IS NOT NULL),
mu AS (SELECT avg(y) AS mean FROM t), u AS (SELECT * FROM t UNPIVOT (x FOR feature IN (persistence, seasonal_naive, moving_average))),
e AS (SELECT pow(2.0, unnest(range(0, 18))) AS threshold),
s AS (SELECT feature, threshold, sum(mean - y) FILTER (x <= threshold) AS gl, count(*) FILTER (x <= threshold) AS hl, sum(mean - y) AS g, count(*) AS h FROM u, e, mu GROUP BY feature, threshold),
c AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM s WHERE hl >= 30 AND h - hl >= 30)
SELECT feature, threshold, round(-gl / (hl + 1), 4) + 0.0 AS left_value, round((gl - g) / (h - hl + 1), 4) + 0.0 AS right_value FROM c WHERE gain = (SELECT max(gain) FROM c)""")
def boosting_first_round(spark, sf_dir):
    """The first cut of boosted trees of depth 1 on the causal baselines, and what it adds on either side."""
    rows = learning.causal_baselines(view5(spark, sf_dir)).where("actual IS NOT NULL")
    p = boosting.Boosting("squared", trees=1, rate=1.0, depth=1, l2=1.0, least_rows=30, bins=len(EDGES) + 1)
    table = boosting.fit(rows, FORECASTS, "actual", "bucket", p, cuts=[np.array(EDGES)] * len(FORECASTS)).table(spark).where("tree = 0")
    sides = table.agg(F.max("feature").alias("feature"), F.max(F.when(F.col("node") == 0, F.col("threshold"))).alias("threshold"), *(F.max(F.when(F.col("node") == i, F.col("value"))).alias(n) for i, n in ((1, "left_value"), (2, "right_value"))))
    return sides.select("feature", "threshold", rounded(F.col("left_value"), 4).alias("left_value"), rounded(F.col("right_value"), 4).alias("right_value"))


def _risk_rows(spark, sf_dir) -> DataFrame:
    rows = features.failure_features(minutes(spark, sf_dir)).where("minute >= 1440")
    return settled(with_split(rows, "minute"), "risk-rows")


def scored_minutes(rows: DataFrame, zero_responses: bool = True) -> DataFrame:
    """Minutes with all features and the classifier's probability of a failure, with or without the features of zero responses."""
    return learning.failure_risk(rows, features.failure_feature_names(zero_responses))


@query()
def failure_gbt(spark, sf_dir):
    return scored_minutes(_risk_rows(spark, sf_dir)).select("minute", "split", "failure", *r("probability_of_failure"))


ISOTONIC_SQL = """ks AS (SELECT minute, failure, CAST(risk AS DOUBLE) AS risk, minute - min(minute) OVER () AS place, max(minute) OVER () - min(minute) OVER () + 1 AS n FROM kr),
kp AS (SELECT minute, failure, risk, {SPLIT} AS split FROM ks),
ki AS (SELECT risk AS x, sum(failure) AS y, count(*) AS w FROM kp WHERE split = 'calibration' GROUP BY risk),
kf AS (SELECT x, (SELECT max(low) FROM (SELECT (SELECT min((SELECT CAST(sum(c.y) AS DOUBLE) / sum(c.w) FROM ki c WHERE c.x >= a.x AND c.x <= b.x)) FROM ki b WHERE b.x >= i.x) AS low FROM ki a WHERE a.x <= i.x)) AS fit FROM ki i),
kl AS (SELECT r.risk, max(x) FILTER (x <= r.risk) AS lo, min(x) FILTER (x >= r.risk) AS hi FROM (SELECT DISTINCT risk FROM kp) r, kf GROUP BY r.risk),
kc AS (SELECT kl.risk, CASE WHEN lo IS NULL THEN b.fit WHEN hi IS NULL OR hi = lo THEN a.fit ELSE a.fit + (b.fit - a.fit) * (kl.risk - lo) / (hi - lo) END AS calibrated FROM kl LEFT JOIN kf a ON a.x = lo LEFT JOIN kf b ON b.x = hi)""".replace("{SPLIT}", minute_split_sql("place", "n"))


@query(f"{WITH_MINUTES}, {RISK_SQL}, {ISOTONIC_SQL} SELECT minute, split, failure, round(kp.risk, 6) + 0.0 AS risk, round(calibrated, 6) + 0.0 AS calibrated FROM kp JOIN kc ON kc.risk = kp.risk")
def isotonic_calibration(spark, sf_dir):
    risk = with_split(surrogate_risk(minutes(spark, sf_dir)), "minute")
    return learning.isotonic(risk, "risk", "failure").select("minute", "split", "failure", *r("risk", "calibrated"))


@query()
def risk_ablation(spark, sf_dir):
    """Metrics of the classifier with all 89 features and without the 17 of zero responses, fitted side by side, on the test split."""
    rows = _risk_rows(spark, sf_dir)

    def one(name: str, zero_responses: bool) -> DataFrame:
        test = settled(scored_minutes(rows, zero_responses).where("split = 'test'"), "test-risk")
        return metrics.risk_metrics(test, "probability_of_failure", "failure", 0.5, inclusive=True, clip=1e-15).withColumn("features", F.lit(name))

    full, ablated = side_by_side(lambda: one("full", True), lambda: one("ablated", False))
    return full.unionByName(ablated)


# ---------------------------------------------------------------- report data


@query(f"{WITH_CP} SELECT cp.bucket, cp.position, v.total_tokens, round(cp.change_score, 6) + 0.0 AS change_score FROM cp JOIN v ON v.bucket = cp.bucket WHERE change_alarm = 1")
def figure_alarm_overlay(spark, sf_dir):
    view = view5(spark, sf_dir)
    alarms = changepoint.change_points(view).where("change_alarm = 1")
    return alarms.join(view.select("bucket", "total_tokens"), "bucket").select("bucket", "position", "total_tokens", *r("change_score"))


@query(f"""{WITH_MINUTES}, {RISK_SQL} SELECT failure, CAST(least(floor(risk * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM kr GROUP BY 1, 2""")
def figure_risk_histogram(spark, sf_dir):
    risk = surrogate_risk(minutes(spark, sf_dir))
    return risk.groupBy("failure", F.least(F.floor(F.col("risk") * 40), F.lit(39)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""{WITH_CTL}, {POLICY_SQL} SELECT policy, round(quantile_cont(greatest(actual_workload - capacity, 0.0), 0.25), 6) + 0.0 AS q25, round(quantile_cont(greatest(actual_workload - capacity, 0.0), 0.5), 6) + 0.0 AS q50,
round(quantile_cont(greatest(actual_workload - capacity, 0.0), 0.75), 6) + 0.0 AS q75 FROM lp GROUP BY policy""")
def figure_shortage_quartiles(spark, sf_dir):
    long = control.long_policies(control.policies(policy_rows(view5(spark, sf_dir))))
    short = F.greatest(F.col("actual_workload") - F.col("capacity"), F.lit(0.0))
    q = exact_quantiles(long.withColumn("shortage", short), ["policy"], "shortage", (0.25, 0.5, 0.75), "q")
    return q.select("policy", *(rounded(F.col("q")[i]).alias(n) for i, n in enumerate(("q25", "q50", "q75"))))


@query(f"""{WITH_VIEW}, {BASE_SQL} SELECT bucket, actual, round(abs(moving_average - actual), 6) + 0.0 AS absolute_error FROM b WHERE actual IS NOT NULL AND moving_average IS NOT NULL AND {TEST_SQL}""")
def figure_absolute_error(spark, sf_dir):
    rows = with_split(learning.causal_baselines(view5(spark, sf_dir))).where("split = 'test' AND actual IS NOT NULL AND moving_average IS NOT NULL")
    return rows.select("bucket", "actual", rounded(F.abs(F.col("moving_average") - F.col("actual"))).alias("absolute_error"))


from tidewheel.plans import reports  # noqa: E402, F401  registers more queries
