"""Causal features of time views: lags, rolling statistics, calendar, and the feature tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.columns import phase
from tidewheel.operators.windows import Blocks

WORKLOAD_LAGS = (1, 2, 3, 6, 12, 24, 72, 144, 288)
ROLLING = (3, 12, 72, 288)
ROLLING_MAX = (12, 72, 288)
FAILURE_LAGS = (1, 2, 5, 15, 60, 240, 1440)
FAILURE_WINDOWS = (5, 15, 60, 240, 1440)
FAILURE_SERIES = ("request_count", "completed_tokens", "gpt4_share", "api_share", "zero_response_count")
DAY_BUCKETS, WEEK_BUCKETS = 288, 2016
DAY_MINUTES, WEEK_MINUTES = 1440, 10080


def workload_columns(b: Blocks, y: str = "total_tokens") -> list:
    """Target, 9 lags, 11 rolling statistics, 4 calendar columns and the full-history flag."""
    day, week = phase(F.col(b.key), DAY_BUCKETS), phase(F.col(b.key), WEEK_BUCKETS)
    return [
        b.lead(y).alias("target_next_5min"),
        *(b.lag(y, k).alias(f"lag_{k}") for k in WORKLOAD_LAGS),
        *(b.past(F.avg(y), y, n).alias(f"rolling_mean_{n}") for n in ROLLING),
        *(b.past(F.stddev_samp(y), y, n).alias(f"rolling_std_{n}") for n in ROLLING),
        *(b.past(F.max(y), y, n).alias(f"rolling_max_{n}") for n in ROLLING_MAX),
        day[0].alias("daily_sin"),
        day[1].alias("daily_cos"),
        week[0].alias("weekly_sin"),
        week[1].alias("weekly_cos"),
        b.lag(y, max(WORKLOAD_LAGS)).isNotNull().alias("has_full_history"),
    ]


def workload_features(view: DataFrame, alarms: DataFrame | None = None) -> DataFrame:
    """Features of the five-minute view; with ``alarms`` the four change-point columns are joined."""
    b = Blocks(view.select("bucket", "total_tokens"), "bucket", max(WORKLOAD_LAGS), ahead=1)
    out = b.result("bucket", "total_tokens", *workload_columns(b))
    if alarms is None:
        return out
    names = {"change_score": "cp_change_score", "change_alarm": "cp_change_alarm", "short_long_ratio": "cp_short_long_ratio", "elapsed_since_alarm": "cp_elapsed_bins"}
    return out.join(alarms.select("bucket", *(F.col(a).alias(c) for a, c in names.items())), "bucket")


def workload_feature_names(change_points: bool = False) -> list[str]:
    out = [f"lag_{k}" for k in WORKLOAD_LAGS]
    for kind, sizes in (("mean", ROLLING), ("std", ROLLING), ("max", ROLLING_MAX)):
        out += [f"rolling_{kind}_{n}" for n in sizes]
    out += ["daily_sin", "daily_cos", "weekly_sin", "weekly_cos"]
    return out + ["cp_change_score", "cp_change_alarm", "cp_short_long_ratio", "cp_elapsed_bins"] * change_points


def failure_feature_names(zero_response: bool = True) -> list[str]:
    out = []
    for s in FAILURE_SERIES if zero_response else FAILURE_SERIES[:-1]:
        out += [f"{s}_lag_{k}" for k in FAILURE_LAGS]
        for n in FAILURE_WINDOWS:
            out += [f"{s}_sum_{n}", f"{s}_mean_{n}"]
    return out + ["minute_sin", "minute_cos", "week_sin", "week_cos"]


def failure_features(minutes: DataFrame) -> DataFrame:
    """Base columns and 89 predictors of each minute: 35 lags, 50 past sums and means, 4 calendar columns."""
    b = Blocks(minutes, "minute", max(FAILURE_LAGS))
    b.running(*FAILURE_SERIES)
    columns = []
    for s in FAILURE_SERIES:
        columns += [b.lag(s, k).alias(f"{s}_lag_{k}") for k in FAILURE_LAGS]
        for n in FAILURE_WINDOWS:
            columns += [b.past_sum(s, n).alias(f"{s}_sum_{n}"), (b.past_sum(s, n) / n).alias(f"{s}_mean_{n}")]
    day, week = phase(F.col("minute"), DAY_MINUTES), phase(F.col("minute"), WEEK_MINUTES)
    calendar = [day[0].alias("minute_sin"), day[1].alias("minute_cos"), week[0].alias("week_sin"), week[1].alias("week_cos")]
    return b.result("minute", *FAILURE_SERIES, "failure", *columns, *calendar)


def drop_warm_up(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows that have all features."""
    return df.na.drop(subset=features)

