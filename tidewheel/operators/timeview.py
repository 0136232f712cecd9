"""Gap-free time views of a request trace, and checks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.columns import bucket_of, normalised, ratio
from tidewheel.sources.shared import settled

COUNTS = ("request_count", "request_tokens", "response_tokens", "total_tokens", "zero_response_count", "gpt4_count", "api_count")


#: Slices of a grid that tasks make on their own.
SLICES = 64


def densify(df: DataFrame, key: str, fill: tuple[str, ...], high: Column | None = None) -> DataFrame:
    """One row for each integer from the smallest key to the largest, or to the aggregate ``high``; ``fill`` is 0 where a row was missing.

    The grid is made in slices, so no task makes all of it. ``df``, which has a
    row for a key at most, is written first: it is read for its span and for the grid.
    """
    df = settled(df, "buckets")
    span = F.broadcast(df.agg(F.min(key).alias("_lo"), (F.max(key) if high is None else high).alias("_hi")).where("_lo <= _hi"))  # one row
    size = F.floor((F.col("_hi") - F.col("_lo")) / SLICES) + 1
    low = F.col("_lo") + F.col("id") * size
    slices = df.sparkSession.range(SLICES).crossJoin(span).where(low <= F.col("_hi"))
    grid = slices.select(F.explode(F.sequence(low, F.least(low + size - 1, F.col("_hi")))).alias(key))
    return grid.join(df, key, "left").na.fill(0, list(fill))


def time_view(trace: DataFrame, width: int, trim: bool = False) -> DataFrame:
    """Counts, token sums and shares for each ``width`` seconds, without gaps.

    With ``trim`` the last bucket goes if the trace ends before the bucket's
    last second; the trace is read once all the same. Categories match exactly. Partial sums are made in each task, so what is
    shuffled is a row for each bucket and task.
    """
    n = F.col("request_count")
    grouped = trace.groupBy(bucket_of(F.col("ts_s"), width).alias("bucket")).agg(
        F.count("*").alias("request_count"),
        F.sum("request_tokens").alias("request_tokens"),
        F.sum("response_tokens").alias("response_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count_if(F.col("response_tokens") == 0).alias("zero_response_count"),
        F.count_if(F.col("model") == "GPT-4").alias("gpt4_count"),
        F.count_if(F.col("log_type") == "API log").alias("api_count"),
        F.max("ts_s").alias("_last"),
    )
    complete = F.floor((F.max("_last") + 1) / width) - 1 if trim else None
    return densify(grouped, "bucket", COUNTS, complete).select(
        "bucket",
        (F.col("bucket") * width).alias("start_second"),
        ((F.col("bucket") + 1) * width).alias("end_second_exclusive"),
        *COUNTS[:6],
        ratio(F.col("gpt4_count"), n).alias("gpt4_share"),
        "api_count",
        ratio(F.col("api_count"), n).alias("api_share"),
    )


def trim_incomplete(view: DataFrame, trace: DataFrame) -> DataFrame:
    """Without the last bucket if the trace ends before the bucket's last second."""
    end = trace.agg(F.max("ts_s").alias("_end"))  # one row
    return view.crossJoin(F.broadcast(end)).where((F.col("end_second_exclusive") - 1 <= F.col("_end")) | (F.col("start_second") > F.col("_end"))).drop("_end")


def view_violations(view: DataFrame) -> DataFrame:
    """One row: how many buckets break each rule of a time view."""
    c = F.col
    step = view.agg((F.max("bucket") - F.min("bucket") + 1 - F.count("*")).alias("missing_buckets"), (F.count("*") - F.count_distinct("bucket")).alias("repeated_buckets"))
    rules = view.agg(
        F.count("*").alias("buckets"),
        F.count_if(F.least(*(c(x) for x in COUNTS)) < 0).alias("negative"),
        F.count_if(c("total_tokens") != c("request_tokens") + c("response_tokens")).alias("token_mismatch"),
        F.count_if(c("zero_response_count") > c("request_count")).alias("too_many_zero_responses"),
        F.count_if((c("gpt4_share") < 0) | (c("gpt4_share") > 1) | (c("api_share") < 0) | (c("api_share") > 1)).alias("share_out_of_range"),
    )
    return rules.crossJoin(F.broadcast(step))


def minute_aggregates(trace: DataFrame) -> DataFrame:
    """Minute rows for failure features: counts, completed tokens, shares, and whether any response was empty.

    Categories match by substring whatever the case; completed tokens are the
    response tokens of requests that got any.
    """
    n = F.col("request_count")
    answered = F.col("response_tokens")
    grouped = trace.groupBy(bucket_of(F.col("ts_s"), 60).alias("minute")).agg(
        F.count("*").alias("request_count"),
        F.sum(F.when(answered > 0, answered).otherwise(0)).alias("completed_tokens"),
        F.count_if(normalised(F.col("model")).contains("gpt-4")).alias("_gpt4"),
        F.count_if(normalised(F.col("log_type")).contains("api")).alias("_api"),
        F.count_if(answered == 0).alias("zero_response_count"),
    )
    whole = densify(grouped, "minute", ("request_count", "completed_tokens", "_gpt4", "_api", "zero_response_count"))
    return whole.select("minute", "request_count", "completed_tokens", ratio(F.col("_gpt4"), n).alias("gpt4_share"), ratio(F.col("_api"), n).alias("api_share"), "zero_response_count", (F.col("zero_response_count") > 0).cast("int").alias("failure"))
