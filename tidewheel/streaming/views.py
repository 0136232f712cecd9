"""Streaming forms of the time view and of the alarm rule; an extension of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_time_view(events: DataFrame, ts: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and token sums for each window; rows later than ``late`` are left out."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width))
        .agg(F.count("*").alias("request_count"), F.sum("total_tokens").alias("total_tokens"), F.count_if(F.col("response_tokens") == 0).alias("zero_response_count"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "request_count", "total_tokens", "zero_response_count")
    )


def streaming_alarms(candidates: DataFrame, gap: int, series: str = "series", at: str = "position") -> DataFrame:
    """Candidates that are at least ``gap`` after the last alarm of their series; the state is that alarm's place."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        taken = []
        for p in sorted(x for b in batches for x in b[at].tolist()):
            if last is None or p - last >= gap:
                taken.append(p)
                last = p
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({series: [key[0]] * len(taken), at: taken})

    kind = candidates.schema[series].dataType.simpleString()
    return candidates.groupBy(series).applyInPandasWithState(run, f"{series} {kind}, {at} long", "last long", "append", GroupStateTimeout.NoTimeout)
