"""Robust causal change points: scores, training threshold, alarms with a refractory gap, and the detector's grid."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.columns import is_finite
from tidewheel.operators.selection import exact_quantiles
from tidewheel.operators.windows import Blocks
from tidewheel.sources.shared import settled

#: Interquartile range of a normal distribution in standard deviations.
IQR_TO_SIGMA = 1.349
#: An alarm before the first one, so long ago that every gap has passed.
NEVER = -(10**9)


@dataclass(frozen=True)
class Detector:
    short: int = 12
    long: int = 276
    least_shift: float = 0.10
    gap: int = 288
    quantile: float = 0.95
    train_fraction: float = 12384 / 17566


def change_scores(view: DataFrame, short: int = 12, long: int = 276, y: str = "total_tokens", key: str = "bucket") -> DataFrame:
    """Columns key, position, short_level_log, long_level_log, robust_scale, absolute_log_shift, change_score, short_long_ratio.

    The mean of the last ``short`` log values is compared with the median of the
    ``long`` before them, in units of their interquartile range. Without spread
    any shift scores infinity and none scores 0. All is null until both windows
    are full.
    """
    low = view.agg(F.min(key).alias("_low"))  # one row
    base = view.select(key, F.log1p(y).alias("_z")).crossJoin(F.broadcast(low)).withColumn("position", F.col(key) - F.col("_low"))
    b = Blocks(base, key, short + long)
    b.frame = b.frame.withColumn("_short", F.avg("_z").over(b.rows(-(short - 1), 0)))
    b.quantiles("_z", -(short + long - 1), -short, (0.25, 0.5, 0.75), "_q")
    ready = F.col("position") >= short + long - 1
    out = b.result(key, "position", F.when(ready, F.col("_short")).alias("short_level_log"), *(F.when(ready, F.col(q)).alias(q) for q in ("_q0", "_q1", "_q2")))
    change = F.col("short_level_log") - F.col("_q1")
    shift, scale = F.abs(change), (F.col("_q2") - F.col("_q0")) / IQR_TO_SIGMA
    score = F.when(scale > 0, shift / scale).when(shift > 0, F.lit(float("inf"))).when(shift == 0, F.lit(0.0))
    return out.select(key, "position", "short_level_log", F.col("_q1").alias("long_level_log"), scale.alias("robust_scale"), shift.alias("absolute_log_shift"), score.alias("change_score"), F.exp(change).alias("short_long_ratio"))


def training_threshold(scores: DataFrame, quantile: float = 0.95, train_fraction: float = 12384 / 17566) -> DataFrame:
    """One row: the exact quantile of the finite scores among the first part of the positions."""
    total = scores.agg((F.floor((F.max("position") + 1) * train_fraction)).alias("_n"))  # one row
    train = scores.crossJoin(F.broadcast(total)).where((F.col("position") < F.col("_n")) & is_finite(F.col("change_score")))
    found = exact_quantiles(train, [], "change_score", [quantile])
    return found.agg(F.max(F.col("quantiles")[0]).alias("threshold"))


def greedy_alarms(candidates: DataFrame, at: str, gap: int | str, by: list[str]) -> DataFrame:
    """Of the candidate places of each group those at least ``gap`` (a number, or a column that is the same in a group) after the last one taken.

    A group is one series' candidates, 8 bytes each; from each alarm the next is
    found by search, so the work grows with the alarms.
    """
    own = candidates.select(*by, F.col(at).cast("long").alias(at), (F.col(gap) if isinstance(gap, str) else F.lit(gap)).cast("long").alias("_gap"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        places, step = np.sort(group[at].to_numpy()), int(group["_gap"].iloc[0])
        taken, i = [], 0
        while i < len(places):
            taken.append(places[i])
            i = int(np.searchsorted(places, places[i] + step))
        return group[by].iloc[[0] * len(taken)].assign(**{at: taken})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*by, at).schema)
    return own.groupBy(*by).applyInPandas(run, schema)


def change_points(view: DataFrame, detector: Detector = Detector(), key: str = "bucket") -> DataFrame:
    """The scores with change_alarm and elapsed_since_alarm.

    On an alarm row elapsed_since_alarm is the time since the alarm before it;
    before the first alarm it counts from the far past.
    """
    scores = settled(change_scores(view, detector.short, detector.long, key=key), "scores")
    limit = training_threshold(scores, detector.quantile, detector.train_fraction)
    hot = scores.crossJoin(F.broadcast(limit)).where((F.col("change_score") >= F.col("threshold")) & (F.col("absolute_log_shift") >= detector.least_shift))
    alarms = settled(greedy_alarms(hot.select(F.lit(0).alias("_series"), "position"), "position", detector.gap, ["_series"]).select("position", F.lit(1).alias("_alarm")), "alarms")
    out = scores.join(alarms, "position", "left").withColumn("change_alarm", F.coalesce("_alarm", F.lit(0)))
    # rows before the next alarm share the last one; alarms are few, so their table is small beside the series
    bounds = alarms.select(F.col("position").alias("_at"), F.lead("position").over(Window.orderBy("position")).alias("_next"))
    spans = bounds.select("_at", F.explode(F.sequence(F.col("_at") + 1, F.coalesce("_next", F.col("_at") + 1))).alias("position"))
    last = bounds.agg(F.max("_at").alias("_last"))
    out = out.join(spans, "position", "left").crossJoin(F.broadcast(last))
    since = F.coalesce("_at", F.when(F.col("position") > F.col("_last"), F.col("_last")), F.lit(NEVER))
    return out.withColumn("elapsed_since_alarm", F.when(F.col("change_score").isNotNull(), F.col("position") - since)).drop("_alarm", "_at", "_last")


def detector_grid(shorts=(6, 12, 24), longs=(138, 276, 552), shifts=(0.05, 0.10, 0.20), gaps=(144, 288, 576)) -> list[tuple[int, int, int, float, int]]:
    """(config_id, short, long, least_shift, gap) of every combination, in order."""
    return [(i, *c) for i, c in enumerate(product(shorts, longs, shifts, gaps), 1)]


def sensitivity(view: DataFrame, grid: list[tuple[int, int, int, float, int]], quantile: float = 0.95, train_fraction: float = 12384 / 17566) -> DataFrame:
    """Alarms of each configuration: config_id, position, change_score, threshold, absolute_log_shift.

    Scores are made once for each pair of windows, written, and shared by the
    configurations with that pair. Infinite scores raise no alarm here.
    """
    spark, view = view.sparkSession, settled(view.select("bucket", "total_tokens"), "view")
    pairs = sorted({(s, n) for _, s, n, _, _ in grid})
    found = None
    for short, long in pairs:
        scores = settled(change_scores(view, short, long).select("position", "change_score", "absolute_log_shift"), "scores")
        rows = scores.where(is_finite(F.col("change_score"))).crossJoin(F.broadcast(training_threshold(scores, quantile, train_fraction)))
        part = rows.where("change_score >= threshold").select(F.lit(short).alias("short"), F.lit(long).alias("long"), "position", "change_score", "threshold", "absolute_log_shift")
        found = part if found is None else found.unionByName(part)
    # the grid is a parameter of a few dozen rows
    configs = F.broadcast(spark.createDataFrame(grid, "config_id int, short int, long int, least_shift double, gap int"))
    hot = found.join(configs, ["short", "long"]).where("absolute_log_shift >= least_shift")
    alarms = greedy_alarms(hot, "position", "gap", ["config_id"])
    return hot.join(alarms, ["config_id", "position"]).select("config_id", "position", "change_score", "threshold", "absolute_log_shift")


def alarm_match_rates(alarms: DataFrame, base_config: int, tolerance: int = 12, configs: list[int] | None = None) -> DataFrame:
    """For each of ``configs`` (those with alarms, if not given): alarms, how many lie within ``tolerance`` of a base alarm and the other way round, and their rates.

    Each alarm is spread over the keys within reach of it, so the band join is
    a join on equal keys. A configuration without alarms matches none of the
    base's; its own rate is null.
    """
    alarms = settled(alarms.select("config_id", "position"), "alarms")
    base = alarms.where(F.col("config_id") == base_config).select(F.col("position").alias("b"))
    # the grid is a parameter of a few dozen rows
    grid = alarms.select("config_id").distinct() if configs is None else alarms.sparkSession.createDataFrame([(c,) for c in configs], "config_id int")
    near = base.select("b", F.explode(F.sequence(F.col("b") - tolerance, F.col("b") + tolerance)).alias("position"))
    hits = alarms.select("config_id", "position").join(near, "position")
    own = alarms.groupBy("config_id").agg(F.count("*").alias("alarms"))
    forward = hits.groupBy("config_id").agg(F.count_distinct("b").alias("base_matched"), F.count_distinct("position").alias("own_matched"))
    size = base.agg(F.count("*").alias("base_alarms"))
    out = grid.join(own, "config_id", "left").join(forward, "config_id", "left").na.fill(0, ["alarms", "base_matched", "own_matched"]).crossJoin(F.broadcast(size))
    rate = [F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).alias(name) for part, whole, name in (("base_matched", "base_alarms", "base_rate"), ("own_matched", "alarms", "own_rate"))]
    return out.select("config_id", "alarms", "base_alarms", F.least("base_matched", "own_matched").alias("matched"), *rate)
