"""The adaptive threshold controller and capacity policies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.columns import rounded, surplus
from tidewheel.operators.selection import exact_quantiles
from tidewheel.operators.windows import BLOCK_ROWS, Blocks
from tidewheel.sources.shared import settled


@dataclass(frozen=True)
class Controller:
    start: float = 0.9591
    window: int = 60
    step: float = 0.01
    low: float = 0.50
    high: float = 0.99


#: Thresholds are whole numbers of this unit, so that any order of steps gives the same ones.
UNIT = 1_000_000


def adaptive_threshold(risk: DataFrame, target: float, key: str, probability: str = "risk", outcome: str = "failure", controller: Controller = Controller(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, probability, outcome, threshold_before_update, reserve_trigger, threshold_after_update of one series, whose keys have no gaps.

    A row triggers if its probability exceeds the threshold so far. Then its
    outcome joins the last ``window`` ones; once these are complete, a failure
    rate above the target lowers the threshold by a step and one below raises
    it, within bounds.

    A step is x -> min(high, max(low, x + d)), and such maps compose to one of
    the same form. So each block of the series is one map; the maps, one for
    each ``block_rows`` rows, are applied one after another, and the blocks are
    replayed on their own from the threshold they begin with.
    """
    c = controller
    start, step, low, high = (round(v * UNIT) for v in (c.start, c.step, c.low, c.high))
    rows = risk.select(F.col(key).cast("long").alias(key), F.col(probability).cast("double").alias(probability), F.col(outcome).cast("int").alias(outcome))
    b = Blocks(rows, key, c.window - 1, block_rows=block_rows)
    rate = b.full(F.avg(outcome), outcome, -(c.window - 1), 0)
    move = F.when(rate > target, -step).when(rate < target, step).otherwise(0)
    moves = settled(b.result(key, probability, outcome, move.alias("_d"), F.col("_block").alias("_b")), "moves")
    held = moves.groupBy("_b").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "_d"))), lambda m: m["_d"]).alias("ds"))  # block_rows numbers each
    # a row without a step changes nothing, whatever the bounds
    first = F.struct(F.lit(0).alias("a"), F.lit(-(2**30)).alias("l"), F.lit(2**30).alias("h"))

    def bounded(x: Column) -> Column:
        return F.least(F.lit(high), F.greatest(F.lit(low), x))

    def then(m: Column, d: Column) -> Column:
        moved = F.struct((m["a"] + d).alias("a"), bounded(m["l"] + d).alias("l"), bounded(m["h"] + d).alias("h"))
        return F.when(d == 0, m).otherwise(moved)

    maps = held.select("_b", F.aggregate("ds", first, then).alias("m")).select("_b", "m.*")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = start
        for batch in batches:
            before = []
            for a, lo, hi in zip(batch["a"], batch["l"], batch["h"], strict=True):
                before.append(x)
                x = int(min(hi, max(lo, x + a)))
            yield pd.DataFrame({"_b": batch["_b"], "_x": before})

    # a row for each block comes to one task
    begin = maps.repartition(1).sortWithinPartitions("_b").mapInPandas(entries, "_b long, _x long")

    def replay(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(key)
        x, after = int(block["_x"].iloc[0]), []
        before = [x]
        for d in block["_d"].tolist():
            x = min(high, max(low, x + d)) if d else x
            after.append(x)
        before += after[:-1]
        out = block[[key, probability, outcome]].assign(threshold_before_update=np.array(before) / UNIT, threshold_after_update=np.array(after) / UNIT)
        out["reserve_trigger"] = (out[probability] > out["threshold_before_update"]).astype("int32")
        return out[[key, probability, outcome, "threshold_before_update", "reserve_trigger", "threshold_after_update"]]

    schema = f"{key} long, {probability} double, {outcome} int, threshold_before_update double, reserve_trigger int, threshold_after_update double"
    return moves.join(begin, "_b").groupBy("_b").applyInPandas(replay, schema)


def to_five_minutes(minutes: DataFrame, key: str = "minute", probability: str = "risk", threshold: str = "threshold_before_update") -> DataFrame:
    """bucket, risk_signal (largest probability of its minutes) and adaptive_threshold (that of its first minute)."""
    return minutes.groupBy(F.floor(F.col(key) / 5).cast("long").alias("bucket")).agg(F.max(probability).alias("risk_signal"), F.min_by(threshold, key).alias("adaptive_threshold"))


def policies(rows: DataFrame, fixed: float = 0.9591, reserve: float = 1.10) -> DataFrame:
    """Trigger and capacity of the four policies for rows with forecast_workload, risk_signal, adaptive_threshold and change_alarm.

    V1 provisions the forecast; V2 adds the reserve above a fixed risk; V3 above
    the adaptive threshold; V4 is V3 with the fixed threshold on alarm rows.
    """
    risk, forecast = F.col("risk_signal"), F.col("forecast_workload")
    alarm = F.coalesce("change_alarm", F.lit(0)) == 1
    out = rows.withColumn("V4_threshold", F.when(alarm, F.lit(fixed)).otherwise(F.col("adaptive_threshold")))
    triggers = {"V1": F.lit(0), "V2": (risk > fixed).cast("int"), "V3": (risk > F.col("adaptive_threshold")).cast("int"), "V4": (risk > F.col("V4_threshold")).cast("int")}
    for name, trigger in triggers.items():
        out = out.withColumn(f"{name}_trigger", F.coalesce(trigger, F.lit(0)))
        out = out.withColumn(f"{name}_capacity", F.when(F.col(f"{name}_trigger") == 1, forecast * reserve).otherwise(forecast))
    return out


def long_policies(rows: DataFrame, names=("V1", "V2", "V3", "V4")) -> DataFrame:
    """One row for each bucket and policy: policy, actual_workload, trigger, capacity."""
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), F.col(f"{n}_trigger").alias("trigger"), F.col(f"{n}_capacity").alias("capacity")) for n in names))).alias("p")
    return rows.select("bucket", "actual_workload", parts).select("bucket", "p.policy", "actual_workload", "p.trigger", "p.capacity")


def capacity_metrics(rows: DataFrame, by: str = "policy") -> DataFrame:
    """For each policy: under-provisioning, shortage (mean, p95, tail mean), unused capacity, activation, totals and cost index."""
    held = rows.withColumns({"shortage": surplus(F.col("actual_workload"), F.col("capacity")), "unused": surplus(F.col("capacity"), F.col("actual_workload"))})
    held = settled(held.select(by, "actual_workload", "capacity", "trigger", "shortage", "unused"), "capacity-rows")
    p95 = exact_quantiles(held, [by], "shortage", [0.95], written=True).select(by, F.col("quantiles")[0].alias("p95"))  # a row for each policy
    return held.join(F.broadcast(p95), by).groupBy(by).agg(
        F.count("*").alias("n"),
        rounded(F.avg((F.col("shortage") > 0).cast("double")) * 100).alias("under_provisioned_percent"),
        rounded(F.avg("shortage")).alias("mean_shortage"),
        rounded(F.first("p95")).alias("p95_shortage"),
        rounded(F.avg(F.when(F.col("shortage") >= F.col("p95"), F.col("shortage")))).alias("shortfall_cvar95"),
        rounded(F.avg("unused")).alias("mean_unused_capacity"),
        rounded(F.avg("capacity")).alias("mean_provisioned_capacity"),
        rounded(F.avg("actual_workload")).alias("mean_actual_workload"),
        rounded(F.sum("shortage"), 3).alias("total_shortage"),
        rounded(F.sum("unused"), 3).alias("total_unused_capacity"),
        rounded(F.avg(F.col("trigger").cast("double")) * 100).alias("reserve_activation_percent"),
        rounded(F.sum("capacity") / F.sum("actual_workload")).alias("cost_index"),
    )


def forecast_control(rows: DataFrame, forecasts: list[str], reserve: float, adaptive: bool) -> DataFrame:
    """A row for each bucket and forecast: capacity under a reserve that is always on, or on where risk exceeds the threshold."""
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("policy"), F.col(f).alias("forecast_workload")) for f in forecasts))).alias("p")
    long = rows.select("bucket", "actual_workload", "risk_signal", "adaptive_threshold", parts).select("bucket", "actual_workload", "risk_signal", "adaptive_threshold", "p.*")
    trigger = (F.col("risk_signal") > F.col("adaptive_threshold")).cast("int") if adaptive else F.lit(1)
    long = long.withColumn("trigger", F.coalesce(trigger, F.lit(0)))
    return long.withColumn("capacity", F.when(F.col("trigger") == 1, F.col("forecast_workload") * reserve).otherwise(F.col("forecast_workload")))
