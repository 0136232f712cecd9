"""Exact quantiles of groups of any size, by narrowing ranges of values from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.sources.shared import settled

#: Rows up to which a group, or what is left of one, is sorted in one task.
DIRECT = 1 << 18
#: Equal shares that a range is cut into a round.
CUTS = 500
#: Ranges that are sent to all tasks; more are joined by shuffle.
SENT_RANGES = 50_000


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], name: str = "quantiles", direct: int = DIRECT, cuts: int = CUTS, written: bool = False) -> DataFrame:
    """The columns ``by`` and ``name``: for each group the quantiles of ``value``, in the order of ``probabilities``, with linear interpolation.

    Null and NaN values are left out; a group without others gives no row.
    Groups of up to ``direct`` rows are sorted by a plain aggregate. Of larger
    ones no task holds more than a sketch. The order statistics sought lie in an
    open range of values, at first all. A sketch of each range gives values near
    them, exact counts tell which of the smaller ranges holds them or that such
    a value is the one, and a range shrinks to about four of ``cuts`` shares a
    round. A wrong sketch costs rounds, not the result. Ranges of at most
    ``direct`` rows are sorted. ``written`` says that ``df`` is cheap to read
    again.
    """
    by, key = list(by), [F.col(c) for c in by]
    rows = df.select(*key, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    if not by:
        by, rows = ["_all"], rows.withColumn("_all", F.lit(0))
    if not written:
        rows = settled(rows, "quantile-rows")
    plain = F.percentile("_v", F.array(*(F.lit(float(p)) for p in probabilities))).alias(name)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    if sizes.where(F.col("_n") > direct).isEmpty():
        found = rows.groupBy(*by).agg(plain)
        return found.select(*(c for c in by if c != "_all"), name)
    sizes = settled(sizes, "quantile-sizes")
    large, small = sizes.where(F.col("_n") > direct), sizes.where(F.col("_n") <= direct).select(*by)
    whole = _selected(rows, large, by, [float(p) for p in probabilities], name, direct, cuts)
    found = whole.unionByName(rows.join(small, by, "left_semi").groupBy(*by).agg(plain))
    return found.select(*(c for c in by if c != "_all"), name)


def _inside(lo: str = "_lo", hi: str = "_hi") -> Column:
    v = F.col("_v")
    return (F.col(lo).isNull() | (v > F.col(lo))) & (F.col(hi).isNull() | (v < F.col(hi)))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT_RANGES else df


def _selected(rows: DataFrame, large: DataFrame, by: list[str], probabilities: list[float], name: str, direct: int, cuts: int) -> DataFrame:
    wanted = F.explode(F.array(*(F.struct(F.lit(j).alias("_j"), F.lit(p).alias("_p")) for j, p in enumerate(probabilities)))).alias("w")
    places = large.select(*by, "_n", wanted).select(*by, "_n", "w.*").withColumn("_at", F.col("_p") * (F.col("_n") - 1))
    places = places.withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at")})
    # an order statistic sought: its rank, the open range it lies in, rows before and within that range
    none = F.lit(None).cast("double")
    state = settled(places.select(*by, F.explode(F.array("_low", "_high")).alias("_rank"), F.col("_n").alias("_m")).distinct().select(*by, "_rank", none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_before"), "_m", none.alias("_value")), "ranks")
    shares = F.array(*(F.lit(i / cuts) for i in range(cuts + 1)))
    r, a, b = F.col("_rank") - F.col("_before"), F.col("_a"), F.col("_b")
    while True:
        open_ = state.where(F.col("_value").isNull() & (F.col("_m") > direct))
        if open_.isEmpty():
            break
        ranges = open_.select(*by, "_lo", "_hi").distinct()
        near = rows.join(_sent(ranges), by).where(_inside()).groupBy(*by, "_lo", "_hi").agg(F.percentile_approx("_v", shares, 10 * cuts).alias("_cuts"))
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*by, "_lo", "_hi")]
        met = open_.alias("s").join(near.alias("n"), same).select("s.*", "n._cuts")
        place = F.floor(r * cuts / F.col("_m")).cast("int")
        pivots = met.select(*by, "_rank", "_lo", "_hi", "_before", "_m", F.get("_cuts", F.greatest(F.lit(0), place - 1)).alias("_a"), F.get("_cuts", F.least(F.lit(cuts), place + 2)).alias("_b"))
        pivots = settled(pivots, "pivots")
        v = F.col("_v")
        held = rows.join(_sent(pivots.select(*by, "_rank", "_lo", "_hi", "_a", "_b")), by).where(_inside())
        counts = held.groupBy(*by, "_rank").agg(F.count_if(v < a).alias("_la"), F.count_if(v <= a).alias("_ua"), F.count_if(v < b).alias("_lb"), F.count_if(v <= b).alias("_ub"))
        la, ua, lb, ub = (F.col(c) for c in ("_la", "_ua", "_lb", "_ub"))

        def pick(*five: Column) -> Column:
            return F.when(r < la, five[0]).when(r < ua, five[1]).when(r < lb, five[2]).when(r < ub, five[3]).otherwise(five[4])

        lo, hi, before, m, zero = F.col("_lo"), F.col("_hi"), F.col("_before"), F.col("_m"), F.lit(0).cast("long")
        moved = pivots.join(counts, [*by, "_rank"]).select(
            *by,
            "_rank",
            pick(lo, lo, a, a, b).alias("_lo"),
            pick(a, hi, b, hi, hi).alias("_hi"),
            (before + pick(zero, zero, ua, zero, ub)).alias("_before"),
            pick(la, m, lb - ua, m, m - ub).alias("_m"),
            pick(none, a, none, b, none).alias("_value"),
        )
        state = settled(state.where(F.col("_value").isNotNull() | (F.col("_m") <= direct)).unionByName(moved), "ranks")
    left = rows.join(_sent(state.where("_value IS NULL").select(*by, "_rank", "_lo", "_hi", "_before")), by).where(_inside())
    counted = left.groupBy(*by, "_rank", "_before", "_v").agg(F.count("*").alias("_k"))
    # a range that is left has at most ``direct`` rows
    upto = F.sum("_k").over(Window.partitionBy(*by, "_rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    hit = counted.withColumn("_upto", upto).where((r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_k"))).select(*by, "_rank", F.col("_v").alias("_value"))
    ranks = settled(state.where("_value IS NOT NULL").select(*by, "_rank", "_value").unionByName(hit), "order-statistics")
    both = places.join(ranks.withColumnsRenamed({"_rank": "_low", "_value": "_x"}), [*by, "_low"]).join(ranks.withColumnsRenamed({"_rank": "_high", "_value": "_y"}), [*by, "_high"])
    between = F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise((F.col("_high") - F.col("_at")) * F.col("_x") + (F.col("_at") - F.col("_low")) * F.col("_y"))
    one = both.select(*by, F.struct("_j", between.alias("_q")).alias("_s"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_q"]).alias(name))  # one entry a probability
