"""Profiles and audits of traces and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.columns import is_finite, rounded
from tidewheel.operators.selection import exact_quantiles
from tidewheel.sources.shared import settled
from tidewheel.sources.trace import coerced


def raw_profile(trace: DataFrame) -> DataFrame:
    """One row of counters and totals of a request trace."""
    c = F.col
    return trace.agg(
        F.count("*").alias("rows"),
        F.count_if(F.greatest(*(c(x).isNull().cast("int") for x in trace.columns)) == 1).alias("rows_with_null"),
        F.count_if((c("request_tokens") < 0) | (c("response_tokens") < 0) | (c("total_tokens") < 0)).alias("negative_rows"),
        F.count_if(c("total_tokens") != c("request_tokens") + c("response_tokens")).alias("token_mismatch"),
        F.count_if(c("response_tokens") == 0).alias("zero_response_rows"),
        F.min("ts_s").alias("first_second"),
        F.max("ts_s").alias("last_second"),
        F.sum("request_tokens").alias("request_tokens"),
        F.sum("response_tokens").alias("response_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
    )


def backward_steps(trace: DataFrame, order: str, value: str = "ts_s") -> DataFrame:
    """One row: how many rows have a smaller ``value`` than the row before them by ``order``.

    Rows are dealt out by ranges of ``order``. Within a range each row is
    compared with the one before it; across ranges the ends are compared.
    """
    parts = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = trace.select(order, value).repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    inside = ranged.withColumn("_was", F.lag(value).over(Window.partitionBy("_part").orderBy(order)))
    summary = inside.groupBy("_part").agg(F.count_if(F.col(value) < F.col("_was")).alias("steps"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    # a row for each range
    ends = summary.withColumn("_was", F.lag("last").over(Window.orderBy("_part")))
    return ends.agg((F.coalesce(F.sum("steps"), F.lit(0)) + F.count_if(F.col("first") < F.col("_was"))).alias("backward_steps"))


def duplicate_census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows in groups of equal rows, and how many such patterns there are."""
    groups = df.groupBy(*(columns or df.columns)).count().where("count > 1")
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows_in_duplicate_groups"), F.count("*").alias("duplicate_patterns"))


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of each value of each column, in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")
    return df.select(pairs).groupBy(F.col("p.column").alias("column"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


def profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, uncoercible, least, mean, median, most): for each column its null values, values that are no numbers, and the spread of the others."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns))).alias("p")
    rows = settled(df.select(pairs).select("p.column", "p.text", coerced(F.col("p.text")).alias("x")), "values")
    middle = exact_quantiles(rows, ["column"], "x", [0.5], written=True).select("column", rounded(F.col("quantiles")[0]).alias("median"))
    spread = rows.groupBy("column").agg(
        F.count_if(F.col("text").isNull()).alias("nulls"),
        F.count_if(F.col("text").isNotNull() & F.col("x").isNull()).alias("uncoercible"),
        rounded(F.min("x")).alias("least"),
        rounded(F.avg("x")).alias("mean"),
        rounded(F.max("x")).alias("most"),
    )
    return spread.join(middle, "column", "left").select("column", "nulls", "uncoercible", "least", "mean", "median", "most")


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``, or ValueError if a key occurs twice."""
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"key {', '.join(key)} is not unique")
    return df


def one_to_one(a: DataFrame, b: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b``, or ValueError if a key occurs twice on either side."""
    return assert_unique(a, key).join(assert_unique(b, key), key, how)


def aligned(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """:func:`one_to_one`, or ValueError if the sides do not have the same keys."""
    if not same_keys(a, b, key):
        raise ValueError(f"the sides differ in {', '.join(key)}")
    return one_to_one(a, b, key)


def _demand(condition: Column, message: str) -> Column:
    """A filter that keeps all rows, and ends the query with ``message`` at the first row without ``condition``."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``; the query that reads it fails if a key occurs twice.

    Rows are numbered within their key on the partitions that a join on the key
    needs anyway, so nothing is computed twice. A null is a value of its own.
    Rows that the query never needs are not checked: those that its filters on
    the key leave out, or all of them if it joins them with an empty table.
    """
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    return df.withColumn("_number", number).where(_demand(F.col("_number") == 1, f"key {', '.join(key)} is not unique")).drop("_number")


def joined_once(a: DataFrame, b: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """:func:`one_to_one` that checks while it joins; the query that reads it fails instead of this call."""
    return unique(a, key).join(unique(b, key), key, how)


def aligned_once(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """:func:`aligned` that checks while it joins; the query that reads it fails instead of this call."""
    left, right = unique(a, key).withColumn("_a", F.lit(1)), unique(b, key).withColumn("_b", F.lit(1))
    both = left.join(right, key, "full_outer")
    return both.where(_demand(F.col("_a").isNotNull() & F.col("_b").isNotNull(), f"the sides differ in {', '.join(key)}")).drop("_a", "_b")


def finite(df: DataFrame, columns: list[str], label: str = "rows") -> DataFrame:
    """``df``; the query that reads it fails if one of ``columns`` is null, NaN or infinite."""
    for c in columns:
        df = df.where(_demand(is_finite(F.col(c).cast("double")), f"{label}: {c} has missing values"))
    return df


def same_keys(a: DataFrame, b: DataFrame, key: list[str]) -> bool:
    """Whether both have the same keys, each as often."""
    both = a.select(*key, F.lit(1).alias("_side")).unionByName(b.select(*key, F.lit(-1).alias("_side")))
    return both.groupBy(*key).agg(F.sum("_side").alias("_more")).where("_more <> 0").isEmpty()


def split_violations(rows: DataFrame, key: str, columns: list[str], split: str = "split") -> DataFrame:
    """(split, rows, first, last, missing, out_of_order) of each split: rows with a null or NaN among ``columns``, and whether it begins before an earlier split ends."""
    order = F.array_position(F.array(*(F.lit(s) for s in ("train", "calibration", "test"))), F.lower(F.trim(F.col(split))))
    bad = F.greatest(*((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in columns), F.lit(0))
    parts = rows.groupBy(F.lower(F.trim(F.col(split))).alias("split"), order.alias("_o")).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"), F.sum(bad).alias("missing"))
    # three rows
    return parts.withColumn("out_of_order", F.coalesce(F.col("first") <= F.max("last").over(Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).drop("_o")


def bound_violations(rows: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, rows, outside, missing) of each column: values outside its closed bounds, and null or NaN ones."""
    held = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for c, (a, b) in bounds.items()))).alias("p")
    x = F.col("x")
    missing = x.isNull() | F.isnan(x)
    return rows.select(held).select("p.*").groupBy("column").agg(F.count("*").alias("rows"), F.count_if(~missing & ((x < F.col("a")) | (x > F.col("b")))).alias("outside"), F.count_if(missing).alias("missing"))


def causality_violations(features: DataFrame, view: DataFrame, key: str = "bucket", y: str = "total_tokens", lags: tuple[int, ...] = (1,)) -> DataFrame:
    """One row: feature rows whose lag of any of ``lags`` or whose target differs from the row that it stands for."""
    expected = [*(f"_lag_{k}" for k in lags), "_after"]
    shifts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(step).cast("long").alias("step")) for i, step in enumerate([*lags, -1])))
    # each row of the view is sent to the rows that it should be seen from, once for all shifts
    seen = view.select(F.col(key), F.col(y).alias("_y"), F.explode(shifts).alias("s")).select((F.col(key) + F.col("s.step")).alias(key), F.col("s.i").alias("_i"), "_y")
    seen = seen.groupBy(key).agg(*(F.max(F.when(F.col("_i") == i, F.col("_y"))).alias(n) for i, n in enumerate(expected)))
    joined = features.select(key, *(f"lag_{k}" for k in lags), "target_next_5min").join(seen, key, "left")
    wrong = F.greatest(*((~F.col(f"lag_{k}").eqNullSafe(F.col(f"_lag_{k}"))).cast("int") for k in lags), F.lit(0))
    return joined.agg(F.count("*").alias("rows"), F.count_if(wrong == 1).alias("wrong_lag"), F.count_if(~F.col("target_next_5min").eqNullSafe(F.col("_after"))).alias("wrong_target"))


def alarm_spacing(points: DataFrame, gap: int) -> DataFrame:
    """One row: alarms, the smallest distance between two, and alarms closer than ``gap``."""
    a = points.where("change_alarm = 1").select("position")
    steps = a.withColumn("step", F.col("position") - F.lag("position").over(Window.orderBy("position")))
    return steps.agg(F.count("*").alias("alarms"), F.min("step").alias("least_step"), F.count_if(F.col("step") < gap).alias("too_close"))
