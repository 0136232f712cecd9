"""Causal windows over a gap-free series.

A window over one long series would bring it to a single task. Here a series is
cut into blocks of consecutive keys, each with the rows before it that its
windows reach back to (and one row ahead where needed), so every block is a task
of its own and results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.sources.shared import settled

BLOCK_ROWS = 1 << 14


class Blocks:
    """A frame cut into blocks along an integer key without gaps, and window expressions within them."""

    def __init__(self, df: DataFrame, key: str, back: int, ahead: int = 0, block_rows: int = BLOCK_ROWS, series: Sequence[str] = ()):
        block_rows = max(block_rows, back, ahead)
        self.key, self.series = key, list(series)
        own = F.floor(F.col(key) / F.lit(block_rows)).cast("long")
        low = F.floor((F.col(key) - ahead) / F.lit(block_rows)).cast("long")
        high = F.floor((F.col(key) + back) / F.lit(block_rows)).cast("long")
        self.frame = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(low, high)))
        self.window = Window.partitionBy(*self.series, "_block").orderBy(key)

    def rows(self, first: int, last: int) -> Window:
        return self.window.rowsBetween(first, last)

    def lag(self, column: str, k: int) -> Column:
        return F.lag(column, k).over(self.window)

    def lead(self, column: str, k: int = 1) -> Column:
        return F.lead(column, k).over(self.window)

    def full(self, value: Column, column: str, first: int, last: int) -> Column:
        """``value`` over the frame, null unless the frame has all its rows and no null."""
        over = self.rows(first, last)
        return F.when(F.count(column).over(over) == last - first + 1, value.over(over))

    def past(self, value: Column, column: str, n: int) -> Column:
        """``value`` over the ``n`` rows before the current one."""
        return self.full(value, column, -n, -1)

    def running(self, *columns: str) -> None:
        """Add sums of all earlier rows of the block, for :meth:`past_sum`."""
        before = self.window.rowsBetween(Window.unboundedPreceding, -1)
        self.frame = self.frame.withColumns({f"_sum_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns})

    def past_sum(self, column: str, n: int) -> Column:
        """Sum of the ``n`` rows before the current one as a difference of running sums, whatever ``n`` costs the same.

        Null unless there are so many rows; the column must have no nulls.
        """
        return F.col(f"_sum_{column}") - F.lag(f"_sum_{column}", n).over(self.window)

    def quantiles(self, column: str, first: int, last: int, probabilities: Sequence[float], name: str) -> None:
        """Add ``name``0, ``name``1, ...: exact quantiles of ``column`` over the rows from ``first`` to ``last`` (at most 0), null unless the frame has all its rows.

        The window slides over a block's rows in an ordered list that takes up
        one value and drops another a row, so a row costs the logarithm of the
        window. Null, NaN and infinite values count as missing.
        """
        key, names = self.key, [f"{name}{i}" for i in range(len(probabilities))]

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by(key)
            slide = pd.Series(table[column].to_numpy()).astype(float).rolling(last - first + 1)
            for label, p in zip(names, probabilities, strict=True):
                table = table.append_column(label, pa.array(slide.quantile(p).shift(-last), pa.float64(), from_pandas=True))
            return table

        schema = T.StructType([*self.frame.schema.fields, *(T.StructField(label, T.DoubleType()) for label in names)])
        self.frame = self.frame.groupBy(*self.series, "_block").applyInArrow(run, schema)

    def result(self, *columns) -> DataFrame:
        """The named columns, each row once."""
        return self.frame.select(*columns, "_own", "_block").where("_own = _block").drop("_own", "_block")


def running_totals(df: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_before_<c>`` for each of ``columns``: its sum over the rows with a smaller ``order`` in the group.

    Rows are dealt out by ranges and written, so that ranges stay as they are.
    Sums are made within each range and moved by the sums of the ranges before,
    of which there is a row for each range and group. ``order`` is unique in a group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    held = ranged.groupBy("_part", *by).agg(*(F.sum(c).alias(f"_all_{c}") for c in columns))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.select("_part", *by, *(F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_all_{c}") for c in columns))
    inside = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"_before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    out = local.join(F.broadcast(moved), ["_part", *by])
    return out.withColumns({f"_before_{c}": F.col(f"_before_{c}") + F.col(f"_all_{c}") for c in columns}).drop("_part", *(f"_all_{c}" for c in columns))
