"""Paired inference: Holm adjustment, block and IID bootstrap, Wilcoxon's signed-rank test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.columns import rounded
from tidewheel.operators.selection import exact_quantiles
from tidewheel.operators.windows import running_totals
from tidewheel.sources.shared import settled

#: Multiplier, increment and modulus of the start generator, small enough for exact 64-bit products.
LCG = (1103515245, 12345, 2147483648)


def holm(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p-values within each family (all rows are one without ``by``)."""
    family = [F.lit(0)] if by is None else [F.col(c) for c in by]
    # families are a handful of tests
    order = Window.partitionBy(*family).orderBy(p)
    ranked = tests.withColumn("_raw", (F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(order) + 1) * F.col(p))
    return ranked.withColumn("p_holm", F.least(F.lit(1.0), F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def block_bootstrap(pairs: DataFrame, key: str, difference: str, replicates: int = 2000, block: int = 288) -> DataFrame:
    """replicate and mean of ``difference`` under the moving-block bootstrap of an ordered series.

    A replicate is made of blocks of consecutive rows, the last cut so that it
    has as many rows as the series. A block's sum is a difference of two prefix
    sums, so no row is repeated. Block starts come from a fixed generator.
    """
    return block_bootstraps(pairs.select(F.lit(0).alias("_test"), key, difference), ["_test"], key, difference, replicates, block).drop("_test")


def block_bootstraps(pairs: DataFrame, by: list[str], key: str, difference: str, replicates: int = 2000, block: int = 288) -> DataFrame:
    """:func:`block_bootstrap` of each of several series, with the same block starts for series of equal length."""
    spark = pairs.sparkSession
    own = pairs.select(*by, F.col(key).alias("_key"), F.col(difference).alias("_d"), F.lit(1).cast("long").alias("_one"))
    totals = running_totals(own, "_key", ["_one", "_d"], by)
    ranked = totals.select(*by, (F.col("_before__one") + 1).alias("i"), (F.col("_before__d") + F.col("_d")).alias("c"))
    ranked = settled(ranked.unionByName(totals.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("c"))), "prefix-sums")
    # a row for each series
    sizes = ranked.groupBy(*by).agg(F.max("i").alias("n")).withColumn("size", F.least(F.lit(block), F.col("n"))).withColumn("blocks", F.ceil(F.col("n") / F.col("size")))
    a, c, m = LCG
    starts = spark.range(replicates).select(F.col("id").alias("replicate")).crossJoin(F.broadcast(sizes)).select(*by, "replicate", "n", "size", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    seed = (F.col("replicate") * F.col("blocks") + F.col("k") + 1) * 48271 % m
    start = ((seed * a + c) % m) % (F.col("n") - F.col("size") + 1)
    starts = starts.select(*by, "replicate", "n", start.alias("lo"), (start + F.least(F.col("size"), F.col("n") - F.col("k") * F.col("size"))).alias("hi"))
    low, high = ranked.select(*by, F.col("i").alias("lo"), F.col("c").alias("c0")), ranked.select(*by, F.col("i").alias("hi"), F.col("c").alias("c1"))
    return starts.join(low, [*by, "lo"]).join(high, [*by, "hi"]).groupBy(*by, "replicate").agg((F.sum(F.col("c1") - F.col("c0")) / F.first("n")).alias("mean"))


def bootstrap_summary(replicates: DataFrame, value: str = "mean", level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """Percentile interval and two-sided sign p-value: one row, or one for each group."""
    tail = (1 - level) / 2
    upper, lower = F.avg((F.col(value) >= 0).cast("double")), F.avg((F.col(value) <= 0).cast("double"))
    return replicates.groupBy(*(by or [])).agg(
        rounded(F.percentile(value, tail)).alias("ci_low"),
        rounded(F.percentile(value, 1 - tail)).alias("ci_high"),
        rounded(F.least(F.lit(1.0), 2 * F.least(upper, lower))).alias("p_value"),
    )


#: Differences up to which p is exact, if no two are of the same size.
EXACT = 50


def exact_p(n: int, statistic: float) -> float:
    """Two-sided p of a signed-rank statistic: the share of all sign patterns of ranks 1 to n with a sum that is as small, doubled."""
    patterns = np.zeros(n * (n + 1) // 2 + 1)
    patterns[0] = 1.0
    for rank in range(1, n + 1):
        patterns[rank:] += patterns[:-rank].copy()
    return min(1.0, 2.0 * float(patterns[: int(statistic) + 1].sum()) / 2.0**n)


def wilcoxon(pairs: DataFrame, difference: str) -> DataFrame:
    """One row: nonzero differences, W+, W-, statistic, z and two-sided p of the signed-rank test.

    Zeros are left out and ties share their mean rank. Differences are counted
    by size first, so ranks are made over distinct sizes. z follows the normal
    approximation with tie correction, and so does p beyond ``EXACT``
    differences or where sizes are tied; else p is exact. Without differences
    the statistic is 0 and p is 1.
    """
    d = pairs.where(F.col(difference) != 0).groupBy(F.abs(difference).alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col(difference) > 0).alias("up"))
    ranked = running_totals(d, "d", ["n"]).withColumn("rank", F.col("_before_n") + (F.col("n") + 1) / 2)
    sums = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("up") * F.col("rank")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum((F.col("n") - F.col("up")) * F.col("rank")), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.pow("n", F.lit(3)) - F.col("n")), F.lit(0.0)).alias("ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    stat = F.least("w_plus", "w_minus")
    z = F.when(spread > 0, (stat - n * (n + 1) / 4) / spread).otherwise(0.0)

    @F.pandas_udf("double")
    def two_sided(values: pd.Series, n: pd.Series, statistic: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([exact_p(int(k), w) if 0 < k <= EXACT and t == 0 else math.erfc(abs(v) / math.sqrt(2)) for v, k, w, t in zip(values, n, statistic, ties, strict=True)], dtype=float)

    return sums.select("n", "w_plus", "w_minus", stat.alias("statistic"), rounded(z).alias("z"), rounded(two_sided(z, "n", stat, "ties")).alias("p_value"))


def iid_bootstrap(pairs: DataFrame, difference: str, replicates: int = 10_000, seed: int = 42, chunk: int = 250) -> DataFrame:
    """replicate and mean under the IID bootstrap."""
    return iid_bootstraps(pairs.select(F.lit(0).alias("_test"), difference), ["_test"], difference, replicates, seed, chunk).drop("_test")


#: Distinct values that a task draws from, and the most parts of a group; beyond both, parts grow.
PART_VALUES, MOST_PARTS = 1 << 14, 1 << 13
#: Cells of a table of draws that a task holds at once.
CELLS = 1 << 20


def draw_sums(values: np.ndarray, weights: np.ndarray, many: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each of ``many`` the sum of so many draws, each from ``values`` by ``weights``.

    Few draws are made one by one; more are made as how often each value comes,
    so copies of a value cost nothing.
    """
    sums, share, upto = np.empty(len(many)), weights / weights.sum(), np.cumsum(weights)
    step = max(1, CELLS // len(values))
    for begin in range(0, len(many), step):
        part = many[begin : begin + step]
        if part.max(initial=0) <= 4 * len(values):
            drawn = values[np.searchsorted(upto, rng.integers(0, upto[-1], int(part.sum())), side="right")]
            ends = np.concatenate([[0.0], np.cumsum(drawn)])[np.concatenate([[0], np.cumsum(part)])]
            sums[begin : begin + step] = np.diff(ends)
        else:
            sums[begin : begin + step] = rng.multinomial(part, share) @ values
    return sums


def iid_bootstraps(pairs: DataFrame, by: list[str], difference: str, replicates: int = 10_000, seed: int = 42, chunk: int = 250, part_values: int = PART_VALUES) -> DataFrame:
    """The columns ``by``, replicate and mean of the IID bootstrap of each group; null differences are left out.

    Values are counted first. A group's distinct values are dealt out to parts
    by their hash. A replicate draws as many rows as the group has: first how
    many from each part, by a multinomial draw that all parts of the group make
    alike from its parts' sizes, then values within the part. So no group is in
    one task, and a value that a third of the rows have is one entry.
    """
    counted = settled(pairs.select(*by, F.col(difference).cast("double").alias("_d")).where("_d IS NOT NULL").groupBy(*by, "_d").agg(F.count("*").alias("_k")), "values")
    groups = counted.groupBy(*by).agg(F.least(F.lit(MOST_PARTS), F.ceil(F.count("*") / part_values)).cast("int").alias("_parts"))
    dealt = settled(counted.join(groups, by).withColumn("_part", F.pmod(F.xxhash64("_d"), F.col("_parts")).cast("int")), "parts")
    held = dealt.groupBy(*by, "_part").agg(F.sum("_k").alias("_w"))
    # at most MOST_PARTS numbers a group
    sizes = held.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_part", "_w"))).alias("_sizes"), F.sum("_w").alias("_n"))
    sizes = sizes.select(*by, "_n", F.transform("_sizes", lambda s: s["_part"]).alias("_names"), F.transform("_sizes", lambda s: s["_w"]).alias("_weights"), F.crc32(F.to_json(F.struct(*by))).alias("_seed"))
    entries = dealt.groupBy(*by, "_part").agg(F.array_sort(F.collect_list(F.struct("_d", "_k"))).alias("_held"))  # about part_values entries
    chunks = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(replicates / chunk) - 1))).alias("_chunk")
    work = entries.select(*by, "_part", F.transform("_held", lambda e: e["_d"]).alias("_values"), F.transform("_held", lambda e: e["_k"]).alias("_counts")).join(sizes, by)
    work = work.select(*by, "_part", "_n", "_names", "_weights", "_seed", "_values", "_counts", chunks)
    work = work.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_part", "_chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)

                def array(name: str, row=row) -> np.ndarray:
                    return row[name].flatten().to_numpy(zero_copy_only=False)

                chunk_no, part, own_seed, n = (row[c][0].as_py() for c in ("_chunk", "_part", "_seed", "_n"))
                begin = chunk_no * chunk
                count, weights = min(chunk, replicates - begin), array("_weights")
                place = int(np.searchsorted(array("_names"), part))
                shared = np.random.default_rng([seed, own_seed, chunk_no])
                many = np.array([shared.multinomial(n, weights / weights.sum())[place] for _ in range(count)])
                sums = draw_sums(array("_values"), array("_counts"), many, np.random.default_rng([seed, own_seed, chunk_no, part + 1]))
                same = [pa.concat_arrays([row[c]] * count) for c in by]
                yield pa.RecordBatch.from_arrays([*same, pa.array(begin + np.arange(count)), pa.array(sums / n)], names=[*by, "replicate", "_s"])

    fields = [f for f in pairs.select(*by).schema]
    schema = T.StructType([*fields, T.StructField("replicate", T.LongType()), T.StructField("_s", T.DoubleType())])
    return work.mapInArrow(run, schema).groupBy(*by, "replicate").agg(F.sum("_s").alias("mean"))


def paired_differences(long: DataFrame, key: str, model: str, metrics: list[str]) -> DataFrame:
    """For each unordered pair of models, metric and key: model_a, model_b, metric, key, difference (a - b).

    The models are a handful, so each row meets its partners of the same key;
    keys that a model lacks give no pair.
    """
    a = long.select(key, F.col(model).alias("model_a"), *(F.col(m).alias(f"a_{m}") for m in metrics))
    b = long.select(key, F.col(model).alias("model_b"), *(F.col(m).alias(f"b_{m}") for m in metrics))
    both = a.join(b, key).where("model_a < model_b")
    parts = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(f"a_{m}") - F.col(f"b_{m}")).alias("difference")) for m in metrics))).alias("p")
    return both.select(key, "model_a", "model_b", parts).select("model_a", "model_b", "p.metric", key, "p.difference")


def pairing_violations(long: DataFrame, key: str, model: str) -> DataFrame:
    """One row: (key, model) groups of more than one row, and keys that do not have all models."""
    groups = long.groupBy(key, model).count()
    models = long.agg(F.count_distinct(model).alias("m"))  # one row
    keys = groups.groupBy(key).agg(F.count("*").alias("have"), F.count_if(F.col("count") > 1).alias("repeated"))
    return keys.crossJoin(F.broadcast(models)).agg(F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated"), F.count_if(F.col("have") != F.col("m")).alias("incomplete_keys"))


def paired_statistics(differences: DataFrame) -> DataFrame:
    """For each pair and metric: n, mean and median difference, W+ and W- of the signed ranks (mean ranks for ties)."""
    by = ["model_a", "model_b", "metric"]
    differences = settled(differences.select(*by, "difference"), "differences")
    middle = exact_quantiles(differences, by, "difference", [0.5], written=True).select(*by, rounded(F.col("quantiles")[0]).alias("median_difference"))
    plain = differences.groupBy(*by).agg(F.count("*").alias("n"), rounded(F.avg("difference")).alias("mean_difference")).join(middle, by)
    sizes = differences.where("difference <> 0").groupBy(*by, F.abs("difference").alias("d")).agg(F.count("*").alias("k"), F.count_if(F.col("difference") > 0).alias("up"))
    ranked = running_totals(sizes, "d", ["k"], by).withColumn("rank", F.col("_before_k") + (F.col("k") + 1) / 2)
    ranks = ranked.groupBy(*by).agg(rounded(F.sum(F.col("up") * F.col("rank")), 3).alias("w_plus"), rounded(F.sum((F.col("k") - F.col("up")) * F.col("rank")), 3).alias("w_minus"))
    return plain.join(ranks, by, "left").na.fill(0.0, ["w_plus", "w_minus"])


def paired_bootstrap(differences: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """model_a, model_b, metric, replicate and mean under the IID bootstrap of each pair and metric."""
    return iid_bootstraps(differences, ["model_a", "model_b", "metric"], "difference", replicates, seed)


def paired_tests(differences: DataFrame, replicates: int = 10_000, level: float = 0.95) -> DataFrame:
    """:func:`paired_statistics` with statistic, two-sided p of the signed ranks, bootstrap interval, and p adjusted by Holm within each metric.

    p follows the normal approximation with tie correction and is not rounded.
    """
    by = ["model_a", "model_b", "metric"]
    sizes = differences.where("difference <> 0").groupBy(*by, F.abs("difference").alias("d")).agg(F.count("*").cast("double").alias("k"))
    ties = sizes.groupBy(*by).agg(F.sum("k").alias("_n"), F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("_ties"))
    tail = (1 - level) / 2
    interval = paired_bootstrap(differences, replicates).groupBy(*by).agg(rounded(F.percentile("mean", tail)).alias("ci_low"), rounded(F.percentile("mean", 1 - tail)).alias("ci_high"))
    rows = paired_statistics(differences).join(ties, by, "left").na.fill(0.0, ["_n", "_ties"]).withColumn("statistic", F.least("w_plus", "w_minus"))
    n = F.col("_n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    z = F.when(spread > 0, (F.col("statistic") - n * (n + 1) / 4) / spread).otherwise(0.0)

    @F.pandas_udf("double")
    def two_sided(values: pd.Series) -> pd.Series:
        return values.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))

    return holm(rows.withColumn("p_value", two_sided(z)).drop("_n", "_ties").join(interval, by), "p_value", ["metric"])
