"""Metrics of forecasts and risk scores as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.columns import quotient, rounded
from tidewheel.operators.windows import running_totals

#: Left edges of ten equal bins, as literals, so that both engines cut alike.
EDGES = tuple(i / 10 for i in range(1, 10))


def forecast_errors(actual: Column, predicted: Column) -> list[Column]:
    """MAE, RMSE, WAPE %, sMAPE % (rows of 0 against 0 left out) and bias."""
    e, size = predicted - actual, F.abs(actual) + F.abs(predicted)
    return [
        F.count("*").alias("n"),
        rounded(F.avg(F.abs(e))).alias("mae"),
        rounded(F.sqrt(F.avg(e * e))).alias("rmse"),
        rounded(100 * F.sum(F.abs(e)) / F.sum(F.abs(actual))).alias("wape_percent"),
        rounded(100 * F.avg(F.when(size > 0, 2 * F.abs(e) / size))).alias("smape_percent"),
        rounded(F.avg(e)).alias("mean_bias"),
    ]


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows and positives of each distinct score; the curves need no more."""
    return df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the tie-aware area under the ROC curve, NaN if there are only positives or only negatives, null without rows."""
    c = running_totals(score_counts(df, score, label).withColumn("neg", F.col("n") - F.col("pos")), "s", ["neg"])
    parts = c.select("pos", "neg", (F.col("pos") * (F.col("_before_neg") + F.col("neg") / 2)).alias("won"))
    # as double: the number of pairs can exceed a long
    return parts.agg(rounded(quotient(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the sum of precision times gained recall over distinct scores, from the highest on; NaN without positives, null without rows."""
    # from the highest score on is from the lowest negative score on
    c = running_totals(score_counts(df, score, label).withColumn("s", -F.col("s")), "s", ["pos", "n"])
    precision = (F.col("_before_pos") + F.col("pos")) / (F.col("_before_n") + F.col("n"))
    steps = c.select("pos", precision.alias("precision"))
    return steps.agg(rounded(quotient(F.sum(F.col("precision") * F.col("pos")), F.sum("pos"))).alias("average_precision"))


def ece_bins(df: DataFrame, score: str, label: str, digits: int | None = 6) -> DataFrame:
    """bin (1 to 10, left-closed, the last closed), n, confidence and accuracy (rounded unless ``digits`` is None) of each bin that has rows."""
    number = F.lit(1)
    for edge in EDGES:
        number = number + (F.col(score) >= edge).cast("int")
    return df.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), *((mean if digits is None else rounded(mean, digits)).alias(name) for name, mean in (("confidence", F.avg(score)), ("accuracy", F.avg(F.col(label).cast("double"))))))


def risk_metrics(df: DataFrame, score: str, label: str, threshold: float, inclusive: bool = False, clip: float = 1e-7) -> DataFrame:
    """One row: prevalence, Brier score, log loss, precision, recall and F1 (0 where undefined)."""
    p, y = F.col(score), F.col(label).cast("double")
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    hit = p >= threshold if inclusive else p > threshold
    c = df.agg(
        F.count("*").alias("n"),
        rounded(F.avg(y)).alias("prevalence"),
        rounded(F.avg((p - y) * (p - y))).alias("brier"),
        rounded(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))).alias("log_loss"),
        F.count_if(hit & (y == 1)).alias("tp"),
        F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"),
    )
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return c.select("n", "prevalence", "brier", "log_loss", rounded(precision).alias("precision"), rounded(recall).alias("recall"), rounded(f1).alias("f1"))
