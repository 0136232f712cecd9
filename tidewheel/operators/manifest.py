"""Results of a run on disk, a manifest of them, and their audit from what is read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.columns import is_finite
from tidewheel.sources.trace import file_fingerprints, numeric_columns

FILES, STAGES = "_manifest/files", "_manifest/stages"


def _stage_path(root: str, stage: str) -> str:
    return f"{root}/stages/{stage}"


def _own_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _files(spark: SparkSession, root: str, stages: list[str]) -> DataFrame:
    parts = [file_fingerprints(spark, _stage_path(root, s)).select(F.lit(s).alias("stage"), _own_name(F.col("path")).alias("name"), "length", "sha256") for s in stages]
    return reduce(DataFrame.unionByName, parts)


def store(results: dict[str, DataFrame], root: str) -> None:
    """Write each result as Parquet under ``root``, and beside them what was written: the schema and rows of each stage, the length and SHA-256 of each file."""
    spark = next(iter(results.values())).sparkSession
    for stage, df in results.items():
        df.write.parquet(_stage_path(root, stage))
    kept = [stored(spark, root, s).agg(F.lit(s).alias("stage"), F.lit(df.schema.simpleString()).alias("columns"), F.count("*").alias("rows")) for s, df in results.items()]
    reduce(DataFrame.unionByName, kept).write.parquet(f"{root}/{STAGES}")
    _files(spark, root, list(results)).write.parquet(f"{root}/{FILES}")


def stored(spark: SparkSession, root: str, stage: str) -> DataFrame:
    return spark.read.parquet(_stage_path(root, stage))


def file_faults(spark: SparkSession, root: str) -> DataFrame:
    """(stage, rows, violations) of each stage in the manifest: its rows as read back, and how many files are missing, changed or not listed, plus one each for another schema and another number of rows."""
    listed = spark.read.parquet(f"{root}/{STAGES}")
    stages = {s.stage: s for s in listed.collect()}  # a row for each stage
    old = spark.read.parquet(f"{root}/{FILES}").withColumn("_was", F.lit(1))
    now = _files(spark, root, sorted(stages)).withColumn("_is", F.lit(1))
    differ = old.join(now, ["stage", "name", "length", "sha256"], "full_outer").where("_was IS NULL OR _is IS NULL").groupBy("stage").agg(F.count_distinct("name").alias("_files"))
    parts = []
    for name, s in stages.items():
        df = stored(spark, root, name)
        other = int(df.schema.simpleString() != s["columns"])
        parts.append(df.agg(F.lit(name).alias("stage"), F.count("*").alias("rows"), (F.lit(other) + (F.count("*") != s["rows"]).cast("int")).alias("_other")))
    return reduce(DataFrame.unionByName, parts).join(differ, "stage", "left").select("stage", "rows", (F.coalesce("_files", F.lit(0)) + F.col("_other")).alias("violations"))


def _missing(df: DataFrame) -> Column:
    """Rows with a null in any column, or a number that is not finite."""
    numbers = set(numeric_columns(df))
    bad = [(~is_finite(F.col(c).cast("double")) if c in numbers else F.col(c).isNull()).cast("int") for c in df.columns]
    return F.count_if(F.greatest(*bad, F.lit(0)) == 1)


def forecast_faults(forecasts: DataFrame, key: str) -> DataFrame:
    """(rows, violations): keys that occur more than once, and rows with missing values."""
    keys = forecasts.groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias("_repeated"))
    return forecasts.agg(F.count("*").alias("rows"), _missing(forecasts).alias("_missing")).crossJoin(keys).select("rows", (F.col("_missing") + F.col("_repeated")).alias("violations"))  # one row each


def model_faults(rows: DataFrame, model: str, expected: list[str]) -> DataFrame:
    """(rows, violations): rows of models that are not expected or with missing values, and expected models without rows."""
    known = F.coalesce(F.col(model).isin(*expected), F.lit(False))
    return rows.agg(F.count("*").alias("rows"), (F.count_if(~known) + _missing(rows) + len(expected) - F.count_distinct(F.when(known, F.col(model)))).alias("violations"))


def pairing_faults(rows: DataFrame, forecasts: DataFrame, key: str, model: str, expected: list[str]) -> DataFrame:
    """(rows, violations) over all keys: those that do not have each model once, or are not among the forecasts, or only there."""
    have = rows.groupBy(key).agg(F.count("*").alias("_n"), F.count_distinct(model).alias("_models"))
    both = have.join(forecasts.select(key).distinct().withColumn("_there", F.lit(1)), key, "full_outer")
    right = (F.col("_n") == len(expected)) & (F.col("_models") == len(expected)) & F.col("_there").isNotNull()
    return both.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(right, F.lit(False))).alias("violations"))


def activation_faults(rows: DataFrame, model: str, trigger: str, tolerance: float = 1e-5) -> DataFrame:
    """(rows, violations) over the models: those whose share of triggers differs from that of the first by name, as all share one risk and threshold."""
    share = rows.groupBy(model).agg(F.avg(F.col(trigger).cast("double")).alias("_mean"))
    first = share.agg(F.min_by("_mean", model).alias("_first"))
    return share.crossJoin(F.broadcast(first)).agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.abs(F.col("_mean") - F.col("_first")) <= 1e-8 + tolerance * F.abs("_first"), F.lit(False))).alias("violations"))


def inference_faults(tests: DataFrame, comparisons: int, metrics: int, alpha: float | None = None) -> DataFrame:
    """(rows, violations): tests too many or too few, with missing values, with a p outside 0 to 1 or above its adjusted one, and with ``alpha`` those that are not significant."""
    p, holm = F.col("p_value"), F.col("p_holm")
    wrong = (p < 0) | (holm > 1) | (p > holm + 1e-9)
    if alpha is not None:
        wrong = wrong | (holm >= alpha)
    return tests.agg(F.count("*").alias("rows"), (F.abs(F.count("*") - comparisons * metrics) + _missing(tests) + F.count_if(wrong)).alias("violations"))


def recomputed_faults(stored_figures: DataFrame, recomputed: DataFrame, by: str, tolerance: float = 1e-9) -> DataFrame:
    """(rows, violations) over the groups of both: those that only one has, or with a figure that differs by more than ``tolerance`` of its size (of 1, if smaller)."""
    figures = [c for c in stored_figures.columns if c != by]
    a, b = stored_figures.withColumn("_a", F.lit(1)), recomputed.select(by, *(F.col(c).alias(f"_new_{c}") for c in figures)).withColumn("_b", F.lit(1))

    def near(c: str) -> Column:
        x, y = F.col(c).cast("double"), F.col(f"_new_{c}").cast("double")
        return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x)), F.lit(False))

    right = reduce(Column.__and__, map(near, figures), F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return a.join(b, by, "full_outer").agg(F.count("*").alias("rows"), F.count_if(~right).alias("violations"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, rows, violations, passed); a check of several rows has its stage in its name."""
    parts = []
    for name, df in checks.items():
        label = F.concat(F.lit(f"{name}: "), F.col("stage")) if "stage" in df.columns else F.lit(name)
        parts.append(df.select(label.alias("check"), F.col("rows").cast("long").alias("rows"), F.col("violations").cast("long").alias("violations")))
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)
