"""Reading and writing traces: schemas, column guards, fingerprints, and the adapter of an event table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote, urlparse

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A request trace: seconds since an anonymised origin, model, token counts and the kind of log.
TRACE_SCHEMA = T.StructType(
    [
        T.StructField("ts_s", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("request_tokens", T.LongType()),
        T.StructField("response_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("log_type", T.StringType()),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, or ValueError that names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate that ``df`` has, whatever its case; ValueError if there is none."""
    have = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in have:
            return have[name.lower()]
    raise ValueError(f"none of the columns {', '.join(candidates)}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TRACE_SCHEMA) -> DataFrame:
    """A CSV table with a header; values that do not fit the schema are null."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Bytes that a file is read by.
STEP = 1 << 20


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file under ``path``, read in steps of 1 MiB: a task holds one step, however long the file.

    Spark lists the files and deals them out by length without reading them. As
    in all its scans, files without bytes, and those whose names begin with a
    dot or underscore, are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[_sha256(uri) for uri in batch["path"]])

    return files.mapInPandas(digests, "path string, length long, sha256 string")


def _sha256(uri: str) -> str:
    # local URIs come with one slash and percent signs, which the file system does not know
    place = unquote(urlparse(uri).path) if uri.startswith("file:") else None
    files, name = (fs.LocalFileSystem(), place) if place else fs.FileSystem.from_uri(uri)
    digest = hashlib.sha256()
    with files.open_input_stream(name) as stream:
        while step := stream.read(STEP):
            digest.update(step)
    return digest.hexdigest()


def coerced(column: Column) -> Column:
    """The value as a number, null where it is none."""
    return column.try_cast("double")


def events_as_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's event table read as a request trace."""
    ts = F.col("ts")
    second = F.datediff(F.to_date(ts), F.lit("2024-01-01")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    answer = F.when(F.col("event_type") == "error", F.lit(0).cast("long")).otherwise(F.regexp_extract("props", "([0-9]+)", 1).cast("long") + 1)
    asked = F.floor("value").cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        second.alias("ts_s"),
        F.when(F.col("event_type") == "purchase", "GPT-4").otherwise("ChatGPT").alias("model"),
        asked.alias("request_tokens"),
        answer.alias("response_tokens"),
        (asked + answer).alias("total_tokens"),
        F.when(F.col("event_type").isin("view", "click"), "API log").otherwise("Conversation log").alias("log_type"),
    )


EVENTS_AS_TRACE_SQL = """trace AS (
    SELECT sec AS ts_s, model, asked AS request_tokens, answered AS response_tokens, asked + answered AS total_tokens, log_type FROM (
        SELECT epoch_us(ts) // 1000000 - 1704067200 AS sec,
               CASE WHEN event_type = 'purchase' THEN 'GPT-4' ELSE 'ChatGPT' END AS model,
               CAST(floor(value) AS BIGINT) AS asked,
               CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 END AS answered,
               CASE WHEN event_type IN ('view', 'click') THEN 'API log' ELSE 'Conversation log' END AS log_type
        FROM events) x)"""
