"""Results written to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset, in a local session, one of our own is set.

    On a cluster without that setting this is a ValueError: executors would
    write to disks that others cannot read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints/tidewheel"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read again, where several results are made of it."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Jobs that one call hands to Spark at once.
AT_ONCE = 8


def side_by_side(*calls: Callable) -> list:
    """What the calls return, made at the same time: independent fits, each of many short jobs."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(lambda call: call(), calls))
