"""What the operators of this subpackage share: shared storage and Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.memory import only

#: Text bytes that one numpy pass takes at once; bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20
#: Bytes that go to a Python worker at once, unless one row has more; by default Spark sends eight times as many.
BATCH_BYTES = 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset in a
    local session a folder of our own is chosen and set; on a cluster that is a
    ValueError, as executors would write to disks that others cannot read.
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


def stored(df: DataFrame, label: str, session: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, in another ``session`` if one is given.

    This cuts the lineage: what follows survives the loss of any executor
    without computing ``df`` again. The shuffle files behind it are of no more
    use then and are removed as soon as the write has ended.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return (session or spark).read.schema(df.schema).parquet(path)


def _folder(table: DataFrame) -> str | None:
    files = table.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def reread(table: DataFrame, session: SparkSession) -> DataFrame:
    """A table that :func:`stored` wrote, in another session."""
    folder = _folder(table)
    return session.read.schema(table.schema).parquet(folder) if folder else session.createDataFrame([], table.schema)


def removed(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote, once what was made of them is written as well."""
    for table in tables:
        if folder := _folder(table):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sibling(spark: SparkSession, **settings) -> SparkSession:
    """A session of the same application with the same settings but for those given (``_`` for dots); the caller's keeps its own."""
    own = spark.newSession()
    for name, value in (spark.conf.getAll | {k.replace("_", "."): v for k, v in settings.items()}).items():
        if own.conf.get(name, None) != value:
            own.conf.set(name, value)
    return own


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session be small, so that workers hold little besides what they compute."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_batches(df: DataFrame, run: Callable, schema: str, uses: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with :func:`small_batches`; of what a worker has kept from other tasks only ``uses`` stays."""
    small_batches(df.sparkSession)

    def tidy(batches):
        only(uses)
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy, schema)


def stored_with(df: DataFrame, label: str, **totals: Column) -> tuple[DataFrame, dict]:
    """:func:`stored`, and aggregates over the rows that are found while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *(c.alias(n) for n, c in totals.items())), label)
    return out, seen.get


def maybe_among(keys: DataFrame, key: str, bits: int = 1 << 26) -> Callable[[Column], Column] | None:
    """A filter that keeps every value of ``keys.key`` and few others, or None if it would keep most.

    It is a bitmap of hashes of ``bits`` bits at most (8 MB), so what is sent
    to the executors doesn't grow beyond that. It only saves work: rows that it
    lets through by chance must not do harm.
    """
    spark = keys.sparkSession
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1  # bitmap functions count from 1
    parts = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map")).collect()
    table = np.zeros(bits // 8, np.uint8)
    for bucket, chunk in parts:
        at = (bucket - 1) * len(chunk)
        table[at : at + len(chunk)] = np.frombuffer(chunk, np.uint8)
    if np.unpackbits(table).mean() > 0.5:
        return None
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def among(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    return lambda column: among(F.pmod(F.xxhash64(column), F.lit(bits)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(column, modulus: int):
    """crc32 of the value written as text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of the batches with about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(values: pa.Array) -> list[str]:
    """The values as Python strings, several times faster than by ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
