"""Token files: Parquet list columns in document order, with row groups and page indexes for selective reads.

Documents are dealt out by ranges of their id, so each file holds the next
stretch of ids. A file's rows are sorted by id, its row groups are small and
its pages carry an index, so a reader fetches the pages of the wanted documents
and columns only. Beside the ids each row has the metadata that a loader needs:
document id, shard, first token within the shard and token count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.bpe import encoder, ids_crc32
from tidewheel.llm.support import BATCH_BYTES, col, documents, fresh_path, list_array, map_batches, slices

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1000


def write_token_files(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, added: bool = False) -> None:
    """Encode each whole text, end it with id 0 and write the token files.

    ``encoding`` is ``dictionary`` (small vocabularies of ids) or ``delta``
    (DELTA_BINARY_PACKED pages). With ``added`` a literal of an added token gets
    that token's id, as in the library by default; else it is ordinary text. Null texts are empty: their one id is 0. Rows
    with a null key come first; rows that repeat a key are ordered by text.
    Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")

    def run(batches):
        shard, at = TaskContext.get().partitionId(), 0
        # the more texts at once, the more of their stretches are looked up together
        for part in slices(batches, limit=BATCH_BYTES):
            ids, sizes = encoder(tokenizer, added).encode(col(part, "text"))
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.record_batch([col(part, "doc_id"), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(starts), pa.array(sizes), list_array(ids, sizes, pa.int32())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = map_batches(rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text"), run, SCHEMA, "bpe")
    writer = tokens.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    writer = writer.option("parquet.enable.dictionary", encoding == "dictionary")
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "v2")
    writer.parquet(path)


def shard_offsets(spark, path: str) -> DataFrame:
    """shard and before (ids of all shards before it), without reading ids; a row for each partition that wrote."""
    totals = spark.read.schema(SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.select("shard", before.alias("before"))


def read_metadata(spark, path: str) -> DataFrame:
    """doc_id, n_tokens and start (ids of all documents before it), without reading ids."""
    meta = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "shard", "shard_start", "n_tokens")
    return meta.join(F.broadcast(shard_offsets(spark, path)), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "shard", "shard_start")


def read_tokens(spark, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the token files with ``low <= doc_id <= high``; the bounds reach the page indexes."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, shard, shard_start, n_tokens and ids_crc32, from the ids that were read."""

    def run(batches):
        for batch in batches:
            ids = col(batch, "ids")
            flat, offsets = np.asarray(ids.flatten()), np.asarray(ids.offsets).astype(np.int64)
            offsets = offsets - offsets[0]
            crc = np.fromiter((ids_crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.int64, len(ids))
            yield pa.record_batch([col(batch, "doc_id"), col(batch, "shard"), col(batch, "shard_start"), pa.array(np.diff(offsets)), pa.array(crc)], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    return map_batches(tokens, run, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """Place and digest of each document's ids, from files of all of ``documents`` that were written and read back."""
    path = fresh_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, added=True)
    read = token_digests(read_tokens(spark, path))
    return read.join(F.broadcast(shard_offsets(spark, path)), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
