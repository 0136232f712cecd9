"""Exact deduplication with an extendible-hash index on shared files.

Only DataFrame functions are used. Each text has a 64-bit hash; the index has
one entry for each hash, addressed by the leading bits of its mixed value. Tasks
reduce their rows to one for each hash before anything moves, so a text that a
third of all rows share costs no more than another. The directory starts small;
a bucket with more entries than its capacity is split by one more bit, and only
such buckets are counted again while the directory doubles. Owner tasks hold
ranges of addresses and write their buckets to the shared folder.

A hash that occurs once is a text of its own. Where it occurs more often, the
bytes are compared: if they are not all equal, the bucket holds a chain, one
link for each text, with its bytes. Rows find their bucket through the
directory, the entry by the hash and the link by the bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.support import documents, stored, stored_with

#: Entries that a bucket holds before it is split.
BUCKET_ENTRIES = 4096
#: Directories and lists of repeated hashes of at most so many rows (24 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_SLOTS = 1 << 16


def _slot(h: Column, depth: int) -> Column:
    """The leading ``depth`` bits of the address of a hash: a bad hash must not make the directory deep."""
    return F.shiftrightunsigned(F.xxhash64(h), 64 - depth) if depth else F.lit(0).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SLOTS else df


def directory(entries: DataFrame, capacity: int = BUCKET_ENTRIES) -> tuple[DataFrame, int]:
    """Directory (slot, bucket_depth, bucket) over the distinct ``entries.h``, and its depth.

    The first depth is one at which nearly all buckets are too full. From there
    overfull buckets are split by one more bit, others stay; several slots
    then share a bucket.
    """
    total = entries.count()
    depth = max(0, math.floor(math.log2(max(1, total) / capacity)) - 1)
    left, done = entries.select("h"), []
    while True:
        counts, seen = stored_with(left.groupBy(_slot(F.col("h"), depth).alias("bucket")).agg(F.count("*").alias("n")), "exact-buckets", full=F.count_if(F.col("n") > capacity))
        done.append(counts.where(F.col("n") <= capacity).select(F.lit(depth).alias("bucket_depth"), "bucket"))
        if not seen["full"]:
            break
        full = _small(counts.where(F.col("n") > capacity).select("bucket"), seen["full"])
        left = left.join(full, _slot(F.col("h"), depth) == F.col("bucket"), "left_semi")
        depth += 1
    buckets = done[0]
    for more in done[1:]:
        buckets = buckets.unionByName(more)
    low = F.expr(f"shiftleft(bucket, {depth} - bucket_depth)")
    high = F.expr(f"shiftleft(bucket + 1, {depth} - bucket_depth) - 1")
    return stored(buckets.select(F.explode(F.sequence(low, high)).alias("slot"), "bucket_depth", "bucket"), "exact-directory"), depth


def _placed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """Rows (with h) and the bucket that the directory has for them."""
    return rows.withColumn("slot", _slot(F.col("h"), depth)).join(_small(slots, 1 << depth), "slot")


def _texts(docs: DataFrame, text: str, key: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("bytes"), F.col(key).alias("key"))
    return own.withColumn("h", hash_of(F.col("bytes")).cast("long"))


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = BUCKET_ENTRIES, hash_of: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, int]:
    """The index of the distinct texts as files in the shared folder, its directory and the directory's depth.

    Columns: bucket_depth, bucket, h (hash), chain (0, 1, ... among different
    texts of equal hash), bytes (the text of a link; null where the hash has
    one text only), keep_id, group_size.
    """
    rows = _texts(docs, text, key, hash_of)
    entries, seen = stored_with(rows.groupBy("h").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size")), "exact-entries", repeated=F.count_if(F.col("group_size") > 1))
    slots, depth = directory(entries, capacity)
    # the bytes of texts whose hash occurs more than once are compared; each task sends a text once
    repeated = _small(entries.where("group_size > 1").select("h"), seen["repeated"])
    links = rows.join(repeated, "h", "left_semi").groupBy("h", "bytes").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size"))
    collided, found = stored_with(links.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "exact-collided", n=F.count("*"))
    index = entries.select("h", F.lit(0).alias("chain"), F.lit(None).cast("string").alias("bytes"), "keep_id", "group_size")
    if found["n"]:
        chained = rows.join(_small(collided, found["n"]), "h", "left_semi").groupBy("h", "bytes").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size"))
        chain = F.row_number().over(Window.partitionBy("h").orderBy("bytes")) - 1
        index = index.join(collided, "h", "left_anti").unionByName(chained.select("h", chain.alias("chain"), "bytes", "keep_id", "group_size"))
    parts = max(1, min(1 << depth, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    owned = _placed(index, slots, depth).repartitionByRange(parts, "slot")
    return stored(owned.select("bucket_depth", "bucket", "h", "chain", "bytes", "keep_id", "group_size"), "exact-index"), slots, depth


def look_up(docs: DataFrame, index: tuple[DataFrame, DataFrame, int], text: str = "text", key: str = "doc_id", hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """key, keep_id, group_size and text_sha256 of each row, from its entry of the index."""
    entries, slots, depth = index
    rows = _texts(docs, text, key, hash_of).withColumn("text_sha256", F.sha2("bytes", 256))
    # bytes travel only where there is a chain to compare them with
    chained = entries.where("bytes IS NOT NULL").select("h", "bytes")
    if chained.isEmpty():
        rows = rows.drop("bytes").withColumn("bytes", F.lit(None).cast("string"))
    placed = _placed(rows, slots, depth).drop("slot")
    found = entries.select("bucket_depth", "bucket", "h", F.col("bytes").alias("link"), "keep_id", "group_size")
    same = (placed["bucket_depth"] == found["bucket_depth"]) & (placed["bucket"] == found["bucket"]) & (placed["h"] == found["h"])
    return placed.join(found, same & (F.col("link").isNull() | (F.col("link") == placed["bytes"]))).select("key", "keep_id", "group_size", "text_sha256")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = BUCKET_ENTRIES, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id (from ``key``), keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are. Null counts as the empty text. Of
    equal texts the row with the largest key stays; rows that repeat both that
    key and the text are all marked kept. A null key never wins against
    another; where all keys of a group are null, keep_id is null and nothing is
    kept. Other columns of ``docs`` are ignored, whatever their names. An empty
    table gives an empty result.
    """
    rows = look_up(docs, build_index(docs, text, key, capacity, hash_of), text, key, hash_of)
    return rows.select(F.col("key").alias("doc_id"), "keep_id", "group_size", F.coalesce(F.col("key") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = BUCKET_ENTRIES, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Where all keys of a group of equal texts are null, all its rows stay.
    """
    entries, _, _ = build_index(docs, text, key, capacity, hash_of)
    kept = entries.select(F.col("h").alias("_entry"), F.col("bytes").alias("_link"), F.col("keep_id").alias("_keep"))
    body = F.coalesce(docs[text], F.lit(""))
    mine = docs[key].eqNullSafe(kept["_keep"]) & (hash_of(body).cast("long") == kept["_entry"])
    return docs.join(kept, mine & (kept["_link"].isNull() | (kept["_link"] == body)), "left_semi")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`exact_dedup` over all of ``documents``."""
    return exact_dedup(documents(spark, sf_dir))


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       coalesce(doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
