"""Near-duplicates by SimHash fingerprints, found through pivot distance tables.

A text's shingles are hashed to 64 bits; a bit of its fingerprint is set if it
is set in more than half of these hashes. Texts link if their fingerprints
differ in ``RADIUS`` bits at most, and a component holds all that links reach.

Each distinct fingerprint has a row of a distance table: its Hamming distances
to many reference fingerprints, the pivots. By the triangle inequality two
fingerprints whose rows differ by more than the radius in any coordinate can't
link, so such pairs are discarded; the bits of survivors are compared.

Only fingerprints that meet in a bucket are paired. The 64 bits are cut into
blocks; at most ``RADIUS`` of them hold a bit that differs, so two fingerprints
that link agree in all others, whichever these are, and have the same bucket for
that choice of blocks. If a bucket holds more than ``FULL`` fingerprints, it isn't
used; its members are dealt anew by 16 blocks of 4 bits, whose buckets have room
for 4,096 different fingerprints and no more. A bucket yields the links of a
spanning forest, never all of its pairs, and a pair of fingerprints stands for
all texts that have them.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.components import components
from tidewheel.llm.support import col, documents, map_batches, stored, stored_with, text_buffers
from tidewheel.llm.words import mix

BITS = 64
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Blocks at first, and for members of full buckets.
BLOCKS, FINE_BLOCKS = 5, 16
#: Members beyond which a bucket is dealt anew.
FULL = 1024
#: Lists of full buckets with at most so many rows (16 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1 << 16
#: Reference fingerprints. Any will do; these are spread by a mixing function.
PIVOTS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of UTF-8 bytes, A-Z lower-cased; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), runs), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 16):
        part = hashes[a : a + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def distances(prints: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """The distance table: a row for each fingerprint, a column for each pivot."""
    return np.bitwise_count(prints[:, None] ^ pivots[None, :])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """key and print (the fingerprint's bits as a long) of each row."""
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(col(batch, "text"))
            raw = data.tobytes()
            found = [fingerprint(raw[a:b], shingle, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([col(batch, "key"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["key", "print"])

    return map_batches(own, run, f"key {own.schema['key'].dataType.simpleString()}, print long")


def distance_table(prints: DataFrame) -> DataFrame:
    """print, row (its distances to the pivots, a byte each) of each distinct fingerprint."""

    def run(batches):
        for batch in batches:
            p = col(batch, "print")
            rows = distances(np.asarray(p).view(np.uint64))
            yield pa.record_batch([p, pa.array([r.tobytes() for r in rows], pa.binary())], names=["print", "row"])

    return map_batches(prints.select("print").distinct(), run, "print long, row binary")


def _masks(blocks: int, radius: int) -> list[int]:
    """A mask for each choice of ``radius`` of the blocks, with the bits of the others, as signed longs."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    kept = [sum(p for i, p in enumerate(parts) if i not in free) for free in combinations(range(blocks), radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in kept]


def _buckets(table: DataFrame, blocks: int, radius: int) -> DataFrame:
    """choice, bits, and the table's columns: a row for each choice of blocks."""
    masks = _masks(blocks, radius)
    choices = F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("choice")
    dealt = table.select("*", choices)
    return dealt.withColumn("bits", F.col("print").bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.col("choice") + 1)))


def forest(prints: np.ndarray, rows: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (positions) that join what is linked within a bucket: the pairs that a search from member to member goes along."""
    left = np.arange(len(prints))
    links = []
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = left[(np.abs(rows[left] - rows[at]) <= radius).all(1)]  # the others are discarded by a coordinate
            near = near[np.bitwise_count(prints[near] ^ prints[at]) <= radius]
            if len(near):
                links += [(at, int(i)) for i in near]
                reached += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return links


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    """a, b: links between fingerprints that meet in a bucket of bounded size."""
    shards = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = buckets.select("choice", "bits", "print", "row").repartition(shards, "choice", "bits").sortWithinPartitions("choice", "bits")

    def whole(batches):
        """Columns of whole buckets: a batch's last bucket waits for the next batch."""
        held = None
        for batch in batches:
            new = [np.asarray(col(batch, c)) for c in ("choice", "bits", "print")]
            new.append(np.frombuffer(b"".join(col(batch, "row").to_pylist()), np.uint8).reshape(len(new[0]), -1).astype(np.int16))
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])).max(initial=-1)) + 1
            if last:
                yield [x[:last] for x in held]
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield held

    def run(batches):
        for choice, bits, prints, rows in whole(b for b in batches if b.num_rows):
            begin = np.flatnonzero(np.concatenate([[True], (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])]))
            end = np.append(begin[1:], len(bits))
            a, b = [], []
            for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                if e - s > 1:
                    for i, j in forest(prints[s:e].view(np.uint64), rows[s:e], radius):
                        a.append(prints[s + i])
                        b.append(prints[s + j])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_batches(dealt, run, "a long, b long")


def print_links(table: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, fine: int = FINE_BLOCKS, full: int = FULL) -> DataFrame:
    """a, b: links whose components are those of all pairs of the :func:`distance_table` that differ in ``radius`` bits at most."""
    buckets = _buckets(table, blocks, radius)
    counts, seen = stored_with(buckets.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > full).select("choice", "bits"), "simhash-full", n=F.count("*"))
    if not seen["n"]:
        return _links(buckets, radius)
    counts = F.broadcast(counts) if seen["n"] <= BROADCAST_ROWS else counts
    usable = buckets.join(counts, ["choice", "bits"], "left_anti")
    crowded = stored(buckets.join(counts, ["choice", "bits"], "left_semi").select("print", "row").distinct(), "simhash-crowded")
    return _links(usable, radius).unionByName(_links(_buckets(crowded, fine, radius), radius))


def simhash_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, full: int = FULL) -> DataFrame:
    """One row per row of ``docs``: doc_id (from ``key``), fingerprint (16 hex digits), component_id.

    component_id is the smallest key in the row's component. Words are runs of
    other than white space (0x20, 0x09-0x0D), A-Z lower-cased; a shingle's
    repeats count. Shorter texts are one shingle; texts without words (null
    ones too) have fingerprint 0, which links like any other. Equal texts have
    equal fingerprints, however many they are, and are one member of a bucket.
    A null key is never the smallest; where a component has no other,
    component_id is null. Rows that repeat stay. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, text, key, shingle, seed), "simhash-prints")
    firsts = rows.groupBy("print").agg(F.min("key").alias("first"))
    table = stored(distance_table(rows), "simhash-table")
    labels = components(stored(print_links(table, radius, full=full), "simhash-links"))
    named = stored(firsts.join(labels.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("label", "print").alias("label")), "simhash-labels")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_print = named.join(least, "label").select("print", "component_id")
    return rows.join(of_print, "print").select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`simhash_dedup` over all of ``documents``."""
    return simhash_dedup(documents(spark, sf_dir))
