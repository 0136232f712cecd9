"""Best-fit packing of documents into sequences by large-item matching.

How many items there are of each length is all that a packing depends on, and
there are at most ``capacity`` lengths. So the plan is made from that histogram
and its size doesn't grow with the corpus:

1. Items above a third of the capacity fit at most twice in a bin. From the
   longest on, each is matched with the longest other one that still fits.
2. Shorter items, longest first, go to the smallest gap that takes them; what
   no gap takes opens new bins.

The plan says, for stretches of ranks within a length, which bins they go to
and where in them. Documents are ranked within their length by a range
partitioned sort, so a length that a third of all documents share is dealt to
many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.bpe import encoder, ids_crc32
from tidewheel.llm.support import col, documents, list_array, map_batches, slices, stored

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Stretches (length, first rank, end rank, first bin, offset in the bin), and the number of bins.

    Item ``first rank + i`` of a length goes to bin ``first bin + i``. Lengths
    are 1 to ``capacity``; others raise ValueError.
    """
    left = {s: int(n) for s, n in counts.items() if n}
    if any(not 1 <= s <= capacity for s in left):
        raise ValueError("a length is not between 1 and the capacity")
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps: list[int] = []
    bins = 0

    def put(length: int, first_bin: int, n: int, offset: int):
        out.append((length, used[length], used[length] + n, first_bin, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first_bin: int, n: int):
        if n and gap:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first_bin, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        if not left[s]:
            large.pop()
            continue
        at = bisect_left(large, capacity - s + 1) - 1
        while at >= 0 and (not left[large[at]] or (large[at] == s and left[s] < 2)):
            if large[at] != s:
                large.pop(at)
            at -= 1
        if at < 0:
            n = left[s]
            put(s, bins, n, 0)
            leave(capacity - s, bins, n)
        else:
            t = large[at]
            n = left[s] // 2 if t == s else min(left[s], left[t])
            put(s, bins, n, 0)
            put(t, bins, n, s)
            leave(capacity - s - t, bins, n)
        bins += n

    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            at = bisect_left(open_gaps, s)
            if at == len(open_gaps):
                gap, first, n = capacity, bins, -(-left[s] // (capacity // s))
                bins += n
            else:
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
            each = gap // s
            full = min(n, left[s] // each)
            for i in range(each if full else 0):
                put(s, first, full, capacity - gap + i * s)
            leave(gap - each * s, first, full)
            first, n = first + full, n - full
            if n and left[s]:  # the last items do not fill a bin as often as they could
                rest = left[s]
                for i in range(rest):
                    put(s, first, 1, capacity - gap + i * s)
                leave(gap - rest * s, first, 1)
                first, n = first + 1, n - 1
            leave(gap, first, n)
    return out, bins


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces of the token ids of each whole text (null: empty), ended by id 0.

    Documents longer than ``capacity`` are cut so that all pieces but the first
    are full. ``ids`` adds the ids themselves. With ``added`` a literal of an
    added token gets that token's id, as in the library by default; else it is
    ordinary text.
    """

    def run(batches):
        for part in slices(batches):
            flat, sizes = encoder(tokenizer, added).encode(col(part, "text"))
            pieces = -(-sizes // capacity)
            of = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of]
            head = sizes - (pieces - 1) * capacity
            length = np.where(number == 0, head[of], capacity)
            start = np.where(number == 0, 0, head[of] + (number - 1) * capacity)
            low = (np.cumsum(sizes) - sizes)[of] + start
            crc = np.fromiter((ids_crc32(flat[a : a + n]) for a, n in zip(low, length, strict=True)), np.int64, len(of))
            arrays = [col(part, "doc_id").take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                arrays, names = [*arrays, list_array(flat, length, pa.int32())], [*names, "ids"]
            yield pa.record_batch(arrays, names=names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, PIECES + ", ids array<int>" * ids, "bpe")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column length) with sequence_id and offset.

    Sequences are numbered from 0 and hold at most ``capacity`` tokens without
    gaps. Rows are ranked within a length by doc_id and piece if there; rows
    that repeat are separate items.
    """
    order = ["length", *(c for c in ("doc_id", "piece") if c in pieces.columns)]
    shards = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rank(batches):
        shard, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            length = np.asarray(col(batch, "length"))
            if not len(length):
                continue
            head = np.flatnonzero(np.append(True, length[1:] != length[:-1]))
            begin = np.repeat(head, np.diff(np.append(head, len(length))))
            local = np.arange(len(length)) - begin
            if length[0] == last:
                local[begin == 0] += seen
            last, seen = length[-1], int(local[-1]) + 1
            yield pa.record_batch([*batch.columns, pa.array(np.full(len(length), shard, np.int32)), pa.array(local)], names=[*batch.schema.names, "_shard", "_rank"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", _shard int, _rank long"
    ranked = stored(map_batches(pieces.repartitionByRange(shards, *order).sortWithinPartitions(*order), rank, schema), "packing-ranks")
    # a shard holds a range of lengths, so there are at most shards + capacity rows here
    held = ranked.groupBy("length", "_shard").count().orderBy("length", "_shard").collect()
    counts: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for length, shard, n in held:
        before[length, shard] = counts[length]
        counts[length] += n
    stretches, _ = plan(counts, capacity)
    stretches.sort()
    s = np.array(stretches, np.int64).reshape(-1, 5)
    shift_keys = np.array([length << 20 | shard for length, shard in before], np.int64)
    shift = np.array(list(before.values()), np.int64)
    by_key = np.argsort(shift_keys)
    shift_keys, shift = shift_keys[by_key], shift[by_key]
    heads = s[:, 0] << 48 | s[:, 1]

    def place(batches):
        for batch in batches:
            length, local = np.asarray(col(batch, "length")), np.asarray(col(batch, "_rank"))
            ranks = local + shift[np.searchsorted(shift_keys, length << 20 | np.asarray(col(batch, "_shard")).astype(np.int64))]
            at = np.searchsorted(heads, length << 48 | ranks, "right") - 1
            kept = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("_shard", "_rank")]
            yield pa.record_batch([*kept, pa.array(s[at, 3] + ranks - s[at, 1]), pa.array(s[at, 4])], names=[*[n for n in batch.schema.names if n not in ("_shard", "_rank")], "sequence_id", "offset"])

    return map_batches(ranked, place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False, added: bool = False) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one token. Null and repeated keys are
    separate documents. Other columns of ``docs`` are ignored. An empty table
    gives no rows.
    """
    return pack(stored(cut(docs, text, key, capacity, tokenizer, ids, added), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces packed with their ids; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Where each piece of each of ``documents`` goes, ids as the library gives them by default."""
    return best_fit_pack(documents(spark, sf_dir), added=True)
