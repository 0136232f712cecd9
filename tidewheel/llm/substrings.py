"""Substring deduplication: word passages that occur earlier, by prefix-partitioned suffix trees.

The suffixes are the word sequences that begin at each word. Only whether two
of them share their first ``WINDOW`` words matters, so the trees are cut at that
depth: an internal node there has the leaves of a repeat, and adjoining repeats
of a text make up its maximal ones.

Suffixes are split by prefixes of 8 to 20 words: from the suffix's first word to
the end of its anchor, the run of 8 words with the smallest hash among those
that lie wholly in the first 20. The anchor depends on these 20 words alone, so
suffixes that share them share the prefix. Prefixes that end in the same anchor
make up a group, and suffixes of a group that follow one another in a text are
sent as one segment. A group whose anchor occurs once has no internal node that
deep and isn't built; an anchor that occurs more than ``GROUP`` times has its
prefixes lengthened to all 20 words, so no group outgrows a task's memory.

A group's suffixes are sorted; neighbours that have all their words in common
are leaves of one deep node. Of its leaves the earliest stays, the others are
repeats. As the earliest of the earliest is the earliest, a node with a third of
all leaves is first settled within the slice of texts, then among some of the
tasks, and only then as a whole. Words decide: suffixes are compared byte by
byte, hashes only deal them out. Texts that equal an earlier one word by word
are resolved before, by 128 bits of the SHA-256 of their words: they add no leaf
that is earlier.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.support import col, documents, map_batches, maybe_among, slices, stored, text_buffers
from tidewheel.llm.words import Words, find, grams, mix

WINDOW = 20
ANCHOR = 8
#: Occurrences of an anchor beyond which its prefixes are lengthened.
GROUP = 2000
#: Segments that a task holds at once, and bytes of text whose suffixes it settles at once.
HELD = 8000
SLICE_BYTES = 1 << 20


def windows(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, path fingerprint and anchor's first word of each window, and the hash of the run at each word."""
    at, path = grams(words, window)
    runs_at, runs = grams(words, anchor)
    hashes = np.full(len(words.hash) + window, np.iinfo(np.uint64).max, np.uint64)
    hashes[runs_at] = runs
    if not len(at):
        return at, path, at, hashes
    spread = window - anchor + 1
    chosen = np.empty(len(at), np.int64)
    for a in range(0, len(at), 1 << 16):
        part = at[a : a + (1 << 16)]
        chosen[a : a + len(part)] = sliding_window_view(hashes, spread)[part].argmin(1) + part
    return at, path, chosen, hashes


def _identity(texts: list[bytes]) -> list[np.ndarray]:
    """128 bits of the SHA-256 of each text's words, joined by one space."""
    digests = np.frombuffer(b"".join(hashlib.sha256(t).digest()[:16] for t in texts), "<i8").reshape(-1, 2)
    return [np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1])]


def _kept(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [b" ".join(raw[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def profiles(docs: DataFrame, keep: list[str], window: int = WINDOW, anchor: int = ANCHOR, texts: str = "all") -> DataFrame:
    """row (unique number), doc_id, the columns ``keep`` as a struct, n_words, t1 and t2 (identity), anchors, and kept_text or its digest.

    An anchor that repeats within the text is listed twice.
    """

    def run(batches):
        task, number = TaskContext.get().partitionId() << 33, 0
        for part in slices(batches, "_text"):
            data, offsets = text_buffers(col(part, "_text"))
            w = find(data, offsets)
            _, _, chosen, hashes = windows(w, window, anchor)
            chosen = np.unique(chosen)
            of, h = w.text[chosen], hashes[chosen].view(np.int64)
            order = np.lexsort((h, of))
            of, h = of[order], h[order]
            new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])) if len(h) else np.zeros(0, bool)
            # of a run of equal ones the first two stay
            two = new | np.append(False, new[:-1]) if len(h) else new
            of, h = of[two], h[two]
            words = _kept(data, offsets)
            t1, t2 = _identity(words)
            n = part.num_rows
            begin = np.searchsorted(of, np.arange(n + 1), "left")
            anchors = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(h))
            kept = pa.array(words if texts != "changed" else [None] * n, pa.binary())
            yield pa.record_batch([pa.array(task + number + np.arange(n)), col(part, "_doc"), col(part, "_keep"), pa.array(w.counts()), pa.array(t1), pa.array(t2), anchors, kept.cast(pa.string())], names=["_row", "doc_id", "_keep", "n_words", "_t1", "_t2", "_anchors", "kept_text"])
            number += n

    own = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.struct(*keep).alias("_keep"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    out = map_batches(own, run, f"_row long, doc_id long, _keep {own.schema['_keep'].dataType.simpleString()}, n_words long, _t1 long, _t2 long, _anchors array<long>, kept_text string")
    return out.withColumn("kept_text", F.sha2("kept_text", 256)) if texts == "digest" else out


def _member(of: np.ndarray, values: np.ndarray, table_of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each (text, value) is in the table of such pairs."""

    def joint(a, b):
        return mix(b.view(np.uint64) + mix(a.astype(np.uint64) + np.uint64(1)))

    have = np.sort(joint(table_of, table))
    if not len(have):
        return np.zeros(len(values), bool)
    want = joint(of, values)
    at = np.searchsorted(have, want)
    at[at == len(have)] = 0
    return have[at] == want


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of each entry of a list column; null lists are empty."""
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    values = lists.flatten()
    return np.repeat(np.arange(len(lists)), size), values if pa.types.is_struct(values.type) else np.asarray(values)


def settle(segments: list[tuple], window: int) -> list[int]:
    """For each segment (text, live, doc, row, at) the bits of its live suffixes that repeat an earlier one.

    Bit ``j`` stands for the suffix at the segment's word ``j``, which is word
    ``at + j`` of its row. Of a node's leaves those of the smallest doc stay
    (None is larger than all), in each row the first.
    """
    suffixes = []
    for i, (text, live, doc, row, at) in enumerate(segments):
        words = text.split(b" ")
        suffixes += [(b" ".join(words[j : j + window]), doc is None, doc or 0, row, at + j, i, j) for j in range(len(words) - window + 1) if live >> j & 1]
    suffixes.sort()
    gone = [0] * len(segments)
    node = least = last = None
    for path, unkeyed, doc, row, _, i, j in suffixes:
        if path != node:
            node, least, last = path, (unkeyed, doc), row
            continue
        if (unkeyed, doc) != least or row == last:
            gone[i] |= 1 << j
        last = row
    return gone


SEGMENT = "key long, hot boolean, task int, row long, doc_id long, at long, live int, gone int, text binary"
_NAMES = ["key", "hot", "task", "row", "doc_id", "at", "live", "gone", "text"]
_KINDS = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Segments as a batch; the text of one without live suffixes isn't needed any more."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    columns[8] = [t if n else None for t, n in zip(columns[8], columns[6], strict=True)]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _settled(rows: list[tuple], window: int) -> list[tuple]:
    """Segments with what :func:`settle` finds moved from live to gone."""
    found = settle([(r[8], r[6], r[4], r[3], r[5]) for r in rows], window)
    return [(*r[:6], r[6] & ~g, r[7] | g, r[8]) for r, g in zip(rows, found, strict=True)]


def _segments(candidates: DataFrame, window: int, anchor: int) -> DataFrame:
    """Segments of the suffixes of candidate texts that are in groups worth building, settled within each slice.

    A segment's suffixes are consecutive and have the same anchor, whose hash
    is the key. In a hot group each suffix is a segment; the key is that of all its words.
    """

    def run(batches):
        task = TaskContext.get().partitionId()
        for part in slices(batches, limit=SLICE_BYTES):
            data, offsets = text_buffers(col(part, "text"))
            w = find(data, offsets)
            at, path, chosen, hashes = windows(w, window, anchor)
            where = np.unique(chosen)
            again, hot = np.zeros(len(w.hash), bool), np.zeros(len(w.hash), bool)
            for flags, name in ((again, "repeated"), (hot, "hot")):
                flags[where] = _member(w.text[where], hashes[where].view(np.int64), *_flat(col(part, name)))
            mine = again[chosen]
            at, path, chosen = at[mine], path[mine], chosen[mine]
            if not len(at):
                continue
            begin = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1) | hot[chosen[1:]]))
            size = np.diff(np.append(begin, len(at)))
            first = at[begin]
            raw, of, warm = data.tobytes(), w.text[first], hot[chosen[begin]]
            keys = np.where(warm, path[begin], hashes[chosen[begin]]).view(np.int64)
            rows, docs = np.asarray(col(part, "row"))[of], col(part, "doc_id").take(pa.array(of)).to_pylist()
            texts = [b" ".join(raw[a:b].split()) for a, b in zip(w.start[first].tolist(), w.end[first + size + window - 2].tolist(), strict=True)]
            live = ((1 << size) - 1).tolist()
            own = (first - w.first[of]).tolist()
            yield _batch(_settled(list(zip(keys.tolist(), warm.tolist(), [task] * len(of), rows.tolist(), docs, own, live, [0] * len(of), texts, strict=True)), window))

    return map_batches(candidates, run, SEGMENT)


def _trees(segments: DataFrame, group: Column, window: int) -> DataFrame:
    """Segments settled among those of equal ``group``; gone holds what was found here."""
    shards = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.withColumn("gone", F.lit(0)).withColumn("_group", group).repartition(shards, "_group").sortWithinPartitions("_group")

    def parts(batches) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(col(batch, c).to_pylist() for c in (*_NAMES, "_group")), strict=True)
            if len(held) >= HELD:
                cut = bisect_left(held, held[-1][9], key=itemgetter(9))
                yield _settled([r[:9] for r in held[:cut]], window)
                held = held[cut:]
            if len(held) >= HELD:
                # all of one group: what is settled already goes, the rest waits for more
                done = [(*x, r[9]) for x, r in zip(_settled([r[:9] for r in held], window), held, strict=True)]
                yield [r[:9] for r in done if not r[6]]
                held = [r for r in done if r[6]]
        yield _settled([r[:9] for r in held], window)

    return map_batches(dealt, lambda batches: map(_batch, parts(batches)), SEGMENT)


def _cut(candidates: DataFrame, window: int) -> DataFrame:
    """row, n_removed, spans (first and end word of each removed stretch) and kept_text of candidate texts."""

    def run(batches):
        for part in slices(batches):
            data, offsets = text_buffers(col(part, "text"))
            w = find(data, offsets)
            of, found = _flat(col(part, "gone"))
            base, bits = w.first[of] + np.asarray(found.field("at")), np.asarray(found.field("gone"))
            cover = np.zeros(len(w.hash) + 1, np.int64)
            for j in range(window):
                at = base[bits >> j & 1 == 1] + j
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            counts = np.bincount(w.text[gone], minlength=part.num_rows)
            raw, texts, spans = data.tobytes(), [], []
            start, end = w.start.tolist(), w.end.tolist()
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                mine = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                texts.append(b" ".join([raw[start[j] : end[j]] for j in (a + np.flatnonzero(~mine)).tolist()]).decode("utf-8"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([col(part, "row"), pa.array(counts), pa.array(spans, kind), pa.array(texts, pa.string())], names=["row", "n_removed", "spans", "kept_text"])

    return map_batches(candidates, run, "row long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")


def substring_dedup(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, anchor: int = ANCHOR, texts: str = "all", prefix: str = "") -> DataFrame:
    """Remove from each text the words covered by ``window`` words that also start earlier.

    Earlier is a smaller doc_id, or the same row and an earlier word. All
    windows are judged on the input. Returns the columns ``keep`` (doc_id if
    not given) with the new columns, whose names begin with ``prefix``: n_words, n_removed,
    spans (word numbers of removed stretches) and kept_text, the kept words
    joined by one space. ``texts`` may also be ``digest`` (the column holds its
    SHA-256) or ``changed`` (it is null where nothing was removed).

    Null texts have no words. A null doc_id is later than all others. Rows that
    repeat a doc_id do not count as earlier than one another. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    profile = stored(profiles(docs, keep, window, anchor, texts), "substring-profiles")
    # texts that equal an earlier one go as a whole
    sequence = stored(profile.groupBy("_t1", "_t2", "n_words").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_c")).where((F.col("_c") > 1) & (F.col("n_words") >= window)).drop("_c"), "substring-copies")
    later = F.coalesce((F.col("_least") < F.col("doc_id")) | (F.col("_least").isNotNull() & F.col("doc_id").isNull()), F.lit(False))
    rows = stored(profile.select("_row", "doc_id", "_t1", "_t2", "n_words").join(sequence, ["_t1", "_t2", "n_words"], "left").select(F.col("_row").alias("row"), "doc_id", "_t1", "_t2", later.alias("copy")), "substring-rows")
    # anchors of different texts, or twice in one
    anchors = profile.select("_row", "_t1", F.explode("_anchors").alias("a"))
    twice = profile.select("_t1", F.posexplode("_anchors").alias("p", "a"), "_anchors").select("a", (F.col("_t1") + F.when((F.col("p") > 0) & (F.get("_anchors", F.col("p") - 1) == F.col("a")), 1).otherwise(0)).alias("t"))
    repeated = stored(twice.groupBy("a").agg(F.min("t").alias("x"), F.max("t").alias("y"), (F.count("*") > GROUP).alias("hot")).where("x != y").select("a", "hot"), "substring-anchors")
    lists = anchors.join(repeated, "a").groupBy("_row").agg(F.collect_set("a").alias("repeated"), F.collect_set(F.when(F.col("hot"), F.col("a"))).alias("hot"))
    chosen = stored(lists.withColumnRenamed("_row", "row").join(rows.where("NOT copy"), "row").select("row", F.col("doc_id").alias("own_id"), "_t1", "_t2", "repeated", "hot"), "substring-chosen")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    among = maybe_among(chosen, "own_id")
    if among is not None:
        own = own.where(among(F.col("doc_id")))
    found = own.join(chosen, own["doc_id"].eqNullSafe(chosen["own_id"])).select("row", "doc_id", "text", "repeated", "hot", "_t1", "_t2")
    candidates = stored(_matching(found), "substring-candidates")
    segments = stored(_segments(candidates, window, anchor), "substring-segments")
    # hot groups are settled among the segments of some tasks first
    salt = F.pmod("task", F.lit(max(1, math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    hot = stored(_trees(segments.where("hot AND live != 0"), F.xxhash64("key", salt), window), "substring-hot")
    settled = stored(_trees(segments.where("NOT hot AND live != 0").unionByName(hot.where("live != 0")), F.col("key"), window), "substring-settled")
    found = segments.select("row", "at", "gone").unionByName(hot.select("row", "at", "gone")).unionByName(settled.select("row", "at", "gone")).where("gone != 0")
    found = found.groupBy("row").agg(F.collect_list(F.struct("at", "gone")).alias("gone"))
    results = _cut(candidates.select("row", "text").join(found, "row"), window)
    if texts == "digest":
        results = results.withColumn("kept_text", F.sha2("kept_text", 256))
    results = stored(results.where("n_removed > 0"), "substring-results").withColumnsRenamed({"n_removed": "_n", "kept_text": "_kept", "row": "_row"})
    all_rows = profile.drop("_t1", "_t2", "_anchors").join(rows.select(F.col("row").alias("_row"), F.col("copy").alias("_copy")), "_row").join(results, "_row", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    empty = F.sha2(F.lit(""), 256) if texts == "digest" else F.lit("")
    return all_rows.select(
        "_keep.*",
        F.col("n_words").alias(f"{prefix}n_words"),
        F.when(F.col("_copy"), F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0))).alias(f"{prefix}n_removed"),
        F.when(F.col("_copy"), whole).otherwise(F.coalesce("spans", none)).alias(f"{prefix}spans"),
        F.when(F.col("_copy"), empty).otherwise(F.coalesce("_kept", "kept_text")).alias(f"{prefix}kept_text"),
    )


def _matching(found: DataFrame) -> DataFrame:
    """Rows of ``found`` whose text is the one that the identity (_t1, _t2) names; one for each row number."""

    def run(batches):
        for part in slices(batches):
            t1, t2 = _identity(_kept(*text_buffers(col(part, "text"))))
            same = (t1 == np.asarray(col(part, "_t1"))) & (t2 == np.asarray(col(part, "_t2")))
            kept = part.select(["row", "doc_id", "text", "repeated", "hot"])
            yield kept.filter(pa.array(same))

    return map_batches(found, run, "row long, doc_id long, text string, repeated array<long>, hot array<long>")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of :func:`substring_dedup` over all of ``documents``."""
    out = substring_dedup(documents(spark, sf_dir), texts="digest")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept_text").alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
x AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
k AS (
    SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
           array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(coalesce(gone, []), p)), lambda p: ws[p]), ' ') AS kept
    FROM w LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
