"""Near-duplicates by BagMinHash signatures, banding and exact verification.

The texts' multisets of five-word shingles are compared by weighted Jaccard
similarity (sum of minima over sum of maxima of the counts).

Signatures: a shingle of count w covers the weights (0, w]. The weight axis is
cut into the blocks (0,1], (1,2], (2,4], (4,8], ..., each with a Poisson process
of its own, seeded by shingle and block, whose points carry a register and a
weight found by halving the block again and again. A register keeps its first
point with a weight of at most w. So two texts agree in a register with a
probability that is exactly their weighted Jaccard similarity. Points are made
up to a time by which all registers are likely filled, whatever the text's
length; texts with a register left get more time.

Candidates share a band of registers. A first pass compares each text with one
other only: of the most central members of its buckets, the one that leads most
of them. That completes most classes. Buckets that still hold several components
go on to a second pass, which tests every pair that can be linked: a bag's
shingles are put into one global order, rare ones first, and two bags of
similarity 0.8 meet in the first fifth of both, early enough for what follows to
make up the similarity. So members of a large group that differ from it by edits
of their own meet nobody, and no pair within a component is made. Links are
verified on the whole multisets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.components import components, roots
from tidewheel.llm.support import col, documents, list_array, map_batches, maybe_among, slices, stored, text_buffers
from tidewheel.llm.words import find, grams, mix, prefix_hash, range_hash

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 7
#: Seconds of the Poisson processes in units of the text's weight, beyond ln(registers).
SLACK = 3.5
_SHORT_BASE = 0xA24BAED4963EE407 | 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each shingle occurrence in order, and each text's first one (one more at the end).

    A text of fewer than ``k`` words (one at least) has one shingle: all of it.
    """
    w = find(data, offsets)
    at, h = grams(w, k)
    text = w.text[at]
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        prefix = prefix_hash(w.hash, _SHORT_BASE)
        extra = mix(range_hash(prefix, w.first[short], w.first[short + 1], _SHORT_BASE) ^ counts[short].astype(np.uint64))
        text, h = np.concatenate([text, short]), np.concatenate([h, extra])
        order = np.argsort(text, kind="stable")
        text, h = text[order], h[order]
    return text, h, np.searchsorted(text, np.arange(len(offsets)), "left")


def counted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) and the count of each."""
    if not len(h):
        return text, h, np.zeros(0, np.int64)
    own = mix(h + mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own)
    own = own[order]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return text[order[begin]], h[order[begin]], np.diff(np.append(begin, len(own)))


def _points(text, h, weight, until, registers, best):
    """Bring all points before ``until[text]`` into ``best`` (texts x registers)."""
    # blocks (0,1], (1,2], (2,4], ... that begin below the weight
    blocks = 1 + np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0)
    of = np.repeat(np.arange(len(h)), blocks)
    block = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    span = np.where(block == 0, 1, low)
    seed = mix(h[of] + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    text, limit, full = text[of], weight[of], low + span <= weight[of]
    time, step = np.zeros(len(of)), 1.0 / (registers * span)
    stop, drawn = until[text], 0
    flat = best.reshape(-1)
    while len(seed):
        many = int(min(512, max(1, 100_000 // len(seed))))
        number = np.arange(drawn, drawn + many, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        bits = mix(seed[:, None] + number[None, :])
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * step[:, None]
        gap[:, 0] += time
        at = np.cumsum(gap, 1)
        early = at <= stop[:, None]
        row, column = np.nonzero(early)
        if len(row):
            place = mix(bits[row, column])
            register = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)
            # halving the block: the high bits say which unit of it the point falls into
            unit = low[row] + 1 + (((place >> np.uint64(32)) * span[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            keep = full[row] | (unit <= limit[row])
            np.minimum.at(flat, text[row][keep] * registers + register[keep].astype(np.int64), at[row, column][keep])
        more = early[:, -1]
        seed, text, step, stop, low, span, limit, full = (x[more] for x in (seed, text, step, stop, low, span, limit, full))
        time, drawn = at[more, -1], drawn + many


def bag_min_hash(text: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Registers (float32, texts x registers) of multisets; a text without elements has infinities."""
    total = np.bincount(text, weight, texts)
    best = np.full((texts, registers), np.inf)
    todo = total > 0
    reach = np.log(registers) + SLACK
    while todo.any():
        until = np.where(todo, reach / np.maximum(total, 1), -1.0)
        mine = todo[text]
        _points(text[mine], h[mine], weight[mine], until, registers, best)
        todo &= np.isinf(best).any(1)
        reach *= 2
    return best.astype(np.float32)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit hash for each band of each text; it depends on the band's number too."""
    bits = mix(signature.view(np.uint32).astype(np.uint64)).reshape(len(signature), bands, -1)
    out = mix(np.arange(bands, dtype=np.uint64) + np.uint64(0x51ED27))[None, :].repeat(len(signature), 0)
    for i in range(bits.shape[2]):
        out = mix(out ^ bits[:, :, i])
    return out.view(np.int64)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def profiles(docs: DataFrame, text: str = "text", key: str = "doc_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row (unique number), doc_id, hash (of the text), f1 and f2 (fingerprint of the multiset), n (shingles), bands."""

    def run(batches):
        task, number = TaskContext.get().partitionId() << 33, 0
        for part in slices(batches):
            n = part.num_rows
            of, h, first = shingles(*text_buffers(col(part, "text")))
            prints = []
            for salt in (0x1234567, 0x89ABCDEF):
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
                prints.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            signature = bag_min_hash(*counted(of, h), n, bands * rows)
            hashes = band_hashes(signature, bands)
            arrays = [pa.array(task + number + np.arange(n)), col(part, "doc_id"), col(part, "hash"), pa.array(prints[0]), pa.array(prints[1]), pa.array(np.diff(first)), list_array(hashes.ravel(), np.full(n, bands), pa.int64())]
            number += n
            yield pa.record_batch(arrays, names=["row", "doc_id", "hash", "f1", "f2", "n", "bands"])

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), _text_hash(F.col(text)).alias("hash"))
    return map_batches(own, run, "row long, doc_id long, hash long, f1 long, f2 long, n long, bands array<long>")


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, repeated ones told apart by their number, and each text's first one (one more at the end)."""
    of, h, first = shingles(data, offsets)
    if not len(h):
        return h, first
    order = np.lexsort((h, of))
    h = h[order]
    begin = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
    head = np.maximum.accumulate(np.where(begin, np.arange(len(h)), 0))
    return mix(h + (np.arange(len(h)) - head).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), first


def _linked(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that share a band and whose whole multisets are similar enough; their other columns stay."""
    x = held.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("bag").alias("_bag"), F.col("bands").alias("_bands"))
    y = held.select(F.col("node").alias("b"), F.col("n").alias("_m"), F.col("bag").alias("_gab"), F.col("bands").alias("_sdnab"))
    both = pairs.join(x, "a").join(y, "b").where(_sizes_fit(F.col("_n"), F.col("_m"), threshold) & F.arrays_overlap("_bands", "_sdnab"))
    common = F.size(F.array_intersect("_bag", "_gab"))
    return both.where(common / (F.col("_n") + F.col("_m") - common) >= threshold).select(*pairs.columns)


def _sizes_fit(n: Column, m: Column, threshold: float) -> Column:
    """Whether multisets of ``n`` and ``m`` elements can be as similar as the threshold."""
    return F.least(n, m) >= threshold * F.greatest(n, m) - 1e-6


def _leaders(members: DataFrame) -> DataFrame:
    """(a, b): each node and the member that leads most of its buckets; leaders share the most buckets with others."""
    heads = members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("rank"))).alias("h"))
    votes = members.join(heads, "bucket").where(F.col("node") != -F.col("h.rank")).groupBy("node", "h").agg(F.count("*").alias("votes"))
    return votes.groupBy("node").agg(F.max(F.struct("votes", "h")).alias("v")).select(F.col("node").alias("a"), (-F.col("v.h.rank")).alias("b"))


def _pairs(open_nodes: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(a, b, p, q): all pairs of nodes of different labels p and q that can be similar enough, and some others.

    The shingles of a bag are ordered by how many bags have them. Two bags of n
    and m elements whose first common element has i and j others before it have
    min(n - i, m - j) elements in common at most. Elements of a single bag come
    first and need no row. For each element one label holds most bags; a pair
    is made from the bag of another label.
    """
    own = stored(held.join(open_nodes, "node").select("node", "n", "label", "bag"), "minhash-own")
    elements = own.select("node", F.explode("bag").alias("e"))
    known = elements.groupBy("e").agg(F.count("*").alias("c")).where("c > 1")
    shared = elements.join(known, "e").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("order"))
    before = F.col("n") - F.size("order")
    reach = F.floor((1 - threshold) * F.col("n") + 1e-6).cast("int") + 1 - before.cast("int")
    first = own.select("node", "n", "label").join(shared, "node").select("node", "n", "label", before.alias("before"), "order", reach.alias("reach")).where("reach > 0")
    first = first.select("node", "n", "label", "before", F.posexplode(F.slice("order", F.lit(1), F.col("reach"))).alias("i", "o"))
    first = stored(first.select("node", "n", "label", (F.col("before") + F.col("i")).alias("i"), F.col("o.e").alias("e")), "minhash-first")
    most = first.groupBy("e", "label").agg(F.count("*").alias("c")).groupBy("e").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("e", F.col("top.label").alias("top"))
    marked = stored(first.join(most, "e").withColumn("minor", F.col("label") != F.col("top")).drop("top"), "minhash-marked")
    x = marked.where("minor").select("e", F.col("node").alias("a"), F.col("label").alias("p"), F.col("n").alias("an"), F.col("i").alias("ai"))
    y = marked.select("e", F.col("node").alias("b"), F.col("label").alias("q"), F.col("n").alias("bn"), F.col("i").alias("bi"), "minor")
    once = ~F.col("minor") | (F.col("a") < F.col("b"))
    enough = F.least(F.col("an") - F.col("ai"), F.col("bn") - F.col("bi")) * (1 + threshold) >= threshold * (F.col("an") + F.col("bn")) - 1e-6
    return x.join(y, "e").where((F.col("p") != F.col("q")) & once & enough).select("a", "b", "p", "q").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the class's smallest doc_id), kept.

    Classes are the connected components of the links of similarity
    ``threshold`` or more. Texts of equal multisets are of one class without
    comparison; texts without words (null, empty, white space) are one class.
    The row whose doc_id is the class_id is kept; rows that repeat it are all
    marked kept. Null doc_ids count as larger than others; where all of a class
    are null, class_id is null and nothing is kept. Other columns of ``docs``
    are ignored, whatever their names. Keys are whole numbers, or text that
    reads as such. An empty table gives an empty result.
    """
    return _classes(docs, text, key, threshold, bands, rows).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def _classes(docs: DataFrame, text: str, key: str, threshold: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, hash of the text and class_id of each row."""
    profile = stored(profiles(docs, text, key, bands, rows), "minhash-profiles")
    equal = stored(profile.groupBy("f1", "f2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "minhash-equal")
    nodes = stored(profile.join(equal.select(F.col("node").alias("row")), "row").where("n > 0").select(F.col("row").alias("node"), "doc_id", "f1", "f2", "n", "bands"), "minhash-nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = stored(buckets.join(shared, "bucket"), "minhash-buckets")
    members = stored(members.drop("c").join(members.groupBy("node").agg(F.sum("c").alias("weight")), "node"), "minhash-members")
    wanted = members.select("node").distinct().join(nodes, "node")
    held = stored(_bags_of(docs, wanted, text, key), "minhash-bags")

    first = stored(_leaders(members), "minhash-pairs")
    labels = stored(roots(stored(_linked(first, held, threshold), "minhash-links")), "minhash-labels")
    # buckets with members of several components
    labelled = members.select("node", "bucket").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("bucket")
    open_nodes = stored(labelled.join(several, "bucket").select("node", "label").distinct(), "minhash-open")
    pairs = stored(_pairs(open_nodes, held, threshold), "minhash-pairs")
    merged = stored(components(stored(_linked(pairs, held, threshold), "minhash-links"), "p", "q"), "minhash-merged").select(F.col("node").alias("label"), F.col("label").alias("now"))
    moved = labels.join(merged, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    alone = merged.select(F.col("label").alias("node"), F.col("now").alias("label")).join(labels.select("node"), "node", "left_anti")
    labels = stored(moved.unionByName(alone), "minhash-labels")
    classes = equal.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("least").alias("class_id"))
    of_node = stored(classes.select("f1", "f2", "n", "label").join(least, "label").select("f1", "f2", "n", "class_id"), "minhash-classes")
    return profile.select("doc_id", "hash", "f1", "f2", "n").join(of_node, ["f1", "f2", "n"]).select("doc_id", "hash", "class_id")


def _bags_of(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """(node, n, bands, bag) of the wanted rows (node, doc_id, f1, f2, n, bands)."""

    def run(batches):
        for part in slices(batches):
            data, offsets = text_buffers(col(part, "text"))
            _, h, first = shingles(data, offsets)
            keep = np.ones(part.num_rows, bool)
            for salt, name in ((0x1234567, "f1"), (0x89ABCDEF, "f2")):
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
                keep &= (total[first[1:]] - total[first[:-1]]).view(np.int64) == np.asarray(col(part, name))
            bag, first = bags(data, offsets)
            held = list_array(bag.view(np.int64), np.diff(first), pa.int64())
            yield pa.record_batch([col(part, "node"), col(part, "n"), col(part, "bands"), held], names=["node", "n", "bands", "bag"]).filter(pa.array(keep))

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    among = maybe_among(wanted, "doc_id")
    if among is not None:
        own = own.where(among(F.col("doc_id")))
    # a null id matches a null id; several rows of one id are told apart by their fingerprints
    found = own.join(wanted, own["doc_id"].eqNullSafe(wanted["doc_id"])).select("node", "text", "n", "f1", "f2", "bands")
    return map_batches(found, run, "node long, n long, bands array<long>, bag array<long>").dropDuplicates(["node"])


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of :func:`near_duplicates`, with all columns: that of the smallest key.

    Rows that repeat a kept key and text stay; where all keys of a class are
    null, all its rows stay. Of rows with one key and different texts each goes
    by its own class.
    """
    classes = _classes(docs, text, key, threshold)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_kept"), F.col("hash").alias("_hash"))
    return docs.join(kept, docs[key].cast("long").eqNullSafe(kept["_kept"]) & (_text_hash(docs[text]) == kept["_hash"]), "left_semi")


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`near_duplicates` over all of ``documents``."""
    return near_duplicates(documents(spark, sf_dir))


#: All pairs, for small tables only: multisets of five-word shingles, weighted Jaccard, components.
OP1_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY ALL),
p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS common
    FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
    SELECT x, y FROM p JOIN t tx ON tx.doc_id = x JOIN t ty ON ty.doc_id = y WHERE common >= 0.8 * (tx.n + ty.n - common)
    UNION ALL
    SELECT (SELECT min(doc_id) FROM w WHERE len(ws) = 0), doc_id FROM w WHERE len(ws) = 0),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS reached FROM w UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reached)
SELECT node AS doc_id, min(reached) AS class_id, node = min(reached) AS kept FROM r GROUP BY node
"""
