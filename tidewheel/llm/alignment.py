"""Alignment of the tokens of two tokenizers, as joins and windows over exploded tokens.

Each token has the offset of its last byte: lengths are summed in a window over
the exploded tokens of a text. A byte at which tokens of both tokenizers end is a
cut, found by an equi-join on text and end. How many cuts lie before a token is
the number of its group, and both sides' groups are joined by text and number.

Neither vocabulary has an entry across a single space between other characters,
so texts are cut there into stretches, and a text's alignment is that of its
stretches one after another. Each distinct stretch is encoded and aligned once,
however many texts have it. Blocks of texts hold their stretches by number, with
a dictionary of the block; the dictionaries are joined with the aligned
stretches, and a block's texts are put together from them. A block has a bounded
number of bytes (or one text), so neither a frequent stretch nor a large corpus
ends up in one task.

How often an id pair is linked is counted over stretches, each as often as it
occurs in texts that have tokens.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.memory import cache
from tidewheel.llm.support import col, documents, list_array, map_batches, removed, reread, sibling, slices, stored, stored_with

#: Bytes of text beyond which a block ends.
BLOCK_BYTES = 32 << 20
#: Stretches that the tokenizers get as one text.
JOINED = 500
#: Entries of a dictionary that go into one row.
WORDS_A_ROW = 1 << 15
#: Pair counts of at most so many rows (24 bytes each) are broadcast; larger tables are joined by shuffle.
BROADCAST_PAIRS = 1 << 17

#: White space at an end or next to white space: then only some spaces are places to cut at.
_RUN = re.compile(r"\A\s|\s\s|\s\Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def stretches(text: str) -> list[str]:
    """``text`` cut at each single space between other characters; joined by one space they are the text. None for the empty text."""
    if not text:
        return []
    return _CUT.split(text) if _RUN.search(text) else text.split(" ")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones are themselves, the rest follow from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, and the bytes of each entry of their vocabularies."""

    def __init__(self, a: str | None = None, b: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a or public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b or public_tokenizers.path("piece_bpe_32k.model"))
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        for entries in (self.a_bytes, self.b_bytes):
            if any(not e or re.search(r"\S ", e.decode("utf-8", "replace")) for e in entries):
                raise ValueError("an entry is empty, or goes on with a space after other characters")
        self.a_size, self.b_size = (np.array([len(e) for e in entries], np.int32) for entries in (self.a_bytes, self.b_bytes))

    def _both(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts one after another and how many each text has, for either side."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        out = []
        for ids in (a, self.b.encode(texts, num_threads=1)):
            many = np.fromiter(map(len, ids), np.int64, len(ids))
            out.append((np.fromiter(chain.from_iterable(ids), np.int32, int(many.sum())), many))
        return out

    def alone(self, texts: list[str]) -> tuple[tuple, tuple, np.ndarray]:
        """Ids and counts of either side, and whether both sides' bytes are a space and the text."""
        a, b = self._both(texts)
        same = np.ones(len(texts), bool)
        for (ids, many), entries in ((a, self.a_bytes), (b, self.b_bytes)):
            found, ends = list(map(entries.__getitem__, ids.tolist())), np.cumsum(many).tolist()
            for i, (s, e, t) in enumerate(zip([0, *ends[:-1]], ends, texts, strict=True)):
                same[i] &= b"".join(found[s:e]) == b" " + t.encode()
        return a, b, same

    def joined(self, texts: list[str]) -> tuple[tuple, tuple, np.ndarray]:
        """:meth:`alone` for stretches without white space at their ends: many at once, told apart by their bytes."""
        groups = [texts[i : i + JOINED] for i in range(0, len(texts), JOINED)]
        (a, a_many), (b, b_many) = self._both([" ".join(g) for g in groups])
        parts: list[list] = [[], [], [], [], []]
        a_end, b_end = np.cumsum(a_many), np.cumsum(b_many)
        for i, group in enumerate(groups):
            sides = (a[a_end[i] - a_many[i] : a_end[i]], self.a_bytes, self.a_size), (b[b_end[i] - b_many[i] : b_end[i]], self.b_bytes, self.b_size)
            raw = [t.encode() for t in group]
            want, ends = b" " + b" ".join(raw), np.cumsum([len(r) + 1 for r in raw])
            bounds = [np.searchsorted(np.cumsum(size[ids]), ends, "left") + 1 for ids, _, size in sides]
            if all(b"".join(map(entries.__getitem__, ids.tolist())) == want for ids, entries, _ in sides):
                found = [(ids, np.diff(bound, prepend=0)) for (ids, _, _), bound in zip(sides, bounds, strict=True)]
                same = np.ones(len(group), bool)
            else:
                *found, same = self.alone(group)
            for part, x in zip(parts, (*found[0], *found[1], same), strict=True):
                part.append(x)
        a, a_many, b, b_many, same = map(np.concatenate, parts)
        return (a, a_many), (b, b_many), same


_pairs: dict[tuple, Pair] = cache("alignment")


def pair(a: str | None = None, b: str | None = None) -> Pair:
    if (a, b) not in _pairs:
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


def blocks(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds: texts (block, key, codes), and parts of a block's dictionary (block, first, words, counts).

    codes are 32-bit integers, the lower byte first: rows with binary columns go to and from workers faster than lists.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["block", "key", "codes", "first", "words", "counts"]

    def run(batches):
        block, held = TaskContext.get().partitionId() << 33, 0
        number, seen = defaultdict(count().__next__), np.zeros(0, np.int64)

        def dictionary(kind):
            words = list(number)
            for at in range(0, len(words), WORDS_A_ROW):
                part = slice(at, at + WORDS_A_ROW)
                yield pa.record_batch([pa.array([block]), pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([at], pa.int32()), pa.array([words[part]], pa.list_(pa.string())), pa.array([seen[part]], pa.list_(pa.int64()))], names=names)

        kind = pa.null()
        for part in slices(batches):
            keys, n = col(part, "key"), part.num_rows
            kind, lists = keys.type, []
            for t in col(part, "text").to_pylist():
                words = stretches(t)
                lists.append(np.fromiter(map(number.__getitem__, words), "<i4", len(words)))
                held += len(t)
            now = np.bincount(np.concatenate(lists), minlength=len(number))
            now[: len(seen)] += seen
            seen = now
            yield pa.record_batch([pa.array(np.full(n, block)), keys, pa.array([x.tobytes() for x in lists], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            if held > size:
                yield from dictionary(kind)
                block, number, seen, held = block + 1, defaultdict(count().__next__), np.zeros(0, np.int64), 0
        yield from dictionary(kind)

    return map_batches(own, run, f"block long, key {own.schema['key'].dataType.simpleString()}, codes binary, first int, words array<string>, counts array<long>")


def encoded(texts: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Columns of ``texts`` (text, n) with a, a_size, b, b_size (ids and lengths by both tokenizers) and same."""

    def run(batches):
        both = pair(a, b)
        for part in slices(batches):
            words = col(part, "text").to_pylist()
            loose = np.fromiter((w[:1].isspace() or w[-1:].isspace() for w in words), bool, len(words))
            for mine, how in ((~loose, both.joined), (loose, both.alone)):
                if not mine.any():
                    continue
                own = part.filter(pa.array(mine))
                *sides, same = how(list(compress(words, mine.tolist())))
                out = [col(own, "text"), col(own, "n")]
                for (ids, many), size in zip(sides, (both.a_size, both.b_size), strict=True):
                    out += [list_array(ids, many, pa.int32()), list_array(size[ids], many, pa.int32())]
                yield pa.record_batch([*out, pa.array(same)], names=["text", "n", "a", "a_size", "b", "b_size", "same"])

    return map_batches(texts.select("text", "n"), run, "text string, n long, a array<int>, a_size array<int>, b array<int>, b_size array<int>, same boolean")


def _ends(dealt: DataFrame, side: int) -> DataFrame:
    """key, n, pos, id, end of each token of one side, by lengths summed along the text."""
    each = dealt.select("key", "n", F.posexplode(F.arrays_zip(F.col("t")[2 * side].alias("id"), F.col("t")[2 * side + 1].alias("size"))).alias("pos", "x"))
    along = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("key", "n", "pos", F.col("x.id").alias("id"), F.sum("x.size").over(along).alias("end"))


def _grouped(own: DataFrame, other: DataFrame, name: str, *more: Column) -> DataFrame:
    """key, group and the ids of each group of one side: cuts before a token number its group."""
    cuts = own.join(other.select("key", "end", F.lit(1).alias("cut")).hint("merge"), ["key", "end"], "left")
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cuts.select("key", "n", "pos", "id", F.coalesce(F.sum("cut").over(before), F.lit(0)).alias("group"))
    ids = F.array_sort(F.collect_list(F.struct("pos", "id")))
    return numbered.groupBy("key", "group").agg(F.transform(ids, lambda x: x["id"]).alias(name), *more)


#: What lets a text's rows stay in the task that they are in: joins and groups may use a partitioning by the text alone, and groups follow the rows' order.
TOGETHER = {"spark_sql_requireAllClusterKeysForCoPartition": "false", "spark_sql_execution_useObjectHashAggregateExec": "false"}


def align(tokens: DataFrame) -> DataFrame:
    """key, n and groups (number, a, b: lists of ids) of texts that have equal bytes on both sides.

    ``tokens`` has key (unique), n (carried along), and for both sides the ids
    (a, b) and their lengths in bytes (a_size, b_size), none of them 0. A
    group's last tokens are its link: no other tokens of it end together. In a
    session with the settings ``TOGETHER``, nothing is shuffled after the texts
    are dealt by key.
    """
    packed = tokens.select("key", "n", F.array("a", "a_size", "b", "b_size").alias("t"))  # one column, so both sides read the same exchange
    dealt = packed.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    a, b = _ends(dealt, 0), _ends(dealt, 1)
    groups = _grouped(a, b, "a", F.first("n").alias("n")).join(_grouped(b, a, "b").hint("merge"), ["key", "group"])
    return groups.groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("group", "a", "b"))).alias("groups"))


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, total (links of the pair, each n times) and best (no id pairs with b more often)."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("total"))
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    return counts.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def _described(aligned: DataFrame) -> DataFrame:
    """key, n, groups written out (ids by comma, sides by bar, groups by semicolon) and links (a, b)."""

    def ids(x: Column) -> Column:
        return F.array_join(x.cast("array<string>"), ",")

    written = F.array_join(F.transform("groups", lambda g: F.concat(ids(g["a"]), F.lit("|"), ids(g["b"]))), ";")
    links = F.transform("groups", lambda g: F.struct(F.element_at(g["a"], -1).alias("a"), F.element_at(g["b"], -1).alias("b")))
    return aligned.select("key", "n", written.alias("groups"), links.alias("links"))


def _without(blocked: DataFrame, words: DataFrame, odd: DataFrame) -> DataFrame:
    """text, n (below 0): stretches of texts that have an odd stretch, whose links don't count."""
    here = words.join(odd.select("text"), "text").groupBy("block").agg(F.collect_set("code").alias("odd"))
    rows = blocked.where("codes IS NOT NULL").join(here, "block").select("block", "codes", "odd")

    def run(batches):
        for batch in batches:
            for block, codes, bad in zip(*(col(batch, c).to_pylist() for c in ("block", "codes", "odd")), strict=True):
                codes = np.frombuffer(codes, "<i4")
                if np.isin(codes, bad).any():
                    code, n = np.unique(codes, return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(code), block)), pa.array(code), pa.array(n)], names=["block", "code", "n"])

    many = map_batches(rows, run, "block long, code int, n long").groupBy("block", "code").agg(F.sum("n").alias("n"))
    return words.join(many, ["block", "code"]).select("text", (-many["n"]).alias("n"))


_STATS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def cross_align(docs: DataFrame, text: str = "text", key: str = "doc_id", a: str | None = None, b: str | None = None, size: int = BLOCK_BYTES, groups: str = "all") -> DataFrame:
    """One row per row of ``docs``: doc_id (from ``key``), n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``a`` is a byte-level BPE file, which gets a space and the text; ``b`` a
    SentencePiece model, which adds the space. groups has the ids of each group,
    ``a1,a2|b1;a3|b2,b3``. n_best counts links whose pair is as frequent as any
    of its b; count_sum adds the pair counts of all links. With ``groups="digest"``
    the column groups_sha256 stands for them, hex digits (empty for empty groups). Special tokens'
    strings in a text are ordinary text. Texts that are null, empty, or that a
    tokenizer does not give back byte by byte (B writes U+2581 as a space) have
    zeros and empty groups, and their links don't count. Null and repeated keys
    are rows of their own. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    blocked = stored(blocks(docs, text, key, size), "align-blocks")
    listed = F.posexplode(F.arrays_zip(F.col("words").alias("text"), F.col("counts").alias("n"))).alias("code", "w")
    words = blocked.where("words IS NOT NULL").select("block", "first", listed).select("block", (F.col("first") + F.col("code")).alias("code"), F.col("w.text").alias("text"), F.col("w.n").alias("n"))
    distinct = words.groupBy("text").agg(F.sum("n").alias("n"))
    tokens, seen = stored_with(encoded(distinct, a, b).withColumn("key", F.monotonically_increasing_id()), "align-tokens", odd=F.count_if(~F.col("same")))
    near, odd = sibling(docs.sparkSession, **TOGETHER), None
    good = reread(tokens, near).where("same")
    if seen["odd"]:
        less = _without(blocked, words, tokens.where("NOT same")).groupBy("text").agg(F.sum("n").alias("less"))
        odd = stored(tokens.where("same").join(less, "text", "left").withColumn("n", F.col("n") + F.coalesce("less", F.lit(0))).drop("less"), "align-input")
        good = reread(odd, near)
    aligned = stored(_described(align(good)), "align-groups", docs.sparkSession)
    links = aligned.select("key", "n", F.explode("links").alias("l")).select("key", "n", "l.a", "l.b")
    counted, have = stored_with(pair_counts(links), "align-pairs", n=F.count("*"))
    counts = F.broadcast(counted) if have["n"] <= BROADCAST_PAIRS else counted
    sums = links.join(counts, ["a", "b"]).groupBy("key").agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("total").alias("count_sum"))
    own = tokens.select("key", "text", "same", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"))
    written = aligned.select("key", "groups", F.size("links").cast("long").alias("n_groups"))
    found = stored(own.join(written, "key", "left").join(sums, "key", "left").select("text", "same", "groups", *_STATS), "align-stretches")
    removed(tokens, aligned, counted, *([odd] if odd is not None else []))
    packed = F.concat_ws(":", F.concat_ws(",", F.col("same").cast("int"), *(F.coalesce(c, F.lit(0)) for c in _STATS)), "groups").cast("binary")
    # written, so that the shuffles by stretch and by block don't lie on the disks together
    entries = stored(words.select("block", "code", "text").join(found.select("text", packed.alias("entry")), "text").select("block", "code", "entry"), "align-entries")
    removed(found)
    entries = entries.select("block", "code", F.lit(None).cast(blocked.schema["key"].dataType).alias("key"), "entry")
    rows = blocked.where("codes IS NOT NULL").select("block", F.lit(TEXT).alias("code"), "key", F.col("codes").alias("entry"))
    return _put_together(entries.unionByName(rows), blocked.schema["key"].dataType.simpleString(), groups == "digest")


#: Stands in place of a dictionary's code for a text, after all codes.
TEXT = (1 << 31) - 1


def _put_together(rows: DataFrame, key: str, digest: bool) -> DataFrame:
    """The result's rows from each block's dictionary entries and texts."""
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a block's entries come first, by code
    dealt = rows.repartition(shards, "block").sortWithinPartitions("block", "code")

    def run(batches):
        block, entries, held = None, None, []
        for batch in batches:
            of, is_text = np.asarray(col(batch, "block")), np.asarray(col(batch, "code")) == TEXT
            edge = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (is_text[1:] != is_text[:-1]))) if len(of) else []
            for s, e in zip(edge, [*edge[1:], len(of)], strict=True):
                part = batch.slice(s, e - s)
                if of[s] != block:
                    block, entries, held = of[s], None, []
                if not is_text[s]:
                    held += col(part, "entry").to_pylist()
                    continue
                if entries is None:
                    entries, held = opened(held), []
                yield described(part, *entries)

    def opened(packed: list[bytes]):
        heads, _, texts = zip(*(p.partition(b":") for p in packed), strict=True) if packed else ((), (), ())
        numbers = np.array(b",".join(heads).decode().split(","), np.int64).reshape(-1, 1 + len(_STATS)).T if packed else np.zeros((1 + len(_STATS), 0), np.int64)
        return texts, numbers[0] == 1, np.ascontiguousarray(numbers[1:])

    def described(part, texts, same, stats):
        total = np.zeros((len(_STATS), part.num_rows), np.int64)
        written = []
        for i, codes in enumerate(col(part, "entry").to_pylist()):
            mine = np.frombuffer(codes, "<i4")
            if same[mine].all():
                total[:, i] = stats[:, mine].sum(1)
                written.append(b";".join(map(texts.__getitem__, mine.tolist())))
            else:
                written.append(b"")
            if digest and written[-1]:
                written[-1] = hashlib.sha256(written[-1]).hexdigest().encode()
        return pa.record_batch([col(part, "key"), *map(pa.array, total), pa.array(written, pa.binary()).cast(pa.string())], names=["doc_id", *_STATS, name])

    name = "groups_sha256" if digest else "groups"
    return map_batches(dealt, run, f"doc_id {key}, {', '.join(f'{c} long' for c in _STATS)}, {name} string")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of :func:`cross_align` over all of ``documents``."""
    return cross_align(documents(spark, sf_dir), groups="digest")
