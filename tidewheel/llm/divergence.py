"""How far the sources of a language differ in their words: a sketch before exact counts, then sparse pair joins.

Tasks reduce their texts to a row for each language and term, with its sources,
before anything moves. From these rows count-min sketches of document frequencies are
merged. A sketch never underestimates, so a term with a cell below the least
frequency is impossible, and its rows are discarded before they are shuffled.
What is left is counted exactly, and the sketch's false positives go then.

A term that a group lacks has the same small probability as all others that it
lacks. So only terms that both sources of a pair have are joined; the rest of a
pair's sum follows from each source's own terms and the number that both lack.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.support import col, documents, map_batches, slices, stored

LEAST_DOCUMENTS = 10
#: Probabilities are whole numbers of a billionth.
UNIT = 1_000_000_000
#: Cells of a sketch row (a power of two) and its rows; a bit of each cell, 1 MB, goes to each executor.
WIDTH, DEPTH = 1 << 22, 2
#: Entries that a task gathers before it hands them on.
HELD = 300_000
TOP = 10

#: Bytes of terms stay, A-Z lower-cased; all others become spaces.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _summed(lang: str, by_source: dict[str, tuple[Counter, Counter]]) -> pa.RecordBatch:
    """A row for each term that a task met in a language, and one with a null term for the sources themselves."""
    sources = pa.array(list(by_source), pa.string())
    terms = list(chain.from_iterable(n for n, _ in by_source.values()))
    n = np.fromiter(chain.from_iterable(n.values() for n, _ in by_source.values()), np.int64, len(terms))
    docs = np.fromiter(chain.from_iterable(map(d.__getitem__, n) for n, d in by_source.values()), np.int64, len(terms))
    source = np.repeat(np.arange(len(by_source)), [len(n) for n, _ in by_source.values()])
    coded = pa.array(terms, pa.binary()).dictionary_encode()
    code = np.asarray(coded.indices)
    order = np.argsort(code, kind="stable")
    many = np.bincount(code, minlength=len(coded.dictionary))
    total = np.bincount(code, docs, minlength=len(many)).astype(np.int64)
    zeros = np.zeros(len(by_source), np.int64)
    inside = [pa.concat_arrays([sources.take(pa.array(source[order])), sources]), *(pa.array(np.concatenate([x[order], zeros])) for x in (n, docs))]
    offsets = pa.array(np.concatenate([[0], np.cumsum(many), [len(terms) + len(by_source)]]).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(inside, names=["source", "n", "docs"]))
    every = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    return pa.record_batch([pa.array([lang] * len(every), pa.string()), every, pa.array(np.append(total, 0)), lists], names=["lang", "term", "docs", "sources"])


def tallies(docs: DataFrame) -> DataFrame:
    """lang, term, docs (rows that have it) and sources (source, n: occurrences, docs), summed within tasks only.

    A null term lists the sources met.
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))

    def run(batches):
        found: dict[str, dict] = {}
        for part in slices(batches):
            for lang, source, text in zip(*(col(part, c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms = text.encode().translate(_LETTERS).split()
                n, having = found.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
                n.update(terms)
                having.update(set(terms))
            if sum(len(n) for by_source in found.values() for n, _ in by_source.values()) > HELD:
                yield from (_summed(*x) for x in found.items())
                found = {}
        yield from (_summed(*x) for x in found.items())

    return map_batches(own, run, "lang string, term string, docs long, sources array<struct<source:string,n:long,docs:long>>")


def _cells(width: int, depth: int) -> list[Column]:
    """A cell of each row of the sketch, numbered through all rows."""
    return [F.pmod(F.xxhash64("lang", "term", F.lit(i)), F.lit(width)) + i * width for i in range(depth)]


def possible(tally: DataFrame, least: int, width: int = WIDTH, depth: int = DEPTH) -> Column:
    """Whether a row's term may be in ``least`` documents of its language, by the merged sketch.

    Tasks send the cells that their rows touch, at most ``width * depth`` of
    them. Only whether a cell reaches ``least`` is kept, one bit.
    """
    cells = tally.select("docs", F.explode(F.array(*_cells(width, depth))).alias("cell")).groupBy("cell").agg(F.sum("docs").alias("n")).where(F.col("n") >= least)
    place = F.col("cell") + 1  # bitmap functions count from 1
    parts = cells.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map")).collect()
    bits = np.zeros(-(-width * depth // 32768) * 4096, np.uint8)
    for bucket, chunk in parts:
        bits[(bucket - 1) * len(chunk) : bucket * len(chunk)] = np.frombuffer(chunk, np.uint8)
    sent = tally.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def reached(*cells: pd.Series) -> pd.Series:
        hit = np.ones(len(cells[0]), bool)
        for c in cells:
            at = c.to_numpy()
            hit &= (sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return pd.Series(hit)

    return reached(*_cells(width, depth))


def _share(n: str, total: str, terms: str) -> Column:
    """p = 1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exactly."""
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(38,0)) * ({n} + 2) div CAST({total} + 2 * {terms} AS DECIMAL(38,0))")


def _apart(p: str, q: str) -> str:
    """f = floor((p - q)^2 / (p + q)); p and q are a billion and one at most, so its square fits a long."""
    return f"({p} - {q}) * ({p} - {q}) div ({p} + {q})"


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, source, part, item, value, rank: how sources differ from one another (``pair``) and from their language (``term``).

    Terms are runs of letters A-Z, a-z and characters beyond ASCII; only A-Z
    are lower-cased. A language keeps the terms that ``least`` of its rows
    have. ``pair`` has a row for each other source of the language, by value;
    ``term`` the ``top`` terms that the source has more often. Null text, lang
    and source are the empty string, groups of that name are groups like
    others. Repeated rows count each time. Groups without terms take part. A
    source that is alone in its language has no pairs. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    tally = stored(tallies(docs), "divergence-tallies")
    groups = tally.where("term IS NULL").select("lang", F.explode("sources.source").alias("source")).distinct()
    terms = tally.where("term IS NOT NULL")
    survivors = terms.where(possible(terms, least, width, depth)).select("lang", "term", F.explode("sources").alias("s")).select("lang", "term", "s.*")
    counted = stored(survivors.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    language = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = counted.drop("docs").join(language, ["lang", "term"])
    # a row for each language and each source of it
    sizes = language.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0)
    groups = stored(groups.withColumn("none", F.when(F.col("v") > 0, _share("0", "total", "v"))), "divergence-groups")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "total", "v").alias("p"), "none", _share("lang_n", "lang_total", "v").alias("q"))
    shares = stored(shares, "divergence-shares")

    a = groups.select("lang", F.col("source").alias("a"), F.col("none").alias("a_none"), F.col("own").alias("a_own"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("none").alias("b_none"), F.col("own").alias("b_own"))
    both = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("a_p"), F.col("none").alias("a_none"))
    with_b = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("b_p"), F.col("none").alias("b_none"))
    # what a shared term adds to the sums below, in which it is taken for absent from the other source
    change = f"{_apart('a_p', 'b_p')} - {_apart('a_p', 'b_none')} - {_apart('a_none', 'b_p')} + {_apart('a_none', 'b_none')}"
    shared = both.join(with_b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.expr(change)).alias("shared"))
    # a source's own terms against the probability of a term that the other lacks, by distinct probability
    steps = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("k"))
    alone = steps.join(b, "lang").where("a != b").groupBy("lang", "a", "b").agg(F.sum(F.expr(f"k * ({_apart('p', 'b_none')})")).alias("alone"))
    pairs = a.join(b, "lang").where("a < b").join(shared, ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left")
    pairs = pairs.join(alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("other")), ["lang", "a", "b"], "left")
    zero = F.lit(0).cast("long")
    rest = F.expr(f"(v - a_own - b_own) * ({_apart('a_none', 'b_none')})")
    pairs = pairs.select("lang", "a", "b", reduce(lambda x, y: x + y, (F.coalesce(x, zero) for x in (F.col("shared"), F.col("alone"), F.col("other"), rest))).alias("value"))
    ways = F.explode(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))))).alias("w")
    by_pair = pairs.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    by_term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = by_term.select("*", rank).where(F.col("rank") <= top)
    return by_pair.select("*", rank).unionByName(ranked)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """:func:`divergence` over all of ``documents``."""
    return divergence(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN l USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * s.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (l.n + 2)) // (s.total + 2 * s.v)::HUGEINT AS q
      FROM g JOIN l USING (lang) JOIN s USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term
      LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM k WHERE part = 'pair' OR rank <= 10
"""
