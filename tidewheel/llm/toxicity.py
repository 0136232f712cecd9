"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features are rates over a text: hits of a general insult lexicon, hits of stems
learned from labelled rows, how near hits stand to second-person words,
capitals, punctuation, and obfuscation (digits and symbols for letters, letters
kept apart). Learned stems are word beginnings of 4 to 6 bytes that occur in
toxic texts far more often than chance allows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import boosting
from tidewheel.llm.memory import only
from tidewheel.llm.support import col, crc_bucket, documents, map_batches, slices, small_batches, stored, text_buffers
from tidewheel.llm.words import Words, find, prefix_hashes

#: Labelled rows that are learned from, at most: those of smallest hashed id.
TRAIN_ROWS = 20_000
STEM_BYTES = (4, 5, 6)
NEAR_WORDS = 6

INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown fool jerk freak garbage vermin coward "
    "imbecile filth filthy scumbag dumbass bastard pig parasite creep lunatic retard ugly hate kill "
    "dumm blöd trottel abschaum müll arschloch schwein versager idiotisch hässlich "
    "crétin débile ordure connard salaud imbécile nul raclure minable dégueulasse "
    "idiota estúpido estúpida imbécil basura escoria asqueroso inútil patético tonto"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo".split()

#: Letters are kept, capitals made small, digits and signs that stand for letters replaced.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLD = _LOWER.copy()
for _a, _b in zip(b"0134578@$", b"oieastbas", strict=True):
    _FOLD[_a] = _b
_GAP = np.ones(256, bool)
_GAP[[*range(97, 123), *range(128, 256)]] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = ~_GAP | _UPPER
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _hashes(entries: list[str]) -> np.ndarray:
    raw = [_FOLD[np.frombuffer(x.encode(), np.uint8)] for x in entries]
    data = np.concatenate([np.append(r, np.uint8(32)) for r in raw])
    return np.unique(find(data, np.array([0, len(data)]), _GAP).hash)


INSULT_HASHES = _hashes(INSULTS)
PERSON_HASHES = _hashes(SECOND_PERSON)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words]:
    folded = _FOLD[data]
    return folded, find(folded, offsets, _GAP)


def features(data: np.ndarray, offsets: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """Dense features of each text of a slice."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    folded, w = _tokens(data, offsets)
    count = w.counts()
    many = np.maximum(count, 1)

    def rate(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(w.text[mask], minlength=n).astype(float)

    listed = _among(w.hash, INSULT_HASHES)
    learned = np.zeros(len(w.hash), bool)
    for length in STEM_BYTES:
        learned |= _among(prefix_hashes(folded, w, length), stems)
    person = _among(w.hash, PERSON_HASHES)
    hit = listed | learned
    at, who = np.flatnonzero(hit), np.flatnonzero(person)
    near = np.zeros(len(hit), bool)
    if len(at) and len(who):
        right = np.minimum(np.searchsorted(who, at), len(who) - 1)
        left = np.maximum(right - 1, 0)
        for side in (who[right], who[left]):
            near[at[(np.abs(side - at) <= NEAR_WORDS) & (w.text[side] == w.text[at])]] = True
    single = (w.end - w.start == 1) & (w.start > 0)
    apart = single.copy()
    apart[1:] &= single[:-1] & (w.start[1:] == w.end[:-1] + 1) & (w.text[1:] == w.text[:-1])
    apart[:1] = False
    inside = np.zeros(len(data), bool)
    if len(data) > 2:
        odd = _DIGIT | (_PUNCT & (_FOLD != _LOWER))
        inside[1:-1] = odd[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]]
    upper = _UPPER[data]
    shout = np.zeros(len(data), bool)
    shout[1:] = upper[1:] & upper[:-1]
    return np.column_stack(
        [
            per_text(listed) / many,
            per_text(learned) / many,
            np.log1p(per_text(listed)),
            np.log1p(per_text(learned)),
            per_text(near) / np.maximum(per_text(hit), 1),
            per_text(person) / many,
            rate(upper),
            rate(shout),
            rate(_PUNCT[data]),
            rate(data == 33),
            rate(_DIGIT[data]),
            rate(inside),
            per_text(apart) / many,
            np.log1p(count),
            (np.diff(offsets) / many),
            rate(data >= 128),
        ]
    )


@dataclass
class Model:
    stems: np.ndarray
    trees: boosting.Boosted
    calibration: boosting.Isotonic

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.trees.margin(features(data, offsets, self.stems))), 0.0, 1.0)


def _stem_counts(rows: DataFrame) -> DataFrame:
    """For each stem hash: rows that have it, and toxic ones among them; summed within tasks first."""

    def run(batches):
        for part in slices(batches, "text", 8 << 20):
            data, offsets = text_buffers(col(part, "text"))
            folded, w = _tokens(data, offsets)
            toxic = np.asarray(col(part, "toxic")).astype(np.int64)
            h = np.concatenate([prefix_hashes(folded, w, k) for k in STEM_BYTES])
            text = np.tile(w.text, len(STEM_BYTES))[h != 0]
            h = h[h != 0]
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
            h, text = h[new], text[new]
            stems, begin = np.unique(h, return_index=True)
            if len(stems):
                held = np.diff(np.append(begin, len(h)))
                yield pa.record_batch([pa.array(stems.view(np.int64)), pa.array(held), pa.array(np.add.reduceat(toxic[text], begin))], names=["stem", "held", "bad"])

    return map_batches(rows.select("text", "toxic"), run, "stem long, held long, bad long").groupBy("stem").agg(F.sum("held").alias("held"), F.sum("bad").alias("bad"))


def learn_stems(rows: DataFrame, total: int, bad: int) -> np.ndarray:
    """Hashes of stems that toxic rows have far more often than chance allows.

    The evidence of a stem is the log-likelihood ratio of its share of toxic
    rows against the overall share. It must exceed the logarithm of twenty
    times the number of stems, so that chance brings in 0.05 stems or so. There
    are no more of them than the sample's words, which ``TRAIN_ROWS`` bounds.
    """
    if not 0 < bad < total:
        return np.zeros(0, np.uint64)
    counts = stored(_stem_counts(rows), "stems")
    tried = max(1, counts.count())
    base = bad / total
    share = F.col("bad") / F.col("held")
    evidence = F.col("held") * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    found = counts.where((F.col("bad") > 0) & (share > min(0.5, 3 * base))).withColumn("evidence", evidence).where(F.col("evidence") > float(np.log(20 * tried)))
    top = found.select("stem").collect()
    return np.unique(np.array([r[0] for r in top], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id") -> Model:
    """Learn from labelled rows whose crc32(key as text) mod 5 is not 0, at most ``rows`` of them.

    Rows without a label or a key are not learned from; of several labels of a
    key the largest counts. Two thirds of the rows grow the trees, the rest
    calibrate them. Without rows of both classes the score is constant.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), 5) != 0))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most ``rows`` rows of 12 bytes are broadcast
    sample = stored(own.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    total, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    stems = learn_stems(sample, total, bad)

    def run(batches):
        for part in slices(batches):
            x = features(*text_buffers(col(part, "text")), stems)
            yield pa.record_batch([col(part, "doc_id"), col(part, "toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    found = map_batches(sample, run, "doc_id long, toxic int, x array<double>").select("doc_id", "toxic", "x", crc_bucket(F.col("doc_id"), 15).alias("fold")).toPandas().sort_values(["doc_id", "toxic"], kind="stable")
    if not len(found):
        return Model(stems, boosting.fit(np.zeros((0, 1)), np.zeros(0)), boosting.fit_isotonic(np.zeros(0), np.zeros(0)))
    x, y = np.stack(found["x"].to_list()), found["toxic"].to_numpy(float)
    calibrate = found["fold"].to_numpy() % 3 == 0
    if calibrate.all() or not calibrate.any():
        calibrate = np.arange(len(x)) % 3 == 0
    trees = boosting.fit(x[~calibrate], y[~calibrate])
    return Model(stems, trees, boosting.fit_isotonic(trees.margin(x[calibrate]), y[calibrate]))


def scorer(model: Model) -> Callable[[Column], Column]:
    """The score of a text column, as a column: only texts go to Python and only scores come back."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        only(None)
        parts = [model.score(*text_buffers(col(part, "text"))) for part in slices(iter([pa.record_batch([texts], names=["text"])]))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text.

    Null is scored as the empty text, rows that repeat are scored alike, an
    empty table gives an empty result. A column of ``docs`` that is called like
    the new one is replaced.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(name, scorer(model)(F.coalesce(F.col(text), F.lit(""))))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns; texts are treated as by :func:`score`."""
    small_batches(docs.sparkSession)
    return docs.where(scorer(model)(F.coalesce(F.col(text), F.lit(""))) < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``.

    Repeated rows are scored alike. An empty table gives an empty result. Other
    columns of ``docs`` are ignored, whatever their names.
    """
    model = train(docs, labels, rows)
    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        for part in slices(batches):
            yield pa.record_batch([col(part, "doc_id"), pa.array(model.score(*text_buffers(col(part, "text"))))], names=["doc_id", "score"])

    scored = map_batches(own, run, "doc_id long, score double")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """:func:`toxicity` over all of ``documents``, learned from ``labels``."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
