"""Language identification with a byte convolutional network.

A text is cut into windows of a fixed number of bytes, the last one padded with
zeros. Bytes are embedded, filters of several widths run over each window, the
maximum of each filter is kept, and a linear layer with softmax gives the
languages' probabilities. The network is trained in numpy. A text's
probabilities are the mean over all of its windows, weighted by their bytes.

When applied, embedding and filters are folded into tables of byte pairs, so a
filter of four bytes costs two lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.support import col, crc_bucket, documents, map_batches, slices, text_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBEDDING = 8
#: Labelled rows that are learned from, at most: those of smallest hashed id.
TRAIN_ROWS = 6000
#: Windows that stand for a labelled row in training, at most, evenly spread over its whole text.
#: Long texts would outweigh others else. Predictions read every window of every text.
TRAIN_WINDOWS = 4
EPOCHS = 12
BATCH = 128
UNKNOWN = "und"


def cut_windows(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover each text (one of zeros for an empty one), their text numbers and byte counts."""
    size = np.diff(offsets)
    many = np.maximum(-(-size // window), 1)
    text = np.repeat(np.arange(len(size)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = offsets[:-1][text] + number * window
    held = np.minimum(window, offsets[1:][text] - start)
    at = start[:, None] + np.arange(window)
    inside = np.arange(window) < held[:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], np.uint8(0)), text, held


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x E
    filters: list[np.ndarray]  # width x E x F
    bias: np.ndarray  # all filters
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray

    def unit_tables(self) -> list[np.ndarray]:
        """For each width the response of each filter to each byte at each place: width x 256 x F."""
        return [np.einsum("be,wef->wbf", self.embedding, f) for f in self.filters]

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to byte pairs: at the filter's start (all filters), and two bytes on (widths 3 and 4)."""
        t2, t3, t4 = self.unit_tables()

        def pairs(a, b):
            return (a[:, None, :] + b[None, :, :]).reshape(65536, -1)

        zero = np.zeros_like(t3[0])
        head = np.concatenate([pairs(t2[0], t2[1]), pairs(t3[0], t3[1]), pairs(t4[0], t4[1])], 1) + self.bias
        return head.astype(np.float32), np.concatenate([pairs(t3[2], zero), pairs(t4[2], t4[3])], 1).astype(np.float32)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias


def pool_folded(windows: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Maximum of each filter over each window, from the folded tables."""
    wide = np.pad(windows, ((0, 0), (0, 3))).astype(np.uint16)
    pair = wide[:, :-1] << np.uint16(8) | wide[:, 1:]
    out = np.empty((len(windows), head.shape[1]), np.float32)
    n, few = windows.shape[1], head.shape[1] - tail.shape[1]
    for a in range(0, len(windows), 64):
        response = head[pair[a : a + 64, :n]]
        response[:, :, few:] += tail[pair[a : a + 64, 2 : n + 2]]
        out[a : a + 64] = response.max(1)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def fit(windows: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 0) -> Network:
    """Train by Adam on the cross entropy of single windows."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "b": np.zeros(len(WIDTHS) * FILTERS), "v": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, k)), "c": np.zeros(k)}
    p |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS}
    first, second = {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}
    step = 0
    wide = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))
    n = windows.shape[1]
    rows_of = np.arange(BATCH)
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            x, y, rows = wide[batch], label[batch], rows_of[: len(batch)]
            pooled, places = [], []
            for w in WIDTHS:
                tables = np.einsum("be,wef->wbf", p["e"], p[f"f{w}"]).astype(np.float32)
                response = tables[0][x[:, :n]]
                for j in range(1, w):
                    response += tables[j][x[:, j : n + j]]
                at = response.argmax(1)
                places.append(at)
                pooled.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
            z = np.concatenate(pooled, 1) + p["b"]
            hidden = np.maximum(z, 0)
            prob = _softmax(hidden @ p["v"] + p["c"])
            prob[rows, y] -= 1
            prob /= len(batch)
            grad = {"v": hidden.T @ prob, "c": prob.sum(0), "e": np.zeros_like(p["e"])}
            back = (prob @ p["v"].T) * (z > 0)
            grad["b"] = back.sum(0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                seen = x[rows[:, None, None], places[i][:, :, None] + np.arange(w)]  # rows x F x w
                grad[f"f{w}"] = np.einsum("rf,rfwe->wef", g, p["e"][seen])
                np.add.at(grad["e"], seen, np.einsum("rf,wef->rfwe", g, p[f"f{w}"]))
            step += 1
            for name, g in grad.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p["e"], [p[f"f{w}"] for w in WIDTHS], p["b"], p["v"], p["c"])


def train(docs: DataFrame, rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS, text: str = "text", key: str = "doc_id", label: str = "lang") -> Network | None:
    """Learn from rows with a label, a key and a text whose crc32(key as text) mod 3 is not 1; None if there is none.

    At most ``rows`` rows are used (those of smallest hashed key), and at most
    ``windows`` windows of each, spread evenly over the whole text.
    """
    usable = docs.select(F.col(key).alias("k"), F.col(label).alias("y"), F.col(text).alias("text")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("k"), 3) != 1))
    chosen = usable.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(rows)

    def run(batches):
        for part in slices(batches):
            data, offsets = text_buffers(col(part, "text"))
            found, of, held = cut_windows(data, offsets)
            many = np.bincount(of, minlength=part.num_rows)
            number = np.arange(len(of)) - (np.cumsum(many) - many)[of]
            step = np.maximum(many[of] / windows, 1)
            # the first window at or after each multiple of the step
            keep = (np.floor(number / step) != np.floor((number - 1) / step)) & (held > 0)
            yield pa.record_batch([col(part, "k").take(pa.array(of[keep])), col(part, "y").take(pa.array(of[keep])), pa.array([bytes(w) for w in found[keep]], pa.binary())], names=["k", "y", "w"])

    # at most ``rows`` keys are broadcast
    kind = usable.schema["k"].dataType.simpleString()
    got = map_batches(usable.join(F.broadcast(chosen), "k"), run, f"k {kind}, y string, w binary").toPandas().sort_values(["k", "y", "w"], kind="stable")
    if not len(got):
        return None
    languages = sorted(got["y"].unique())
    y = np.searchsorted(np.array(languages, object), got["y"].to_numpy(object))
    return fit(np.stack([np.frombuffer(w, np.uint8) for w in got["w"]]), y, languages)


def identify(docs: DataFrame, network: Network | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score (the language's mean probability) of each whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is all
    if nothing was learned.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}").alias("letters"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tables = network.folded() if network else None

    def run(batches):
        for part in slices(batches, limit=1 << 20):
            n = part.num_rows
            letters = np.asarray(col(part, "letters"))
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if network:
                windows, of, held = cut_windows(*text_buffers(col(part, "text")))
                prob = _softmax(network.logits(pool_folded(windows, *tables))) * np.maximum(held, 1)[:, None]
                begin = np.searchsorted(of, np.arange(n), "left")
                mean = np.add.reduceat(prob, begin, 0)
                mean /= mean.sum(1, keepdims=True)
                best = mean.argmax(1)
                names = np.where(letters, np.array(network.languages, object)[best], UNKNOWN)
                score = np.where(letters, mean.max(1), 0.0)
            yield pa.record_batch([col(part, "doc_id"), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return map_batches(rows, run, f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs``.

    Repeated rows are predicted alike; a null key counts as the empty text in
    the split. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    return identify(docs, train(docs, rows)).select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """:func:`language_id` over all of ``documents``."""
    return language_id(documents(spark, sf_dir))
