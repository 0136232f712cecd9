"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The best segmentation of a text maximises the sum of its pieces' scores. That
is a product of matrices over (max, +): the state at a cut is how far the piece
that crosses it reaches beyond. Giant documents are cut into chunks anywhere;
each chunk yields its transfer matrix from entry to exit states, the matrices
are combined by an associative scan, and with the scores of its entry states
each chunk is solved and traced back on its own, for every exit state. Chunks
are the lanes of numpy operations here.

Smaller documents are segmented piece of text by piece of text: no piece has a
space after another sign, so each stretch that begins with spaces is solved on
its own, and a worker remembers the stretches it has met.

A vocabulary of merge ranks has no scores that add up. It is read as a unigram
vocabulary whose pieces are as frequent as their rank says (Zipf's law): the
score is the logarithm of 1 / (1 + rank). Scores are rounded to multiples of
2**-20, so sums are exact. Of equal sums the segmentation with the longest last
piece wins, at every step backwards. A sign
without a piece becomes its UTF-8 bytes' pieces; so does U+2581 itself, the
mark for spaces, which makes decoding lossless. A worker holds one vocabulary
and encodes, decodes and digests a slice of texts before it takes the next.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.memory import Memory, cache
from tidewheel.llm.support import col, documents, list_array, map_batches, slices, strings
from tidewheel.llm.words import mix, prefix_hash, range_hash

MARK = 0x2581
#: Documents of more characters are solved by the parallel scan.
GIANT_CHARS = 1 << 15
CHUNK_CHARS = 128
#: Lanes that are solved in step, and chunks whose arcs are held at once.
LANES = 4096
BLOCK_CHUNKS = 512
#: Stretches that a worker remembers, and their characters and ids together.
CACHE_STRETCHES = 300_000
CACHE_SIGNS = 6_000_000
#: Stretches that are solved at once, ids that are decoded at once, text bytes that are taken at once.
LEARN_STRETCHES = 8_000
DECODE_IDS = 200_000
SLICE_BYTES = 512 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_RUNS = re.compile(" +[^ ]*").findall


def piece_scores(scores: np.ndarray) -> np.ndarray:
    """Log-probabilities in multiples of 2**-20; scores that are whole numbers are merge ranks.

    Scores of -1e9 and less mark pieces without a rank; they get the last one.
    """
    ranked = scores > -1e9
    if ranked.any() and (scores[ranked] == np.round(scores[ranked])).all():
        ranks = -scores[ranked]
        scores = np.where(ranked, -np.log1p(np.where(ranked, -scores, 0)), -np.log1p(ranks.max() + 1))
    return np.round(scores * 2**20) / 2**20


class Vocabulary:
    """Pieces, scores and lookup tables of a SentencePiece model file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.bytes = np.zeros(256, np.int32)
        texts, ids, scores, raw = [], [], [], []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                raw.append(piece.replace(chr(MARK), " ").encode())
                texts.append(piece)
                ids.append(i)
                scores.append(model.get_score(i))
        if any(chr(MARK) in t.lstrip(chr(MARK)) for t in texts):
            raise ValueError("a piece has a space after another sign")
        scores = piece_scores(np.array(scores))
        self.longest = max(map(len, texts))
        self.unknown = float(scores.min()) - 10.0
        lengths = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(lengths)
        prefix = prefix_hash(points + np.uint64(1), _BASE)
        h = mix(range_hash(prefix, ends - lengths, ends, _BASE) + lengths.astype(np.uint64))
        # open addressing; a lookup probes on until it meets the key or a free slot
        self.mask = (1 << 20) - 1
        self.keys, self.values, self.scores = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1, np.int32), np.full(1 << 20, -np.inf)
        self.probes = 1
        for key, i, score in zip(h.tolist(), ids, scores.tolist(), strict=True):
            at, tried = key & self.mask, 1
            while self.keys[at]:
                at, tried = (at + 1) & self.mask, tried + 1
            self.keys[at], self.values[at], self.scores[at] = key, i, score
            self.probes = max(self.probes, tried)
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_size = np.array([len(r) for r in raw], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.by_byte = np.zeros(len(raw), bool)
        self.by_byte[self.bytes] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 if there is none) and score (-inf) of hashed pieces."""
        at = (h & np.uint64(self.mask)).astype(np.int64)
        ids, scores = np.full(len(h), -1, np.int32), np.full(len(h), -np.inf)
        open_ = np.arange(len(h))
        for _ in range(self.probes):
            key = self.keys[at[open_]]
            hit = key == h[open_]
            found = open_[hit]
            ids[found], scores[found] = self.values[at[found]], self.scores[at[found]]
            open_ = open_[~hit & (key != 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
        return ids, scores

    def arcs(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (longest x characters) of the pieces of each length from 1 that begin at each character.

        A character that is no piece has the id -2 and the score of unknown ones.
        """
        n = len(points)
        ids, scores = np.full((self.longest, n), -1, np.int32), np.full((self.longest, n), -np.inf)
        prefix = prefix_hash(points.astype(np.uint64) + np.uint64(1), _BASE)
        for k in range(1, min(self.longest, n) + 1):
            start = np.arange(n - k + 1)
            ids[k - 1, : n - k + 1], scores[k - 1, : n - k + 1] = self.find(mix(range_hash(prefix, start, start + k, _BASE) + np.uint64(k)))
        bare = ids[0] == -1
        ids[0, bare], scores[0, bare] = -2, self.unknown
        return ids, scores


def _forward(scores: np.ndarray, base: np.ndarray, length: int, best: np.ndarray, reach: int) -> np.ndarray:
    """Solve lanes in step. ``best`` (lanes x reach+length+reach) holds entry scores at its columns reach..2*reach-1.

    Lane ``i`` reads arcs at ``base[i] + t``; arcs begin before ``length`` and may end up to ``reach - 1`` beyond.
    Returns the length of the winning last piece for each lane and place (0: an entry state or unreached).
    """
    last = np.zeros((len(base), length + reach), np.int8)
    limit, furthest = scores.shape[1], int(base.max())
    for t in range(1, length + reach):
        low = max(1, t - length + 1)
        sizes = np.arange(reach, low - 1, -1)
        sizes = sizes[sizes <= t] if t < reach else sizes
        if not len(sizes):
            continue
        begin = base[:, None] + t - sizes[None, :]
        if furthest + t <= limit:
            value = best[:, reach + t - sizes] + scores[sizes - 1, begin]
        else:
            value = best[:, reach + t - sizes] + scores[sizes - 1, np.minimum(begin, limit - 1)]
            value[begin + sizes > limit] = -np.inf
        choice = value.argmax(1)
        top = value[np.arange(len(base)), choice]
        # an entry state stands for a piece that began before the lane, so it is longer than any other
        better = top > best[:, reach + t]
        best[better, reach + t] = top[better]
        last[better, t] = sizes[choice[better]]
    return last


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacked matrices."""
    out = np.full(a.shape, -np.inf)
    for j in range(a.shape[2]):
        np.maximum(out, a[:, :, j, None] + b[:, j, None, :], out=out)
    return out


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by doubling strides; combining is associative."""
    out, stride = matrices.copy(), 1
    while stride < len(out):
        out[stride:] = combine(out[:-stride], out[stride:])
        stride *= 2
    return out


def _blocks(vocabulary: Vocabulary, points: np.ndarray, base: np.ndarray, chunk: int):
    """For each block of chunks: its first and last chunk, where its points begin, and their scores.

    A block's points reach back one piece, for those that cross into its first
    chunk, and as far on as pieces that begin in its last chunk.
    """
    k = vocabulary.longest
    for a in range(0, len(base), BLOCK_CHUNKS):
        b = min(a + BLOCK_CHUNKS, len(base))
        low = max(0, int(base[a]) - k)
        _, scores = vocabulary.arcs(points[low : base[b - 1] + chunk + k])
        yield a, b, low, scores


def solve_giant(vocabulary: Vocabulary, points: np.ndarray, chunk: int = CHUNK_CHARS) -> np.ndarray:
    """Lengths of the pieces of the best segmentation of one long text, by the parallel scan."""
    n, k = len(points), vocabulary.longest
    if n <= k or chunk < k:
        return solve_small(vocabulary, points, np.array([0]), np.array([n]))
    base = np.arange(0, n, chunk)
    many = len(base)
    # entry states: how far a piece that crosses into the chunk can reach
    possible = np.zeros((many, k), bool)
    possible[:, 0] = True
    matrices = np.full((many, k, k), -np.inf)
    blocks = _blocks(vocabulary, points, base, chunk)
    if many <= BLOCK_CHUNKS:
        blocks = list(blocks)
    for first, end, low, scores in blocks:
        inner = np.arange(max(first, 1), end)
        for size in range(2, k + 1):
            for i in range(1, size):
                possible[inner, i] |= scores[size - 1, base[inner] + i - size - low] > -np.inf
        chunk_of, state_of = np.nonzero(possible[first:end])
        chunk_of += first
        for a in range(0, len(chunk_of), LANES):
            c, i = chunk_of[a : a + LANES], state_of[a : a + LANES]
            best = np.full((len(c), k + chunk + k), -np.inf)
            best[np.arange(len(c)), k + i] = 0.0
            _forward(scores, base[c] - low, chunk, best, k)
            # a piece from before the chunk can't reach its end, as chunks are no shorter than pieces
            matrices[c, i] = best[:, k + chunk : k + chunk + k]
    reached = scan(matrices)[:, 0]
    entry = np.full((many, k), -np.inf)
    entry[0, 0] = 0.0
    entry[1:] = reached[:-1]
    last = np.zeros((many, chunk + k), np.int8)
    for first, end, low, scores in blocks if many <= BLOCK_CHUNKS else _blocks(vocabulary, points, base, chunk):
        best = np.full((end - first, k + chunk + k), -np.inf)
        best[:, k : 2 * k] = entry[first:end]
        last[first:end] = _forward(scores, base[first:end] - low, chunk, best, k)
    # trace each chunk back from each of its exit states, all in step
    place = np.full((many, k), -1)
    place[:-1][possible[1:]] = np.broadcast_to(chunk + np.arange(k), (many - 1, k))[possible[1:]]
    place[-1, 0] = n - base[-1]  # the text ends within the last chunk
    cuts = np.zeros((many, k, chunk + k), bool)
    rows, columns = np.nonzero(place >= 0)
    while len(rows):
        at = place[rows, columns]
        cuts[rows, columns, at] = True
        step = last[rows, at]
        place[rows, columns] = at - step
        rows, columns = rows[step > 0], columns[step > 0]
    # which exit state each chunk has: where the next one's trace begins
    state, ends = 0, []
    for c in range(many - 1, -1, -1):
        ends.append(base[c] + np.flatnonzero(cuts[c, state]))
        state = int(place[c, state])
    places = np.unique(np.concatenate(ends))
    return np.diff(places[places <= n])


def solve_small(vocabulary: Vocabulary, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lengths of the pieces of the best segmentations of stretches [start, end), one after another."""
    _, scores = vocabulary.arcs(points)
    k, n = vocabulary.longest, len(points)
    best, last = np.full(n + len(start) + 1, -np.inf), np.zeros(n + len(start) + 1, np.int8)
    # place t of stretch i is at start[i] + i + t, so each stretch has a place for its end
    origin = start + np.arange(len(start))
    best[origin] = 0.0
    order = np.argsort(end - start, kind="stable")
    size = (end - start)[order]
    for t in range(1, int(size[-1]) + 1 if len(size) else 0):
        lanes = order[np.searchsorted(size, t) :]
        sizes = np.arange(min(k, t), 0, -1)
        value = best[origin[lanes][:, None] + t - sizes] + scores[sizes - 1, start[lanes][:, None] + t - sizes]
        choice = value.argmax(1)
        best[origin[lanes] + t] = value[np.arange(len(lanes)), choice]
        last[origin[lanes] + t] = sizes[choice]
    mark = np.zeros(n + len(start) + 1, bool)
    place, lanes = (end - start).copy(), np.arange(len(start))
    while len(lanes):
        lanes = lanes[place[lanes] > 0]
        at = origin[lanes] + place[lanes]
        mark[at] = True
        place[lanes] -= last[at]
    return last[mark].astype(np.int64)


class Codec:
    """Encoder and decoder over a vocabulary; remembers the stretches it has met."""

    def __init__(self, path: str | None = None, giant: int = GIANT_CHARS):
        self.vocabulary, self.giant = Vocabulary(path), giant
        self.memory = Memory(CACHE_STRETCHES, CACHE_SIGNS)

    def _ids(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that lie one after another, and how many each gave (several for bytes)."""
        v = self.vocabulary
        ends = np.cumsum(sizes)
        start = ends - sizes
        prefix = prefix_hash(points.astype(np.uint64) + np.uint64(1), _BASE)
        ids, _ = v.find(mix(range_hash(prefix, start, ends, _BASE) + sizes.astype(np.uint64)))
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, np.ones(len(ids), np.int64)
        each = [v.bytes[np.frombuffer(chr(MARK if points[p] == ESCAPE else int(points[p])).encode("utf-8", "surrogatepass"), np.uint8)] for p in start[bare]]
        many = np.ones(len(ids), np.int64)
        many[bare] = [len(e) for e in each]
        out = np.repeat(ids, many)
        where = np.cumsum(many) - many
        for i, e in zip(bare, each, strict=True):
            out[where[i] : where[i] + len(e)] = e
        return out, many

    def _learn(self, stretches: list[str]):
        # each stretch with its space, one after another
        flat = to_points(" " + " ".join(stretches))
        size = np.fromiter(map(len, stretches), np.int64, len(stretches)) + 1
        end = np.cumsum(size)
        sizes = solve_small(self.vocabulary, flat, end - size, end)
        ids, many = self._ids(flat, sizes)
        total = np.concatenate([[0], np.cumsum(many)])
        bound = total[np.searchsorted(np.cumsum(sizes), end) + 1]
        lengths = np.diff(np.concatenate([[0], bound]))
        self.memory.learn(stretches, ids, bound, lengths)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the count of each. The empty text has none."""
        memory = self.memory
        found = [[] if not t or len(t) > self.giant else _RUNS(" " + t) if "  " in t or t[0] == " " else t.split(" ") for t in texts]
        for i, f in enumerate(found):
            if f and ("  " in texts[i] or texts[i][0] == " "):
                found[i] = f = [s[1:] for s in f]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        code = memory.numbers(list(chain.from_iterable(found)))
        unknown = memory.unknown()
        for a in range(0, len(unknown), LEARN_STRETCHES):
            self._learn(unknown[a : a + LEARN_STRETCHES])
        flat, ends = memory.ids_of(code)
        text_end = np.concatenate([[0], ends])[np.cumsum(counts)]
        sizes = np.diff(np.concatenate([[0], text_end]))
        giants = [i for i, t in enumerate(texts) if len(t) > self.giant]
        if giants:
            parts = np.split(flat, text_end[:-1])
            for i in giants:
                points = to_points(" " + texts[i])
                parts[i], _ = self._ids(points, solve_giant(self.vocabulary, points))
                sizes[i] = len(parts[i])
            flat = np.concatenate(parts)
        memory.trim()
        return flat, sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text; control and unknown pieces give none."""
        ends = np.cumsum(sizes)
        out, at = [], 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + DECODE_IDS, "right")))
            out += self._decode(ids[ends[at] - sizes[at] : ends[to - 1]], sizes[at:to])
            at = to
        return out

    def _decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        v = self.vocabulary
        length = v.piece_size[ids]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        data = v.piece_bytes[np.repeat(v.piece_start[ids] - (end - length), length) + np.arange(total)].tobytes()
        bound = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(sizes)])]
        return [data[a + 1 : b] if data[a : a + 1] == b" " else data[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


#: Stands for a U+2581 of the text itself; it is beyond all code points, so no text or piece has it.
ESCAPE = 0x110000


def to_points(text: str) -> np.ndarray:
    """Code points with spaces marked."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points == MARK] = ESCAPE
    points[points == 32] = MARK
    return points


_codecs: dict[str | None, Codec] = cache("pieces")


def codec(path: str | None = None) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encoded(batches, path: str | None):
    """doc_id column, ids and their count for each text, slice by slice."""
    for part in slices(batches, limit=SLICE_BYTES):
        ids, sizes = codec(path).encode(strings(pc.fill_null(col(part, "text"), "")))
        yield col(part, "doc_id"), ids, sizes


def encode_pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id (from ``key``, of any type) and ids (array of int) of each whole text. Null and empty texts have no ids.

    Repeated rows are encoded alike, null keys are kept, other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for keys, ids, sizes in _encoded(batches, path):
            yield pa.record_batch([keys, list_array(ids, sizes, pa.int32())], names=["doc_id", "ids"])

    return map_batches(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>", "pieces")


def decode_pieces(tokens: DataFrame, path: str | None = None, name: str = "text") -> DataFrame:
    """All columns of ``tokens`` and the text of its ids as column ``name``; a column of that name is replaced.

    Null ids give the empty text. Repeated rows and null keys are kept. An
    empty table gives an empty result.
    """
    kept = [c for c in tokens.columns if c != name]

    def run(batches):
        for batch in batches:
            ids = col(batch, "ids")
            sizes = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
            texts = codec(path).decode(np.asarray(ids.flatten()), sizes)
            yield pa.record_batch([*(col(batch, c) for c in kept), pa.array(texts, pa.binary()).cast(pa.string())], names=[*kept, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*kept).schema)
    return map_batches(tokens.select(*kept), run, f"{schema}, `{name}` string", "pieces")


def piece_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and decoded_sha256 (of the text that the ids decode to) of each whole text.

    Encoding and decoding happen in one worker, so neither ids nor texts leave
    it. Rows are treated as in :func:`encode_pieces`.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for keys, ids, sizes in _encoded(batches, path):
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(np.ascontiguousarray(ids[b - n : b], "<u4").tobytes()) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            sha = [hashlib.sha256(t).hexdigest() for t in codec(path).decode(ids, sizes)]
            yield pa.record_batch([keys, pa.array(sizes), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    return map_batches(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, decoded_sha256 string", "pieces")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of the text that they decode to: :func:`piece_digests` over ``documents``."""
    return piece_digests(documents(spark, sf_dir))
