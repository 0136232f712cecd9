"""Word positions and word hashes of whole texts, computed on UTF-8 bytes with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. These are all
ASCII, so cutting at bytes is the same as cutting at characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

#: Bytes beyond which a word is hashed as a whole.
LONG_WORD = 64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i up to ``n`` at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            pair.append(np.multiply.accumulate(t))
        have = _tables[base] = (pair[0], pair[1])
    return have


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``; differences of them hash any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    power, _ = powers(base, len(values))
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    _, inverse = powers(base, len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


@dataclass
class Words:
    """Words of a slice of texts: byte ranges, text number and hash of each; words of each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # for each text the number of its first word; one more at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes outside ``space`` (a table of 256 flags); a run ends with its text."""
    n = len(data)
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    prefix = prefix_hash(data.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
    h = mix(range_hash(prefix, start, end, _BYTE_BASE) ^ ((end - start).astype(np.uint64) << np.uint64(48)))
    # sums of powers modulo 2**64 collide for some pairs of long ranges, whatever the base
    long = np.flatnonzero(end - start > LONG_WORD)
    if len(long):
        raw = data.tobytes()
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    first = np.searchsorted(start, offsets, "left")
    return Words(start, end, text, h, first)


def prefix_hashes(data: np.ndarray, words: Words, length: int) -> np.ndarray:
    """Hash of the first ``length`` bytes of each word; 0 for shorter words."""
    prefix = prefix_hash(data.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
    long = words.end - words.start >= length
    start = words.start[long]
    out = np.zeros(len(words.hash), np.uint64)
    out[long] = mix(range_hash(prefix, start, start + length, _BYTE_BASE) ^ (np.uint64(length) << np.uint64(48)))
    return out


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that begin a run of ``k`` words of one text, and the hashes of these runs."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - k + 1)
    at = at[words.text[at] == words.text[at + k - 1]]
    prefix = prefix_hash(words.hash, _WORD_BASE)
    return at, mix(range_hash(prefix, at, at + k, _WORD_BASE) + np.uint64(k))
