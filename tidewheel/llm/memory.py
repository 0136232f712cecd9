"""What a tokenizing worker remembers: the ids of stretches of text, bounded in number and size."""

from __future__ import annotations

from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A key that begins with this lone surrogate, which no valid text has, stands for a text's beginning.
HEAD = "\ud800"
#: Calls that a stretch outlasts another one for each further call that met it, up to so many.
CREDIT, MOST_CREDITS = 30, 8


_CACHES: dict[str, dict] = {}


def cache(name: str) -> dict:
    """What this process keeps from task to task under a name, until a task that does not use it begins."""
    return _CACHES.setdefault(name, {})


def only(name: str | None) -> None:
    """Forget all that is kept under other names: a worker does not hold one operator's tables while it runs another's."""
    for other, held in _CACHES.items():
        if other != name:
            held.clear()


class Memory:
    """Ids of stretches. When it is full, those are forgotten that were used long ago and in few calls.

    ``stretches`` bounds their number, ``signs`` their characters and ids
    together, both as of the end of a call.
    """

    def __init__(self, stretches: int, signs: int):
        self.stretches, self.signs = stretches, signs
        self._clear()
        self.ids = np.zeros(1 << 16, np.int32)
        # for each stretch: where its ids are, how many, its characters and ids, the last call that met it and how many did
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths, self.size, self.last, self.met = (np.zeros(1 << 14, np.int32) for _ in range(4))
        self.known = self.used = self.held = self.calls = 0

    def _clear(self):
        self.codes: dict[str, int] = {}

    def numbers(self, keys: list[str]) -> np.ndarray:
        """The number of each key; new ones get the next numbers, in order."""
        found = list(map(self.codes.get, keys))
        if None in found:
            new = dict.fromkeys(compress(keys, [f is None for f in found]))
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
            found = [self.codes[k] if f is None else f for k, f in zip(keys, found, strict=True)]
        return np.fromiter(found, np.int64, len(keys))

    def unknown(self) -> list[str]:
        """Keys that have a number but no ids yet."""
        return list(islice(self.codes, self.known, None)) if len(self.codes) > self.known else []

    def learn(self, keys, ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray):
        """Ids of the next keys without: those of key ``i`` end at ``ends[i]`` of ``ids``."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(keys) > len(self.starts):
            self.starts, self.lengths, self.size, self.last, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.size, self.last, self.met))
        at = slice(self.known, self.known + len(keys))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at], self.lengths[at] = self.used + ends - lengths, lengths
        self.size[at] = lengths + self._signs(keys)
        self.last[at], self.met[at] = -1, 0
        self.used += len(ids)
        self.known += len(keys)
        self.held += int(self.size[at].sum())

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the keys with these numbers one after another, and the end of each key's."""
        self.touch(codes)
        return self.gather(codes)

    def touch(self, codes: np.ndarray):
        """This call met the keys with these numbers."""
        self.met[codes[self.last[codes] != self.calls]] += 1  # once for each key
        self.last[codes] = self.calls

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`ids_of`, without a note of the call."""
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, self.used) < 1 << 31 else np.int64
        at = np.repeat((self.starts[codes] - (ends - lengths)).astype(kind), lengths)
        at += np.arange(total, dtype=kind)
        return self.ids[at], ends

    @staticmethod
    def _signs(keys: list[str]) -> np.ndarray:
        return np.fromiter(map(len, keys), np.int64, len(keys))

    def _keep(self, stays: np.ndarray):
        """Forget the other keys; returns those that stay."""
        keys = list(compress(self.codes, stays.tolist()))
        self.codes = dict(zip(keys, range(len(keys)), strict=True))
        return keys

    def trim(self):
        """Ends a call: forget half if the memory is full."""
        self.calls += 1
        if self.known <= self.stretches and self.held <= self.signs:
            return
        worth = self.last[: self.known] + CREDIT * np.minimum(self.met[: self.known], MOST_CREDITS)
        order = np.argsort(-worth, kind="stable")
        most = int(np.searchsorted(np.cumsum(self.size[order], dtype=np.int64), self.signs // 2, "right"))
        stays = np.zeros(self.known, bool)
        stays[order[: min(most, self.stretches // 2)]] = True
        kept = np.flatnonzero(stays)
        ids, ends = self.gather(kept)
        lengths, last, met = self.lengths[kept], self.last[kept], self.met[kept]
        keys = self._keep(stays)
        self.known = self.used = self.held = 0
        self.ids = np.zeros(max(1 << 16, len(ids)), np.int32)
        self.learn(keys, ids, ends, lengths)
        self.last[: len(keys)], self.met[: len(keys)] = last, met


class ColumnMemory(Memory):
    """A memory whose keys are a string column, looked up a column at once; bytes count as characters.

    Keys are stretches as they stand in texts, with the space before them if there is one.
    """

    def _clear(self):
        self.keys = pa.array([], pa.string())

    @property
    def codes(self) -> dict[str, int]:
        """The numbers of the keys; those with a space before them without it, others behind ``HEAD``."""
        return {k[1:] if k[:1] == " " else HEAD + k: i for i, k in enumerate(self.keys.to_pylist())}

    def numbers(self, keys: pa.StringArray) -> np.ndarray:
        known = len(self.keys)
        # the first occurrence of a value gives it its number
        coded = pa.concat_arrays([self.keys, keys]).dictionary_encode()
        self.keys = coded.dictionary
        return np.asarray(coded.indices)[known:]

    def unknown(self) -> pa.StringArray:
        return self.keys.slice(self.known)

    @staticmethod
    def _signs(keys: pa.StringArray) -> np.ndarray:
        return np.asarray(pc.binary_length(keys))

    def _keep(self, stays: np.ndarray) -> pa.StringArray:
        self.keys = self.keys.filter(pa.array(stays))
        return self.keys
