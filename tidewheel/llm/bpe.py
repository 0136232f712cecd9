"""Token ids of whole texts by the ``tokenizers`` library, each distinct stretch encoded once.

A byte-level BPE vocabulary never merges across the pieces of its split
pattern, and that pattern ends a piece before each space that is not followed
by more white space. So the ids of a text are the ids of its stretches between
spaces, in order. The pattern of the ``ByteLevel`` pre-tokenizer also ends a
piece where a run of letters ends, and after a newline that stands between two
characters that are no white space; with it stretches end there too, so a word
is one stretch whatever follows it. Each worker keeps the ids of up to
``CACHE_STRETCHES`` of them, those used last, and lets the library encode only
others, many of them joined to one text; the bytes of the ids tell where each
ends. Literals of added tokens in a text are ordinary text, or, with ``added``,
get their own id as the library does by default; such texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewheel.llm.memory import ColumnMemory, cache
from tidewheel.llm.support import strings, text_buffers

#: Stretches that a worker remembers, and their characters and ids together.
CACHE_STRETCHES = 400_000
CACHE_SIGNS = 8_000_000
#: New stretches that the library gets as one text.
JOINED = 500
END = 0
#: A space inside a run of white space that goes on behind it: a cut there could change the pieces.
_SPACE = r"[\s\v\x{85}\p{Z}\x{1c}-\x{1f}]"
_ASCII = np.arange(256) < 0x80
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
#: Bytes after a space with which a stretch can be joined to others: they begin no white space.
_JOINS = ~_WHITE & ~np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: What a byte is: a letter, another ASCII character, an ASCII character that is no white space.
IS_LETTER, IS_OTHER, IS_SOLID = 1, 2, 4
_KINDS = (IS_LETTER * _LETTER + IS_OTHER * (_ASCII & ~_LETTER) + IS_SOLID * (_ASCII & ~_WHITE)).astype(np.uint8).tobytes()
_UNSAFE = rf"{_SPACE} ({_SPACE}|\z)"


class Encoder:
    def __init__(self, path: str | None = None, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        # a byte-level vocabulary writes each byte as one character
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)
        self.tokenizer.encode_special_tokens = not added
        literals = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values()) if added else []
        if any(" " in t for t in literals):
            raise ValueError("an added token has a space")
        #: texts that are encoded whole: cuts at their spaces could change the ids, or they hold an added token
        self.whole = "|".join([_UNSAFE, *map(re.escape, literals)])
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        #: whether the split pattern is known to end pieces where runs of letters end
        self.fine = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        self.memory = ColumnMemory(CACHE_STRETCHES, CACHE_SIGNS)

    def _stretches(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """Stretches of all texts one after another, and where those of each text end. They make up the texts; a space begins one."""
        data, offsets = text_buffers(texts)
        cut = data == 0x20
        if self.fine and len(data):
            kind = np.frombuffer(bytearray(data.tobytes().translate(_KINDS)), np.uint8)
            # U+00C0 to U+00FF are letters but for two
            at = np.flatnonzero(data == 0xC3) + 1
            kind[at[(data[at] != 0x97) & (data[at] != 0xB7)]] = IS_LETTER | IS_SOLID
            cut[1:] |= (kind[:-1] & (kind[1:] >> 1) & 1).view(bool)
            # nothing is cut after the newline if what is around it could be white space
            at = np.flatnonzero(data[1:-1] == 0x0A) + 1
            at = at[(kind[at - 1] & IS_SOLID > 0) & ((kind[at + 1] & IS_SOLID > 0) | (data[at + 1] == 0xC3))] + 1
            cut[at] = True
        for i in np.flatnonzero(np.asarray(pc.match_substring_regex(texts, self.whole))):
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)), np.searchsorted(starts, offsets[1:])

    def _learn(self, stretches: pa.StringArray):
        """Encode stretches and give their ids to the memory, in order of their numbers.

        Those that begin with white space behind their space, or have no space before
        them, are encoded on their own: joined to others they could be cut differently.
        """
        data, offsets = text_buffers(stretches)
        size = np.diff(offsets)
        second = np.minimum(offsets[:-1] + 1, len(data) - 1)
        joins = (size > 1) & (data[offsets[:-1]] == 0x20) & _JOINS[data[second]]
        words, lone = stretches.filter(pa.array(joins)), strings(stretches.filter(pa.array(~joins)))
        row, at = text_buffers(words)
        row, at = row.tobytes(), at[[*range(0, len(words), JOINED), len(words)]].tolist()
        texts = [row[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)] + lone
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(encoded), np.int32, sum(map(len, encoded)))
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        found = np.searchsorted(np.cumsum(self.size[flat]), np.cumsum(size[order]), "left") + 1
        bound, lengths = np.empty_like(found), np.empty_like(found)
        bound[order], lengths[order] = found, np.diff(found, prepend=0)
        self.memory.learn(stretches, flat, bound, lengths)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each ended by id 0, and the count of each (with the end). Null is empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        memory = self.memory
        stretches, last = self._stretches(texts)
        distinct = stretches.dictionary_encode()
        code = memory.numbers(distinct.dictionary)
        if len(unknown := memory.unknown()):
            self._learn(unknown)
        memory.touch(code)
        flat, ends = memory.gather(code[np.asarray(distinct.indices)])
        text_end = np.concatenate([[0], ends])[last]
        sizes = np.diff(text_end, prepend=0) + 1
        out = np.insert(flat, text_end, END)
        memory.trim()
        return out, sizes


_encoders: dict[tuple, Encoder] = cache("bpe")


def encoder(path: str | None = None, added: bool = False) -> Encoder:
    """This process's encoder; its memory of stretches lasts over batches and tasks."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
