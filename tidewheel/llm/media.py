"""Media columns: ISO media containers written, walked and described without decoding.

A payload of bytes is kept as mono 8-bit PCM: one sample of the sample tables
is an access unit of 64 bytes, a chunk holds up to ``CHUNK_UNITS`` of them, and
the first unit of each chunk is a sync sample (keyframe). The reader knows
nothing of that layout: it walks the nested boxes and decodes the sample tables
(stts, stsc, stsz, stco or co64, stss), so other ISO media files with one track
or more can be described too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.support import col, documents, map_batches, slices, stored

UNIT = 64
CHUNK_UNITS = 256
RATE = 8000
#: Boxes that only hold boxes.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_UNITY = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")


def write_container(payload: bytes) -> bytes:
    """An ISO media file with ``payload`` (a positive multiple of 64 bytes) as its one track."""
    units = len(payload) // UNIT
    duration = len(payload)
    chunks = -(-units // CHUNK_UNITS)
    last = units - (chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS, 1)] if chunks > 1 else []
    if chunks == 1 or last != CHUNK_UNITS:
        runs.append((chunks, last, 1))
    wide = len(payload) + 4096 + 16 * chunks >= 1 << 32
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * (CHUNK_UNITS * UNIT)
        where = _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, UNIT)),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            where,
            _full(b"stss", struct.pack(">I", chunks), (1 + np.arange(chunks) * CHUNK_UNITS).astype(">u4").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), _UNITY, bytes(8), flags=3, version=1)
        head = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">IH", 1 << 16, 256), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", head, _box(b"trak", track, media))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    base = len(_FTYP) + len(moov(0)) + head
    return _FTYP + moov(base) + _box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, type, body start, body end) of all boxes, parents first. Truncated boxes raise ValueError."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit its parent")
        yield depth, kind, start + head, start + size
        if kind in NESTS:
            yield from walk(data, start + head, start + size, depth + 1)
        start += size


def read_tracks(data: bytes) -> list[dict]:
    """For each track: codec, timescale, duration, sizes and offsets of its samples, and its sync samples."""
    tracks: list[dict] = []
    for _, kind, a, b in walk(data):
        if kind == b"trak":
            tracks.append({"codec": "", "timescale": 1, "stts": None, "sync": None})
            continue
        if not tracks:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t["timescale"] = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
        elif kind == b"stsd":
            t["codec"] = data[a + 12 : a + 16].decode("latin-1").strip()
        elif kind == b"stts":
            t["stts"] = np.frombuffer(data, ">u4", 2 * struct.unpack_from(">I", data, a + 4)[0], a + 8).reshape(-1, 2).astype(np.int64)
        elif kind == b"stsc":
            t["stsc"] = np.frombuffer(data, ">u4", 3 * struct.unpack_from(">I", data, a + 4)[0], a + 8).reshape(-1, 3).astype(np.int64)
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, a + 4)
            t["sizes"] = np.full(n, size, np.int64) if size else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = np.frombuffer(data, ">u4" if kind == b"stco" else ">u8", struct.unpack_from(">I", data, a + 4)[0], a + 8).astype(np.int64)
        elif kind == b"stss":
            t["sync"] = np.frombuffer(data, ">u4", struct.unpack_from(">I", data, a + 4)[0], a + 8).astype(np.int64) - 1
    for t in tracks:
        first = t["stsc"][:, 0] - 1
        per_chunk = np.repeat(t["stsc"][:, 1], np.diff(np.append(first, len(t["chunks"]))))
        chunk = np.repeat(np.arange(len(t["chunks"])), per_chunk)[: len(t["sizes"])]
        before = np.concatenate([[0], np.cumsum(t["sizes"])[:-1]]) if len(t["sizes"]) else np.zeros(0, np.int64)
        opens = np.searchsorted(chunk, np.arange(len(t["chunks"])), "left")
        t["offsets"] = t["chunks"][chunk] + before - before[opens[chunk]]
        t["duration"] = int((t["stts"][:, 0] * t["stts"][:, 1]).sum())
        t["sync"] = np.arange(len(t["sizes"])) if t["sync"] is None else t["sync"]
    return tracks


def keyframe_ranges(track: dict) -> list[tuple[int, int]]:
    """Byte range (start, end) of each sync sample; its payload isn't touched."""
    at = track["sync"]
    return list(zip(track["offsets"][at].tolist(), (track["offsets"][at] + track["sizes"][at]).tolist(), strict=True))


def stored_payload(data: bytes, track: dict) -> bytes:
    """The bytes of a track's samples in order, adjacent ones read in one piece."""
    start, size = track["offsets"], track["sizes"]
    if not len(start):
        return b""
    cut = np.flatnonzero(np.append(True, start[1:] != start[:-1] + size[:-1]))
    ends = np.append(cut[1:], len(start)) - 1
    return b"".join(data[a:b] for a, b in zip(start[cut].tolist(), (start[ends] + size[ends]).tolist(), strict=True))


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FACTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])


def to_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, unpadded byte count and container of each whole text (null: empty)."""

    def run(batches):
        for part in slices(batches):
            texts = [(x or "").encode() for x in col(part, "text").to_pylist()]
            yield pa.record_batch([col(part, "doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([write_container(pad(x)) for x in texts], pa.binary())], schema=MEDIA)

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """Facts of each row's container, from its boxes: codec, duration, keyframe byte ranges, digests."""

    def run(batches):
        for part in slices(batches, "media", 8 << 20):
            rows = []
            for doc, n, data in zip(col(part, "doc_id").to_pylist(), col(part, "n_bytes").to_pylist(), col(part, "media").to_pylist(), strict=True):
                track = read_tracks(data)[0]
                payload = stored_payload(data, track)
                rows.append({"doc_id": doc, "n_bytes": n, "codec": track["codec"], "timescale": track["timescale"], "duration": track["duration"], "samples": len(track["sizes"]), "keyframes": [{"start": a, "end": b} for a, b in keyframe_ranges(track)], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema=FACTS)

    return map_batches(media, run, "doc_id long, n_bytes long, codec string, timescale long, duration long, samples long, keyframes array<struct<start:long,end:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string")


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store each whole text as an ISO media file in a Parquet media column, read it back, describe it.

    Null and empty texts become one unit of 64 zero bytes. Equal texts give
    equal files, so repeated rows give equal rows. Null keys are kept. Other
    columns of ``docs`` are ignored, whatever their names. An empty table gives
    an empty result.
    """
    return describe_media(stored(to_media(docs, text, key), "media"))


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    """Facts of the containers of all of ``documents``, from the stored bytes."""
    facts = media_columns(documents(spark, sf_dir))
    first, last = F.element_at("keyframes", 1), F.element_at("keyframes", -1)
    feature = F.format_string("codec=%s timescale=%d duration=%d samples=%d keyframes=%d first=%d-%d last=%d-%d", "codec", "timescale", "duration", "samples", F.size("keyframes"), first["start"], first["end"], last["start"], last["end"])
    return facts.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
