"""WARC records in seekable Zstandard bundles, written by tasks and read back by identifier.

Records are grouped into independent Zstandard frames. A bundle ends with the
seek table of the public seekable format (a skippable frame), so one range read
finds the frames and a second fetches the one that holds a record. The manifest
maps each record to its bundle, frame and offset in the frame.

A task gives its bundles names of their own and returns them in the manifest.
The files of a task that was lost or ran twice are in no manifest and so are
never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.support import fresh_path, map_batches, slices, stored

SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uuid(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def build_record(key, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join((url or f"urn:page:{key}").split()) or f"urn:page:{key}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uuid(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uuid(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if key is not None:
        head.append(f"X-Page: {key}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of the record that starts at ``at``."""

    def headers(text: bytes) -> dict[str, str]:
        lines = text.decode("utf-8").split("\r\n")
        return {"": lines[0]} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}

    end = data.index(b"\r\n\r\n", at)
    warc = headers(data[at:end])
    if not warc[""].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    block = data[end + 4 : end + 4 + int(warc["content-length"])]
    cut = block.index(b"\r\n\r\n")
    return warc, headers(block[:cut]), block[cut + 4 :]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with the compressed and plain size of each frame, and the footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """A bundle open for reading: frames by number, over range reads."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed
        self.held: tuple[int, bytes] | None = None

    def close(self):
        self.file.close()

    def frame(self, number: int) -> bytes:
        if self.held is None or self.held[0] != number:
            at, packed, plain = self.frames[number]
            self.held = number, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)
        return self.held[1]


MANIFEST = "page_id long, record_id string, bundle string, frame int, start long, length long"


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL)
        rows: list[tuple] = []
        open_frame: list[bytes] = []
        frames: list[tuple[int, int]] = []
        out, name, held, packed_bytes = None, "", 0, 0

        def end_frame():
            nonlocal open_frame, held, packed_bytes
            if open_frame:
                plain = b"".join(open_frame)
                packed = packer.compress(plain)
                out.write(packed)
                frames.append((len(packed), len(plain)))
                packed_bytes += len(packed)
            open_frame, held = [], 0

        def end_bundle():
            nonlocal out, rows, frames, packed_bytes
            if out is None:
                return None
            end_frame()
            out.write(seek_table(frames))
            out.close()
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "record_id", "bundle", "frame", "start", "length"])
            out, rows, frames, packed_bytes = None, [], [], 0
            return made

        for part in slices(batches, "html", 4 << 20):
            for r in part.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                record = build_record(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"], r["revisit"])
                if held and held + len(record) > frame_bytes:
                    end_frame()
                rows.append((r["page_id"], record_uuid(r["page_id"]), f"{folder}/{name}", len(frames), held, len(record)))
                open_frame.append(record)
                held += len(record)
                if packed_bytes + held > bundle_bytes:
                    yield end_bundle()
        if (made := end_bundle()) is not None:
            yield made

    return run


def write_archives(pages: DataFrame, min_payload: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the manifest.

    Of rows with equal payloads of at least ``min_payload`` bytes the one with
    the largest page_id is the response, the others revisit it; of rows that
    repeat both that page_id and the payload, each is a response. Smaller
    payloads are all responses. A null html is an empty payload, an empty table gives no records; a null page_id
    never wins against another, and where all are null all are responses. Other
    columns of ``pages`` are ignored.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(body, 256).alias("_same"), F.octet_length(body).alias("_n"))
    # payloads that occur once need no partner; as a table of its own the others can be joined in split parts
    best = stored(rows.groupBy("_same", "_n").agg(F.max("page_id").alias("_best"), F.count("*").alias("_c")).where("_c > 1").drop("_c"), "warc-repeated")
    rows = rows.join(best, ["_same", "_n"], "left")
    revisit = F.coalesce((F.col("_n") >= min_payload) & ((F.col("page_id") != F.col("_best")) | (F.col("page_id").isNull() & F.col("_best").isNotNull())), F.lit(False))
    rows = rows.select("page_id", "url", "html", F.when(revisit, F.col("_best")).alias("refers_to"), revisit.alias("revisit"))
    return stored(map_batches(rows, _write(fresh_path(pages.sparkSession, "warc"), frame_bytes, bundle_bytes), MANIFEST), "warc-manifest")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the manifest names, each from its frame: facts and, if asked for, payloads.

    The digest of a response is computed from the bytes read back and must
    equal the one in its header; a revisit has the one in its header.
    """

    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        name, bundle = None, None
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    if bundle:
                        bundle.close()
                    name = r["bundle"]
                    files, path = fs.FileSystem.from_uri(name)
                    bundle = Bundle(files, path)
                warc, http, payload = parse_record(bundle.frame(r["frame"]), r["start"])
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                kind = warc["warc-type"]
                if kind == "response" and digest != payload_digest(payload):
                    raise ValueError(f"record of page {r['page_id']} does not match its digest")
                refers = warc.get("x-refers-to-page")
                page = warc.get("x-page")
                rows.append((None if page is None else int(page), int(http["content-length"]), digest, kind, None if refers is None else int(refers), payload if payloads else None))
                held += len(payload) if payloads else 0
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if bundle:
            bundle.close()

    return map_batches(manifest, run, READ)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Facts of the records of all ``pages``, from archives that were written and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages), payloads=False).drop("payload")


#: Base32 of the SHA-1: four groups of five bytes, eight letters each.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT page_id, body, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS best FROM p)
SELECT page_id,
       CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = best OR best IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM s
"""
