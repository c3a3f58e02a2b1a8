"""Seekable Zstandard bundles of WARC records."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import xxhash
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 16 << 20, 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PLAIN = re.compile(r"[\x21-\x7e]+")
_INDEX = "array<struct<record_id: string, page_id: bigint, frame: int, frame_offset: bigint, offset: bigint, length: bigint>>"
SCHEMA = f"bundle_id string, n_records long, n_frames long, raw_bytes long, payload binary, records {_INDEX}"
_ENTRY = pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def record(page_id: int | None, url: str | None, html: str | None, date: str) -> tuple[str, bytes]:
    """(record id, WARC/1.1 resource record) of a page; equal pages get equal ids."""
    body = b"" if html is None else html.encode("utf-8", "surrogatepass")
    digest = hashlib.sha1(body).hexdigest()
    rid = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{html is None}|{digest}')}"
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None and _PLAIN.fullmatch(url):
        head.append(f"WARC-Target-URI: {url}")
    elif url is not None:  # not a header value as it is
        head.append(f"WARC-Target-URI-Encoded: {quote(url, safe='', errors='surrogatepass')}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if html is None:
        head.append("X-Null-Payload: true")
    head.append(f"Content-Length: {len(body)}")
    return rid, ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The page of a record, as it went in, with its record_id."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n" or hashlib.sha1(body).hexdigest() != fields["WARC-Payload-Digest"][5:]:
        raise ValueError("damaged record")
    url = fields.get("WARC-Target-URI")
    if (encoded := fields.get("WARC-Target-URI-Encoded")) is not None:
        url = unquote(encoded, errors="surrogatepass")
    page = fields.get("X-Page-Id")
    return {"record_id": fields["WARC-Record-ID"][1:-1], "page_id": None if page is None else int(page), "url": url, "html": None if "X-Null-Payload" in fields else body.decode("utf-8", "surrogatepass")}


class Bundle:
    """Collects records into frames, and frames into one payload with a seek table at its end."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes = frame_bytes
        self.compress = zstd.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.index: list[dict] = []
        self.open: list[bytes] = []
        self.filled = self.at = self.raw = 0

    def add(self, page_id: int | None, rid: str, data: bytes) -> None:
        if self.open and self.filled + len(data) > self.frame_bytes:
            self.end_frame()
        self.index.append({"record_id": rid, "page_id": page_id, "frame": len(self.frames), "frame_offset": self.at, "offset": self.filled, "length": len(data)})
        self.open.append(data)
        self.filled += len(data)

    def end_frame(self) -> None:
        raw = b"".join(self.open)
        frame = self.compress(raw)
        self.frames.append(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.at += len(frame)
        self.raw += len(raw)
        self.open, self.filled = [], 0

    def row(self) -> pa.RecordBatch:
        if self.open:
            self.end_frame()
        entries = b"".join(struct.pack("<III", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE)
        payload = b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer
        name = hashlib.sha256(payload).hexdigest()[:32]
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays([one(name, pa.string()), one(len(self.index), pa.int64()), one(len(self.table), pa.int64()), one(self.raw, pa.int64()), one(payload, pa.binary()), one(self.index, pa.list_(_ENTRY))], ["bundle_id", "n_records", "n_frames", "raw_bytes", "payload", "records"])


def bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Bundles of WARC records: (bundle_id, n_records, n_frames, raw_bytes, payload, records).

    payload is a sequence of independent Zstandard frames of about ``frame_bytes`` of records,
    ended by the seek table of the Zstandard seekable format (a skippable frame, with checksums),
    so any Zstandard reader reads it from the front and a seekable one from the end. records maps
    each record id to its frame, that frame's place in the payload, and the record's place in the
    frame. Each task bundles the rows it reads: there is no shuffle, and a task that runs again
    makes the same bundles, named by their content.

    Every row is a record, repeated rows too (equal pages share a record id). A null url or page_id
    is left out of the header, a null html is marked there; all come back as they were. A record
    larger than a frame has a frame, and one larger than a bundle a bundle, of its own; a binary
    column holds at most 2 GB. Only page_id, url and html are read. An empty table gives no bundle.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rid, data = record(page_id, url, html, date)
                if now is not None and now.at + now.filled + len(data) > bundle_bytes:
                    yield now.row()
                    now = None
                now = now or Bundle(frame_bytes, level)
                now.add(page_id, rid, data)
        if now is not None:
            yield now.row()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(pack, SCHEMA)


def seek_table(payload: bytes) -> list[tuple[int, int, int, int]]:
    """(place, compressed size, size, checksum) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", payload[-9:])
    if magic != _SEEKABLE or not flags & 0x80:
        raise ValueError("no seek table")
    entries = payload[-9 - 12 * n : -9]
    out, at = [], 0
    for c, d, x in struct.iter_unpack("<III", entries):
        out.append((at, c, d, x))
        at += c
    return out


def read_record(payload: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record, by decompressing its frame only; a frame that fails its checksum raises."""
    at, size, raw, checksum = seek_table(payload)[frame]
    data = zstd.ZstdDecompressor().decompress(payload[at : at + size], max_output_size=raw)
    if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
        raise ValueError("damaged frame")
    return data[offset : offset + length]


def index(bundled: DataFrame) -> DataFrame:
    """(record_id, page_id, bundle_id, frame, frame_offset, offset, length), one row a record id.

    Equal pages have equal records under one id; of their places the least is given.
    """
    rows = bundled.select("bundle_id", F.explode("records").alias("r"))
    place = F.struct("bundle_id", "r.frame", "r.frame_offset", "r.offset", "r.length", "r.page_id")
    return rows.groupBy("r.record_id").agg(F.min(place).alias("p")).select("record_id", "p.page_id", "p.bundle_id", "p.frame", "p.frame_offset", "p.offset", "p.length")


def read_back(bundled: DataFrame) -> DataFrame:
    """(record_id, page_id, url, html) of every record of the bundles."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for k, (at, size, raw, _) in enumerate(seek_table(payload)):
                    data = zstd.ZstdDecompressor().decompress(payload[at : at + size], max_output_size=raw)
                    rows += [parse(data[r["offset"] : r["offset"] + r["length"]]) for r in records if r["frame"] == k]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]))

    return bundled.select("payload", "records").mapInArrow(unpack, "record_id string, page_id long, url string, html string")


def write_files(bundled: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as <bundle_id>.warc.zst into a shared folder, a path or a URI of any file system
    that pyarrow knows; (bundle_id, path, bytes).

    Runs when the result is acted on. A file appears whole or not at all, so tasks may run again.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        for b in batches:
            for name, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}.warc.zst"
                part = f"{path}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as f:
                    f.write(payload)
                files.move(part, path)
                yield pa.RecordBatch.from_pylist([{"bundle_id": name, "path": f"{folder}/{name}.warc.zst", "bytes": len(payload)}])

    return bundled.select("bundle_id", "payload").mapInArrow(put, "bundle_id string, path string, bytes long")
