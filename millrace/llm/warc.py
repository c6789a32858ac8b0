"""WARC archives as seekable Zstandard bundles, and reading them back."""

import base64
import hashlib
import os
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path, stage
from .common import batch

# Fixed values of the seekable format: a skippable frame that ends with a footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_RECORD = "-"


def create(path: str):
    """A new file in the shared folder: a path or file: URI, or any URI that Arrow's file systems know."""
    if path.startswith("file:") or "://" not in path:
        path = path.removeprefix("file://").removeprefix("file:")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    return system.open_output_stream(inner)


def open_at(path: str):
    """A readable, seekable file."""
    if path.startswith("file:") or "://" not in path:
        return open(path.removeprefix("file://").removeprefix("file:"), "rb")
    from pyarrow import fs
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class BundleWriter:
    """Independent frames of about ``frame_bytes``, then the seek table."""

    def __init__(self, path: str, frame_bytes: int):
        import zstandard
        self.path, self.file, self.frame_bytes = path, create(path), frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.open, self.frames = [], []
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame at which the record will be found."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.frames), self.size
        self.open.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        if self.size:
            packed = self.compressor.compress(b"".join(self.open))
            self.file.write(packed)
            self.frames.append((len(packed), self.size))
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


class BundleReader:
    """Reads single frames by the seek table at the end of the file."""

    def __init__(self, path: str):
        import zstandard
        self.file, self.codec = open_at(path), zstandard.ZstdDecompressor()
        self.file.seek(-9, os.SEEK_END)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entry = 12 if flags & 0x80 else 8
        self.file.seek(-9 - entry * n, os.SEEK_END)
        raw, offset, self.frames = self.file.read(entry * n), 0, []
        for i in range(n):
            packed, size = struct.unpack_from("<II", raw, i * entry)
            self.frames.append((offset, packed, size))
            offset += packed

    def frame(self, number: int) -> bytes:
        offset, packed, size = self.frames[number]
        self.file.seek(offset)
        return self.codec.decompress(self.file.read(packed), max_output_size=size)


def field(name: str, value: str) -> str:
    """A header line; line breaks in a value would end it."""
    return f"{name}: {' '.join(value.split())}\r\n" if value else ""


def record(page_id: int | None, url: str | None, date: str, payload: bytes, size: int, digest: str, refers_to: str) -> bytes:
    """One record; a revisit (``refers_to`` set) keeps the HTTP header with the full length and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to else http + payload
    name = NO_RECORD if page_id is None else str(page_id)
    head = ("WARC/1.1\r\n" + field("WARC-Type", "revisit" if refers_to else "response") + field("WARC-Record-ID", f"<urn:page:{name}>")
            + field("WARC-Target-URI", url or "") + field("WARC-Date", date) + field("WARC-Payload-Digest", f"sha1:{digest}")
            + (field("WARC-Profile", PROFILE) + field("WARC-Refers-To", f"<urn:page:{refers_to}>") if refers_to else "")
            + field("Content-Type", "application/http;msgtype=response") + field("Content-Length", str(len(body))) + "\r\n")
    return head.encode() + body + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """Record headers, HTTP headers and payload of the record at ``at``, and where the next begins."""
    def headers(lines: str) -> dict[str, str]:
        return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines.split("\r\n")[1:] if line)}

    end = data.index(b"\r\n\r\n", at)
    head = headers(data[at:end].decode())
    start, size = end + 4, int(head["content-length"])
    cut = data.index(b"\r\n\r\n", start) + 4
    return head, headers(data[start:cut - 4].decode()), data[cut:start + size], start + size + 4


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write(pages: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 28,
          date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) into bundles in ``folder`` and
    returns where each lies: page_id, path, frame, offset (in the decompressed frame), size.

    Rows with equal payloads are revisits of the one with the largest page_id. Rows that repeat that
    page_id are responses too, as a revisit can't refer to itself; a row without page_id is a response
    only if no equal one has an id. A null html is an empty payload. The digests choose the responses
    by a maximum that is combined before the shuffle; the html then moves once, and a group of copies
    may be split over tasks. A task's bundles have names of their own, and only the rows of the task
    that succeeded name them, so a repeated or lost task leaves no wrong record.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    first = rows.groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    copies = first.filter("n > 1").select("sha1", "response")
    chosen = rows.join(copies, "sha1", "left").select("page_id", "url", "payload", "response")
    where = pa.schema([("page_id", pa.int64()), ("path", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])

    def work(batches):
        writer, written = None, 0
        for b in batches:
            out = []
            for page_id, url, payload, response in zip(*(c.to_pylist() for c in b.columns)):
                if writer is None:
                    writer, written = BundleWriter(f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst", frame_bytes), 0
                refers = "" if response is None or response == page_id else str(response)
                made = record(page_id, url, date, payload, len(payload), base32_sha1(payload), refers)
                out.append((page_id, writer.path, *writer.add(made), len(made)))
                written += len(made)
                if written >= bundle_bytes:
                    writer.close()
                    writer = None
            if out:
                yield batch(where, *zip(*out))
        if writer is not None:
            writer.close()

    return stage(chosen.mapInArrow(work, "page_id long, path string, frame long, offset long, size long"), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Reads the records that ``index`` names: each frame is fetched once by the seek table and each
    record taken at its offset. page_id, url, payload (null for a revisit), payload_bytes,
    payload_digest (of the header; a response's is checked), record_type, refers_to."""
    frames = index.groupBy("path", "frame").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))  # bounded by a frame's size
    # a row of ``frames`` is small and its work is not: tasks by number of frames, not by their bytes
    frames = frames.repartition(max(1, -(-index.select("path", "frame").distinct().count() // 32)), "path", "frame") \
        .sortWithinPartitions("path", "frame")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(name: str | None) -> int | None:
        name = name and name.removeprefix("<urn:page:").removesuffix(">")
        return None if name in (None, NO_RECORD) else int(name)

    def work(batches):
        path, reader = None, None
        for b in batches:
            for name, frame, offsets in zip(*(c.to_pylist() for c in b.columns)):
                if name != path:
                    path, reader = name, BundleReader(name)
                data, out = reader.frame(frame), []
                for offset in offsets:
                    head, http, payload, _ = parse(data, offset)
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and base32_sha1(payload) != digest:
                        raise ValueError(f"wrong payload of record {head['warc-record-id']} in {name}")
                    out.append((number(head["warc-record-id"]), head.get("warc-target-uri"), None if revisit else payload,
                                int(http["content-length"]), digest, head["warc-type"], number(head.get("warc-refers-to"))))
                yield batch(schema, *zip(*out))

    return frames.mapInArrow(work, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
                                   "record_type string, refers_to long")


def archive_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
