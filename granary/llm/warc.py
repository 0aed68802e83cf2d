"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC records, then two skippable frames: an index
from record id to (frame, offset in the frame's content, length), and the seek table of the public seekable format
(compressed and decompressed size of every frame, and a footer). A reader finds one record from the bundle's end,
decompressing one frame. Bundles are rows of a Parquet table in the shared folder: Spark's committer makes the write
survive lost executors on any file system. `export` copies them out as .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, ship, table

#: Content of a frame and of a bundle in bytes, about; a record is never split.
FRAME, BUNDLE = 1 << 18, 1 << 24
#: Payloads of fewer bytes are never revisits.
LEAST_PAYLOAD = 1000
#: When records are said to have been made, unless a date is given: the same input makes the same bytes.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the public formats.
_SKIPPABLE_INDEX, _SKIPPABLE_SEEK, _SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


# --- records --------------------------------------------------------------------------------------------------------


def record(record_id: str, kind: str, uri: str | None, payload: bytes, digest: str, size: int, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One WARC/1.1 record. digest: lower-case hex SHA-1 of the full payload, of `size` bytes, even for a revisit."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {size}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in uri if c >= " "))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def info(record_id: str, date: str = DATE) -> bytes:
    """The warcinfo record that opens a bundle."""
    fields = b"software: granary\r\nformat: WARC file version 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(fields)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + fields + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes

    @property
    def digest(self) -> str:
        return base64.b32decode(self.headers["warc-payload-digest"].removeprefix("sha1:")).hex()


def parse(b: bytes) -> Record:
    head, sep, rest = b.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    return Record(headers, rest[:size])


# --- bundles --------------------------------------------------------------------------------------------------------


class BundleWriter:
    def __init__(self, level: int = 3) -> None:
        self.level = level
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.total = 0

    def add(self, record_id: str, b: bytes) -> None:
        self.index.append((record_id, len(self.sizes), self.filled, len(b)))
        self.open.append(b)
        self.filled += len(b)
        if self.filled >= FRAME:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = zstandard.ZstdCompressor(level=self.level).compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.filled))
            self.total += self.filled
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self._close()
        index = zstandard.ZstdCompressor(level=self.level).compress(json.dumps(self.index, separators=(",", ":")).encode())
        own = struct.pack("<II", _SKIPPABLE_INDEX, len(index)) + index
        entries = [*self.sizes, (len(own), 0)]  # the index is a frame without content
        body = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IBI", len(entries), 0, _SEEKABLE_MAGIC)
        return b"".join([*self.frames, own, struct.pack("<II", _SKIPPABLE_SEEK, len(body)), body])


class BundleReader:
    """Reads by seeking from the end. `blob` may be bytes or a memory map."""

    def __init__(self, blob: bytes | memoryview) -> None:
        self.blob = memoryview(blob)
        n, flags, magic = struct.unpack("<IBI", self.blob[-9:])
        if magic != _SEEKABLE_MAGIC or flags & 0x7C:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        start = len(self.blob) - 9 - n * width
        kind, size = struct.unpack("<II", self.blob[start - 8 : start])
        if kind != _SKIPPABLE_SEEK or size != n * width + 9:
            raise ValueError("seek table is broken")
        self.frames: list[tuple[int, int, int]] = []
        at = 0
        for i in range(n):
            packed, content = struct.unpack_from("<II", self.blob, start + i * width)
            self.frames.append((at, packed, content))
            at += packed
        at, packed, _ = self.frames[-1]
        if struct.unpack("<I", self.blob[at : at + 4])[0] != _SKIPPABLE_INDEX:
            raise ValueError("no record index")
        self.index = [(r, f, o, n) for r, f, o, n in json.loads(zstandard.ZstdDecompressor().decompress(self.blob[at + 8 : at + packed]))]

    def frame(self, i: int) -> bytes:
        at, packed, content = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.blob[at : at + packed], max_output_size=max(1, content))

    def get(self, record_id: str) -> Record:
        """The last record of that id, by decompressing its frame alone."""
        for r, f, o, n in reversed(self.index):
            if r == record_id:
                return parse(self.frame(f)[o : o + n])
        raise KeyError(record_id)

    def __iter__(self) -> Iterator[tuple[str, Record]]:
        now, content = -1, b""
        for r, f, o, n in self.index:
            if f != now:
                now, content = f, self.frame(f)
            yield r, parse(content[o : o + n])


# --- on DataFrames --------------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which pages are revisits of which.

    Of equal payloads of `least` bytes or more, the greatest page_id is the response; rows that tie with it are responses
    too, and a null page_id is one always. The digests' groups are counted from (page_id, digest) alone with partial
    aggregation; pages meet only the groups that have copies, in a join that Spark can split where a group is hot.
    """
    p = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    groups = p.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = p.join(groups, "digest", "left")
    late = (F.length("payload") >= least) & (F.col("page_id") < F.col("of"))
    return out.select("page_id", "url", "payload", "digest", F.when(late, F.col("of")).alias("refers_to"))


def bundle(records: DataFrame, date: str = DATE) -> DataFrame:
    """(bundle_id, records, bundle): tasks write bundles of about BUNDLE bytes of content as they read; a warcinfo record is first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def new() -> BundleWriter:
            w = BundleWriter()
            w.add(_INFO, info(_INFO, date))
            return w

        w = new()

        def done() -> pa.RecordBatch:
            blob = w.finish()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(blob).hexdigest()[:32]]), pa.array([len(w.index) - 1], pa.int64()), pa.array([blob], pa.binary())], ["bundle_id", "records", "bundle"])

        for b in batches:
            for page, url, payload, digest, to in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(b.columns))):
                raw = payload.as_buffer().to_pybytes()
                kind = "response" if to is None else "revisit"
                w.add(_urn(page), record(_urn(page), kind, url, raw if to is None else b"", digest, len(raw), None if to is None else _urn(to), date))
                if w.total + w.filled >= BUNDLE:
                    yield done()
                    w = new()
        if len(w.index) > 1:
            yield done()

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "bundle_id string, records long, bundle binary")


_INFO = "urn:page-bundle:info"


def _urn(page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def _page(urn: str) -> int | None:
    return int(x) if (x := urn.strip("<>").removeprefix("urn:page:")) else None


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Writes the bundles of pages (page_id, url, html) as a table at path; they are compressed already."""
    bundle(plan_records(pages), date).write.option("compression", "none").parquet(path)


def read_archive(bundles: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record, read back.

    Size and digest of a response are those of the payload as read; a revisit has them in its headers and no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        for b in batches:
            for blob in b.column(0):
                rows, size = [], 0
                for rid, r in BundleReader(blob.as_buffer()):
                    if r.headers["warc-type"] == "warcinfo":
                        continue
                    h, same = r.headers, r.headers["warc-type"] == "revisit"
                    digest = r.digest if same else hashlib.sha1(r.payload).hexdigest()
                    if digest != r.digest:
                        raise ValueError(f"payload of {rid} doesn't match its digest")
                    rows.append((_page(rid), h.get("warc-target-uri"), h["warc-type"], int(h["x-payload-length"]) if same else len(r.payload), digest, _page(h["warc-refers-to"]) if same else None, None if same else r.payload))
                    size += len(r.payload)
                    if size > 1 << 23:
                        yield pack(rows)
                        rows, size = [], 0
                yield pack(rows)

    return bundles.select("bundle").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def export(bundles: DataFrame, uri: str) -> DataFrame:
    """Writes each bundle as `<bundle_id>.warc.zst` under uri (any file system of pyarrow); returns (file, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(uri)
        for b in batches:
            files, sizes = [], []
            for name, blob in zip(b.column(0).to_pylist(), b.column(1)):
                with where.open_output_stream(f"{top}/{name}.warc.zst", compression=None) as f:  # named by content: a retry writes the same
                    f.write(blob.as_buffer())
                files.append(f"{name}.warc.zst")
                sizes.append(blob.as_buffer().size)
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(sizes, pa.int64())], ["file", "bytes"])

    return bundles.select("bundle_id", "bundle").mapInArrow(run, "file string, bytes long")


def load(urls: Iterable[str], spark: SparkSession) -> DataFrame:
    """.warc.zst files with a record index, as bundles for read_archive."""
    return spark.read.format("binaryFile").load(list(urls)).select(F.col("path").alias("bundle_id"), F.lit(None).cast("long").alias("records"), F.col("content").alias("bundle"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page in the shared folder and describes each record as read back from there."""
    ship(spark)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark.read.parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS m FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < m THEN m END AS refers_to
FROM d LEFT JOIN g ON d.h = g.h AND d.n >= 1000
"""
