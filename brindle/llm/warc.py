"""WARC records in ZIP-packaged archives: a writer, and a reader by byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import Scratch, bounded_batches

#: Payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 0
#: Payload bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
#: Records that a reading task fetches at once, and archive bytes for each such task.
RANGE_RECORDS = 64
READ_BYTES = 16 << 20

# Fixed values of the ZIP format: signatures and record layouts.
END_SIGNATURE, END64_LOCATOR, END64_SIGNATURE, CENTRAL_SIGNATURE, LOCAL_SIGNATURE = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
ZIP64_EXTRA = 0x0001


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if not urlparse(path).scheme:
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


@dataclass
class Member:
    name: str
    method: int
    offset: int
    size: int
    stored: int


class ZipRanges:
    """A ZIP archive read by byte ranges alone: the end record, the central directory (ZIP64 too), and
    parts of stored members. Nothing is extracted."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.members = {m.name: m for m in self._directory()}

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        out = self.source.read(n)
        if len(out) != n:
            raise ValueError(f"archive ends at {at + len(out)}, {n} bytes were expected at {at}")
        return out

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(END_SIGNATURE)
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(END_SIGNATURE, 0, end)  # the signature can stand in a comment
        if end < 0:
            raise ValueError("no end record: not a ZIP archive")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        locator = tail_at + end - 20
        if locator >= 0 and (loc := self.read(locator, 20))[:4] == END64_LOCATOR:
            record = self.read(struct.unpack_from("<Q", loc, 8)[0], 56)
            if record[:4] != END64_SIGNATURE:
                raise ValueError("the ZIP64 end record is damaged")
            count, size, at = struct.unpack_from("<QQQ", record, 32)
        data, p = self.read(at, size), 0
        for _ in range(count):
            if data[p : p + 4] != CENTRAL_SIGNATURE:
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", data, p + 8)
            stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, p + 20)
            (offset,) = struct.unpack_from("<I", data, p + 42)
            name = data[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[p + 46 + n_name : p + 46 + n_name + n_extra]
            q = 0
            while q + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, q)
                if kind == ZIP64_EXTRA:  # holds just those fields that are all ones, in this order
                    r = q + 4
                    if full == 0xFFFFFFFF:
                        full, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                    if stored == 0xFFFFFFFF:
                        stored, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                    if offset == 0xFFFFFFFF:
                        offset = struct.unpack_from("<Q", extra, r)[0]
                q += 4 + length
            yield Member(name, method, offset, full, stored)
            p += 46 + n_name + n_extra + n_comment

    def data_offset(self, member: Member) -> int:
        head = self.read(member.offset, 30)
        if head[:4] != LOCAL_SIGNATURE:
            raise ValueError(f"{member.name}: the local header is damaged")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return member.offset + 30 + n_name + n_extra

    def member(self, name: str) -> bytes:
        m = self.members[name]
        data = self.read(self.data_offset(m), m.stored)
        return data if m.method == 0 else zlib.decompress(data, -15)

    def ranges(self, name: str, spans: list[tuple[int, int]]) -> Iterator[bytes]:
        """Parts (offset, length) of a stored member."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} isn't stored: its ranges can't be read")
        start = self.data_offset(m)
        for at, n in spans:
            if at < 0 or at + n > m.stored:
                raise ValueError(f"{name}: {at}+{n} lies outside")
            yield self.read(start + at, n)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record as a gzip member of its own."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    raw = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    raw = gzip.decompress(data)
    end = raw.index(b"\r\n\r\n")
    first, *lines = raw[:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    block = raw[end + 4 : end + 4 + n]
    if raw[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, block


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None, revisit: bool) -> bytes:
    uri = "".join(c if 32 < ord(c) < 127 else "%%%02X" % b if len(c.encode()) == 1 else "".join("%%%02X" % x for x in c.encode()) for c in url or "" for b in [ord(c) & 255])
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri or "urn:none"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", str(page_id)), ("X-Payload-Length", str(size))]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>")]
        return record_bytes(headers, head)
    return record_bytes(headers, head + payload)


class ArchiveWriter:
    """One ZIP archive: a stored member of gzipped WARC records, an index of their ranges, a manifest.
    It is written under another name and renamed when whole, so a task that is run again leaves no
    half archive."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.part = f"{root}/{name}.wacz", f"{root}/.{name}.{attempt}.part"
        self.uri = f"{folder}/{name}.wacz"
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        info = zipfile.ZipInfo("archive/data.warc.gz", (1980, 1, 1, 0, 0, 0))
        self.member = self.zip.open(info, "w", force_zip64=True)
        self.index: list[tuple[int, int]] = []
        self.at = self.payload = 0

    def add(self, record: bytes, payload: int) -> None:
        self.member.write(record)
        self.index.append((self.at, len(record)))
        self.at += len(record)
        self.payload += payload

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        lines = "".join(f"{at} {n}\n" for at, n in self.index)
        self.zip.writestr(zipfile.ZipInfo("indexes/ranges.idx", (1980, 1, 1, 0, 0, 0)), lines)
        self.zip.writestr(zipfile.ZipInfo("datapackage.json", (1980, 1, 1, 0, 0, 0)), json.dumps({"profile": "data-package", "records": len(self.index)}))
        self.zip.close()
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)  # of an attempt before; not every store's move replaces
        self.fs.move(self.part, self.path)
        return self.uri, self.fs.get_file_info(self.path).size, len(self.index)


def plan_records(pages: DataFrame, scratch: Scratch, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for a response. Payloads are equal by SHA-256 (collisions
    of the record's own SHA-1 can be made), by JVM functions;
    the largest page_id of each payload is found by a combined aggregation, and only payloads that
    occur more than once are joined."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", "html", F.sha2(data, 256).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    again = scratch.save(hashed.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"))
    joined = hashed.join(again, "sha", "left")
    return joined.select("page_id", "url", "html", F.when((F.col("size") >= least) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.col("first")).alias("refers_to"))


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Write the planned records; returns (archive, bytes, records), a row for each archive."""
    bounded_batches(plan.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        context = TaskContext.get()
        out, done, number = None, [], 0
        for b in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = ArchiveWriter(folder, f"part-{context.partitionId():06d}-{number:04d}", uuid.uuid4().hex)
                payload = (html or "").encode("utf-8", "surrogatepass")
                out.add(page_record(page_id, url, payload, payload_digest(payload), len(payload), refers, refers is not None), len(payload))
                if out.payload >= ARCHIVE_BYTES:
                    done.append(out.close())
                    out, number = None, number + 1
        if out is not None:
            done.append(out.close())
        yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "bytes", "records"])

    return plan.mapInArrow(run, "archive string, bytes long, records long")


def list_ranges(archives: DataFrame) -> DataFrame:
    """(archive, bytes, spans): the record ranges of each archive's index, some at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    spans = [[int(x) for x in line.split()] for line in ZipRanges(f, size).member("indexes/ranges.idx").decode().splitlines()]
                groups = [sum(spans[k : k + RANGE_RECORDS], []) for k in range(0, len(spans), RANGE_RECORDS)]
                yield pa.record_batch([pa.array([uri] * len(groups), pa.string()), pa.array([size] * len(groups), pa.int64()), pa.array(groups, pa.list_(pa.int64()))], names=["archive", "bytes", "spans"])

    return archives.select("archive", "bytes").mapInArrow(run, "archive string, bytes long, spans array<bigint>")


def read_records(ranges: DataFrame, with_payload: bool = False) -> DataFrame:
    """Range-read records: page_id, payload_bytes, payload_digest, record_type, refers_to, and the
    payload on request. A response's digest and length are those of the bytes read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, size, flat in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, path = filesystem(uri)
                rows = []
                with fs.open_input_file(path) as f:
                    spans = list(zip(flat[::2], flat[1::2], strict=True))
                    for data in ZipRanges(f, size).ranges("archive/data.warc.gz", spans):
                        headers, block = parse_record(data)
                        kind, said = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        page = None if headers["X-Page-Id"] == "None" else int(headers["X-Page-Id"])
                        length, refers, payload = int(headers["X-Payload-Length"]), None, None
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if payload_digest(payload) != said or len(payload) != length:
                                raise ValueError(f"{uri}: page {page} is damaged")
                        else:
                            refers = int(headers["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
                        rows.append((page, length, said, kind, refers, *([payload] if with_payload else [])))
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return ranges.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write a WARC record for each row of `pages(page_id, url, html, ...)`, read the archives back and
    return a row for each record. A null html is empty, a payload of any length is stored whole (a task
    starts another archive after ARCHIVE_BYTES); other columns aren't read; a payload that occurs again is a revisit of the
    one with the largest page_id (rows that repeat that page_id are responses too; a null page_id is
    null). Empty input: no archive, empty result."""
    scratch = Scratch(pages.sparkSession, "warc")
    plan = plan_records(pages, scratch)
    archives = scratch.save(write_archives(plan, folder or f"{scratch.root}/archives"))
    n, size = archives.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # by number: the rows are tiny beside what they stand for, and would be put together in one task
    ranges = scratch.save(list_ranges(archives.repartition(max(1, n), "archive")))
    return read_records(ranges.repartition(max(1, -(-size // READ_BYTES)), F.xxhash64("archive", "spans")), with_payload)
