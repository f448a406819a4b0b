"""Operator 8: WARC archives as a PySpark data source, ``warc``.

Writing: every task writes gzip members, one record each, into files of its own; their names become final when the
job commits, so a lost or repeated task leaves nothing in the archive.  Each member's extra field (``sl``) has its
length.  Reading: files are planned into partitions by size; predicates on record type, target URI, record id and
date are pushed down; a record's headers are parsed first, and where a predicate fails (or payloads aren't asked for) its
payload is neither read nor inflated beyond the piece in which its headers, http ones included, end.  Archives without that field, and plain ``.warc`` files, are read as streams.

Options of the reader: ``path``; ``payload`` (true: decode payloads); ``partition_bytes``.  Of the writer: ``path``,
``file_bytes`` (a new file begins beyond that).  Paths: local ones and those that pyarrow's file systems open.

Defined results of ``archive``: null html is an empty payload; of equal payloads of at least ``min_bytes`` the
smallest page_id is the response and rows with other ids revisit it, rows that repeat that id are responses too; ties can't
occur otherwise; null urls become an empty target; empty tables give an empty archive; a payload of any length is one member, written and read by one task; other columns are not read.
"""

from __future__ import annotations

import atexit
import base64
import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import delete, hot_join, shared_dir

READ = "record_id string, record_type string, target_uri string, date string, refers_to string, header_digest string, payload_bytes long, payload_digest string, payload binary"
WRITE = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_bytes long, payload binary"
#: Header of each column that predicates may be pushed down to.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def line(text: str | None) -> str:
    """A header's value: bytes that would end the line are percent-encoded."""
    return (text or "").replace("%0D", "%250D").replace("%0A", "%250A").replace("\r", "%0D").replace("\n", "%0A")


def unline(text: str) -> str:
    return text.replace("%0D", "\r").replace("%0A", "\n").replace("%25\r", "%0D").replace("%25\n", "%0A")


def record(row: dict) -> bytes:
    """A whole record of the archive, uncompressed; a revisit has the digest and length of its payload, not the payload."""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + (row["payload"] or b"")
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{line(row['record_id'])}>"), ("WARC-Date", line(row["date"])), ("WARC-Target-URI", line(row["target_uri"])), ("WARC-Payload-Digest", f"sha1:{digest_of(row['payload'] or b'')}")]
    if revisit:
        head += [("WARC-Refers-To", f"<{line(row['refers_to'])}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds its own length and that of its content."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    total = 24 + len(body) + 8
    if total >= 1 << 32 or len(raw) >= 1 << 32:
        return gzip.compress(raw, level)
    return struct.pack("<4BI2BH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, total, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.file_bytes = options["path"].rstrip("/"), int(options.get("file_bytes", 128 << 20))
        self.mark = f"_open-{uuid.uuid4().hex}-"  # of the files of this write until it is committed

    def write(self, iterator: Iterator) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{self.mark}{files[-1]}", compression=None), 0
                raw = member(record(row))
                out.write(raw)
                size += len(raw)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for f in m.files if m else ():
                fs.move(f"{root}/{self.mark}{f}", f"{root}/{f}")
        self.clear(fs, root)

    def abort(self, messages: list) -> None:
        fs, root = opened(self.path)
        self.clear(fs, root)

    def clear(self, fs, root: str) -> None:
        """Deletes what tasks of this write have left open, lost ones too."""
        from pyarrow.fs import FileSelector

        for found in fs.get_file_info(FileSelector(root, allow_not_found=True)):
            if found.base_name.startswith(self.mark):
                fs.delete_file(found.path)


@dataclass
class Files(InputPartition):
    paths: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"].rstrip("/"), options.get("payload", "true").lower() == "true"
        self.bytes, self.tests = int(options.get("partition_bytes", 32 << 20)), []

    def pushFilters(self, filters: list) -> Iterator:
        kinds = ((EqualTo, "eq"), (In, "in"), (GreaterThan, "gt"), (GreaterThanOrEqual, "ge"), (LessThan, "lt"), (LessThanOrEqual, "le"))
        for f in filters:
            kind = next((n for k, n in kinds if isinstance(f, k)), None)
            if kind and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((HEADERS[f.attribute[0]], kind, f.value))
            else:
                yield f

    def partitions(self) -> list:
        from pyarrow.fs import FileSelector, FileType

        fs, root = opened(self.path)
        infos = fs.get_file_info(FileSelector(root, recursive=True)) if fs.get_file_info(root).type == FileType.Directory else [fs.get_file_info(root)]
        found = sorted((i.size, i.path) for i in infos if i.type == FileType.File and i.base_name.endswith((".warc", ".warc.gz")) and not i.base_name.startswith("_"))
        parts, size = [], 0
        for n, p in found:
            if not parts or size + n > self.bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(p)
            size += n
        return parts or [Files([])]

    def wanted(self, head: dict) -> bool:
        for name, kind, value in self.tests:
            x = head.get(name)
            if x is None or not {"eq": x == value, "in": kind == "in" and x in value, "gt": kind == "gt" and x > value, "ge": kind == "ge" and x >= value, "lt": kind == "lt" and x < value, "le": kind == "le" and x <= value}[kind]:
                return False
        return True

    def read(self, partition: Files) -> Iterator:
        fs, _ = opened(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                start = f.read(24)
                f.seek(0)
                if start[:3] == b"\x1f\x8b\x08" and len(start) == 24 and start[3] & 4 and start[12:14] == b"sl":
                    yield from self.members(f)
                else:
                    plain = io.BufferedReader(gzip.GzipFile(fileobj=f) if start[:2] == b"\x1f\x8b" else f, 1 << 20)
                    yield from self.stream(plain)

    def members(self, f) -> Iterator:
        """Records of members with lengths: the headers are inflated first, the rest if it is wanted."""
        f = io.BufferedReader(f, 1 << 20)
        while len(lead := f.read(24)) == 24:
            flags, total = lead[3], struct.unpack_from("<I", lead, 16)[0]
            if lead[:2] != b"\x1f\x8b" or not flags & 4 or lead[12:14] != b"sl":
                yield from self.stream(io.BufferedReader(gzip.GzipFile(fileobj=_Joined(lead, f))))
                return
            first = f.read(min(2048, total - 24))
            z = zlib.decompressobj(-15)
            raw, at = z.decompress(first, 4096), 24 + len(first)
            while (end := raw.find(b"\r\n\r\n")) < 0 and not z.eof:
                part, at = further(f, z, at, total)
                raw += part
            head = headers(raw[:end])
            if self.wanted(head):
                if not self.payload or head.get("warc-type") == "revisit":
                    last = end + 4 + int(head.get("content-length", 0))
                    while http_in(head) and raw.find(b"\r\n\r\n", end + 4, last) < 0 and len(raw) < last and not z.eof:
                        part, at = further(f, z, at, total)
                        raw += part
                else:
                    rest = f.read(total - at)
                    raw += z.decompress(z.unconsumed_tail + rest) + z.flush()
                    at = total
                yield self.row(head, raw[end + 4 : end + 4 + int(head.get("content-length", 0))])
            skip(f, total - at)

    def stream(self, f) -> Iterator:
        while True:
            text = f.readline()
            while text in (b"\r\n", b"\n"):
                text = f.readline()
            if not text:
                return
            lines = [text]
            while (text := f.readline()) not in (b"\r\n", b"\n", b""):
                lines.append(text)
            head = headers(b"".join(lines).rstrip(b"\r\n"))
            n = int(head.get("content-length", 0))
            if self.wanted(head) and (self.payload or head.get("warc-type") == "revisit"):
                yield self.row(head, f.read(n))
            else:
                if self.wanted(head):
                    taken = b""
                    while http_in(head) and b"\r\n\r\n" not in taken and n and (part := f.read(min(n, 65536))):
                        taken += part
                        n -= len(part)
                    yield self.row(head, taken)
                skip(f, n)

    def row(self, head: dict, block: bytes) -> tuple:
        """The columns; http headers in front of the payload, where the type says so, are taken off."""
        kind, given = head.get("warc-type"), head.get("warc-payload-digest", "").partition(":")[2] or None
        http = b""
        if http_in(head):
            top, gap, body = block.partition(b"\r\n\r\n")
            http, block = (top, body) if gap else (b"", block)
        sizes = [v for k, v in (x.split(b":", 1) for x in http.split(b"\r\n")[1:] if b":" in x) if k.strip().lower() == b"content-length"]
        full = self.payload and kind != "revisit"
        n = len(block) if full else int(sizes[0]) if sizes else None
        ref = head.get("warc-refers-to")
        return head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-date"), ref.strip("<>") if ref else None, given, n, digest_of(block) if full else given, block if full else None


class _Joined(io.RawIOBase):
    """What was read already, then the rest of the file."""

    def __init__(self, lead: bytes, f):
        self.lead, self.f = lead, f

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if self.lead:
            out, self.lead = (self.lead, b"") if n < 0 else (self.lead[:n], self.lead[n:])
            return out
        return self.f.read(n)


def http_in(head: dict) -> bool:
    """Whether the record's block begins with http headers."""
    return "application/http" in head.get("content-type", "")


def further(f, z, at: int, total: int) -> tuple[bytes, int]:
    """More of the member that z inflates, and the place in it up to which f is read."""
    got = b""
    if not z.unconsumed_tail:
        got = f.read(min(65536, total - at))
        if not got:
            raise ValueError("a WARC member ends within its headers")
    return z.decompress(z.unconsumed_tail + got, 65536), at + len(got)


def skip(f, n: int) -> None:
    if n > 0:
        if f.seekable():
            f.seek(n, 1)
        else:
            while n > 0 and (got := f.read(min(n, 1 << 20))):
                n -= len(got)


def headers(raw: bytes) -> dict:
    out = {}
    for text in raw.decode("utf-8", "surrogateescape").split("\r\n" if b"\r\n" in raw else "\n")[1:]:
        k, _, v = text.partition(":")
        out[k.strip().lower()] = unline(v.strip())
    if "warc-record-id" in out:
        out["warc-record-id"] = out["warc-record-id"].strip("<>")
    return out


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """The records to write: response or revisit of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    groups = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    total = pages.count()
    rows = hot_join(rows, groups, "key", "n", total, "page_id")
    n = F.octet_length("payload")
    again = (n >= min_bytes) & (F.col("page_id") != F.col("first"))
    return rows.select("page_id", F.when(again, "revisit").otherwise("response").alias("record_type"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), F.when(again, F.col("first")).alias("refers_to"), n.cast("long").alias("payload_bytes"), "payload")


def archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per page to the archive at path; its records as the reader returns them."""
    spark = pages.sparkSession
    register(spark)

    def rid(c: str) -> Column:
        return F.concat(F.lit("urn:page:"), F.col(c).cast("string"))

    out = records(pages, min_bytes, date).select(rid("page_id").alias("record_id"), "record_type", "target_uri", "date", rid("refers_to").alias("refers_to"), "payload_bytes", "payload")
    out.write.format("warc").mode("append").option("path", path).save()
    return spark.read.format("warc").option("path", path).load()


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read back from its archive."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    back = archive(pages, path, min_bytes)
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
