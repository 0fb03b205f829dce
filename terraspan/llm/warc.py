"""WARC records in ZIP packages, read back by range.

A package is a ZIP archive whose members are stored, not compressed:
``archive/data.warc.gz`` with the records, each a gzip member of its own, and ``indexes/index.cdxj`` with one line a
record (offset and length inside the member). The reader parses the end record,
the ZIP64 locator and end record where there are any, and the central directory;
finds where each member's bytes begin from its local header; and fetches
records by position. Nothing is unpacked, and a record costs one read.

Executors write whole packages into the shared folder; a package counts only once its
task has reported it, so what a lost executor leaves is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_path

#: Payloads from this length on are stored once.
LEAST_SHARED = 100
#: Repeated payloads (of about 100 bytes each) that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Bytes of compressed records in a package.
PACKAGE_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Signatures and sizes of ZIP structures, from the public APPNOTE.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, END64_SIZE, LOCATOR64_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 56, 20, 46, 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class ArchiveError(ValueError):
    """The bytes are no package that this reader knows."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class Package:
    """Random access to the stored members of a ZIP archive of any size."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}

    def at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ArchiveError(f"{length} bytes at {offset} lie outside the archive's {self.size}")
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise ArchiveError("the archive is cut short")
        return data

    def _end(self) -> tuple[int, int, int]:
        """(entries, directory's size, directory's offset)."""
        tail = min(self.size, END_SIZE + FULL16)
        data = self.at(self.size - tail, tail)
        place = data.rfind(END)
        while place >= 0:  # an end record's comment reaches exactly to the end of the file
            if place + END_SIZE <= len(data) and place + END_SIZE + struct.unpack_from("<H", data, place + 20)[0] == len(data):
                break
            place = data.rfind(END, 0, place)
        if place < 0:
            raise ArchiveError("no end of central directory")
        entries, length, offset = struct.unpack_from("<HII", data, place + 10)
        where = self.size - tail + place
        if where >= LOCATOR64_SIZE and (entries == FULL16 or FULL32 in (length, offset)):
            locator = self.at(where - LOCATOR64_SIZE, LOCATOR64_SIZE)
            if locator[:4] == LOCATOR64:
                record = self.at(struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
                if record[:4] != END64:
                    raise ArchiveError("no ZIP64 end of central directory where its locator points")
                entries, length, offset = struct.unpack_from("<QQQ", record, 32)
        return entries, length, offset

    def _directory(self) -> Iterator[Member]:
        entries, length, offset = self._end()
        data, at = self.at(offset, length), 0
        for _ in range(entries):
            if data[at : at + 4] != CENTRAL:
                raise ArchiveError("a central directory entry is missing")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            size, plain, names, extras, comments = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            at += CENTRAL_SIZE
            name = data[at : at + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + names : at + names + extras]
            at += names + extras + comments
            if FULL32 in (size, plain, header):
                plain, size, header = self._wide(extra, plain, size, header)
            yield Member(name, method, size, header)

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """The values with those that are full replaced, in order, from the ZIP64 extra field."""
        at = 0
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
                try:
                    return [next(wide) if v == FULL32 else v for v in values]
                except StopIteration:
                    break
            at += 4 + length
        raise ArchiveError("a ZIP64 extra field is missing or short")

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        member = self.members.get(name)
        if member is None:
            raise ArchiveError(f"no member {name}")
        if member.method != zipfile.ZIP_STORED:
            raise ArchiveError(f"member {name} is compressed")
        head = self.at(member.header, LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ArchiveError(f"no local header of {name}")
        return member.header + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26))

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        size = self.members[name].size if name in self.members else 0
        start = self.start(name)
        length = size - offset if length is None else length
        if offset < 0 or offset + length > size:
            raise ArchiveError(f"{length} bytes at {offset} lie outside {name}")
        return self.at(start + offset, length)


def header_value(text: str | None) -> str:
    """A value for one header line: controls and spaces percent-encoded, since a line break would begin another header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` that keeps the response's head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {header_value(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = block.partition(b"\r\n\r\n")
    if not found:
        raise ArchiveError("a header block doesn't end")
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, rest


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str
    kind: str
    payload: bytes
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def parse_record(data: bytes) -> Record:
    if not data.startswith(b"WARC/"):
        raise ArchiveError("no WARC record here")
    warc, rest = headers(data)
    block = rest[: int(warc["content-length"])]
    http, payload = headers(block)
    digest = warc["warc-payload-digest"].removeprefix("sha256:")
    kind = warc["warc-type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ArchiveError(f"the payload of {warc['warc-record-id']} doesn't have its digest")
    origin = warc.get("warc-refers-to")
    return Record(page_of(warc["warc-record-id"]), warc.get("warc-target-uri", ""), kind, payload, int(http["content-length"]), digest, page_of(origin) if origin else None)


def pack(records: list[tuple[int | None, bytes]]) -> bytes:
    """A package of these (page_id, compressed record)s."""
    out, lines, at = io.BytesIO(), [], 0
    for page_id, data in records:
        lines.append(json.dumps({"page_id": page_id, "offset": at, "length": len(data)}))
        at += len(data)
    stamp = (1980, 1, 1, 0, 0, 0)  # the same records give the same bytes
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(DATA, stamp), "w", force_zip64=True) as member:
            for _, data in records:
                member.write(data)
        z.writestr(zipfile.ZipInfo(INDEX, stamp), "\n".join(lines))
    return out.getvalue()


#: Spark's names for stores -> those of the Python side.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def store_uri(uri: str) -> str:
    """A URI as Spark names it, as pyarrow does: other schemes, three slashes for local files; a plain path is a local file."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return f"file://{uri}"
    if scheme == "file":
        return f"file:///{rest.lstrip('/')}"
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def store_of(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(store_uri(uri))


@contextmanager
def open_package(uri: str) -> Iterator[Package]:
    """A package of the store, closed afterwards."""
    store, path = store_of(uri)
    with store.open_input_file(path) as file:
        yield Package(file, file.size())


def records(package: Package) -> Iterator[Record]:
    for line in package.read(INDEX).decode("utf-8").splitlines():
        entry = json.loads(line)
        data = package.read(DATA, entry["offset"], entry["length"])
        yield parse_record(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)


def deduplicated(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set on rows whose payload an earlier page holds."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = materialize(pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")), "payloads")
    several = narrow.filter(F.col("n") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    several = materialize(several.select("digest", "first"), "repeated_payloads")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    refers = F.when(other, F.col("first")).alias("refers_to")
    if several.count() <= BROADCAST_ROWS:  # only (digest, first page) of repeated payloads meets the pages, so that no page is shuffled
        return rows.join(F.broadcast(several), "digest", "left").select("page_id", "url", "payload", "digest", refers)
    # narrow rows meet on the digest, which may be hot; pages then on their own id and digest
    revisits = narrow.join(several.hint("merge"), "digest").filter(other).select("page_id", "digest", refers).distinct()
    revisits = materialize(revisits, "revisits").select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "refers_to")
    met = rows.join(revisits.hint("merge"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    return met.select("page_id", "url", "payload", "digest", "refers_to")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write packages into ``folder`` (a URI that all executors reach); one row (path, rows) for each that counts.

    One record a row: equal payloads of 100 bytes or more are stored with the
    smallest page_id, the others refer to it. Null html is an empty payload,
    a null url an empty one. Rows that share a page_id and payload are one
    page, each a response. A null page_id is never the smallest one unless all
    of a payload's are null, and then each is a response. Very long payloads are
    one record each, whole, so a package may exceed PACKAGE_BYTES. Other
    columns are ignored, whatever their names; an empty table writes no package.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)

        def save(held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(pack(held))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], names=["path", "rows"])

        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((page_id, gzip.compress(record(page_id, url, payload, digest, first), 6, mtime=0)))
                size += len(held[-1][1])
                if size >= PACKAGE_BYTES:
                    yield save(held)
                    held, size = [], 0
        if held:
            yield save(held)

    return materialize(deduplicated(pages).mapInArrow(put, "path string, rows long"), "packages")


def read(packages: DataFrame) -> DataFrame:
    """The records of the packages whose URIs stand in ``path``: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to."""
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def batch_of(rows: list[Record]) -> pa.RecordBatch:
        columns = list(zip(*((r.page_id, r.url, r.kind, r.payload, r.payload_bytes, r.payload_digest, r.refers_to) for r in rows), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, size = [], 0
                with open_package(uri) as package:
                    for r in records(package):
                        held.append(r)
                        size += len(r.payload)
                        if size >= 4 << 20:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    spark = packages.sparkSession
    parts = max(1, min(packages.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return packages.select("path").repartition(parts).mapInArrow(get, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of all ``pages`` say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Nulls, empty and very long payloads, ties and repeated rows are as in
    ``write``; an empty table gives an empty one.
    """
    packages = write(pages, shared_path(pages.sparkSession, "warc"))
    return read(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
