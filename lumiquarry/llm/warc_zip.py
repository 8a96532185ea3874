"""WARC in ZIP packages: writing deduplicated records, and reading them by range without unpacking.

A package holds two stored members: ``archive/data.warc.gz``, records that are a gzip member each, and
``indexes/index.cdxj``, a line with key, offset and length of each record. The reader takes the end of the file, parses
the central directory (ZIP64 records included), finds the stored members' bytes behind their local headers, and from the
index alone cuts the archive into ranges that tasks read on their own. Nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiquarry.llm.textbytes import pieces, utf8
from lumiquarry.operators.joins import hub_join
from lumiquarry.session import shared_folder, table, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed beyond so many bytes of records; a task reads records of about so many bytes at once.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
# Fixed values of the ZIP format: signatures, and what a field holds whose value is in the ZIP64 record.
LOCAL, CENTRAL, DESCRIPTOR, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\7\x08", b"PK\5\6", b"PK\6\6", b"PK\6\7"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int
    crc: int


class ZipWriter:
    """Stored members, streamed: sizes follow each member and stand in the central directory; ``zip64`` writes 64-bit fields always."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append(Member(name, 0, 0, self.at, 0))
        # Version 4.5, flags: sizes follow (bit 3) and UTF-8 names (bit 11). The ZIP64 field makes the descriptor's sizes 64 bits.
        self.put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(name.encode()), 20) + name.encode() + struct.pack("<HHQQ", 1, 16, 0, 0))

    def add(self, data: bytes) -> None:
        m = self.members[-1]
        m.crc, m.size = zlib.crc32(data, m.crc), m.size + len(data)
        self.put(data)

    def end(self) -> None:
        m = self.members[-1]
        self.put(DESCRIPTOR + struct.pack("<IQQ", m.crc, m.size, m.size))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            big = self.zip64 or m.size >= FULL32 or m.header >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.size, m.header) if big else b""
            size, header = (FULL32, FULL32) if big else (m.size, m.header)
            self.put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x808, 0, 0, 0x21, m.crc, size, size, len(m.name.encode()), len(extra), 0, 0, 0, 0, header) + m.name.encode() + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or self.at >= FULL32 or n >= FULL16:
            at = self.at
            self.put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start) + LOCATOR64 + struct.pack("<IQI", 0, at, 1))
            n, size, start = FULL16, FULL32, FULL32
        self.put(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


def directory(file, size: int) -> dict[str, Member]:
    """The members of a ZIP file by name, from its end and central directory."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 22 - FULL16)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END, 0, max(0, len(tail) - 18))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):  # the signature may stand in the comment
        end = tail.rfind(END, 0, end + 3)
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if FULL16 == count or FULL32 in (length, start):
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    data, at, out = read(start, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("a broken ZIP directory")
        method, crc, packed, plain, name, extra, comment, header = struct.unpack_from("<10xH4xIIIHHH8xI", data, at)
        label = data[at + 46 : at + 46 + name].decode()
        place, stop = at + 46 + name, at + 46 + name + extra
        while place + 4 <= stop:  # the ZIP64 field holds, in this order, what is full in the entry
            kind, n = struct.unpack_from("<HH", data, place)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", data, place + 4))
                plain = wide.pop(0) if plain == FULL32 else plain
                packed = wide.pop(0) if packed == FULL32 else packed
                header = wide.pop(0) if header == FULL32 else header
            place += 4 + n
        out[label] = Member(label, method, packed, header, crc)
        at = stop + comment
    return out


def stored_at(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed: it has no ranges")
    file.seek(member.header)
    head = file.read(30)
    if head[:4] != LOCAL:
        raise ValueError("no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit of ``refers_to`` with the headers alone, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, wbits=31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC headers, the HTTP headers and the payload of one record's bytes; names in lower case."""
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    warc = fields(lines)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), payload


def write_packages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = 0, date: str = "2000-01-01T00:00:00Z", zip64: bool = False) -> DataFrame:
    """Writes a record per row of ``pages`` into packages below ``path``; returns (package, records), a row per package.

    Of rows with equal payloads of ``smallest`` bytes or more, that with the smallest id is a response (rows that repeat
    it too) and the others are revisits; rows with a null id are responses. A null payload is empty; a null url is left
    out; further columns are not read. Duplicates are found on (id, digest) rows: a digest that more than a task's share
    of the pages have is broadcast, so its pages are not gathered. Pages are then shuffled once, by id and digest, to meet
    what they refer to and to fill packages evenly.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    slim = base.where(F.octet_length("payload") >= smallest).select("id", "sha1")
    slim = written(slim, "digests")
    first = slim.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = hub_join(slim, first, "sha1", "n", slim.count()).where(F.col("id") > F.col("first")).distinct()
    dealt = base.join(revisits, ["id", "sha1"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(path)
        store.create_dir(folder, recursive=True)
        out = zip_ = None
        names, counts, lines = [], [], []

        def close() -> None:
            nonlocal out
            zip_.end()
            zip_.begin(INDEX)
            zip_.add("".join(lines).encode())
            zip_.end()
            zip_.close()
            out.close()
            store.move(f"{folder}/.{names[-1]}", f"{folder}/{names[-1]}")
            counts.append(len(lines))
            lines.clear()
            out = None

        for batch in pieces(batches, "payload"):
            data, offsets = utf8(batch.column("payload"))
            columns = [batch.column(c).to_pylist() for c in ("id", "url", "sha1", "first")]
            for k, (page, url, sha1, refers) in enumerate(zip(*columns, strict=True)):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.wacz")
                    out = store.open_output_stream(f"{folder}/.{names[-1]}")
                    zip_ = ZipWriter(out, zip64)
                    zip_.begin(ARCHIVE)
                packed = record(page, url, data[offsets[k] : offsets[k + 1]].tobytes(), base32(bytes.fromhex(sha1)), refers, date)
                lines.append(f"{'' if page is None else page} {json.dumps({'offset': zip_.members[-1].size, 'length': len(packed)})}\n")
                zip_.add(packed)
                if zip_.members[-1].size > PACKAGE_BYTES:
                    close()
        if out is not None:
            close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{n}" for n in names]), pa.array(counts, pa.int64())], names=["package", "records"])

    # A task that is run again writes other names; only the packages of the run that counts are listed.
    return written(dealt.select("id", "url", "payload", "sha1", "first").mapInArrow(run, "package string, records long"), "packages")


def read_packages(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record of ``packages`` (package).

    Length and digest are of the full payload: counted and hashed from a response, whose digest must be the one stored,
    and from a revisit's headers. The payload of a revisit is null.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for package in batch.column("package").to_pylist():
                store, name = opened(package)
                with store.open_input_file(name) as file:
                    members = directory(file, file.size())
                    base, at = stored_at(file, members[ARCHIVE]), stored_at(file, members[INDEX])
                    file.seek(at)
                    index = [json.loads(x.split(" ", 1)[1]) for x in file.read(members[INDEX].size).decode().splitlines()]
                lengths, size = [], 0
                for k, entry in enumerate(index):
                    lengths.append(entry["length"])
                    size += entry["length"]
                    if size >= RANGE_BYTES or k == len(index) - 1:
                        rows.append((package, base + entry["offset"] + entry["length"] - size, lengths))
                        lengths, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["package", "at", "lengths"])

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn[10:-1]) if urn and urn[10:-1] else None  # noqa: E731  of <urn:page:N>
        for batch in batches:
            for package, at, lengths in zip(*(batch.column(c).to_pylist() for c in ("package", "at", "lengths")), strict=True):
                store, name = opened(package)
                with store.open_input_file(name) as file:
                    file.seek(at)
                    data = file.read(sum(lengths))
                rows, place = [], 0
                for n in lengths:
                    warc, http, payload = parsed(zlib.decompress(data[place : place + n], wbits=31))
                    place += n
                    digest, full = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"] == "response"
                    if full and (base32(hashlib.sha1(payload).digest()) != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"{package}: a payload is not the one that was written")
                    rows.append((number(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], number(warc.get("warc-refers-to")), int(http["content-length"]), digest, payload.decode() if full else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = packages.select("package").repartition(parts).mapInArrow(ranges, "package string, at long, lengths array<long>")
    return found.repartition(parts).mapInArrow(read, schema)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through packages and back: page_id, payload_bytes, payload_digest, record_type, refers_to. Null payloads are empty; see ``write_packages``."""
    packages = write_packages(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return read_packages(spark, packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
