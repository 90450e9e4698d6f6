"""WARC archives in ZIP packages: written by Spark tasks, read again by range.

A package is a ZIP file with stored members: archive/data.warc.gz (a gzip member for each record) and
indexes/index.cdxj (a line for each record, with its offset and length in the archive). A reader parses the
central directory, with its ZIP64 forms, from the end of the file, finds where a stored member's bytes
lie, reads the index, and then only the ranges of the records that it wants; nothing is unpacked.

Packages lie in any file system that pyarrow.fs can name by a URI."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Fixed values of the formats: names within a package, signatures of ZIP, the revisit profile.
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
LEAST_BYTES = 100
RECORDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
PLACES = "path string, archive_at long, archive_bytes long, at long, bytes long"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


# ---- ZIP directories


class Member(NamedTuple):
    name: str
    method: int  # 0: stored
    size: int  # as it lies in the package
    full_size: int
    header_at: int


def _wide(extra: bytes, fields: list[int], limits: list[int]) -> list[int]:
    """fields with those at their limit taken from the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, p, out = extra[at + 4 : at + 4 + size], 0, []
            for value, limit in zip(fields, limits, strict=True):
                if value == limit:
                    width = 8 if limit == 0xFFFFFFFF else 4
                    value, p = int.from_bytes(body[p : p + width], "little"), p + width
                out.append(value)
            return out
        at += 4 + size
    return fields


def _ranged(file: BinaryIO, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def members(file: BinaryIO, size: int) -> list[Member]:
    """The members of a ZIP file of ``size`` bytes by its central directory, ZIP64 or not. Bytes before the first
    member are allowed. Raises ValueError on what is no ZIP file, or one that lacks its end."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = _ranged(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file, or cut off")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if end_at >= 20 and (locator := _ranged(file, end_at - 20, 20))[:4] == LOCATOR64:
        wide_at = struct.unpack_from("<Q", locator, 8)[0]
        wide = _ranged(file, wide_at, 56)
        if wide[:4] != END64:  # bytes stand before the first member, so that places are off by as many
            wide_at = end_at - 20 - 56
            wide = _ranged(file, wide_at, 56)
        if wide[:4] != END64:
            raise ValueError("the ZIP64 end of the central directory isn't where its locator says")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
        end_at = wide_at
    shift = end_at - length - start
    if shift < 0:
        raise ValueError("the central directory is cut off")
    directory, out, at = _ranged(file, start + shift, length), [], 0
    while at < len(directory):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("a central directory entry has no signature")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n, x, c, disk, _, _, header = struct.unpack_from("<IIHHHHHII", directory, at + 20)
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, header, _ = _wide(directory[at + 46 + n : at + 46 + n + x], [full, packed, header, disk], [0xFFFFFFFF] * 3 + [0xFFFF])
        out.append(Member(name, method, packed, full, header + shift))
        at += 46 + n + x + c
    if len(out) != count:
        raise ValueError(f"the central directory has {len(out)} entries of {count}")
    return out


def data_at(file: BinaryIO, member: Member) -> int:
    """Where a member's bytes begin: its local header has lengths of its own."""
    header = _ranged(file, member.header_at, 30)
    if header[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    n, x = struct.unpack_from("<HH", header, 26)
    return member.header_at + 30 + n + x


def unpacked(file: BinaryIO, member: Member) -> bytes:
    """A small member's content (an index), stored or deflated, and out of gzip if its name says so."""
    data = _ranged(file, data_at(file, member), member.size)
    if member.method not in (0, 8):
        raise ValueError(f"{member.name} is packed by method {member.method}")
    data = zlib.decompress(data, -15) if member.method == 8 else data
    return gzip.decompress(data) if member.name.endswith(".gz") else data


# ---- WARC records


def _uri(url: str) -> str:
    """A url that fits into a header line: control characters, blanks and % of their escapes as %XX."""
    return "".join(c if " " < c != "\x7f" and c != "%" else f"%{ord(c):02X}" for c in url)


def _url(uri: str) -> str:
    parts = uri.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record (without payload) of the page refers_to. Page ids travel in
    headers of their own; the HTTP header has the length of the full payload in both."""
    again = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if again else http + payload
    head = [f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_uri(url)}"] if url is not None else []
    head += [f"Page-ID: {_uri(page_id)}"] if page_id is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {_uri(refers_to)}"] if again else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record, names in lower case."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    named = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    head = named(lines[1:])
    length = int(head["content-length"])
    if len(rest) < length:
        raise ValueError("a WARC record is cut off")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return head, named(http.decode().split("\r\n")[1:]), payload


# ---- writing


def with_verdicts(pages: DataFrame, least: int = LEAST_BYTES, salts: int = 16) -> DataFrame:
    """(page_id, url, html, payload_digest, refers_to) of pages: refers_to is the smallest page_id with the same
    payload (by length and SHA-256) of at least ``least`` bytes, null for that page itself.

    Copies are counted before they are shuffled, and only digests of several rows are joined back; the copies of
    one digest are dealt out over ``salts`` keys."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).alias("size"))
    first = rows.filter(F.col("size") >= least).groupBy("payload_digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select("payload_digest", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    joined = salted.join(first, ["payload_digest", "size", "salt"], "left")
    return joined.select("page_id", "url", "html", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


class _Package:
    """One ZIP file while it is written, as a stream: its sizes follow each member."""

    def __init__(self, folder: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wacz"
        where, path = opened(self.uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, key: str, packed: bytes, kind: str) -> None:
        self.archive.write(packed)
        self.lines.append(f"{key} {json.dumps({'type': kind, 'offset': self.size, 'length': len(packed)})}\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.archive.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.lines)))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.lines)


def write_packages(pages: DataFrame, folder: str, most: int = 1 << 30, level: int = 6, date: str = DATE, least: int = LEAST_BYTES) -> DataFrame:
    """Writes a WARC record for each row of pages(page_id, url, html) into packages of about ``most`` bytes below
    folder, and returns their table (path, records). Files of attempts that failed aren't in it.

    Null html is an empty payload, a null url gives a record without target. Payloads of ``least`` bytes or more
    that were there before are revisits of the smallest page_id with them. Rows that repeat that page_id and
    payload are all responses; a null page_id is never the smallest, and copies that all have null ids are
    responses. Texts of any length make one record; a task holds one record and one index (a line a record)
    besides its batch. An empty table gives no package. page_id may be of any type that casts to string and
    back; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in batch.columns)
                package = package or _Package(folder)
                data = gzip.compress(record(page_id, url, html or b"", digest, refers_to, date), level, mtime=0)
                package.add(_uri(url or "-"), data, "response" if refers_to is None else "revisit")
                if package.size >= most:
                    done, package = [*done, package.close()], None
        done += [package.close()] if package else []
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    text = lambda c: F.col(c).cast("string")
    rows = with_verdicts(pages, least).select(text("page_id"), text("url"), F.col("html").cast("binary"), "payload_digest", text("refers_to"))
    return written(rows.mapInArrow(run, "path string, records long"), "packages")


# ---- reading


def record_places(packages: DataFrame) -> DataFrame:
    """(path, archive_at, archive_bytes, at, bytes) of the records of packages(path), by their directories and indexes:
    at and bytes are the record's range in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, path = opened(uri)
                with where.open_input_file(path) as file:
                    found = members(file, file.size())
                    archives = {m.name.rpartition("/")[2]: m for m in found if m.name.startswith("archive/")}
                    lines = [json.loads(x[x.index("{") :]) for m in found if m.name.startswith("indexes/") for x in unpacked(file, m).decode().splitlines() if "{" in x]
                    begins = {}
                    for name, m in archives.items():
                        if m.method:
                            raise ValueError(f"{m.name} in {uri} isn't stored: its records have no ranges")
                        begins[name] = data_at(file, m)
                only = next(iter(archives)) if len(archives) == 1 else None
                names = [x.get("filename", only) for x in lines]
                at, size = [int(x["offset"]) for x in lines], [int(x["length"]) for x in lines]
                columns = [[uri] * len(lines), [begins[n] for n in names], [archives[n].size for n in names], [begins[n] + a for n, a in zip(names, at, strict=True)], size]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] + [pa.int64()] * 4, strict=True)], ["path", "archive_at", "archive_bytes", "at", "bytes"])

    return packages.select("path").mapInArrow(run, PLACES)


def read_records(places: DataFrame, payloads: bool = True, stride: int = 16 << 20, most: int = 4 << 20) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the records at places.

    Places of one stretch of ``stride`` bytes go to one task, which reads neighbours of up to ``most`` bytes at once.
    Of a response the length and digest are worked out anew and held against its headers (ValueError if they
    differ); a revisit has no payload, its headers give those of the full one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            while rows:
                path, at, size = rows[0]
                k, end = 1, at + size
                while k < len(rows) and rows[k][0] == path and rows[k][1] == end and end + rows[k][2] - at <= most:
                    k, end = k + 1, end + rows[k][2]
                if path != name:
                    if file:
                        file.close()
                    where, inner = opened(path)
                    file, name = where.open_input_file(inner), path
                data = memoryview(_ranged(file, at, end - at))
                yield _batch([gzip.decompress(data[a - at : a - at + n]) for _, a, n in rows[:k]], payloads)
                rows = rows[k:]
        if file:
            file.close()

    near = places.select("path", "at", "bytes", F.floor(F.col("at") / stride).alias("run"))
    dealt = near.repartition("path", "run").sortWithinPartitions("path", "at").select("path", "at", "bytes")
    return dealt.mapInArrow(run, RECORDS)


def _batch(records: list[bytes], payloads: bool) -> pa.RecordBatch:
    rows = []
    for data in records:
        head, http, payload = parsed(data)
        kind, digest, size = head["warc-type"], head["warc-payload-digest"].rpartition(":")[2], int(http["content-length"])
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {head['warc-record-id']} isn't what its headers say")
        back = lambda name: _url(head[name]) if name in head else None  # noqa: B023, E731
        rows.append((back("page-id"), back("warc-target-uri"), size, digest, kind, back("refers-to-page-id"), payload if payloads and kind == "response" else None))
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """pages written as packages below folder (of the shared folder, where it is None) and read again; page_id and
    refers_to have page_id's type. Rules and odd rows as in write_packages()."""
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    packages = write_packages(pages, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    found = read_records(record_places(packages), payloads)
    kind = pages.schema["page_id"].dataType
    own: dict[str, Column] = {c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}
    return found.withColumns(own) if payloads else found.withColumns(own).drop("payload")
