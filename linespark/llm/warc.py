"""WARC records in ZIP-packaged archives: a distributed writer and a range reader.

An archive is one ZIP file with stored (uncompressed) members::

    archive/data.warc.gz     one gzip member for each WARC record
    indexes/index.cdxj       one line for each record: key, time, JSON with offset and length
    datapackage.json         names of the resources

``write_archives`` packs records inside the tasks and writes each bounded archive through
Spark's own file writer, so any store that Spark reaches will do. ``read_archives`` works in two
steps. First, tasks read of each archive the end record, the ZIP64 locator, the central directory and
the indexes (also gzipped ones), each by its byte range; of an archive's member that no index
lists, the records are found by one pass over it. Then the records' places are dealt out in runs of
about ``RANGE_BYTES``, and tasks read just these ranges. No archive is read or held whole, and no
member is extracted. Only where Python can't open the store (Spark alone reaches it), Spark
hands over whole archives, up to its limit for binary files.

Defined cases: a null payload is empty; a null URL is written as ``urn:none``; a row with a
null id is always a response and never what a revisit refers to; rows repeated with the same
id and payload each get a record; an empty table gives archives without records; further
columns of the input are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this many bytes are never written as revisits.
MIN_REVISIT_BYTES = 1000
#: An archive is closed once its records reach this many bytes.
ARCHIVE_BYTES = 4 << 20
#: Bytes of neighbouring records that are read at once (a single record may be longer).
RANGE_BYTES = 1 << 20

RECORD_FIELDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean"

# Fixed values of the ZIP format: signatures and record layouts.
END_SIGNATURE = b"PK\x05\x06"
END_LAYOUT = "<4s4H2LH"
END64_LOCATOR_SIGNATURE = b"PK\x06\x07"
END64_LOCATOR_LAYOUT = "<4sLQL"
END64_SIGNATURE = b"PK\x06\x06"
END64_LAYOUT = "<4sQ2H2L4Q"
ENTRY_SIGNATURE = b"PK\x01\x02"
ENTRY_LAYOUT = "<4s6H3L5H2L"
LOCAL_SIGNATURE = b"PK\x03\x04"
LOCAL_LAYOUT = "<4s5H3L2H"
ZIP64_EXTRA = 1
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


# ---------------------------------------------------------------- ZIP ranges


class ByteRanges:
    """Random access to bytes in memory or to a seekable file."""

    def __init__(self, source):
        self._data = memoryview(source) if isinstance(source, (bytes, bytearray, memoryview)) else None
        self._file = None if self._data is not None else source
        self.size = len(self._data) if self._data is not None else source.seek(0, io.SEEK_END)

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} is outside of {self.size} bytes")
        if self._data is not None:
            return bytes(self._data[offset : offset + length])
        self._file.seek(offset)
        return self._file.read(length)


@dataclass(frozen=True)
class Member:
    name: str
    stored: bool
    size: int
    compressed_size: int
    header_offset: int


def read_directory(ranges: ByteRanges) -> list[Member]:
    """Members listed in the central directory, with ZIP64 sizes and offsets resolved."""
    tail_size = min(ranges.size, struct.calcsize(END_LAYOUT) + FULL16)
    tail = ranges.read(ranges.size - tail_size, tail_size)
    at = tail.rfind(END_SIGNATURE)
    while at >= 0:
        if len(tail) - at >= struct.calcsize(END_LAYOUT):
            end = struct.unpack_from(END_LAYOUT, tail, at)
            if at + struct.calcsize(END_LAYOUT) + end[7] == len(tail):
                break
        at = tail.rfind(END_SIGNATURE, 0, at)
    if at < 0:
        raise ValueError("not a ZIP file: there is no end record")
    count, directory_size, directory_offset = end[4], end[5], end[6]
    end_offset = ranges.size - tail_size + at
    locator_size = struct.calcsize(END64_LOCATOR_LAYOUT)
    if end_offset >= locator_size:
        locator = struct.unpack(END64_LOCATOR_LAYOUT, ranges.read(end_offset - locator_size, locator_size))
        if locator[0] == END64_LOCATOR_SIGNATURE:
            end64 = struct.unpack(END64_LAYOUT, ranges.read(locator[2], struct.calcsize(END64_LAYOUT)))
            if end64[0] != END64_SIGNATURE:
                raise ValueError("broken ZIP64 end record")
            count, directory_size, directory_offset = end64[7], end64[8], end64[9]
    directory = ranges.read(directory_offset, directory_size)
    members, at, fixed = [], 0, struct.calcsize(ENTRY_LAYOUT)
    for _ in range(count):
        entry = struct.unpack_from(ENTRY_LAYOUT, directory, at)
        if entry[0] != ENTRY_SIGNATURE:
            raise ValueError("broken central directory")
        flags, method, packed, size, name_size, extra_size, comment_size, offset = entry[3], entry[4], entry[8], entry[9], entry[10], entry[11], entry[12], entry[16]
        name = directory[at + fixed : at + fixed + name_size]
        extra = directory[at + fixed + name_size : at + fixed + name_size + extra_size]
        size, packed, offset = _zip64_values(extra, size, packed, offset)
        members.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method == 0, size, packed, offset))
        at += fixed + name_size + extra_size + comment_size
    return members


def _zip64_values(extra: bytes, *values: int) -> list[int]:
    """The given 32-bit values, with those that are full replaced from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == ZIP64_EXTRA:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide) if v == FULL32 else v for v in values]
        at += 4 + size
    return list(values)


def data_offset(ranges: ByteRanges, member: Member) -> int:
    """Where the member's own bytes begin, behind its local header."""
    size = struct.calcsize(LOCAL_LAYOUT)
    local = struct.unpack(LOCAL_LAYOUT, ranges.read(member.header_offset, size))
    if local[0] != LOCAL_SIGNATURE:
        raise ValueError(f"broken local header of {member.name}")
    return member.header_offset + size + local[9] + local[10]


def read_index(ranges: ByteRanges, members: list[Member]) -> Iterator[tuple[str, int, int]]:
    """(archive member's name, offset, length) of each record that the indexes list."""
    for member in members:
        if member.name.startswith("indexes/") and member.stored:
            raw = ranges.read(data_offset(ranges, member), member.size)
            text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8")
            for line in text.splitlines():
                if "{" in line:
                    entry = json.loads(line[line.index("{") :])
                    yield "archive/" + entry["filename"], int(entry["offset"]), int(entry["length"])


def scan_member(ranges: ByteRanges, start: int, size: int, chunk: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member of a stored archive, found by unpacking it in pieces."""
    begin, at, unpack = 0, 0, zlib.decompressobj(wbits=31)
    while at < size:
        data = ranges.read(start + at, min(chunk, size - at))
        at += len(data)
        while data:
            unpack.decompress(data)
            if not unpack.eof:
                break
            data = unpack.unused_data
            end = at - len(data)
            yield begin, end - begin
            begin, unpack = end, zlib.decompressobj(wbits=31)


def record_ranges(ranges: ByteRanges) -> Iterator[tuple[int, int]]:
    """(offset, length) in the file of each record: of the indexes' lines, then of members that no index lists."""
    members = read_directory(ranges)
    start = {m.name: (data_offset(ranges, m), m.size) for m in members if m.stored and m.name.startswith("archive/")}
    listed = set()
    for name, offset, length in read_index(ranges, members):
        listed.add(name)
        yield start[name][0] + offset, length
    for name, (at, size) in start.items():
        if name not in listed:
            yield from ((at + offset, length) for offset, length in scan_member(ranges, at, size))


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one packed record."""
    head, _, rest = zlib.decompress(raw, wbits=31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def iter_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record in one archive, each read from its own byte range."""
    ranges = ByteRanges(source)
    for offset, length in record_ranges(ranges):
        yield parsed(ranges.read(offset, length))


def open_file(path: str):
    """A seekable file of any store that Python reaches; local paths as Spark writes them."""
    if path.startswith(("file:", "/")):
        return open("/" + unquote(path.removeprefix("file:")).lstrip("/") if path.startswith("file:") else path, "rb")  # noqa: SIM115
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


# ------------------------------------------------------------------- records


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    found = urn[len("<urn:page:") : -1] if urn else "null"
    return None if found == "null" else int(found)


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` it is a revisit that carries no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Target-URI: " + ("urn:none" if url is None else "".join(url.split())),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        headers[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(headers).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Archive:
    """Collects records and packs them as one ZIP file."""

    def __init__(self):
        self.data, self.index, self.size = [], [], 0

    def add(self, page_id, url, payload, digest, refers_to) -> None:
        packed = gzip.compress(warc_record(page_id, url, payload, digest, refers_to), compresslevel=3, mtime=0)
        about = {"url": url, "digest": f"sha1:{digest}", "offset": self.size, "length": len(packed), "filename": "data.warc.gz"}
        self.index.append(f"{'-' if page_id is None else page_id} 19700101000000 {json.dumps(about)}")
        self.data.append(packed)
        self.size += len(packed)

    def pack(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            # Members are written as ZIP64, so that larger archives need no other form.
            for name, content in (("archive/data.warc.gz", b"".join(self.data)), ("indexes/index.cdxj", "\n".join(self.index).encode("utf-8")), ("datapackage.json", json.dumps({"profile": "data-package", "resources": ["archive/data.warc.gz", "indexes/index.cdxj"]}).encode())):
                with package.open(name, "w", force_zip64=True) as member:
                    member.write(content)
            package.comment = b"\n"
        return out.getvalue()


def _pack(batches: Iterable[pa.RecordBatch], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    archive = _Archive()
    done = lambda: pa.RecordBatch.from_pydict({"archive": pa.array([archive.pack()[:-1]], pa.binary())})
    for batch in batches:
        for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            archive.add(page_id, url, payload, digest, refers_to)
            if archive.size >= archive_bytes:
                yield done()
                archive = _Archive()
    if archive.data:
        yield done()


# -------------------------------------------------------------------- Spark


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which record each row becomes.

    Only ids and digests are shuffled to find copies (the maximum is combined before the
    shuffle); the payloads move once, by their id, to meet the verdict.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    ids = rows.filter(F.length("payload") >= min_bytes).select("page_id", "digest")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = ids.join(last, "digest").filter("page_id < refers_to").distinct()
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the rows of ``with_revisits`` as ZIP-packaged WARC archives, one file each.

    The file writer ends each value with a line feed; that byte is the archive's ZIP comment.
    """
    packed = records.mapInArrow(lambda batches: _pack(batches, archive_bytes), "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(path)


TYPES = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())]


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    url = headers["WARC-Target-URI"]
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
    revisit = headers["WARC-Type"] == "revisit"
    digest = told if revisit else hashlib.sha1(payload).hexdigest()
    return _page_of(headers["WARC-Record-ID"]), None if url == "urn:none" else url, headers["WARC-Type"], payload if with_payload and not revisit else None, length if revisit else len(payload), digest, _page_of(headers.get("WARC-Refers-To")), digest == told


def _rows(records: Iterable[tuple[dict[str, str], bytes]], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Record batches of about RANGE_BYTES of payload."""
    rows, size = [], 0
    done = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), TYPES, strict=True)], names=[n for n, _ in TYPES])
    for headers, block in records:
        rows.append(_row(headers, block, with_payload))
        size += len(block) if with_payload else 256
        if size >= RANGE_BYTES:
            yield done()
            rows, size = [], 0
    if rows:
        yield done()


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, begin, end, offsets, lengths): runs of neighbouring records, from the archives' directories and indexes."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open_file(path) as file:
                found = sorted(record_ranges(ByteRanges(file)))
            runs: list[list[tuple[int, int]]] = []
            for offset, length in found:
                if not runs or offset + length - runs[-1][0][0] > RANGE_BYTES:
                    runs.append([])
                runs[-1].append((offset, length))
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([path] * len(runs), pa.string()),
                "offsets": pa.array([[o for o, _ in r] for r in runs], pa.list_(pa.int64())),
                "lengths": pa.array([[n for _, n in r] for r in runs], pa.list_(pa.int64())),
            })


def _read_runs(batches: Iterable[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    def records():
        for batch in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_file(path) as file:
                    ranges = ByteRanges(file)
                    end = max(o + n for o, n in zip(offsets, lengths, strict=True))
                    # Records in a row are read at once; a single one may be longer than a run.
                    raw = memoryview(ranges.read(offsets[0], end - offsets[0]))
                for offset, length in zip(offsets, lengths, strict=True):
                    yield parsed(raw[offset - offsets[0] : offset - offsets[0] + length])

    yield from _rows(records(), with_payload)


def _read_whole(batches: Iterable[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    yield from _rows((r for batch in batches for content in batch.column(0) for r in iter_records(memoryview(content.as_buffer()))), with_payload)


def _reachable(path: str) -> bool:
    if path.startswith(("file:", "/")):
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except Exception:  # each store's client fails in its own way
        return False
    return True


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of every archive below ``path``; revisits have no payload of their own."""
    files = spark.read.format("binaryFile").load(path)
    if not _reachable(path):
        return files.select("content").mapInArrow(lambda batches: _read_whole(batches, with_payload), RECORD_FIELDS)
    # Without the column of contents Spark lists the files and reads none.
    runs = files.select("path").repartition("path").mapInArrow(_runs, "path string, offsets array<long>, lengths array<long>")
    dealt = runs.repartition("path", F.element_at("offsets", 1))
    return dealt.mapInArrow(lambda batches: _read_runs(batches, with_payload), RECORD_FIELDS)
