"""WARC records in ZIP archives: written by Spark tasks, read back through the archives' own directories.

Archive: a ZIP of two stored members, data.warc.gz (each record a gzip member of its own) and index.cdxj (a line per
record: page, offset and length within data.warc.gz). Sizes and offsets over 4 GB take ZIP64 fields.

Reader (`ZipReader`): finds the end-of-central-directory record, follows the ZIP64 locator if there is one, parses
the central directory, locates stored members through their local headers, and reads byte ranges of them; nothing is
extracted. It needs only a function read(start, end), so files, object stores and bytes all serve.

Records: of pages with equal payloads of at least `revisit_from` bytes, that with the smallest page_id is a response,
the others revisit it and carry no payload but its digest and WARC-Refers-To; smaller payloads are all responses.

Archives go through Spark's own writer (one text row per file, bytes unchanged; the line feed that it appends is the
archive's declared ZIP comment), so they land wherever Spark can write. A task holds one archive of about
`archive_bytes` at a time, or one record if that is larger.

Defined results: null html is the empty payload; rows that repeat the smallest page_id of a payload are all
responses; a null page_id counts as larger than all others; other columns are ignored. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.llm.common import by_value, materialise, scratch_path

by_value(__name__)

ARCHIVE_BYTES = 8 << 20
#: So many digests (about 100 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 300_000
REVISIT_FROM = 0
#: Fixed values of the ZIP format: signatures, and the marks that stand for "see the ZIP64 field".
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "data.warc.gz", "index.cdxj"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without payload."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    size = int(headers["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": http, "payload": payload}


def zip64_extra(*values: int) -> bytes:
    large = [v for v in values if v >= FULL32]
    return struct.pack("<HH", 1, 8 * len(large)) + b"".join(struct.pack("<Q", v) for v in large) if large else b""


def zip_bytes(members: list[tuple[str, bytes]], comment: bytes = b"", force64: bool = False) -> bytes:
    """A ZIP of stored members."""
    out, central = [], []
    at = 0
    short = lambda v: FULL32 if v >= FULL32 or force64 else v
    for name, data in members:
        crc, n, raw = zlib.crc32(data), len(data), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, n, n) if n >= FULL32 or force64 else b""
        local = struct.pack("<4s5H3I2H", LOCAL, 45, 0x800, 0, 0, 33, crc, short(n), short(n), len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if force64 else zip64_extra(n, n, at)
        central.append(struct.pack("<4s6H3I5H2I", CENTRAL, 45, 45, 0x800, 0, 0, 33, crc, short(n), short(n), len(raw), len(extra), 0, 0, 0, 0, short(at)) + raw + extra)
        out += [local, data]
        at += len(local) + n
    directory = b"".join(central)
    out.append(directory)
    if force64 or at >= FULL32 or len(directory) >= FULL32 or len(members) >= FULL16:
        out.append(struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, len(members), len(members), len(directory), at))
        out.append(struct.pack("<4sIQI", LOCATOR64, 0, at + len(directory), 1))
    count = FULL16 if force64 else min(len(members), FULL16)
    out.append(struct.pack("<4s4H2IH", END, 0, 0, count, count, short(len(directory)), short(at), len(comment)))
    return b"".join(out) + comment


class ZipReader:
    """Stored members of a ZIP, by ranges. read(start, end) gives bytes; size is the archive's length."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read, self.size = read, size
        self.members = {m["name"]: m for m in self._directory()}

    def _end(self) -> tuple[int, int, int]:
        """Number of members, size and offset of the central directory."""
        span = min(self.size, FULL16 + 22)
        tail = self.read(self.size - span, self.size)
        at = len(tail)
        while (at := tail.rfind(END, 0, at)) >= 0:
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, count, length, start = struct.unpack_from("<4H2I", tail, at + 4)
        where = self.size - span + at
        if FULL16 == count or FULL32 in (length, start):
            locator = self.read(where - 20, where) if where >= 20 else b""
            if locator[:4] == LOCATOR64:
                (at64,) = struct.unpack_from("<Q", locator, 8)
                end64 = self.read(at64, at64 + 56)
                if end64[:4] != END64:
                    raise ValueError("the ZIP64 locator points elsewhere")
                count, length, start = struct.unpack_from("<3Q", end64, 32)
        return count, length, start

    def _directory(self) -> Iterator[dict]:
        count, length, start = self._end()
        raw, at = self.read(start, start + length), 0
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", raw, at + 10)[0]
            crc, packed, size, n_name, n_extra, n_comment = struct.unpack_from("<3I3H", raw, at + 16)
            (offset,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = wide.pop(0) if size == FULL32 else size
                    packed = wide.pop(0) if packed == FULL32 else packed
                    offset = wide.pop(0) if offset == FULL32 else offset
                extra = extra[4 + n :]
            yield {"name": name, "method": method, "size": size, "packed": packed, "offset": offset, "crc": crc}
            at += 46 + n_name + n_extra + n_comment

    def start_of(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if m["method"]:
            raise ValueError(f"{name} is not stored")
        head = self.read(m["offset"], m["offset"] + 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        return m["offset"] + 30 + sum(struct.unpack_from("<HH", head, 26))

    def range(self, name: str, start: int, end: int) -> bytes:
        if not 0 <= start <= end <= self.members[name]["size"]:
            raise ValueError(f"range outside {name}")
        base = self.start_of(name)
        return self.read(base + start, base + end)


def records_of(archive: ZipReader) -> Iterator[tuple[dict, dict]]:
    """Index line and parsed record of every record, by range reads."""
    for line in archive.range(INDEX, 0, archive.members[INDEX]["size"]).decode().splitlines():
        entry = json.loads(line)
        yield entry, parse_record(gzip.decompress(archive.range(DATA, entry["offset"], entry["offset"] + entry["length"])))


def packer(archive_bytes: int, appended: bytes):
    """Rows page_id, url, html, refers_to, revisit to archives, each without the bytes that the writer appends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index, at = [], [], 0

        def archive() -> pa.RecordBatch:
            raw = zip_bytes([(DATA, b"".join(data)), (INDEX, "\n".join(index).encode())], appended)
            raw = raw[: len(raw) - len(appended)]
            return pa.RecordBatch.from_arrays([pa.array([raw], type=pa.binary())], names=["archive"])

        for batch in batches:
            cols = [batch.column(n) for n in ("page_id", "url", "html", "refers_to", "revisit")]
            for row in range(batch.num_rows):
                page, url, html, refers, revisit = (c[row].as_py() for c in cols)
                raw = gzip.compress(record_bytes(page, url, (html or "").encode(), refers, revisit), compresslevel=4, mtime=0)
                index.append(json.dumps({"page_id": page, "offset": at, "length": len(raw), "type": "revisit" if revisit else "response"}))
                data.append(raw)
                at += len(raw)
                if at >= archive_bytes:
                    yield archive()
                    data, index, at = [], [], 0
        if data:
            yield archive()

    return run


def with_revisits(pages: DataFrame, revisit_from: int) -> DataFrame:
    """page_id, url, html, refers_to, revisit."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # only digests that come twice are looked up, so pages move with their payload only where these are too many to broadcast
    shared = rows.where(F.octet_length("html") >= revisit_from).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").select("digest", "first")
    shared = materialise(shared, "shared")
    joined = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> None:
    packed = with_revisits(pages, revisit_from).mapInArrow(packer(archive_bytes, b"\n"), "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def page_of(uri: str | None) -> int | None:
    return int(uri[len("<urn:page:") : -1]) if uri else None


def reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("content"):
                raw = cell.as_buffer()
                view = memoryview(raw)
                rows: list[dict] = []
                for entry, record in records_of(ZipReader(lambda a, b, view=view: bytes(view[a:b]), len(view))):
                    h = record["headers"]
                    size = int(dict(x.split(": ", 1) for x in record["http"].decode().split("\r\n")[1:])["Content-Length"])
                    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(record["payload"]) != size or sha1_base32(record["payload"]) != digest):
                        raise ValueError(f"page {entry['page_id']}: the payload is not what its digest says")
                    rows.append({"page_id": entry["page_id"], "url": h["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(h.get("warc-refers-to")), "payload": record["payload"] if with_payload and kind == "response" else None})
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=READ)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives under path: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (of responses, if asked for)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(reader(with_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of all pages into the shared folder and reads them back, without payloads."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, revisit_from, archive_bytes)
    return read_archives(spark, path).drop("payload")
