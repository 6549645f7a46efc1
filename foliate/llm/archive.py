"""Legacy web archives: ARC records of versions 1 and 2 parsed and rewritten as WARC records, files of them read back."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import cut, file_system, new_folder, rows_of, write_file

#: Names of the fields of a record's header line, by the archive's version. Fixed values of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000

#: Up to so many rows that repeat a payload go to every executor; more are joined by shuffle.
BROADCAST_ROWS = 200_000

#: A file is closed beyond so many bytes, and a piece of one that a task reads is about so long.
FILE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20

#: The HTTP header that carries a row's id through the archive.
ROW_HEADER = "X-Archive-Row"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    result_code: str | None = None
    checksum: str | None = None


def arc_start(version: int, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An archive's first record: its version block, which names the fields of later header lines."""
    body = f"{version} 0 foliate\n{FIELDS[version]}\n\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body


def arc_record(record: ArcRecord, version: int, offset: int, name: str = "pages.arc") -> bytes:
    extra = "" if version == 1 else f"{record.result_code or '-'} {record.checksum or '-'} - {offset} {name} "
    line = f"{record.url} {record.ip} {record.date} {record.content_type} {extra}{len(record.block)}\n"
    return line.encode() + record.block + b"\n"


def read_arc(stream) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block, as that block's version says.

    Header lines are read from the right, so that blanks in a URL do no harm. A declared length beyond the file's end,
    an unknown version or a short header line raises ValueError.
    """
    version = None
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if version is None:
            length = int(text.rsplit(" ", 1)[1])
            body = stream.read(length)
            version = int(body.split(b" ", 1)[0] or 0) if len(body) == length else 0
            if version not in FIELDS:
                raise ValueError(f"not an archive of a known version: {text[:80]}")
            continue
        count = len(FIELDS[version].split())
        parts = text.rsplit(" ", count - 1)
        if len(parts) < count or not parts[-1].isdigit():
            raise ValueError(f"header line of {len(parts)} fields, version {version} has {count}: {text[:80]}")
        block = stream.read(int(parts[-1]))
        if len(block) < int(parts[-1]):
            raise ValueError(f"{parts[-1]} bytes declared, {len(block)} there: {text[:80]}")
        code, checksum = parts[4:6] if version == 2 else (None, None)
        yield ArcRecord(*parts[:4], block, code, checksum)


def record_id(row: int | None, digest: str, *else_from: str) -> str:
    """A record's URN. A row's id and the start of its payload's SHA-1 (hex) stand inside the UUID (version 8, custom bits),
    so that the id can be read from there, and rows of one id with different payloads have records of their own."""
    if row is None:
        return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((digest, *else_from)))}"
    bits = row & (1 << 64) - 1
    return f"urn:uuid:{uuid.UUID(int=int(digest[:12], 16) << 80 | 8 << 76 | (bits >> 62) << 64 | 2 << 62 | bits & (1 << 62) - 1)}"


def row_of_id(urn: str) -> int:
    value = uuid.UUID(urn.rpartition(":")[2]).int
    bits = (value >> 64 & 3) << 62 | value & (1 << 62) - 1
    return bits - (1 << 64) if bits >> 63 else bits


def digest_header(data: bytes) -> str:
    return f"sha1:{base64.b32encode(hashlib.sha1(data).digest()).decode()}"


def convert(record: ArcRecord, refers_to: int | None = None) -> bytes:
    """An ARC record as a WARC 1.1 record with identifiers, timestamp, type and digests of its own.

    HTTP messages become `response`, other blocks `resource`. refers_to: the row whose record has the same payload;
    then the record is a `revisit`, with the HTTP head alone.
    """
    http = record.block.startswith(b"HTTP/")
    head, gap, payload = record.block.partition(b"\r\n\r\n") if http else (b"", b"", record.block)
    found = re.search(rb"(?im)^" + ROW_HEADER.encode() + rb":\s*(-?\d+)\s*$", head) if http else None
    stamp = record.date.ljust(14, "0")[:14]
    block = head + gap if refers_to is not None else record.block
    digest = hashlib.sha1(payload).hexdigest()
    headers = {
        "WARC-Type": "revisit" if refers_to is not None else "response" if http else "resource",
        "WARC-Record-ID": f"<{record_id(int(found[1]) if found else None, digest, record.url, record.date, digest_header(record.block))}>",
        "WARC-Date": f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z",
        "WARC-Target-URI": record.url,
        "WARC-IP-Address": record.ip,
        "Content-Type": "application/http; msgtype=response" if http else record.content_type,
        "WARC-Payload-Digest": digest_header(payload),
        "WARC-Block-Digest": digest_header(block),
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{record_id(refers_to, digest)}>"}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return text.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record in gzip members that stand in a row; checks lengths and digests."""
    while data:
        inflate = zlib.decompressobj(31)
        text = inflate.decompress(data) + inflate.flush()
        data = inflate.unused_data
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = int(headers["content-length"])
        block = rest[:length]
        if rest[length:] != b"\r\n\r\n" or digest_header(block) != headers["warc-block-digest"]:
            raise ValueError(f"damaged record {headers.get('warc-record-id')}")
        yield headers, block


def page_to_arc(page_id: int | None, url: str | None, payload: bytes, date: str = "20240101000000") -> ArcRecord:
    """A page as it stands in an old archive: its HTTP answer. Blanks and line ends in a URL are percent-coded."""
    address = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "urn:none")
    row = b"" if page_id is None else f"{ROW_HEADER}: {page_id}\r\n".encode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + row + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    return ArcRecord(address, "0.0.0.0", date, "text/html", head + payload, "200", hashlib.sha1(payload).hexdigest())


def convert_archive(archive: bytes, refers_to: Iterable[int | None]) -> Iterator[bytes]:
    """The WARC records of an ARC file; refers_to: for each of its records in turn."""
    for record, target in zip(read_arc(io.BytesIO(archive)), refers_to, strict=True):
        yield convert(record, target)


def with_targets(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with refers_to: of rows with equal payloads of LEAST_REVISIT bytes or more, the largest
    page_id for all others. Digests meet first, as narrow rows summed before they move. Texts don't move at all unless more
    than BROADCAST_ROWS rows repeat a payload; then they move once, by page_id."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    narrow = pages.select("page_id", F.sha1(payload).alias("digest")).filter(F.octet_length(payload) >= LEAST_REVISIT)
    largest = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    again = narrow.distinct().join(largest, "digest").filter((F.col("page_id") < F.col("refers_to")) | F.col("page_id").isNull() & F.col("refers_to").isNotNull())
    again = cut(again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to"))
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    return rows.join(again, rows.page_id.eqNullSafe(again.again_id) & (rows.digest == again.again_digest), "left").select("page_id", "url", "html", "refers_to")


MANIFEST = "file string, at long, size long, records long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a WARC record for each row of pages through ARC records of both versions; a row for each piece of a file.

    Null html is an empty payload, a null url `urn:none`; repeated rows get a record each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        chunks: list[list[int]] = []  # at, size, records

        def flush() -> pa.RecordBatch:
            file = write_file(folder, f"part-{part:06d}-{number:04d}.warc.gz", parts)
            return pa.RecordBatch.from_arrays([pa.array([file] * len(chunks), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*chunks, strict=True))], names=["file", "at", "size", "records"])

        for k, batch in enumerate(rows_of(batches, 200, "html")):
            version = 1 + (part + k) % 2
            rows = batch.to_pylist()
            archive = io.BytesIO()
            archive.write(arc_start(version))
            for row in rows:
                archive.write(arc_record(page_to_arc(row["page_id"], row["url"], (row["html"] or "").encode()), version, archive.tell()))
            for record in convert_archive(archive.getvalue(), [row["refers_to"] for row in rows]):
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = packer.compress(record) + packer.flush()
                if not chunks or chunks[-1][1] >= CHUNK_BYTES:
                    chunks.append([chunks[-1][0] + chunks[-1][1] if chunks else 0, 0, 0])
                chunks[-1][1] += len(data)
                chunks[-1][2] += 1
                parts.append(data)
            if chunks and chunks[-1][0] + chunks[-1][1] >= FILE_BYTES:
                yield flush()
                parts, chunks, number = [], [], number + 1
        if chunks:
            yield flush()

    return cut(with_targets(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).mapInArrow(run, MANIFEST))


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of write_archives' files: RECORDS. Revisits have a null payload; digests of others are computed anew."""
    spark = manifest.sparkSession
    pieces = manifest.select("file", "at", "size")
    tasks = max(1, min(pieces.count(), 4 * spark.sparkContext.defaultParallelism + pieces.count() // 16))

    def record(headers: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
        kind, row = headers["warc-type"], fields.get(ROW_HEADER.lower())
        digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
        if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} doesn't agree with its digest")
        refers_to = row_of_id(headers["warc-refers-to"].strip("<>")) if kind == "revisit" else None
        return (None if row is None else int(row), int(fields["content-length"]), digest, kind, refers_to, headers["warc-target-uri"], None if kind == "revisit" else payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (row for batch in batches for row in batch.to_pylist()):
            system, path = file_system(piece["file"])
            with system.open_input_file(path) as stream:
                stream.seek(piece["at"])
                data = stream.read(piece["size"])
            made = [record(*r) for r in read_warc(data)]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return pieces.repartition(tasks).mapInArrow(run, RECORDS)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """write_archives to a new folder in the shared one (or to `folder`), then read_archives: RECORDS of each row of pages.

    Null html is an empty payload of 0 bytes, payloads of any size are written whole; rows that repeat an id and a payload
    are the same record as often as they are there; other columns of pages are left out; an empty table writes nothing.
    """
    return read_archives(write_archives(pages, folder or new_folder(pages.sparkSession, "warc")))
