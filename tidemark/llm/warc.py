"""WARC from legacy ARC archives, and back to rows.

ARC: a file starts with a version block whose second line names the version and whose third names the fields of the
header lines; each record is a header line (version 1: URL IP-address Archive-date Content-type Archive-length;
version 2 has five fields more), that many bytes, and a line feed. WARC: each record is a block of named fields, as
many bytes as Content-Length says, and two line ends; identifiers, dates, types and digests are derived from the ARC
record, so that a task that runs again writes the same bytes.

Both kinds of archive are written by Spark's text sink to a folder that all executors share and read by Spark's
binaryFile source, so that any store that Spark reaches will do. Each record is a gzip member of its own; a task begins
a new archive, with its own first record, when the one it writes has archive_bytes of compressed bytes, whatever the size
of its partition, so that no archive is larger than that and one record (a row of the sink is a whole archive, and
maxRecordsPerFile gives each row a file; the sink's line end is a zero byte, which gzip takes as padding). Archives are
parsed as streams, by declared length; those of others may be one gzip member of up to 2 GB.

Defined results: a null payload is empty; a null id or URL stays null; blanks in a URL are percent-encoded; repeated
rows of one page_id and payload are all of the same record type; an empty table gives no records. A record whose
length or digest does not fit what is read raises ValueError: archives are never taken in part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

CRLF = b"\r\n"
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20240101000000"
#: Payload bytes that are gathered before a batch goes on.
BATCH_BYTES = 8 << 20
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 64 << 20
#: Of gzip: on pages of 4 KB level 6 takes half as much time again and saves 1 %.
LEVEL = 4


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def http_block(page_id: int | None, payload_bytes: int) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {payload_bytes}"]
    return "\r\n".join([*lines, *([] if page_id is None else [f"X-Page-Id: {page_id}"]), "", ""]).encode()


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Named fields, the header with its empty line, and the payload. A block without a status line is all payload."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return {}, b"", block
    fields = dict(x.decode("latin-1").split(": ", 1) for x in block[:end].split(CRLF)[1:] if b": " in x)
    return {k.lower(): v for k, v in fields.items()}, block[: end + 4], block[end + 4 :]


def arc_version_block(name: str, version: int = 1) -> bytes:
    body = f"{version} 0 tidemark\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain", "Archive-length": str(len(body))}
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(url: str | None, block: bytes, version: int = 1, date: str = DATE, ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    values = {"URL": "-" if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~"), "IP-address": ip, "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "-", "Archive-length": str(len(block))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block


def read_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by name, and the block, of each record but the version block."""
    fields = ARC_FIELDS[1]
    while line := stream.readline():
        if line == b"\n":
            continue
        parts = line.decode().rstrip("\n").split(" ")
        block = _exactly(stream, int(parts[-1]))
        if parts[0].startswith("filedesc://"):
            names = block.split(b"\n")[1].decode().split(" ")
            if block.split(b" ", 1)[0] not in (b"1", b"2") or names[-1] != "Archive-length":
                raise ValueError("not an ARC file of version 1 or 2")
            fields = names
            continue
        if len(parts) != len(fields):
            raise ValueError(f"an ARC header line of {len(parts)} fields, not {len(fields)}")
        yield dict(zip(fields, parts, strict=True)), block


def _exactly(stream: io.BufferedIOBase, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"{len(data)} bytes where {n} were declared")
    return data


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z" if len(date) == 14 and date.isdigit() else "1970-01-01T00:00:00Z"


def record_id(url: str | None, date: str, payload_digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {payload_digest} {page_id}')}>"


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + CRLF + CRLF


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record that does not start with its version")
        fields = {}
        while (line := stream.readline()) != CRLF:
            if not line:
                raise ValueError("a WARC header without end")
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        yield fields, _exactly(stream, int(fields["Content-Length"]))


def _archives(spark: SparkSession, path: str, parse: Callable, rows: Callable, columns: dict[str, str]) -> DataFrame:
    """What `rows` makes of each record of the archives at a path, in columns of the given types."""
    schema = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = pa.py_buffer(content.as_buffer())
                held, size = [], 0
                with gzip.open(io.BufferedReader(pa.BufferReader(data))) as stream:
                    for fields, block in parse(stream):
                        for row in rows(fields, block):
                            held.append(row)
                            size += len(block)
                        if size > BATCH_BYTES:
                            yield _batch(held, schema)
                            held, size = [], 0
                yield _batch(held, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in columns.items()))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _written(df: DataFrame, first: Callable[[bytes], bytes], record: Callable, path: str, archive_bytes: int) -> None:
    """Archives of what `record` makes of each row; each starts with what `first` makes of its first record."""
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                data = record(*(x.as_py() for x in row))
                for part in (data,) if members else (first(data), data):
                    members.append(gzip.compress(part, LEVEL, mtime=0))
                    size += len(members[-1])
                if size >= archive_bytes:
                    yield _batch([(b"".join(members),)], schema)
                    members, size = [], 0
        if members:
            yield _batch([(b"".join(members),)], schema)

    df.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, version: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """pages: page_id, url, html (a string, or bytes)."""

    def record(page_id: int | None, url: str | None, html: bytes | None) -> bytes:
        html = html or b""
        return arc_record(url, http_block(page_id, len(html)) + html, version) + b"\n"

    _written(pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary")), lambda _: arc_version_block("pages.arc", version) + b"\n", record, path, archive_bytes)


def convert(spark: SparkSession, arc: str, warc: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC archives to WARC archives. Of records with equal payloads of at least so many bytes, that with the largest id is the response and the others revisit it."""

    def named(fields: dict[str, str], block: bytes) -> tuple:
        http, _, payload = split_http(block)
        return _int(http.get("x-page-id")), digest(payload), len(payload), None if fields["URL"] == "-" else fields["URL"], fields["Archive-date"]

    def brief(fields: dict[str, str], block: bytes) -> list[tuple]:
        return [named(fields, block)]

    def full(fields: dict[str, str], block: bytes) -> list[tuple]:
        # Packed, so that the shuffle to the verdicts moves and keeps less.
        return [(*named(fields, block), fields["IP-address"], fields["Content-type"], len(block), pa.compress(block, codec="zstd", asbytes=True))]

    thin = {"page_id": "long", "digest": "string", "bytes": "long", "url": "string", "date": "string"}
    known = materialize(_archives(spark, arc, read_arc, brief, thin), "digests")
    # Equal payloads are found among thin rows; the records themselves meet their verdict by their own id.
    lead = known.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url", "date")).alias("lead"))
    verdict = known.select("page_id", "digest").distinct().join(lead, "digest").where("lead.page_id is not null and not page_id <=> lead.page_id")
    verdict = verdict.select(F.col("page_id").alias("id"), F.col("digest").alias("of"), F.col("lead.page_id").alias("lead"), F.col("lead.url").alias("lead_url"), F.col("lead.date").alias("lead_date"))
    whole = _archives(spark, arc, read_arc, full, thin | {"ip": "string", "mime": "string", "size": "long", "packed": "binary"})
    whole = whole.join(verdict, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left").drop("id", "of", "bytes")

    def record(page_id, payload_digest, url, date, ip, mime, size, packed, lead, lead_url, lead_date) -> bytes:
        http, head, payload = split_http(pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True))
        revisit, block = lead is not None, head if lead is not None else head + payload
        fields = {
            "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(url, date, payload_digest, page_id), "WARC-Date": warc_date(date), "WARC-Target-URI": url, "WARC-IP-Address": ip,
            "WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response" if head else mime,
        }
        if revisit:
            # The page id is a field of our own; the standard's fields name the same record.
            fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(lead_url, lead_date, payload_digest, lead), "WARC-Refers-To-Target-URI": lead_url, "WARC-Refers-To-Date": warc_date(lead_date), "WARC-Refers-To-Page-Id": str(lead)}
        return warc_record(fields, block)

    def info(following: bytes) -> bytes:
        fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'tidemark:warcinfo {digest(following)}')}>", "WARC-Date": warc_date(DATE), "Content-Type": "application/warc-fields"}
        return warc_record(fields, b"software: tidemark\r\nformat: WARC File Format 1.1\r\n")

    _written(whole, info, record, warc, archive_bytes)


def _int(text: str | None) -> int | None:
    return None if text is None else int(text)


def records(spark: SparkSession, warc: str) -> DataFrame:
    """The archives' response and revisit records as rows, lengths and digests checked."""

    def row(fields: dict[str, str], block: bytes) -> list[tuple]:
        if fields["WARC-Type"] not in ("response", "revisit"):
            return []
        if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError("a block that does not have its digest")
        http, _, payload = split_http(block)
        name = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and digest(payload) != name:
            raise ValueError("a payload that does not have its digest")
        size = int(http["content-length"]) if fields["WARC-Type"] == "revisit" else len(payload)
        uri = fields.get("WARC-Target-URI")
        return [(_int(http.get("x-page-id")), uri, size, name, fields["WARC-Type"], _int(fields.get("WARC-Refers-To-Page-Id")), fields["WARC-Record-ID"], fields.get("WARC-Refers-To"))]

    columns = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "record_id": "string", "refers_to_record": "string"}
    return _archives(spark, warc, read_warc, row, columns)
