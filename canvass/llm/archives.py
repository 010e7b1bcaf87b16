"""Web archives: legacy ARC files to WARC files, and reading WARC files back.

ARC: a file begins with a version block that names the version (1 or 2) and the
fields of every record's header line; a record is that line, then exactly as
many bytes as the line's last field declares. The line is split by the fields
that the block names, from the right, as old URLs may hold spaces. WARC records
get what ARC lacks: an identifier (a UUID from the record's own fields, so a
task that runs again writes the same), an ISO timestamp, a record type and
digests of payload and block.

Files are written by Spark's text writer (record separator as line separator,
gzip) and read whole by ``binaryFile``; a file holds at most
``RECORDS_PER_FILE`` records. Both work on any file system Spark reads.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, shared_path

RECORDS_PER_FILE = 8192
#: Payloads from this size on are written once; later records refer to the first.
LEAST_REVISIT_BYTES = 100

#: Fields of an ARC header line by version, as the format fixes them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

_ARC_ROW = "arc_version int, url string, ip string, date string, mime string, page_id long, head string, payload_bytes long, payload_digest string"
_WARC_ROW = "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to_id string"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


# --- writing ARC -------------------------------------------------------------

def _version_block(version: int) -> str:
    body = f"{version} 0 canvass\n{ARC_FIELDS[version]}\n"
    return f"filedesc://pages.arc 0.0.0.0 20000101000000 text/plain {len(body)}\n{body}"


def _arc_record(version: int, page_id: int | None, url: str | None, html: bytes) -> bytes:
    url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "-"
    date = (datetime(2000, 1, 1) + timedelta(seconds=(page_id or 0) % 10**8)).strftime("%Y%m%d%H%M%S")
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html)}\r\n\r\n".encode() + html
    more = "" if version == 1 else "200 - - 0 pages.arc "
    return f"{url} 0.0.0.0 {date} text/html {more}{len(body)}\n".encode() + body


def _arc_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in chunks(batches, "html"):
        lines = []
        for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            version = 1 + (part + n // RECORDS_PER_FILE) % 2
            if n % RECORDS_PER_FILE == 0:
                lines.append(_version_block(version).encode())
                n += 1
            lines.append(_arc_record(version, page_id, url, (html or "").encode()))
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], ["value"])


def write_arc(pages: DataFrame, path: str) -> None:
    """Write (page_id, url, html) as ARC files of version 1 and 2; a null html is
    empty, a null url is ``-``, a null page_id leaves its header line out."""
    lines = pages.select("page_id", "url", "html").mapInArrow(_arc_lines, "value string")
    _write(lines, path, "\n")


def _write(lines: DataFrame, path: str, end: str) -> None:
    (lines.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


# --- reading -----------------------------------------------------------------

def _opened(content: bytes):
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(version, header fields, bytes) of each record of an ARC file but the
    version block. Empty lines between records are skipped. A header line
    without its fields or without a length, or a record shorter than declared,
    ends the file: what follows has no known start."""
    file = _opened(content)
    version, names = 1, ARC_FIELDS[1].split(" ")
    while line := file.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        fields = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if line.startswith(b"filedesc://"):
            fields = line.decode("utf-8", "replace").split(" ")
        if len(fields) < 2 or not fields[-1].isdigit():
            return
        body = file.read(int(fields[-1]))
        if len(body) < int(fields[-1]):
            return
        if line.startswith(b"filedesc://"):
            told = body.decode("utf-8", "replace").split("\n")
            version = int(told[0].split(" ")[0])
            names = told[1].rstrip("\r").split(" ") if len(told) > 1 and told[1] else ARC_FIELDS[version].split(" ")
        elif len(fields) == len(names):
            yield version, dict(zip(names, fields)), body
        else:
            return


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its empty line, and payload; all payload if it isn't HTTP."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (b"", block) if end < 0 else (block[:end + 4], block[end + 4:])


def _field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + name + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode("utf-8", "replace") if m else None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None


def _arc_rows(keep_payload: bool):
    def rows(batches):
        schema = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        names = [x.split(" ")[0] for x in _ARC_ROW.split(", ")]
        if keep_payload:
            schema, names = [*schema, pa.binary()], [*names, "payload"]

        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema)], names)

        for batch in batches:
            for content in batch.column("content"):
                out, size = [], 0
                for version, f, block in arc_records(content.as_py()):
                    head, payload = _split_http(block)
                    row = (version, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], _number(_field(head, b"X-Page-Id")),
                           head.decode("utf-8", "replace"), len(payload), hashlib.sha256(payload).hexdigest())
                    out.append((*row, payload) if keep_payload else row)
                    size += 200 + keep_payload * len(payload)
                    if size > CHUNK_BYTES:
                        yield flush(out)
                        out, size = [], 0
                if out:
                    yield flush(out)
    return rows


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per ARC record: version, header fields, the HTTP header and its
    page_id (null if it has none), size and SHA-256 of the payload, and the
    payload itself if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_arc_rows(payload), _ARC_ROW + ", payload binary" * payload)


# --- ARC to WARC -------------------------------------------------------------

def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Write the ARC files as WARC files.

    Of records with equal payloads of at least ``LEAST_REVISIT_BYTES`` that with
    the smallest page_id is written whole, the others as ``revisit`` records
    that refer to it (HTTP header only). Records with that same page_id (a
    repeated row) are written whole too; a null page_id counts as the largest.
    Records without an HTTP header are of type ``resource``.
    """
    first = (
        read_arc(spark, arc_path, payload=False).where(F.col("payload_bytes") >= LEAST_REVISIT_BYTES)
        .groupBy("payload_digest").agg(
            F.count("*").alias("n"),
            F.min(F.struct(F.isnull("page_id").alias("none"), "page_id", "url", "date")).alias("first"))
        .where("n > 1").select("payload_digest", "first"))
    records = read_arc(spark, arc_path).join(first, "payload_digest", "left")

    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    kind = (F.when(revisit, "revisit").when(F.length("head") > 0, "response").otherwise("resource"))
    block = F.when(revisit, F.col("head").cast("binary")).otherwise(F.concat(F.col("head").cast("binary"), F.col("payload")))
    lines = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: "), _record_id("page_id", "url", "date"),
        F.lit("\r\nWARC-Date: "), _iso("date"),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-IP-Address: "), F.col("ip"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2("block", 256),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            _record_id("first.page_id", "first.url", "first.date"),
            F.lit("\r\nWARC-Refers-To-Target-URI: "), F.col("first.url"),
            F.lit("\r\nWARC-Refers-To-Date: "), _iso("first.date"))).otherwise(""),
        F.lit("\r\nContent-Type: "), F.when(kind == "resource", F.col("mime")).otherwise("application/http; msgtype=response"),
        F.lit("\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    out = records.withColumn("block", block).select(F.concat(lines.cast("binary"), F.col("block")).cast("string").alias("value"))
    _write(out, warc_path, "\r\n\r\n")


def _record_id(page_id: str, url: str, date: str):
    of = F.concat_ws("\n", F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.col(url), F.col(date))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(of.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _iso(date: str):
    """ARC's 14 digits as an ISO timestamp (a shorter date is padded with zeros)."""
    return F.regexp_replace(F.rpad(F.col(date), 14, "0"), "^(.{4})(.{2})(.{2})(.{2})(.{2})(.{2})$", "$1-$2-$3T$4:$5:$6Z")


def warc_records(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC file, by the declared lengths; a
    record without a length or shorter than declared ends the file."""
    file = _opened(content)
    while line := file.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            return
        head = []
        while (line := file.readline()) not in (b"", b"\r\n", b"\n"):
            head.append(line)
        head = b"".join(head)
        length = _number(_field(head, b"Content-Length"))
        if length is None or len(block := file.read(length)) < length:
            return
        yield head, block


def _warc_rows(batches):
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split(" ")[0] for x in _WARC_ROW.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for head, block in warc_records(content.as_py()):
                kind = _field(head, b"WARC-Type")
                http, payload = _split_http(block)
                if kind == "revisit":
                    size, digest = _number(_field(http, b"Content-Length")), (_field(head, b"WARC-Payload-Digest") or "").removeprefix("sha256:")
                else:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                out.append((_field(head, b"WARC-Record-ID"), kind, _number(_field(http, b"X-Page-Id")), size, digest, _field(head, b"WARC-Refers-To")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record: identifier, type, page_id, size and SHA-256 of
    the full payload (a revisit's from its headers), and the identifier it refers to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_warc_rows, _WARC_ROW)


def resolve(records: DataFrame) -> DataFrame:
    """``read_warc`` rows with refers_to: the page_id of the record referred to."""
    whole = (records.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("_whole_id"))
             .agg(F.min("page_id").alias("refers_to")))
    # what refers to nothing gets a key of its own that no record has: null keys would meet in one task
    key = F.coalesce("refers_to_id", F.concat(F.lit("none "), "record_id"))
    return records.withColumn("_key", key).join(whole, F.col("_key") == F.col("_whole_id"), "left").drop("_key", "_whole_id")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as ARC files, convert those to WARC files, read them back."""
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return resolve(read_warc(spark, warc))
