"""WARC archives: writing with revisits, and a reader that salvages damaged archives.

*Writing.*  A record a page, as text files of WARC/1.1 records by Spark's own text writer, whose line separator is
the blank line pair that ends a record.  Pages with equal payloads are found by their digests; the counts are summed
before the shuffle, and the join back to the pages is the only exchange of payloads, one that Spark may split where one
payload is very common.  Archives are written as the join leaves the rows, each as one gzip member, since plain ones
take twice the pages' own space.

*Reading.*  An archive is a row of bytes; a task holds one at a time, and the writer keeps archives near
``ARCHIVE_BYTES``.  Each record is checked: version line, header lines, Content-Length, the blank line pair after it
and the payload digest.  After a failed check the reader looks, over all that is left, for the nearer of the next
version line and the next gzip member that inflates to one, goes on there, and logs the bytes between as a gap with
the reason.  So plain and compressed records may stand in one archive, and a record's payload may be compressed.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.session import materialise, remove, scratch_path, ship

VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
END = "\r\n\r\n"
#: Payloads below this size are never written as revisits.
LEAST_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20
_START = re.compile(rb"WARC/1\.[01]\r\n")
#: The end of a record's headers, or the next record's version line before it.
_HEADERS_END = re.compile(rb"\r\n\r\n|\r\n(?=WARC/1\.[01]\r\n)")
_EITHER = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


@dataclass
class Record:
    """A sound record: where it stands in the (uncompressed) archive, its headers and payload."""

    start: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    """Bytes [start, end) that were put aside, and the check that failed."""

    start: int
    end: int
    reason: str


def digest_holds(stated: str, data: bytes) -> bool:
    """Whether a digest such as ``sha1:...`` is that of some bytes: in hexadecimal of either case or in base32, as its
    length tells.  An algorithm that isn't known here, or another spelling, can't be checked and holds."""
    name, _, value = stated.strip().partition(":")
    if name.lower() not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return True
    made = hashlib.new(name.lower(), data).digest()
    value = value.strip().rstrip("=")
    if len(value) == 2 * len(made):
        return value.lower() == made.hex()
    base = base64.b32encode(made).decode().rstrip("=")
    return value.upper() == base if len(value) == len(base) else True


def _record(data: bytes, at: int) -> tuple[Record, int]:
    """The record at ``at`` and where it ends; ValueError names the failed check."""
    if not _START.match(data, at):
        raise ValueError("version line")
    found = _HEADERS_END.search(data, at + len(VERSION) - 2)
    if not found or found.end() - found.start() < 4:
        raise ValueError("headers end")
    stop = found.start()
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError("content length")
    begin, end = stop + 4, stop + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    payload = data[begin:end]
    if not digest_holds(headers.get("warc-block-digest", ""), payload):
        raise ValueError("block digest")
    # of an HTTP message the payload is a part, coded as its own headers say; a revisit's is another record's
    whole = headers.get("warc-type") in ("response", "resource", "conversion") and not headers.get("content-type", "").lower().startswith("application/http")
    if whole and not digest_holds(headers.get("warc-payload-digest", ""), payload):
        raise ValueError("payload digest")
    return Record(at, headers, payload), end + 4


def _inflate(data: memoryview, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` holds and where it ends; no end if it can't be read to it, checksum included."""
    inflate, out, step = zlib.decompressobj(31), [], 4096
    try:
        while not inflate.eof:
            if at >= len(data):
                return b"".join(out), None
            out.append(inflate.decompress(data[at : at + step]))
            at += step
            step = min(2 * step, 1 << 18)
    except zlib.error:
        return b"".join(out), None
    return b"".join(out), min(at, len(data)) - len(inflate.unused_data)


def _begins_record(data: memoryview, at: int) -> bool:
    """Whether the gzip member at ``at`` inflates to a version line at first."""
    try:
        return _START.match(zlib.decompressobj(31).decompress(data[at : at + 4096], 16)) is not None
    except zlib.error:
        return False


def _next(data: bytes, view: memoryview, at: int) -> int:
    """The next place from ``at`` on where a record may begin, or the end."""
    for hit in _EITHER.finditer(data, at):
        if data[hit.start()] != MEMBER[0] or _begins_record(view, hit.start()):
            return hit.start()
    return len(data)


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, whose records are plain or gzip members.

    A compressed record's start is that of its member, which may hold several.  Whatever fails a check is a gap up to
    the next place at which a record may begin.  Of a damaged member, whose checksum says nothing, those records count
    that another one follows.  The work is linear in the archive's size.
    """
    view, at = memoryview(data), 0
    while at < len(data):
        if data.startswith(MEMBER, at):
            plain, end = _inflate(view, at)
            inner, last = 0, None
            while inner < len(plain):
                try:
                    record, inner = _record(plain, inner)
                except ValueError as failed:
                    if last:
                        yield last
                        last = None
                    if end:
                        yield Gap(at, end, str(failed))
                    later = _START.search(plain, inner + 1)
                    inner = later.start() if later else len(plain)
                else:
                    record.start = at
                    if last:
                        yield last
                    last = record
            if last and end:
                yield last
            if not end:
                end = _next(data, view, at + 1)
                yield Gap(at, end, "gzip member")
        else:
            try:
                record, end = _record(data, at)
            except ValueError as failed:
                end = _next(data, view, at + 1)
                yield Gap(at, end, str(failed))
            else:
                yield record
        at = end


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, record (text without its final blank lines) of each page.

    Of pages with equal payloads of ``least`` bytes or more, that with the largest page_id is a response and the
    others revisit it.  Null html is an empty payload.  A page without id is a response; rows of equal id are rows of
    their own.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", payload.alias("payload")).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = base.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    shared = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "response")
    joined = base.join(shared, "digest", "left")
    revisit = (F.col("bytes") >= least) & (F.col("page_id") < F.col("response"))
    typed = joined.withColumn("refers_to", F.when(revisit, F.col("response")))
    is_revisit = F.col("refers_to").isNotNull()
    no_break = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")
    block = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    record = F.concat(
        F.lit(VERSION.decode()),
        header("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        F.when(F.col("url").isNotNull(), header("WARC-Target-URI", no_break)).otherwise(""),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(is_revisit, F.concat(header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    return typed.select("page_id", "url", record.alias("record"))


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_REVISIT, compression: str = "gzip") -> int:
    """Write archives of about ``archive_bytes`` of records each, where a partition holds so much; the number of records.

    A compressed archive is one gzip member; ``none`` leaves it plain.
    """
    size = pages.agg(F.sum(F.octet_length(F.coalesce("html", F.lit(""))) + 600).alias("bytes"), F.count("*").alias("rows")).first()
    rows = max(1, math.ceil(size["rows"] * archive_bytes / max(1, size["bytes"] or 0)))
    records(pages, least).select("record").write.option("lineSep", END).option("maxRecordsPerFile", rows).option("compression", compression).text(path)
    return size["rows"]


_FIELDS = T.StructType().add("archive", "string").add("start", "long").add("end", "long").add("reason", "string").add("record_type", "string").add("record_id", "string").add("url", "string").add("digest", "string").add("payload_bytes", "long").add("refers_to", "string").add("payload", "binary")


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record (reason null) and for each gap (start, end, reason) of the archives under ``path``."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, content = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                rows, held = [], 0
                for item in read_archive(content):
                    row = dict.fromkeys(_FIELDS.names) | {"archive": name, "start": item.start}
                    if isinstance(item, Gap):
                        row |= {"end": item.end, "reason": item.reason}
                    else:
                        h = item.headers
                        revisit = h.get("warc-type") == "revisit"
                        row |= {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "url": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to")}
                        row |= {"digest": h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(item.payload).hexdigest()}
                        row |= {"payload_bytes": int(h.get("x-payload-length") or 0) if revisit else len(item.payload), "payload": item.payload if with_payload else None}
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    types = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in _FIELDS])
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, _FIELDS)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from its archive.

    The archives are removed once they have been read.  A gap in them, or a page that doesn't come back, is an error.
    Null html is an empty payload; null ids, repeated rows, very long pages and an empty table are no error.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    written = write(pages, path, archive_bytes, least)
    found = materialise(read(spark, path).drop("payload"), "warc-read")
    remove(spark, path)
    back = found.agg(F.count_if(F.col("reason").isNull()).alias("records"), F.count_if(F.col("reason").isNotNull()).alias("gaps"), F.any_value("reason", F.lit(True)).alias("reason")).first()
    if back["gaps"] or back["records"] != written:
        raise ValueError(f"{written} records written, {back['records']} read, {back['gaps']} gaps ({back['reason']})")
    number = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1)
    target = F.regexp_extract(F.coalesce("refers_to", F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.when(number != "", number).cast(kind).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.when(target != "", target).cast(kind).alias("refers_to"),
    )
