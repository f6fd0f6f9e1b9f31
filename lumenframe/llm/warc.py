"""Legacy archive converter: ARC 1 and 2 to WARC 1.1, with revisit records for equal payloads.

An ARC file begins with a version block, whose second line tells the version and third the
fields of the header lines; each record is a header line, so many bytes as its last field
declares, and a newline. Versions 1 and 2 differ in the fields between the type and the length.
Of each record the converter makes a WARC record: its identifier from the record's content
(so that a second conversion gives the same), its date from the 14 digits, its type response or
revisit, and its SHA-256 payload digest.

Archives are written by Spark's text writer with the record separator as line separator, and
read as whole files that are unpacked as a stream, so a task holds one packed file and a few
records. A file is as large as the partition it is written from.

Defined results: a null payload is empty, a null url is "-", white space in urls is escaped; a
null id stays null; of equal payloads the record with the smallest id (nulls last, then the
smallest identifier) is the response, and rows that repeat it in full are responses too; other
columns are ignored; no rows give archives without records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import LEAST_HOT, join_by_counts, prepared, released, shared_folder, written

#: The header fields of each version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
LEAST_BYTES = 100
BATCH_BYTES = 4 << 20
BROADCAST_DIGESTS = 100_000
#: Records of an archive at most, so that one stays far below what a binary value can hold.
ARCHIVE_RECORDS = 10_000


def _write_archives(rows: DataFrame, head: bytes, record: Column, end: str, path: str, records: int) -> None:
    """Archives of so many records, each after head: the writer begins a file after that many, whatever the session says."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    value = F.when(place % records == 0, F.concat(F.lit(head), record)).otherwise(record)
    rows.select(value.cast("string").alias("value")).write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _utf8(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary")


def write_arc(pages: DataFrame, path: str, version: int, records: int = ARCHIVE_RECORDS) -> None:
    """Writes pages (page_id, url, html) as ARC files of the version; the id travels in an HTTP header."""
    fields = ARC_FIELDS[version]
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    url = F.regexp_replace(F.coalesce(F.when(F.col("url") == "", None).otherwise(F.col("url")), F.lit("-")), r"\s", "%20")
    number = F.when(F.col("page_id").isNull(), "").otherwise(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")))
    http = _utf8("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n", number, "Content-Length: ", F.octet_length(payload).cast("string"), "\r\n\r\n")
    date = F.date_format(F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(100_000_000))), "yyyyMMddHHmmss")
    middle = "" if version == 1 else " 200 - - 0 pages.arc"
    line = _utf8(url, " 0.0.0.0 ", date, " text/html", middle, " ", F.octet_length(F.concat(http, payload)).cast("string"), "\n")
    about = f"{version} 0 lumenframe\n{' '.join(fields)}\n"
    head = f"filedesc://pages.arc 0.0.0.0 20200101000000 text/plain{middle} {len(about)}\n{about}\n"
    _write_archives(pages, head.encode(), F.concat(line, http, payload), "\n", path, records)


def arc_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and network document of each record, the version block left out."""
    fields: tuple[str, ...] = ()
    while line := file.readline():
        line = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not line:
            continue
        if line.startswith("filedesc://"):
            length = int(line.rsplit(" ", 1)[1])
            about = file.read(length)
            version = int(about.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} isn't known")
            fields = ARC_FIELDS[version]
            continue
        if not fields:
            raise ValueError("an ARC file must begin with its version block")
        parts = line.rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields):
            raise ValueError(f"an ARC header line lacks fields: {line[:200]}")
        head = dict(zip(fields, parts, strict=True))
        block = file.read(int(head["Archive-length"]))
        if len(block) != int(head["Archive-length"]):
            raise ValueError("an ARC record ends before its declared length")
        yield head, block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; a block without HTTP header is all payload."""
    if block.startswith(b"HTTP/"):
        at = block.find(b"\r\n\r\n")
        if at >= 0:
            return block[: at + 4], block[at + 4 :]
    return b"", block


def http_field(header: bytes, name: bytes) -> str | None:
    for line in header.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


_CONVERTED = "page_id long, url string, ip string, date string, mime string, http binary, payload binary, n_bytes long, digest string, record_id string"


def _convert(with_payload: bool):
    names = [x.split()[0] for x in _CONVERTED.split(", ")]

    def row(head: dict[str, str], block: bytes) -> tuple:
        http, payload = split_http(block)
        digest = hashlib.sha256(payload).hexdigest()
        page = http_field(http, b"x-page-id")
        d = head["Archive-date"]
        date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        name = uuid.uuid5(NAMESPACE, "\n".join((head["URL"], d, page or "", digest)))
        kept = (http, payload) if with_payload else (None, None)
        return int(page) if page else None, head["URL"], head["IP-address"], date, head["Content-type"], *kept, len(payload), digest, f"urn:uuid:{name}"

    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, _CONVERTED.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block in arc_records(unpacked(content.as_py())):
                    rows.append(row(head, block))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def unpacked(content: bytes) -> BinaryIO:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _files(spark, *paths: str) -> DataFrame:
    prepared(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(paths)).select("content")


def read_arc(spark, *paths: str, with_payload: bool = True) -> DataFrame:
    """A row for each ARC record, with what its WARC record needs."""
    return _files(spark, *paths).mapInArrow(released(_convert(with_payload)), _CONVERTED)


def arc_to_warc(spark, arc_paths: list[str], path: str, least_bytes: int = LEAST_BYTES, records: int = ARCHIVE_RECORDS, most: int = BROADCAST_DIGESTS, least_hot: int = LEAST_HOT) -> None:
    """Converts ARC files to WARC files."""
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url", "date")
    light = read_arc(spark, *arc_paths, with_payload=False).where(F.col("n_bytes") >= least_bytes)
    firsts = written(light.groupBy("digest").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1"), "payloads")
    rows = read_arc(spark, *arc_paths)
    # beyond a bounded number of digests, one that a third of all pages may share is still broadcast
    rows = rows.join(F.broadcast(firsts.drop("n")), "digest", "left") if firsts.limit(most + 1).count() <= most else join_by_counts(rows, firsts, ["digest"], "left", least_hot)
    revisit = F.col("first").isNotNull() & (F.col("n_bytes") >= least_bytes) & (F.col("first.record_id") != F.col("record_id"))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    page = F.when(F.col("page_id").isNull(), "").otherwise(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")))
    refers = F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <"), F.col("first.record_id"), F.lit(">\r\nWARC-Refers-To-Target-URI: "), F.col("first.url"), F.lit("\r\nWARC-Refers-To-Date: "), F.col("first.date"), F.lit("\r\nX-Refers-To-Page-Id: "), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    kind = F.when(F.octet_length("http") > 0, "application/http; msgtype=response").otherwise(F.col("mime"))
    head = _utf8(
        "WARC/1.1\r\nWARC-Type: ", F.when(revisit, "revisit").otherwise("response"), "\r\nWARC-Record-ID: <", F.col("record_id"), ">\r\nWARC-Date: ", F.col("date"), "\r\nWARC-Target-URI: ", F.col("url"),
        "\r\nWARC-IP-Address: ", F.col("ip"), "\r\nWARC-Payload-Digest: sha256:", F.col("digest"), "\r\n", F.when(revisit, refers).otherwise(""), page, "Content-Type: ", kind, "\r\nContent-Length: ", F.octet_length(block).cast("string"), "\r\n\r\n",
    )
    about = b"software: lumenframe\r\nformat: WARC File Format 1.1\r\n"
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, 'warcinfo')}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n".encode()
    _write_archives(rows, info + about + b"\r\n\r\n", F.concat(head, block), "\r\n\r\n", path, records)


def warc_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a WARC record must begin with its version, not {line[:60]!r}")
        head: dict[str, str] = {}
        while (line := file.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        n = int(head["content-length"])
        block = file.read(n)
        if len(block) != n:
            raise ValueError("a WARC record ends before its declared length")
        yield head, block


_READ = "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, sound boolean"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in _READ.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for head, block in warc_records(unpacked(content.as_py())):
                kind = head["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                http, payload = split_http(block)
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                declared = http_field(http, b"content-length")
                n = len(payload) if kind == "response" else int(declared or 0)
                sound = kind == "revisit" or (hashlib.sha256(payload).hexdigest() == digest and (declared is None or int(declared) == n))
                rows.append((int(page) if page else None, head.get("warc-target-uri"), head["warc-record-id"].strip("<>"), kind, n, digest, int(refers) if refers else None, sound))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_warc(spark, *paths: str) -> DataFrame:
    """A row for each response or revisit record; sound tells whether its payload has the digest it declares."""
    return _files(spark, *paths).mapInArrow(released(_read), _READ)


def op4_warc_convert(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arc, warc = [shared_folder(spark, f"arc{v}") for v in ARC_FIELDS], shared_folder(spark, "warc")
    for version, path in zip(ARC_FIELDS, arc, strict=True):
        older = F.pmod(F.xxhash64("page_id"), F.lit(2)) == version - 1
        write_arc(pages.where(older), path, version)
    arc_to_warc(spark, arc, warc)
    found = read_warc(spark, warc)
    checked = F.when(F.col("sound"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("a payload doesn't have its digest: "), F.col("record_id"))))
    return found.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")
