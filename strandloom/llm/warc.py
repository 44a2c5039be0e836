"""Content-addressed WARC archive: payload bytes stored once by digest, record headers apart.

An archive is a folder of two Parquet tables. ``headers`` has one row per record: the exact
bytes of its WARC and HTTP headers, and the digest of its payload. ``payloads`` has each
distinct payload once, under its SHA-256. Original records are put together again by a join, also
to read what the archive holds, and payloads are hashed anew whenever they are read, so that a damaged one is found.

Of records with equal payloads that with the least page_id is the response and the others
revisit it; payloads under ``least_bytes`` are responses always. A null html is an empty
payload. Records with a null page_id come after all others; of rows with the same page_id one is
the response and the others revisit it. Record ids are made from the row's number, so that equal
rows have ids of their own; page ids stand in headers of the archive's own (``X-Page-Id`` and
``X-Refers-To-Page-Id``), which are left out where they are null. Control characters in a url are
percent-encoded; a null url is empty. Payloads may be as long as a column can hold. An empty
table makes an empty archive. Other columns are not read.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import dropped, looked_up, shared_folder, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT_BYTES = 16 << 20


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    path: str

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.schema("page_id long, digest string, head binary").parquet(f"{self.path}/headers")

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.schema("digest string, n_records long, body binary").parquet(f"{self.path}/payloads")


def base32_sha1(body: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of 20 bits make four digits each."""
    hex40 = F.sha1(body)
    groups = [F.lpad(F.conv(F.substring(hex40, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS32, BASE32)


def _heads(kind: Column, url: Column, date: str) -> Column:
    """The header bytes of a record, up to its payload."""
    digits = lambda row: F.md5(F.concat(F.lit("record "), row.cast("string")))
    record_id = lambda row: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits(row), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    own = lambda name, value: F.when(value.isNotNull(), line(name, value.cast("string"))).otherwise("")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.length(http) + F.when(kind == "response", F.col("bytes")).otherwise(0)
    revisit = F.concat(line("WARC-Refers-To", record_id(F.col("first_row"))), own("X-Refers-To-Page-Id", F.col("refers_to")), line("WARC-Profile", F.lit(PROFILE)))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(F.col("row"))),
        line("WARC-Date", F.lit(date)),
        own("X-Page-Id", F.col("page_id")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(kind == "revisit", revisit).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str | None = None) -> Archive:
    """Write ``pages`` (page_id, url, html) as an archive; date: the WARC-Date of its records, that of writing by default."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    for c in "\r\n\t\0 ":
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    digest = F.sha2(body, 256)
    rows = stored(pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"), digest.alias("digest"), base32_sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("bytes")), "records")
    least = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row"))
    first = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), least.alias("first"))
    first = first.filter("n > 1")
    told = looked_up(rows, first, "digest", "n", rows.count())
    again = F.col("first.row").isNotNull() & (F.col("first.row") != F.col("row"))
    told = told.select("row", "page_id", "digest", "sha1", "bytes", "url", F.when(again, F.col("first.row")).alias("first_row"), F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, "revisit").otherwise("response").alias("kind"))
    told.select("page_id", "digest", _heads(F.col("kind"), F.col("url"), date).alias("head")).write.parquet(f"{path}/headers")
    dropped(rows)
    stock = pages.select(digest.alias("digest"), body.alias("body")).groupBy("digest").agg(F.count("*").alias("n_records"), F.first("body").alias("body"))
    stock.write.parquet(f"{path}/payloads")
    return Archive(pages.sparkSession, path)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)$", 1)


def verified(body: Column, digest: Column) -> Column:
    """``body``, if it is what its name says; else an error."""
    wrong = F.raise_error(F.concat(F.lit("damaged payload "), digest))
    return F.when(F.sha2(body, 256) == digest, body).otherwise(wrong.cast("binary"))


def reconstruct(archive: Archive) -> DataFrame:
    """page_id, kind, head and the exact bytes of every record; revisits have no payload of their own.

    Responses are joined with their payloads by digest. A payload that many of them have is one below the archive's
    least size, and so are those that are broadcast; a large one has one response.
    """
    rows = archive.headers.select("*", _field(F.decode("head", "UTF-8"), "WARC-Type").alias("kind"))
    end = F.lit(b"\r\n\r\n")
    responses = rows.filter("kind <> 'revisit'")
    wanted = responses.groupBy("digest").agg(F.count("*").alias("n"))
    stock = archive.payloads.select("digest", verified(F.col("body"), F.col("digest")).alias("body")).join(wanted, "digest")
    full = looked_up(responses, stock, "digest", "n", responses.count())
    whole = F.when(F.col("body").isNull(), F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("binary")).otherwise(F.concat("head", "body", end))
    full = full.select("page_id", "kind", "head", whole.alias("record"))
    return full.unionByName(rows.filter("kind = 'revisit'").select("page_id", "kind", "head", F.concat("head", end).alias("record")))


def read_records(archive: Archive) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest and payload_bytes of every record, from the original records.

    A response's payload is what follows its headers, hashed anew and held against the header; a revisit
    takes what is told of the record that it refers to.
    """
    head = F.decode("head", "UTF-8")
    page = lambda name: F.expr("try_cast(regexp_extract(text, '\\r\\n" + name + ": (-?[0-9]+)\\r', 1) AS BIGINT)")
    payload = F.expr("substring(record, octet_length(head) + 1, octet_length(record) - octet_length(head) - 4)")
    rows = reconstruct(archive).withColumn("text", head)
    names = [page("X-Page-Id").alias("page_id"), _field(F.col("text"), "WARC-Target-URI").alias("url"), F.col("kind").alias("record_type"), page("X-Refers-To-Page-Id").alias("refers_to"), _field(F.col("text"), "WARC-Payload-Digest").alias("named")]
    responses = rows.filter("kind <> 'revisit'").select(*names, _field(F.col("text"), "WARC-Record-ID").alias("record_id"), base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    responses = stored(responses, "responses")
    revisits = archive.headers.select(head.alias("text")).withColumn("kind", _field(F.col("text"), "WARC-Type")).filter("kind = 'revisit'").select(*names, _field(F.col("text"), "WARC-Refers-To").alias("record_id"))
    revisits = stored(revisits, "revisits")
    asked = revisits.groupBy("record_id").agg(F.count("*").alias("n"))
    told = looked_up(revisits, responses.select("record_id", "sha1", "bytes").join(asked, "record_id"), "record_id", "n", revisits.count())
    both = responses.unionByName(told)
    digest = F.when(F.concat(F.lit("sha1:"), F.col("sha1")) == F.col("named"), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("no payload as in the header: "), F.col("named"))).cast("string"))
    return both.select("page_id", "url", "record_type", "refers_to", digest.alias("payload_digest"), F.col("bytes").alias("payload_bytes"))


def segments(records: DataFrame) -> DataFrame:
    """Records as .warc.gz segments, one gzip member for each record, up to ``SEGMENT_BYTES`` of them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0).to_pylist():
                held.append(gzip.compress(record, 6, mtime=0))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["segment"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["segment"])

    return records.select("record").mapInArrow(run, "segment binary")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, exact header bytes and block of each record of a .warc or .warc.gz."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not re.match(rb"WARC/1\.\d\r\n", line):
            raise ValueError(f"no WARC record at {line[:20]!r}")
        head, fields = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        head.append(line)
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record ends early")
        yield fields, b"".join(head), block


def read_segments(segments: DataFrame) -> DataFrame:
    """record_id, record_type, head and payload of every record in .warc.gz or .warc bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                out: tuple[list, ...] = ([], [], [], [])
                for fields, head, block in parse_warc(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    row = (fields.get("warc-record-id"), fields.get("warc-type"), head + http + b"\r\n\r\n", payload)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                kinds = (pa.string(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["record_id", "record_type", "head", "payload"])

    return segments.mapInArrow(run, "record_id string, record_type string, head binary, payload binary")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read its records back."""
    path = f"{shared_folder(pages.sparkSession)}/strandloom/warc-{uuid.uuid4().hex}"
    return read_records(write_archive(pages, path, least_bytes))
