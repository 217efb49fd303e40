"""WARC archives: writing captures as request, response and metadata records, and assembling them again.

The three records of a capture stand on their own in the archive; request and metadata name the response (or
revisit) record in WARC-Concurrent-To. captures() joins them through it and emits one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, write_shared

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"

RECORDS = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, payload_digest string, head string, payload binary, payload_bytes long"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hex digits (four base32 digits) at a time."""
    digest, digits = F.sha1(data), []
    for group in range(8):
        value = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*digits)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, i + 1, n) for i, n in ((0, 8), (8, 4), (12, 4), (16, 4), (20, 12)))), F.lit(">"))


def _record(kind: Column, record_id: Column, content_type: Column, block: Column, *headers: tuple[str, Column]) -> Column:
    """One record but for the two line ends that follow it. A header whose value is null is left out."""
    lines = [F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Type: "), content_type), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 24_000) -> None:
    """Write page_id, url, html as WARC 1.0 archives (gzip) into path, which must not exist.

    Of pages whose payloads (UTF-8 of html; null: empty) are equal and of at least min_revisit_bytes bytes, that with
    the largest page_id (of repeated rows: one of them) is a response, the others are revisits of it; smaller ones are
    all responses. A null url has no WARC-Target-URI; line ends in it are percent-encoded. Each row makes a capture,
    repeated rows too; extra columns do not matter. Archives are written by Spark's text writer with the record end
    as line separator, so they go to any store that Spark can write, and hold a bounded number of records each.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"),
        base32_sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"), F.monotonically_increasing_id().alias("row_no"),
    )
    rows = write_shared(rows, "warc-pages")  # row_no must not change between the uses below
    owner = F.struct(F.coalesce(F.col("page_id"), F.lit(-(2**63))).alias("page_id"), "row_no")
    owners = rows.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max(owner).alias("owner"), F.count("*").alias("copies"))
    owners = owners.where("copies > 1").select(F.col("digest").alias("owner_digest"), F.col("owner.row_no").alias("owner_no"))
    rows = rows.join(owners, (F.col("digest") == F.col("owner_digest")) & (F.col("n") >= min_revisit_bytes), "left")

    revisit = F.col("owner_no").isNotNull() & (F.col("owner_no") != F.col("row_no"))
    main_id, uri = _urn(F.lit("capture"), F.col("row_no").cast("string"), F.col("digest")), F.col("url")
    concurrent, when = ("WARC-Concurrent-To", main_id), ("WARC-Date", F.lit(date))
    http = F.concat(F.lit(_CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""])), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    host = F.coalesce(F.parse_url(F.regexp_replace("url", r"[^\x21-\x7E]|[\[\]{}|\\^`\"<>]", "-"), F.lit("HOST")), F.lit("unknown"))
    request = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("-")), F.lit(" HTTP/1.1" + _CRLF + "Host: "), host, F.lit(_CRLF * 2))
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_CRLF))
    main = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), main_id, F.lit("application/http; msgtype=response"), http,
        ("WARC-Target-URI", uri), when, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(revisit, _urn(F.lit("capture"), F.col("owner_no").cast("string"), F.col("digest")))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
    )
    of = lambda kind: _urn(F.lit(kind), F.col("row_no").cast("string"), F.col("digest"))
    records = F.array(
        _record(F.lit("request"), of("request"), F.lit("application/http; msgtype=request"), request, ("WARC-Target-URI", uri), when, concurrent),
        main,
        _record(F.lit("metadata"), of("metadata"), F.lit("application/warc-fields"), fields, ("WARC-Target-URI", uri), when, concurrent),
    )
    (rows.select(F.explode(records).alias("value")).write.option("lineSep", _CRLF * 2)
     .option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def _head(stream: BinaryIO) -> dict[str, str] | None:
    """The next record's fields by lower-case name (None: no record follows); a line that begins with white space continues the one before."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    fields, name = {}, ""
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _parse(data: bytes) -> Iterator[tuple]:
    """Records of one archive, in order, plain or of any number of gzip members; block lengths come from Content-Length alone."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while (head := _head(stream)) is not None:
        record, kind = head.get("warc-record-id"), head.get("warc-type")
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"archive ends within record {record}")
        first, payload = block, None
        if head.get("content-type", "").lower().startswith("application/http"):
            first, _, payload = block.partition(b"\r\n\r\n")
        elif kind in ("response", "resource"):
            first, payload = b"", block
        digest = head.get("warc-payload-digest") or None
        if digest and digest.lower().startswith("sha1:"):
            digest = digest[5:]
            if kind == "response" and digest != (found := base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                raise ValueError(f"payload of {record} has SHA-1 {found}, not {digest}")
        yield (
            record, kind, head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-concurrent-to"),
            head.get("warc-refers-to"), digest, first.decode("utf-8", "replace"), payload, None if payload is None else len(payload),
        )


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder, plain or gzip (of one member, or of one for each record). SHA-1 digests of responses are checked on the way.

    Field names are taken in any case. A task holds one archive as it is stored and one record of it inflated, however
    long; records that break off, or that lack a length, are errors. An empty archive has no records.
    payloads=False leaves the payload column null, for uses that need sizes and digests alone.
    """
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for r in _parse(bytes(content)):
                    rows.append(r if payloads else (*r[:8], None, r[9]))
                    size += r[9] or 0
                    if size > 8e6 or len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit record, with its request and metadata.

    Request and metadata are null where no record names the capture; of several, that with the smallest record id
    stands. Requests that name no capture of the archive do not appear.
    """
    main = records.where(F.col("type").isin("response", "revisit"))
    other = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    part = lambda kind: F.min(F.when(F.col("type") == kind, F.struct("record_id", "target_uri", "date", "head"))).alias(kind)
    sides = other.groupBy(F.col("concurrent_to").alias("_main")).agg(part("request"), part("metadata"))
    joined = main.join(sides, F.col("record_id") == F.col("_main"), "left")
    return joined.select(
        F.struct("record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "head", "payload", "payload_bytes").alias("capture"),
        "request",
        "metadata",
    )


def page_summary(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id) per capture; revisits take the payload's size from what they revisit."""
    page = F.nullif(F.regexp_extract("metadata.head", r"page_id: (-?\d*)", 1), F.lit("")).cast("long")
    flat = found.select("capture.record_id", page.alias("page_id"), "capture.type", F.col("capture.refers_to").alias("ref"), "capture.payload_digest", "capture.payload_bytes")
    first = flat.where("type = 'response'").select(F.col("record_id").alias("ref"), F.col("page_id").alias("ref_page"), F.col("payload_bytes").alias("ref_bytes"))
    return flat.join(first, "ref", "left").select(
        "page_id", F.when(F.col("type") == "revisit", F.col("ref_bytes")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        "payload_digest", F.col("type").alias("record_type"), F.col("ref_page").alias("refers_to"),
    )


def archive_and_read(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages into a new folder of the shared one, read the archives back and summarise each capture."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    records = write_shared(read_records(spark, path, payloads=False), "warc-records")
    return page_summary(captures(records))
