"""Content-addressed WARC archive.

An archive is two tables in a shared folder: ``payloads`` holds the bytes of every distinct payload once, each a
zstd member of its own, addressed by SHA-1 and checked by SHA-256; ``records`` holds the exact header block of every
WARC record and the address of its payload. Records are rebuilt by joining both, parsed again and verified.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the largest id is the response, the
others revisit it; smaller payloads are all responses. Equality is decided on SHA-1, SHA-256 and length together.

Records are WARC/1.1: every one has its own ``WARC-Record-ID`` (page id and row number, so that ids stay apart where a page id repeats), the
``WARC-Date`` of the archive, and ends in two line ends after its block.

Steps and data movement: digests and lengths are computed in the scan and written once as slim rows; these are grouped, with
map-side combine, so a hot payload does not skew the grouping. Payloads go compressed through one shuffle when the
archive is written and one when it is read. Reading joins responses with the store by address (a hot address is one
store row, and AQE splits its record side), recomputes both digests and fails on a mismatch; revisits move no bytes.

Defined cases: null html is the empty payload; a null url is written as ``urn:unknown``; blanks and control characters of
a url become ``%20`` so that a header stays one line; payloads may have any length; ties: of rows with the largest id and equal payloads all are responses, and the one with the largest row number is referred to; a null id is kept; rows that repeat an id are all written; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch_path, stored
from .memory import frugal

CRLF = "\r\n"
#: What ends a record.
END = b"\r\n\r\n"
MIN_REVISIT = 1000
LEVEL = 6
#: Stands for a null id inside an archive.
NO_ID = -(2**63)


@frugal
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=LEVEL)
    for b in batches:
        body = pa.array([z.compress(x or b"") for x in b.column("payload").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("sha1"), b.column("sha256"), body], names=["page_id", "sha1", "sha256", "packed"])


@frugal
def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in batches:
        body = [z.decompress(x) for x in b.column("packed").to_pylist()]
        for sha1, sha256, x in zip(b.column("sha1").to_pylist(), b.column("sha256").to_pylist(), body, strict=True):
            if hashlib.sha1(x).hexdigest() != sha1 or hashlib.sha256(x).hexdigest() != sha256:
                raise ValueError(f"stored payload {sha1} does not match its address")
        record = [h + x + END for h, x in zip(b.column("header").to_pylist(), body, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("header"), pa.array(record, pa.binary())], names=["header", "record"])


def _headers(record_id: Column, url_column: Column, date: str, n: Column, sha1: Column, revisit: Column, response: Column) -> Column:
    """The exact header block of a record: WARC headers, a blank line, the block's HTTP headers and their blank line."""
    url = F.coalesce(F.regexp_replace(url_column, r"[\x00-\x20]", "%20"), F.lit("urn:unknown"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(CRLF * 2))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), response)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(n)).cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http), "UTF-8")


def write_archive(pages: DataFrame, path: str | None = None, min_revisit: int = MIN_REVISIT, date: str | None = None) -> str:
    """Write ``pages(page_id, url, html)`` as an archive of a date (``2026-01-31T12:00:00Z``, now if none is given); returns its folder."""
    path = path or scratch_path(pages.sparkSession, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    raw = pages.select(F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    raw = raw.select("*", F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("n"))
    # row numbers are fixed by this table
    ids = stored(raw.select("page_id", "url", "sha1", "sha256", "n").withColumn("row", F.monotonically_increasing_id()), "warc-rows")
    keepers = ids.groupBy("sha1", "sha256", "n").agg(F.max(F.struct("page_id", "row")).alias("response"))
    keepers = stored(keepers, "warc-payloads")  # both sides of the joins are plain tables, so a payload of very many pages can be split
    roles = ids.join(keepers.hint("merge"), ["sha1", "sha256", "n"])
    roles = roles.withColumn("revisit", (F.col("n") >= min_revisit) & (F.col("page_id") != F.col("response.page_id")))
    record_id = lambda page_id, row: F.concat(F.lit("<urn:page:"), F.col(page_id).cast("string"), F.lit(":"), F.col(row).cast("string"), F.lit(">"))
    header = _headers(record_id("page_id", "row"), F.col("url"), date, F.col("n"), F.col("sha1"), F.col("revisit"), record_id("response.page_id", "response.row"))
    roles.select("sha1", "sha256", "revisit", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    key = ["page_id", "sha1", "sha256"]
    packed = raw.select(*key, "payload").mapInArrow(_pack, "page_id long, sha1 string, sha256 string, packed binary")
    keep = keepers.select(F.col("response.page_id").alias("page_id"), "sha1", "sha256")
    # an id that repeats with the same html meets itself in one task: the address decides, one row stays
    store = packed.join(keep.hint("merge"), key, "left_semi").dropDuplicates(key)
    store.select("sha1", "sha256", "packed").write.option("compression", "none").parquet(f"{path}/payloads")
    discard(ids, keepers)
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild, verify and parse every record: ``page_id, record_type, refers_to, url, payload_bytes, payload_digest, record``.

    ``record`` is the record's exact bytes: for a response its headers and the joined payload, for a revisit its headers, and the record's end.
    """
    records = spark.read.parquet(f"{path}/records")
    store = spark.read.parquet(f"{path}/payloads")
    responses = records.filter(~F.col("revisit")).join(store.hint("merge"), ["sha1", "sha256"]).select("sha1", "sha256", "header", "packed")
    responses = responses.mapInArrow(_rebuild, "header binary, record binary")
    revisits = records.filter("revisit").select("header", F.concat("header", F.lit(END)).alias("record"))
    text = F.decode("header", "UTF-8")
    field = lambda name, rx: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {rx}\r\n", 1), F.lit(""))
    page_id = lambda name: F.nullif(field(name, r"<urn:page:(-?\d+):\d+>").cast("long"), F.lit(NO_ID))
    return responses.unionByName(revisits).select(
        page_id("WARC-Record-ID").alias("page_id"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        page_id("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI", r"(\S+)").alias("url"),
        # the block's own length, so that a revisit tells the length of the payload it refers to
        F.regexp_extract(text, r"charset=utf-8\r\nContent-Length: (\d+)\r\n", 1).cast("long").alias("payload_bytes"),
        field("WARC-Payload-Digest", r"sha1:([0-9a-f]+)").alias("payload_digest"),
        "record",
    )
