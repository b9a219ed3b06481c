"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing: a page becomes a response record whose block is an HTTP response with a chunked
body. A block beyond ``segment_bytes`` is cut: the first segment keeps the record's type, and
continuation records name it as their origin. Of pages with equal payloads of 100 bytes or
more, the one with the smallest page id is the response and the others are revisits of it.
Archives are real WARC files (gzip), written by Spark's own text sink with the record
separator as line separator, so a lost task's file is written anew by the output protocol.

Reading: every archive is parsed by its declared lengths. Records without segments are
decoded where they are met; segments are grouped by origin id, ordered by number, checked
for gaps and against the total length, joined, and decoded. A group is one page.

Rules: null html is an empty payload; payloads under 100 bytes are always responses. A null
page id is a revisit if an equal payload has a page id, else a response. Repeated rows with
the smallest page id are all responses. An empty table gives no archives and no rows.
Damaged records (bad lengths, missing segments, wrong digests) are errors, never skipped.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import batched, map_rows, to_arrow
from panelspark.session import shared_folder

#: Payloads below this length are always written in full.
REVISIT_BYTES = 100
SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 8 * 1024
#: Records per archive file; with the segment length this bounds an archive's size.
RECORDS_PER_FILE = 4000
#: Pages have no capture time of their own.
DATE = "2020-01-01T00:00:00Z"
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload binary, "
    "payload_length long, declared_digest string"
)


def classified(pages: DataFrame) -> DataFrame:
    """Pages with ``digest``, ``size`` and, for revisits, ``refers_to``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).cast("long").alias("size"),
    )
    # The counts combine before the shuffle, and a payload is one row afterwards.
    first = (
        pages.where(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    same = F.col("page_id").eqNullSafe(F.col("first"))
    return pages.join(first, "digest", "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & ~same, F.col("first"))
    )


def _header(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1"]
    for name, value in [*fields, ("Content-Length", length)]:
        if value is not None:
            # A line end inside a value would end the field.
            lines.append(f"{name}: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", str(value)))
    return ("\r\n".join(lines) + SEPARATOR).encode()


def _chunked(payload: bytes, chunk: int) -> bytes:
    parts = []
    for start in range(0, len(payload), chunk):
        some = payload[start : start + chunk]
        parts += [b"%x\r\n" % len(some), some, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def records(page_id, url, html: str, digest: str, refers_to, segment_bytes: int) -> Iterator[bytes]:
    """One page's records, each without the separator that ends it."""
    payload = html.encode()
    identity = f"<urn:uuid:{uuid.uuid4()}>"
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", identity),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", len(payload)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", refers_to)]
        yield _header(fields, len(HTTP_HEAD)) + HTTP_HEAD
        return
    block = HTTP_HEAD + _chunked(payload, CHUNK_BYTES)
    if len(block) <= segment_bytes:
        yield _header(fields, len(block)) + block
        return
    for number, start in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[start : start + segment_bytes]
        if number > 1:
            fields = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", identity),
            ]
        own = [*fields, ("WARC-Segment-Number", number)]
        if start + segment_bytes >= len(block):
            own.append(("WARC-Segment-Total-Length", len(block)))
        yield _header(own, len(part)) + part


def write(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write one or more records per page into gzip archives in ``folder``."""
    arrow = to_arrow(pages.sparkSession, "value binary")

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield from batched(((r,) for row in rows for r in records(*row, segment_bytes)), arrow, size=256)

    (
        classified(pages)
        .select("page_id", "url", "html", "digest", "refers_to")
        .mapInArrow(run, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", SEPARATOR)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .option("compression", "gzip")
        .text(folder)
    )


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of an archive."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins here: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != SEPARATOR.encode():
            raise ValueError("a record's length is wrong")
        yield fields, block


def body_of(block: bytes) -> bytes:
    """The body of an HTTP response, with chunked transfer framing undone."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP head")
    if not re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head):
        return body
    parts, here = [], 0
    while True:
        end = body.index(b"\r\n", here)
        size = int(body[here:end].split(b";")[0], 16)
        here = end + 2
        if size == 0:
            return b"".join(parts)
        if body[here + size : here + size + 2] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        parts.append(body[here : here + size])
        here += size + 2


def decoded(fields: dict[str, str], block: bytes) -> tuple:
    """A row of ``SCHEMA`` from a whole record."""
    number = lambda name: int(fields[name]) if name in fields else None
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    payload = body_of(block) if kind == "response" else None
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload does not have its digest")
    return (
        number("x-page-id"),
        fields.get("warc-target-uri"),
        kind,
        number("x-refers-to-page-id"),
        payload,
        number("x-payload-length"),
        digest,
    )


def joined(segments: list[dict]) -> tuple:
    """A row of ``SCHEMA`` from all segments of one record, in any order."""
    segments = sorted(segments, key=lambda s: s["number"])
    if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(s["block"] for s in segments)
    if segments[-1]["total"] != len(block):
        raise ValueError("segments do not add up to the total length")
    return decoded(dict(segments[0]["fields"]), block)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of the archives in ``folder``, in the columns of ``SCHEMA``."""
    archives = spark.read.format("binaryFile").load(folder).select("content")
    rows = to_arrow(spark, SCHEMA)
    segment = "origin string, number long, total long, fields map<string, string>, block binary"
    parts = to_arrow(spark, segment)

    def whole(batches):
        found = (record for b in batches for c in b.column(0) for record in parse(c.as_py()))
        yield from batched((decoded(f, b) for f, b in found if "warc-segment-number" not in f), rows, size=256)

    def cut(batches):
        found = (record for b in batches for c in b.column(0) for record in parse(c.as_py()))
        yield from batched(
            (
                (
                    f.get("warc-segment-origin-id", f["warc-record-id"]),
                    int(f["warc-segment-number"]),
                    int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                    f,
                    b,
                )
                for f, b in found
                if "warc-segment-number" in f
            ),
            parts,
            size=64,
        )

    # Only the segments are shuffled, and a group is one page.
    groups = (
        archives.mapInArrow(cut, segment)
        .groupBy("origin")
        .agg(F.collect_list(F.struct("number", "total", "fields", "block")).alias("segments"))
    )
    reassembled = map_rows(groups.select("segments"), SCHEMA, lambda: joined)
    return archives.mapInArrow(whole, SCHEMA).unionByName(reassembled)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of all pages in the shared folder, read them back and describe them.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A response's
    values come from its payload as read; a revisit's from its header.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    back = read(spark, folder)
    return back.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "declared_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


#: The same rows, without archives.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
    CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
