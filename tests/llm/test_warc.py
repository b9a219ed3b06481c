"""Archives: round trips, segments in any order, and damage."""

import gzip
import hashlib
import random

import pytest

from panelspark.llm import warc
from tests.llm.helpers import FOLDER, empty, rows_of

SCHEMA = "page_id long, url string, html string"
LONG = "é" * 100_000
ODD = [
    (1, "u", None),
    (2, None, ""),
    (3, "a\r\nWARC-Type: x", "x" * 99),
    (4, "u", "x" * 99),
    (5, "u", "y" * 100),
    (5, "u", "y" * 100),
    (6, "u", "y" * 100),
    (None, "u", "y" * 100),
    (None, None, "z" * 200),
    (7, "u", LONG),
    (8, "u", "WARC/1.1\r\n\r\n\r\n\r\n0\r\n\r\n" * 20),
    (9, "u", LONG),
]


def expected(rows):
    first = {}
    for key, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and key is not None:
            first[payload] = min(key, first.get(payload, key))
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        at = first.get(payload)
        again = at is not None and key != at
        out.append((key, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", at if again else None))
    return sorted(out, key=str)


def test_odd_rows(spark):
    frame = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS digest", "2 AS size", "3 AS first", "4 AS value").repartition(3)
    assert sorted(map(tuple, warc.round_trip(frame).collect()), key=str) == expected(ODD)
    assert warc.round_trip(empty(spark, SCHEMA)).count() == 0


def test_pages(spark):
    frame = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert sorted(map(tuple, warc.round_trip(frame).collect()), key=str) == expected(rows_of("pages", "page_id, url, html"))


def test_payloads_and_small_segments(spark, tmp_path):
    warc.write(spark.createDataFrame(ODD, SCHEMA), str(tmp_path / "w"), segment_bytes=77)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, str(tmp_path / "w")).where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert got == {k: h or "" for k, _, h in ODD if k in (1, 2, 3, 4, 5, 7, 8)}
    kinds = set()
    for file in (tmp_path / "w").glob("part-*.gz"):
        for fields, _ in warc.parse(gzip.decompress(file.read_bytes())):
            kinds.add(fields["warc-type"])
    assert kinds == {"response", "revisit", "continuation"}


def test_segments_in_any_order_and_damage():
    html = "".join(random.Random(0).choices("abc \r\n", k=5000))
    digest = hashlib.sha256(html.encode()).hexdigest()
    cut = list(warc.records(1, "u", html, digest, None, 300))
    archive = b"".join(r + warc.SEPARATOR.encode() for r in cut)
    parts = [
        {"number": int(f["warc-segment-number"]), "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "fields": f, "block": b}
        for f, b in warc.parse(archive)
    ]
    random.Random(1).shuffle(parts)
    assert warc.joined(parts)[4].decode() == html
    with pytest.raises(ValueError, match="missing"):
        warc.joined([p for p in parts if p["number"] != 2])
    with pytest.raises(ValueError, match="total"):
        warc.joined([{**p, "total": p["total"] and p["total"] + 1} for p in parts])
    with pytest.raises(ValueError, match="length"):
        list(warc.parse(archive[:-50]))
    with pytest.raises(ValueError, match="digest"):
        warc.joined([{**p, "fields": {**p["fields"], "warc-payload-digest": "sha256:0"}} for p in parts])


def test_plain_bodies_and_chunk_extensions():
    assert warc.body_of(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody") == b"body"
    assert warc.body_of(b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
