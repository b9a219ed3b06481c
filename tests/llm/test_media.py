"""Stored media: round trips, sniffing and carving."""

import hashlib
import struct
import zlib

from panelspark.llm import media
from tests.llm.helpers import FOLDER, ODD, empty, odd, rows_of


def png(pixels=b"\0\1"):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"!\xf9\x04\0\0\0\0\0" + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4cd" + b"scan\xff\0more\xff\xd0" + b"\xff\xd9"
BMP = struct.pack("<2sIII", b"BM", 58, 0, 54) + struct.pack("<I", 40) + b"\0" * 40


def test_validators_take_whole_files_only():
    for kind, blob in (("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("image/bmp", BMP)):
        assert media.hits(blob) == [(kind, 0, len(blob))]
        assert media.hits(blob[:-1]) == []
        assert media.hits(b"text " + blob + b" text") == [(kind, 5, len(blob))]
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.hits(bytes(broken)) == []
    assert media.hits(b"GIF89a is a magic word, BM too, and RIFF....WAVE") == []


def test_media_inside_media():
    blob = media.to_wav(b"RIFF" + png() + b"between" + GIF)
    assert [(kind, start > 0) for kind, start, _ in media.hits(blob)] == [("audio/wav", False), ("image/png", True), ("image/gif", True)]


def test_sniff_corrects_and_carves(spark):
    rows = [(1, png(), "image/jpeg"), (2, b"", "text/plain"), (3, None, None), (4, GIF, "image/gif"), (5, b"ab" + JPEG, "text/plain")]
    frame = spark.createDataFrame(rows, "id long, media binary, declared string")
    got = {r["id"]: (r["media_type"], r["corrected"], [(c[0], c[1], bytes(c[2])) for c in r["carved"]]) for r in media.sniff(frame, "id").collect()}
    assert got == {
        1: ("image/png", True, []),
        2: ("text/plain", False, []),
        3: (None, False, []),
        4: ("image/gif", False, []),
        5: ("text/plain", False, [("image/jpeg", 2, JPEG)]),
    }


def described(text):
    payload = (text or "").encode()
    padded = payload + b"\0" * (-len(payload) % 64 or (0 if payload else 64))
    return (len(payload), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(padded) + 44)


def test_features(spark):
    def got(frame):
        return sorted(
            ((r["doc_id"] or 0), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"])
            for r in media.features(media.store(frame)).collect()
        )

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert got(documents) == sorted((key, *described(text)) for key, text in rows_of("documents", "doc_id, text"))
    assert got(odd(spark)) == sorted((r[0] or 0, *described(r[1])) for r in ODD)
    assert media.features(media.store(empty(spark))).count() == 0
    some = media.features(media.store(odd(spark))).where("doc_id = 8").first()
    values = list(b"!!! 123 ..." + b"\0" * 53)
    assert some["feature"] == (
        f"audio/wav;carved=0;min=0;max={max(values)};sum={sum(values)};sumsq={sum(v * v for v in values)};crossings=0"
    )
    assert some["media_type"] == "audio/wav" and some["corrected"]
