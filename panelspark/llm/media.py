"""Media columns: signature sniffing, validation, carving, and samples in WAV form.

One automaton over the magic bytes of all formats runs over a blob. At each hit the format's
validator walks the structure from there (chunks, blocks or markers, with their lengths and
checksums) and gives the length, or nothing if it is not sound. A sound format at the blob's
beginning corrects the declared type; sound ones elsewhere are carved. Inside a carved span no
further hits count, so a picture within a picture's own bytes is not reported twice; the
inside of the blob's own container is searched, as media are embedded there.

Rules: a null text is empty; a null or empty blob has no type and nothing to carve. Payloads
are padded with zero bytes to a positive multiple of 64. Repeated rows give equal values. A
WAV holds less than 4 GiB; a longer payload is an error, never cut.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from panelspark.llm.common import batched, map_rows, text_column, to_arrow

#: Payloads are padded to a multiple of this many bytes.
UNIT = 64
#: Samples a second that stored payloads claim.
SAMPLE_RATE = 8000


def _riff(data: bytes, at: int, form: bytes) -> int | None:
    """RIFF: the chunks fill the size that the header names."""
    if len(data) < at + 12 or data[at + 8 : at + 12] != form:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    here = at + 12
    while here + 8 <= end <= len(data):
        here += 8 + struct.unpack_from("<I", data, here + 4)[0]
        here += here - at & 1 and here < end
    return end - at if here == end <= len(data) else None


def _wav(data: bytes, at: int) -> int | None:
    size = _riff(data, at, b"WAVE")
    return size if size and data[at + 12 : at + 16] == b"fmt " else None


def _webp(data: bytes, at: int) -> int | None:
    return _riff(data, at, b"WEBP")


def _png(data: bytes, at: int) -> int | None:
    """PNG: a header chunk, chunks with right checksums, and the end chunk."""
    here = at + 8
    if data[here + 4 : here + 8] != b"IHDR":
        return None
    while here + 12 <= len(data):
        size = struct.unpack_from(">I", data, here)[0]
        end = here + 12 + size
        if end > len(data) or zlib.crc32(data[here + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if data[here + 4 : here + 8] == b"IEND":
            return end - at
        here = end
    return None


def _gif(data: bytes, at: int) -> int | None:
    """GIF: colour tables, then extensions and images made of sub-blocks, then the trailer."""
    if len(data) < at + 13:
        return None
    flags, here = data[at + 10], at + 13
    here += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    while here < len(data):
        kind = data[here]
        if kind == 0x3B:
            return here + 1 - at
        if kind == 0x21:
            here += 2
        elif kind == 0x2C and here + 10 < len(data):
            flags = data[here + 9]
            here += 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        else:
            return None
        while here < len(data) and data[here]:
            here += data[here] + 1
        here += 1
    return None


def _jpeg(data: bytes, at: int) -> int | None:
    """JPEG: marker segments by length; scan data run to the next marker; the end marker."""
    here = at + 2
    while here + 4 <= len(data) or data[here : here + 2] == b"\xff\xd9":
        if data[here] != 0xFF:
            return None
        kind = data[here + 1]
        if kind == 0xD9:
            return here + 2 - at
        if kind == 0xFF:
            here += 1
            continue
        size = struct.unpack_from(">H", data, here + 2)[0]
        if size < 2:
            return None
        here += 2 + size
        if kind == 0xDA:
            while (here := data.find(b"\xff", here)) >= 0 and data[here + 1 : here + 2] in _STUFFED:
                here += 2
            if here < 0:
                return None
    return None


#: What follows 0xFF inside JPEG scan data: a stuffed zero or a restart marker (fixed values).
_STUFFED = {bytes([b]) for b in (0, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7)}


def _bmp(data: bytes, at: int) -> int | None:
    """BMP: size, offset of the pixels and a known header size agree with one another."""
    if len(data) < at + 26:
        return None
    size, zero, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    sound = not zero and header in (12, 40, 108, 124) and 14 + header <= pixels <= size <= len(data) - at
    return size if sound else None


#: Media type, magic bytes and validator of every known format (magic bytes: fixed values).
FORMATS: tuple[tuple[str, bytes, Callable[[bytes, int], int | None]], ...] = (
    ("audio/wav", b"RIFF", _wav),
    ("image/webp", b"RIFF", _webp),
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("image/bmp", b"BM", _bmp),
)


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic in dict.fromkeys(m for _, m, _ in FORMATS):
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def hits(data: bytes) -> list[tuple[str, int, int]]:
    """Sound media as ``(type, start, length)``: that at the beginning, and those embedded."""
    found, free = [], 0
    for last, magic in _automaton().iter(data.decode("latin-1")):
        start = last + 1 - len(magic)
        if start < free:
            continue
        for kind, its, validate in FORMATS:
            if its == magic and (size := validate(data, start)):
                found.append((kind, start, size))
                # The container at the beginning is searched inside.
                free = start + size if start else len(magic)
                break
    return found


def sniff(blobs: DataFrame, id_column: str, blob: str = "media", declared: str = "declared") -> DataFrame:
    """``id, media_type, corrected, carved``: the type by content (the declared one if no sound
    format begins the blob), whether that differs from the declared one, and what is embedded
    as an array of ``(media_type, start, content)``."""
    kind = blobs.schema[id_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, media_type string, corrected boolean, "
        "carved array<struct<media_type: string, start: long, content: binary>>"
    )
    return map_rows(blobs.select(id_column, blob, declared), schema, lambda: _sniffed)


def _sniffed(key, data, declared):
    found = hits(data or b"")
    real = next((kind for kind, start, _ in found if start == 0), declared)
    carved = [
        {"media_type": kind, "start": start, "content": data[start : start + size]}
        for kind, start, size in found
        if start
    ]
    return key, real, real != declared, carved


def to_wav(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono WAV."""
    if len(payload) > 0xFFFFFFFF - 36 - 1:
        raise ValueError("a WAV holds less than 4 GiB")
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    body = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(body), b"WAVE") + head + body


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV."""
    here = 12
    while here + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, here)
        if name == b"fmt " and struct.unpack_from("<HH", media, here + 8) + struct.unpack_from("<H", media, here + 22) != (1, 1, 8):
            raise ValueError("not 8-bit mono samples")
        if name == b"data":
            return media[here + 8 : here + 8 + size]
        here += 8 + size + (size & 1)
    raise ValueError("no samples")


def store(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_bytes, declared, media``: every whole text as a padded WAV. The declared type is
    the generic one, as an upload without a type has."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes long, declared string, media binary"
    arrow = to_arrow(docs.sparkSession, schema)

    def one(key, body):
        payload = body.encode()
        padding = -len(payload) % UNIT or (0 if payload else UNIT)
        return key, len(payload), "application/octet-stream", to_wav(payload + b"\0" * padding)

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            # Few rows a batch: the blobs are as long as the texts.
            yield from batched((one(*row) for row in rows), arrow, size=256)

    return docs.select(id_column, text_column(text).alias("text")).mapInArrow(run, schema)


def features(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Sniff each stored blob, read its samples back and describe them.

    ``feature`` is ``type;carved=n;min=;max=;sum=;sumsq=;crossings=`` of the samples, crossings
    being neighbours on either side of the middle value 128.
    """
    kind = stored.schema[id_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, n_carved long"
    )

    def one(key, n_bytes, declared, media):
        found = hits(media)
        if not found or found[0] != ("audio/wav", 0, len(media)):
            raise ValueError("the stored form is damaged")
        payload = from_wav(media)
        samples = np.frombuffer(payload, np.uint8)
        counts = np.bincount(samples, minlength=256)
        values = np.arange(256)
        used = np.flatnonzero(counts)
        crossings = int(np.count_nonzero(np.diff((samples >= 128).view(np.int8))))
        feature = (
            f"audio/wav;carved={len(found) - 1};min={used[0]};max={used[-1]};sum={int(counts @ values)};"
            f"sumsq={int(counts @ values**2)};crossings={crossings}"
        )
        return (
            key,
            n_bytes,
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-UNIT:]),
            len(media),
            hashlib.sha256(media).hexdigest(),
            feature,
            "audio/wav",
            declared != "audio/wav",
            len(found) - 1,
        )

    return map_rows(stored.select(id_column, "n_bytes", "declared", "media"), schema, lambda: one)
