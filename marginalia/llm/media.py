"""Media columns: what a blob of bytes really is, where media lie in it, and samples stored as media.

An Aho-Corasick automaton finds magic bytes in one pass over a blob. A format's validator then walks the structure from
each hit (chunk and segment lengths, checksums, end marks) and says how long the object is; hits that do not hold are
dropped. The outermost object at offset 0 that covers the blob corrects its declared type; the others can be carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import small_batches

#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64
RATE = 8000
UNKNOWN = "application/octet-stream"


class Found(NamedTuple):
    kind: str
    offset: int
    length: int
    #: Where the samples or pixels lie within the blob, if the format stores them plainly.
    data_offset: int
    data_length: int


# fixed values: magic bytes of the formats, and their media types
MAGIC = {b"\x89PNG\r\n\x1a\n": "image/png", b"\xff\xd8\xff": "image/jpeg", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b"RIFF": "riff", b"BM": "image/bmp"}


def _png(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + n
        if end > len(b) or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0] or (first and (kind != b"IHDR" or n != 13)):
            return None
        pos, first = end, False
        if kind == b"IEND":
            return "image/png", pos - at, 0, 0
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    pos, frame = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if mark < 0xC0 or 0xD0 <= mark <= 0xD9 or n < 2 or pos + 2 + n > len(b):
            return None
        frame |= mark in (0xC0, 0xC1, 0xC2)
        pos += 2 + n
        if mark == 0xDA:  # entropy-coded data up to the next mark that is no stuffing or restart
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0 or pos + 1 >= len(b):
                return None
            if b[pos + 1] == 0xD9:
                return ("image/jpeg", pos + 2 - at, 0, 0) if frame else None
    return None


def _gif(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        return pos + 1

    image = False
    while pos < len(b):
        if b[pos] == 0x3B:
            return ("image/gif", pos + 1 - at, 0, 0) if image else None
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            flags, image = b[pos + 9], True
            pos = blocks(pos + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
        else:
            return None
    return None


def _riff(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    if at + 12 > len(b):
        return None
    n, form = struct.unpack_from("<I4s", b, at + 4)
    end, pos = at + 8 + n, at + 12
    if end > len(b) or form not in (b"WAVE", b"WEBP"):
        return None
    chunks: dict[bytes, tuple[int, int]] = {}
    while pos + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + size > end:
            return None
        chunks.setdefault(kind, (pos + 8, size))
        pos += 8 + size + size % 2
    if pos != end:
        return None
    if form == b"WEBP":
        return ("image/webp", end - at, 0, 0) if chunks.keys() & {b"VP8 ", b"VP8L", b"VP8X"} else None
    if b"fmt " not in chunks or b"data" not in chunks or chunks[b"fmt "][1] < 16:
        return None
    code, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", b, chunks[b"fmt "][0])
    if not channels or align != channels * ((bits + 7) // 8) or per_second != rate * align or chunks[b"data"][1] % align:
        return None
    return "audio/wav", end - at, *(chunks[b"data"] if code == 1 else (0, 0))


def _bmp(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    if at + 30 > len(b):
        return None
    size, _, pixels, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if header not in (40, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not 14 + header <= pixels <= size or at + size > len(b):
        return None
    need = (width * depth + 31) // 32 * 4 * abs(height)
    return ("image/bmp", size, at + pixels, need) if pixels + need <= size else None


_VALID = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "riff": _riff, "image/bmp": _bmp}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            self.automaton.add_word(magic.decode("latin-1"), (len(magic), kind))
        self.automaton.make_automaton()

    def find(self, blob: bytes) -> list[Found]:
        """All objects that hold, by offset; those inside others too."""
        found = []
        for end, (n, kind) in self.automaton.iter(blob.decode("latin-1")):
            at = end + 1 - n
            if held := _VALID[kind](blob, at):
                found.append(Found(held[0], at, *held[1:]))
        return sorted(found, key=lambda x: (x.offset, -x.length))


def true_type(blob: bytes, found: list[Found]) -> str:
    return found[0].kind if found and found[0].offset == 0 and found[0].length == len(blob) else UNKNOWN


def sniff_media(df: DataFrame, data: str = "media", declared: str = "declared") -> DataFrame:
    """id, declared, corrected, and embedded: the objects (kind, offset, length, bytes) found inside, for a column `id`.

    A null blob is empty; one without an object that covers it is application/octet-stream; null ids and repeated rows
    pass through; other columns are not carried; an empty table gives an empty result.
    """
    inside = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            kinds, lists = [], []
            for blob in batch.column(2).to_pylist():
                blob = blob or b""
                found = sniffer.find(blob)
                kinds.append(true_type(blob, found))
                lists.append([{"kind": x.kind, "offset": x.offset, "length": x.length, "bytes": blob[x.offset : x.offset + x.length]} for x in found if x.length < len(blob)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string()), pa.array(lists, inside)], ("id", "declared", "corrected", "embedded"))

    small_batches(df.sparkSession)
    own = df.select(F.col("id").cast("long").alias("id"), F.col(declared).cast("string").alias("declared"), F.col(data).cast("binary").alias("media"))
    return own.mapInArrow(run, "id long, declared string, corrected string, embedded array<struct<kind:string,offset:bigint,length:bigint,bytes:binary>>")


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM whose samples are the payload (of even length)."""
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16) + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def features(kind: str, samples: bytes, embedded: int) -> str:
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    levels = np.arange(256)
    mean = float(n @ levels) / len(x)
    spread = (float(n @ (levels * levels)) / len(x) - mean * mean) ** 0.5
    share = n[n > 0] / len(x)
    return f"{kind};samples={len(x)};mean={mean:.4f};std={spread:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};peak={int(x.max())};embedded={embedded}"


def carved(found: list[Found], blob: bytes, start: int, length: int) -> str:
    """kind:offset:length:sha256 of the objects that lie in a stretch of the blob, offsets from its start, comma-joined."""
    inside = [x for x in found if start <= x.offset and x.offset + x.length <= start + length]
    return ",".join(f"{x.kind}:{x.offset - start}:{x.length}:{hashlib.sha256(blob[x.offset : x.offset + x.length]).hexdigest()}" for x in inside)


def store_texts(docs: DataFrame, declared: str = "text/plain") -> DataFrame:
    """doc_id, the payload's digests as read back, the stored form, and what the sniffer found, for each row of (doc_id, text).

    The text's UTF-8 bytes (none for null), padded to a positive multiple of 64, are stored as WAV samples, declared as the text
    they came from; the sniffer corrects the type (media_type) and locates the samples, from which payload and features are
    read, and carves the media inside the payload (carved: kind:offset:length:sha256, by offset). Null ids and repeated rows
    pass through; other columns are not carried; an empty table gives an empty result.
    """
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared_type", "media_type", "carved")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            out = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                media = to_wav(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)))
                found = sniffer.find(media)
                kind = true_type(media, found)
                at, n = found[0].data_offset, found[0].data_length
                payload = media[at : at + n]
                held = (len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest())
                out.append((*held, features(kind, payload, len(found) - 1), declared, kind, carved(found, media, at, n)))
            columns = list(zip(*out, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "declared_type string, media_type string, carved string",
    )
