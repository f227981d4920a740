"""Whether an image file is whole, by the lengths, checksums and markers of its own format; no picture is decoded.

Each walker returns what is wrong, or None. What follows the end of an image (cameras append data) is no fault.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from albumen.sources.metadata import KINDS, Directories

# The markers of JPEG frames, and those without a length.
FRAMES = frozenset({*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC})
BARE = frozenset({0x01, *range(0xD0, 0xD8)})
#: Tags of where the parts of a TIFF's picture lie, and of their lengths.
PARTS = {0x0111: 0x0117, 0x0144: 0x0145, 0x0201: 0x0202}


def png(data: memoryview) -> str | None:
    at, kinds = 8, []
    while True:
        if at + 12 > len(data):
            return "truncated"
        size, kind = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8])
        if at + 12 + size > len(data):
            return "truncated"
        if zlib.crc32(data[at + 4 : at + 8 + size]) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            return "checksum of a chunk"
        if not kinds and (kind != b"IHDR" or size != 13 or 0 in struct.unpack(">II", data[at + 8 : at + 16])):
            return "no header chunk"
        kinds.append(kind)
        at += 12 + size
        if kind == b"IEND":
            return None if b"IDAT" in kinds else "no picture"


def jpeg(data: memoryview) -> str | None:
    at, frame, scan, raw = 2, False, False, data.tobytes()
    while True:
        if at + 2 > len(raw):
            return "truncated"
        if raw[at] != 0xFF:
            return "no marker where one must be"
        marker = raw[at + 1]
        if marker == 0xFF or marker in BARE:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            return None if frame and scan else "no picture"
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        if marker in (0x00, 0xD8) or size < 2:
            return "no marker where one must be"
        if at + 2 + size > len(raw):
            return "truncated"
        if marker in FRAMES:
            if size < 11 or size != 8 + 3 * raw[at + 9] or 0 in (raw[at + 7] << 8 | raw[at + 8], raw[at + 9]):
                return "frame without a size"
            frame = True
        at += 2 + size
        if marker == 0xDA:
            if not frame:
                return "scan before its frame"
            scan = True
            # The scan's data: a marker is 0xFF and neither 0 (a stuffed byte) nor a restart.
            while True:
                at = raw.find(b"\xff", at)
                if at < 0 or at + 1 >= len(raw):
                    return "truncated"
                if raw[at + 1] and not 0xD0 <= raw[at + 1] <= 0xD7 and raw[at + 1] != 0xFF:
                    break
                at += 1 if raw[at + 1] == 0xFF else 2


def gif(data: memoryview) -> str | None:
    if len(data) < 13:
        return "truncated"
    at, pictures = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0), 0
    while True:
        if at >= len(data):
            return "truncated"
        kind = data[at]
        if kind == 0x3B:
            return None if pictures else "no picture"
        if kind == 0x21:
            at += 2
        elif kind == 0x2C:
            if at + 10 > len(data):
                return "truncated"
            if 0 in struct.unpack("<HH", data[at + 5 : at + 9]):
                return "frame without a size"
            at += 10 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0) + 1
            pictures += 1
        else:
            return "unknown block"
        while at < len(data) and data[at]:
            at += 1 + data[at]
        at += 1


def bmp(data: memoryview) -> str | None:
    if len(data) < 26:
        return "truncated"
    size, _, _, offset, header = struct.unpack("<IHHII", data[2:18])
    if header == 12:
        width, height, _, bits, packing = *struct.unpack("<HHHH", data[18:26]), 0
    elif header >= 40 and len(data) >= 54:
        width, height, _, bits, packing = struct.unpack("<iiHHI", data[18:34])
    else:
        return "no header"
    if not width or not height or bits not in (1, 2, 4, 8, 16, 24, 32) and packing not in (4, 5) or not 14 + header <= offset:
        return "no header"
    least = (abs(width) * bits + 31) // 32 * 4 * abs(height) if packing in (0, 3) else 1
    return "truncated" if max(size, offset + least) > len(data) else None


def webp(data: memoryview) -> str | None:
    end = 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        return "truncated"
    at, kinds = 12, []
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        kinds.append(bytes(data[at : at + 4]))
        at += 8 + size + size % 2
    if at != end:
        return "chunk beyond its file"
    return None if {b"VP8 ", b"VP8L", b"ANMF"} & set(kinds) else "no picture"


def tiff(data: memoryview) -> str | None:
    """Every directory of the chain, its values, and the parts of the picture lie in the file."""
    d = Directories(data)
    try:
        at, count = d.first(), 0
        head, size, room = (8, 20, 8) if d.big else (2, 12, 4)
        word, offset = ("Q", "Q") if d.big else ("H", "I")
        while at:
            if at in d.seen:
                return "directories in a circle"
            d.seen.add(at)
            n, tags = d.number(at, word), {}
            if not n:
                return "empty directory"
            for k in range(n):
                entry = at + head + k * size
                tag, kind, items = d.number(entry, "H"), d.number(entry + 2, "H"), d.number(entry + 4, offset)
                width, form = KINDS.get(kind, (0, ""))
                where = entry + size - room if items * width <= room else d.number(entry + size - room, offset)
                if where + items * width > len(data):
                    return "truncated"
                if tag in PARTS or tag in PARTS.values():
                    if form not in ("H", "I", "Q"):
                        return "places of the picture are no numbers"
                    tags[tag] = struct.unpack_from(d.order + form * items, data, where)
            for starts, lengths in PARTS.items():
                if starts in tags:
                    if len(tags[starts]) != len(tags.get(lengths, ())):
                        return "places of the picture without lengths"
                    if any(a + b > len(data) for a, b in zip(tags[starts], tags[lengths])):
                        return "truncated"
            at, count = d.number(at + head + n * size, offset), count + 1
        return None if count else "no directory"
    except struct.error:
        return "truncated"


def heif(data: memoryview) -> str | None:
    at, kinds = 0, set()
    while at < len(data):
        if at + 8 > len(data):
            return "truncated"
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8]), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or len(data) - at
        if size < head or at + size > len(data):
            return "truncated"
        kinds.add(kind)
        at += size
    return None if {b"meta", b"mdat"} <= kinds or {b"moov", b"mdat"} <= kinds else "no picture"


def problem_of(data: bytes) -> str | None:
    """What is wrong with an image, whose format is told by its first bytes."""
    view = memoryview(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return png(view)
    if data[:2] == b"\xff\xd8":
        return jpeg(view)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return gif(view)
    if data[:2] == b"BM":
        return bmp(view)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return webp(view)
    if data[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return tiff(view)
    if data[4:8] == b"ftyp":
        return heif(view)
    return "header mismatch"


def structure_problem(content: Column) -> Column:
    """problem_of() over rows; null where nothing is wrong, or for null bytes."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else problem_of(bytes(b)))

    return run(content)
