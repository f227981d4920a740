"""Metadata and integrity of planted files, byte by byte."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from albumen.sources import files, metadata, structure


def tiff(order="<", main=(), exif=(), gps=(), big=False):
    """A TIFF block of (tag, kind, values) entries; fractions are pairs."""
    word, size, room, pointer = ("Q", 20, 8, 16) if big else ("H", 12, 4, 4)
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "H", 43 if big else 42)
    head += struct.pack(order + "HHQ", 8, 0, 16) if big else struct.pack(order + "I", 8)
    main = list(main)
    offset_form = "Q" if big else "I"

    def length(entries):
        return struct.calcsize(word) + size * len(entries) + struct.calcsize(offset_form)

    main += [(0x8769, pointer, None)] * bool(exif) + [(0x8825, pointer, None)] * bool(gps)
    at = {"main": len(head)}
    at["exif"] = at["main"] + length(main)
    at["gps"] = at["exif"] + (length(exif) if exif else 0)
    end = at["gps"] + (length(gps) if gps else 0)
    out, heap = head, b""
    for entries in (main, exif, gps):
        if not entries:
            continue
        out += struct.pack(order + word, len(entries))
        for tag, kind, values in entries:
            values = [at["exif" if tag == 0x8769 else "gps"]] if values is None else values
            if isinstance(values, bytes):
                data, n = values, len(values)
            else:
                form = metadata.KINDS[kind][1]
                flat = [x for v in values for x in (v if isinstance(v, tuple) else (v,))]
                data, n = b"".join(struct.pack(order + f, x) for f, x in zip(form * len(values), flat)), len(values)
            out += struct.pack(order + "HH" + offset_form, tag, kind, n)
            if len(data) <= room:
                out += data.ljust(room, b"\0")
            else:
                out += struct.pack(order + offset_form, end + len(heap))
                heap += data
        out += struct.pack(order + offset_form, 0)
    return out + heap


def segment(marker, body):
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


def jpeg(block=None, picture=b"\x01\x02\xff\x00\x03" * 400, size=(6, 4)):
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += segment(0xE1, b"Exif\0\0" + block) if block else b""
    out += segment(0xDB, bytes(65)) + segment(0xC0, struct.pack(">BHHB", 8, size[1], size[0], 1) + b"\1\x11\0") + segment(0xC4, bytes(17))
    return out + segment(0xDA, b"\1\1\0\0\x3f\0") + picture + b"\xff\xd9"


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(block=None):
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0))
    out += chunk(b"eXIf", block) if block else b""
    return out + chunk(b"IDAT", zlib.compress(b"\0ab\0cd")) + chunk(b"IEND", b"")


def webp(block=None):
    body = b"VP8L" + struct.pack("<I", 5) + b"\x2f\1\0\0\0\0"
    body += b"EXIF" + struct.pack("<I", len(block)) + block + b"\0" * (len(block) % 2) if block else b""
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def gif(frames=2):
    out = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6)
    for _ in range(frames):
        out += b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\2" + b"\3abc" + b"\2de" + b"\0"
    return out + b"\x3b"


def bmp():
    return b"BM" + struct.pack("<IHHI", 54 + 16, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + bytes(range(1, 17))


def boxes():
    return struct.pack(">I4s4sI", 16, b"ftyp", b"heic", 0) + struct.pack(">I4s", 20, b"meta") + b"123456789012" + struct.pack(">I4s", 40, b"mdat") + b"x" * 32


MAIN = ((0x010F, 2, b"Nikon\0"), (0x0110, 2, b"D5\0"), (0x0112, 3, [6]), (0x0100, 4, [6000]), (0x011A, 5, [(300, 1)]), (0xBEEF, 3, [1, 2]))
EXIF = ((0x829A, 5, [(1, 250)]), (0x829D, 5, [(28, 10)]), (0x9003, 2, b"2024:05:06 07:08:09\0"), (0x9204, 10, [(-1, 3)]), (0x9286, 7, b"ASCII\0\0\0hi"), (0xA002, 3, [640]), (0x920A, 5, [(1, 0)]))
GPS = ((0, 1, b"\2\3\0\0"), (1, 2, b"S\0"), (2, 5, [(33, 1), (51, 1), (3540, 100)]), (3, 2, b"E\0"), (4, 5, [(151, 1), (12, 1), (0, 1)]))
WANT = {
    "Make": "Nikon", "Model": "D5", "Orientation": "6", "ImageWidth": "6000", "XResolution": "300.0", str(0xBEEF): "1, 2", "ExposureTime": "0.004", "FNumber": "2.8",
    "DateTimeOriginal": "2024:05:06 07:08:09", "ExposureBiasValue": str(-1 / 3), "UserComment": "ASCII\0\0\0hi", "ExifImageWidth": "640", "FocalLength": "nan", "GPS.GPSVersionID": "\2\3\0\0",
    "GPS.GPSLatitudeRef": "S", "GPS.GPSLatitude": "33.0, 51.0, 35.4", "GPS.GPSLongitudeRef": "E", "GPS.GPSLongitude": "151.0, 12.0, 0.0", "GPS.LatitudeDecimal": "-33.8598333", "GPS.LongitudeDecimal": "151.2",
}


def without_offset(found):
    return {k: v for k, v in found.items() if k != "ExifOffset"}


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [False, True])
def test_metadata_of_planted_files(order, big):
    block = tiff(order, MAIN, EXIF, GPS, big)
    raf = b"FUJIFILMCCD-RAW ".ljust(84, b"0") + struct.pack(">II", 100, len(jpeg(block))) + bytes(8) + jpeg(block)
    for data in (block, block + bytes(1000), jpeg(block), png(block), webp(block), webp(b"Exif\0\0" + block), raf):
        assert without_offset(metadata.of_bytes(data)) == WANT
    if not big:
        for start in (b"IIRO", b"IIRS", b"IIU\0") if order == "<" else (b"MMOR",):
            assert without_offset(metadata.of_bytes(start + block[4:])) == WANT


def test_files_without_metadata():
    for data in (b"", b"\xff", b"\xff\xd8", jpeg(), png(), webp(), gif(), bmp(), boxes(), b"II*\0", b"MM\0*\0\0\0\x08", tiff()):
        assert metadata.of_bytes(data) == {}


@pytest.mark.parametrize("order", "<>")
def test_broken_offsets_and_lengths_do_not_crash(order):
    """Every truncation, and every byte set to 0 and 255, gives some map of texts; loops end."""
    block = tiff(order, MAIN, EXIF, GPS)
    for data in (block, jpeg(block, b"x")):
        for at in range(len(data)):
            for broken in (data[:at], data[:at] + b"\xff" + data[at + 1 :], data[:at] + b"\0" + data[at + 1 :]):
                assert all(isinstance(k, str) and isinstance(v, str) for k, v in metadata.of_bytes(broken).items())
    loop = bytearray(tiff(order, ((0x8769, 4, [8]), (0x010F, 2, b"Nikon\0"))))
    assert metadata.of_bytes(bytes(loop)) == {"ExifOffset": "8", "Make": "Nikon"}


def test_metadata_over_rows(spark):
    block = tiff(">", MAIN, EXIF, GPS)
    rows = [("a.jpg", "native", jpeg(block)), ("b.nef", "raw", block), ("c.mp4", "video", block), ("d.png", "native", None), ("e.png", "native", b""), ("f.jpg", "native", jpeg(tiff("<", ((0x010E, 2, b"d" * 600 + b"\0"),))))]
    df = spark.createDataFrame([r + (1,) for r in rows], "path string, kind string, content binary, exif int")
    got = {r.path: r.exif for r in metadata.metadata(df).collect()}
    assert without_offset(got["a.jpg"]) == WANT and without_offset(got["b.nef"]) == WANT
    assert (got["d.png"], got["e.png"], got["f.jpg"]) == (None, {}, {"ImageDescription": "d" * 512 + "..."}) and "c.mp4" not in got


def test_trimmed_maps(spark):
    def plain(m):
        """As plain code: values, then the whole."""
        import json

        cut = {k: (v or "")[:512] + "..." * (len(v or "") > 512) for k, v in m.items()}
        if len(json.dumps(cut, ensure_ascii=False, separators=(",", ":"))) <= 60_000:
            return cut
        out, n = {}, 2
        for k in sorted(cut):
            n += len(k) + len(cut[k]) + 6
            if n > 60_000:
                break
            out[k] = cut[k]
        return out | {"EXIF.Truncated": "true"}

    maps = [{}, {"a": None, "b": "x" * 512, "c": "y" * 513}, {f"k{i:03}": "v" * 500 for i in range(130)}, {f"k{i:03}": "é\"\n" * 100 for i in range(118)}, {f"k{i:03}": "v" * (1000 - i) for i in range(116)}, {f"k{i:04}": "v" * 70 for i in range(740)}]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>")
    assert [r.m for r in df.select("i", files.trim_entries(F.col("m")).alias("m")).orderBy("i").collect()] == [plain(m) for m in maps]


def scans(n=3):
    """A JPEG of several scans with restarts and stuffed bytes."""
    out = jpeg()[:-2]
    for _ in range(n - 1):
        out += segment(0xC4, bytes(17)) + segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x01\xff\xd0\x02\xff\x00" * 30
    return out + b"\xff\xd9"


def picture(order="<", big=False):
    """A TIFF with strips: their places are known once its length is."""
    strips = [(0x0111, 4, [0, 0]), (0x0117, 4, [20, 12])]
    size = len(tiff(order, (*MAIN, *strips), big=big))
    return tiff(order, (*MAIN, (0x0111, 4, [size, size + 20]), strips[1]), big=big) + bytes(range(1, 33))


WHOLE = {"png": png(), "png with exif": png(tiff("<", MAIN)), "jpeg": jpeg(), "jpeg with exif": jpeg(tiff("<", MAIN, EXIF, GPS)), "scans": scans(), "gif": gif(), "bmp": bmp(), "webp": webp(), "webp with exif": webp(tiff("<", MAIN)), "heif": boxes(), "tiff": picture(), "big-endian": picture(">"), "bigtiff": picture("<", True)}


@pytest.mark.parametrize("name", WHOLE)
def test_each_truncation_is_told(name):
    data = WHOLE[name]
    assert structure.problem_of(data) is None
    # A HEIF file cut where a box ends is told by the boxes it lacks.
    assert [at for at in range(len(data)) if structure.problem_of(data[:at]) is None] == []


@pytest.mark.parametrize("name", ["png", "png with exif"])
def test_each_bit_flip_in_a_png_is_told(name):
    data = WHOLE[name]
    for at in range(len(data)):
        for bit in range(8):
            broken = bytearray(data)
            broken[at] ^= 1 << bit
            assert structure.problem_of(bytes(broken)) is not None, (at, bit)


@pytest.mark.parametrize("name", WHOLE)
def test_broken_bytes_never_crash(name):
    data = WHOLE[name]
    for at in range(len(data)):
        for value in (0, 255, data[at] ^ 1):
            structure.problem_of(data[:at] + bytes((value,)) + data[at + 1 :])


def test_flips_in_markers_and_blocks_are_told():
    data = WHOLE["scans"]
    marks = [k for k in range(len(data) - 1) if data[k] == 0xFF and data[k + 1] in (0xC0, 0xDA)]
    for k in [*marks[:1], 2, len(data) - 2]:
        for bit in range(8):
            broken = bytearray(data)
            broken[k] ^= 1 << bit
            assert structure.problem_of(bytes(broken)) is not None, (k, bit)
    for frames in (0, 1):
        assert (structure.problem_of(gif(frames)) is None) == (frames > 0)
    assert structure.problem_of(gif()[:13 + 6] + b"\x77" + gif()[13 + 7 :]) == "unknown block"
    assert structure.problem_of(b"text") == structure.problem_of(b"") == "header mismatch"


def test_data_behind_the_end_is_no_fault():
    for name in ("png", "jpeg", "scans", "gif", "bmp", "webp", "tiff"):
        assert structure.problem_of(WHOLE[name] + b"more bytes") is None, name


def test_integrity_over_rows(spark):
    rows = [("a.jpg", "native", jpeg()), ("b.jpg", "native", png()), ("c.png", "native", png()[:-1]), ("d.gif", "native", bytes(300)), ("e.nef", "raw", b"II" * 100), ("f.mp4", "video", bytes(2000)), ("g.mp4", "video", b"x" * 1024), ("h.braw", "cinema", b"x" * (1 << 20)), ("i.png", "native", None), ("j.tif", "native", b"text"), ("k.png", "native", b"")]
    df = spark.createDataFrame([r + ("clash",) for r in rows], "path string, kind string, content binary, problem string")
    assert {r.path: r.problem for r in files.integrity(df).collect()} == {"a.jpg": None, "b.jpg": None, "c.png": "truncated", "d.gif": "empty header", "e.nef": "too small", "f.mp4": "empty header", "g.mp4": None, "h.braw": None, "i.png": None, "j.tif": "header mismatch", "k.png": "empty header"}
