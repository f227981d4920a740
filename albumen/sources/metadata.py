"""Metadata read from the bytes of images: EXIF directories of JPEG, TIFF (and RAW files built on it), PNG, WebP and RAF.

A file is walked by its own lengths and offsets; one that points outside the file, back to a directory that was read,
or to an unknown kind of value costs that entry alone. Nothing is decoded, and no byte is copied but the values'.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumen.sources.files import trim_entries

# The names of EXIF tags, by number.
TAGS = {
    0x000B: "ProcessingSoftware", 0x00FE: "NewSubfileType", 0x00FF: "SubfileType", 0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample",
    0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model",
    0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution",
    0x011B: "YResolution", 0x011C: "PlanarConfiguration", 0x0128: "ResolutionUnit", 0x012D: "TransferFunction", 0x0131: "Software", 0x0132: "DateTime",
    0x013B: "Artist", 0x013C: "HostComputer", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x014A: "SubIFDs", 0x0201: "JpegIFOffset",
    0x0202: "JpegIFByteCount", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling", 0x0213: "YCbCrPositioning", 0x0214: "ReferenceBlackWhite",
    0x02BC: "XMLPacket", 0x4746: "Rating", 0x4749: "RatingPercent", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x83BB: "IPTCNAA",
    0x8769: "ExifOffset", 0x8773: "InterColorProfile", 0x8822: "ExposureProgram", 0x8824: "SpectralSensitivity", 0x8825: "GPSInfo", 0x8827: "ISOSpeedRatings",
    0x8830: "SensitivityType", 0x8832: "RecommendedExposureIndex", 0x8833: "ISOSpeed", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal",
    0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9101: "ComponentsConfiguration",
    0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue",
    0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength",
    0x9214: "SubjectLocation", 0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubsecTime", 0x9291: "SubsecTimeOriginal", 0x9292: "SubsecTimeDigitized",
    0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject", 0xA000: "FlashPixVersion", 0xA001: "ColorSpace",
    0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA004: "RelatedSoundFile", 0xA005: "ExifInteroperabilityOffset", 0xA20B: "FlashEnergy",
    0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit", 0xA215: "ExposureIndex", 0xA217: "SensingMethod",
    0xA300: "FileSource", 0xA301: "SceneType", 0xA302: "CFAPattern", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance",
    0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation",
    0xA40A: "Sharpness", 0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber",
    0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber", 0xC612: "DNGVersion", 0xC614: "UniqueCameraModel",
}
# The names of GPS tags, in the order of their numbers from 0.
GPS_TAGS = (
    "GPSVersionID GPSLatitudeRef GPSLatitude GPSLongitudeRef GPSLongitude GPSAltitudeRef GPSAltitude GPSTimeStamp GPSSatellites GPSStatus GPSMeasureMode GPSDOP "
    "GPSSpeedRef GPSSpeed GPSTrackRef GPSTrack GPSImgDirectionRef GPSImgDirection GPSMapDatum GPSDestLatitudeRef GPSDestLatitude GPSDestLongitudeRef "
    "GPSDestLongitude GPSDestBearingRef GPSDestBearing GPSDestDistanceRef GPSDestDistance GPSProcessingMethod GPSAreaInformation GPSDateStamp GPSDifferential "
    "GPSHPositioningError"
).split()
EXIF_IFD, GPS_IFD = 0x8769, 0x8825
# Bytes and format of each kind of value; 1, 2 and 7 are bytes, texts and raw bytes, 5 and 10 fractions.
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
# What files built on TIFF begin with, and the order of their bytes.
TIFF_STARTS = {b"II*\0": "<", b"MM\0*": ">", b"II+\0": "<", b"MM\0+": ">", b"IIRO": "<", b"IIRS": "<", b"MMOR": ">", b"IIU\0": "<"}
#: Numbers of one value that are read: what is longer (tables of offsets, maker notes) is cut to this many before it is cut as text.
MOST_NUMBERS, MOST_BYTES = 600, 4096


class Directories:
    """The directories of a TIFF block, read by offset."""

    def __init__(self, data: memoryview):
        self.data, start = data, bytes(data[:4])
        self.order = TIFF_STARTS.get(start, "")
        self.big = start in (b"II+\0", b"MM\0+")
        self.seen: set[int] = set()

    def number(self, at: int, kind: str) -> int:
        if at > len(self.data):
            raise struct.error("beyond the file")
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def first(self) -> int:
        return self.number(8, "Q") if self.big else self.number(4, "I")

    def entries(self, at: int):
        """(tag, value) of the directory at an offset; a value is a text, bytes, or a list of numbers."""
        if at in self.seen or not 0 < at < len(self.data):
            return
        self.seen.add(at)
        head, size, room = (8, 20, 8) if self.big else (2, 12, 4)
        try:
            count = self.number(at, "Q" if self.big else "H")
        except struct.error:
            return
        for k in range(min(count, (len(self.data) - at - head) // size)):
            entry = at + head + k * size
            tag, kind, n = self.number(entry, "H"), self.number(entry + 2, "H"), self.number(entry + 4, "Q" if self.big else "I")
            if kind not in KINDS:
                continue
            width, form = KINDS[kind]
            where = entry + size - room
            if n * width > room:
                where = self.number(where, "Q" if self.big else "I")
            if where + n * width > len(self.data):
                continue
            yield tag, self.value(kind, form, where, n)

    def value(self, kind: int, form: str, at: int, n: int):
        if form == "s" or kind == 1:
            raw = bytes(self.data[at : at + min(n, MOST_BYTES)])
            return raw.split(b"\0", 1)[0].decode("utf-8", "replace") if kind == 2 else raw
        n = min(n, MOST_NUMBERS)
        numbers = struct.unpack_from(self.order + form * n, self.data, at)
        if len(form) == 2:
            return [a / b if b else float("nan") for a, b in zip(numbers[::2], numbers[1::2])]
        return list(numbers)


def as_text(value) -> str:
    """Bytes as UTF-8, numbers joined by commas, a fraction as a decimal number."""
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return value if isinstance(value, str) else ", ".join(map(str, value))


def degrees(value, ref: str) -> float | None:
    """Degrees, minutes and seconds as degrees, 7 places; turned for S and W."""
    if not isinstance(value, list) or len(value) < 3 or any(x != x for x in value[:3]):
        return None
    out = value[0] + value[1] / 60.0 + value[2] / 3600.0
    return round(-out if ref in ("S", "W") else out, 7)


def of_tiff(data: memoryview) -> dict[str, str]:
    """Entries of the first directory, the EXIF directory and the GPS directory; a name that comes twice keeps its first value."""
    tiff, out, gps = Directories(data), {}, {}
    if not tiff.order:
        return out
    try:
        queue = [(tiff.first(), TAGS, "")]
    except struct.error:
        return out
    while queue:
        at, names, prefix = queue.pop(0)
        for tag, value in tiff.entries(at):
            pointer = tag in (EXIF_IFD, GPS_IFD) and names is TAGS and isinstance(value, list) and len(value) == 1
            if pointer and tag == GPS_IFD:
                queue.append((value[0], dict(enumerate(GPS_TAGS)), "GPS."))
                continue
            if pointer:
                queue.append((value[0], TAGS, ""))
            out.setdefault(prefix + names.get(tag, str(tag)), as_text(value))
            if prefix:
                gps.setdefault(tag, value)
    ref = lambda tag, default: as_text(gps.get(tag, default)).upper()[:1] or default
    lat, lon = degrees(gps.get(2), ref(1, "N")), degrees(gps.get(4), ref(3, "E"))
    if lat is not None and lon is not None:
        out |= {"GPS.LatitudeDecimal": str(lat), "GPS.LongitudeDecimal": str(lon)}
    return out


def jpeg_segments(data: memoryview, at: int = 0):
    """(marker, first byte, end) of each segment up to the picture itself."""
    at += 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # padding
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, at + 4, min(at + 2 + size, len(data))
        at += 2 + size if marker not in (0x01, *range(0xD0, 0xD8)) else 2


def exif_block(data: memoryview) -> memoryview | None:
    """Where in a file its TIFF block lies, by the file's own format; None if there is none."""
    head = bytes(data[:16])
    if head[:4] in TIFF_STARTS:
        return data
    if head[:2] == b"\xff\xd8":
        for marker, at, end in jpeg_segments(data):
            if marker == 0xE1 and bytes(data[at : at + 6]) == b"Exif\0\0":
                return data[at + 6 : end]
    elif head[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8])
            if kind == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size, kind = int.from_bytes(data[at + 4 : at + 8], "little"), bytes(data[at : at + 4])
            if kind == b"EXIF":
                block = data[at + 8 : at + 8 + size]
                return block[6:] if bytes(block[:6]) == b"Exif\0\0" else block
            at += 8 + size + size % 2
    elif head == b"FUJIFILMCCD-RAW ":
        at = int.from_bytes(data[84:88], "big")
        return exif_block(data[at : at + int.from_bytes(data[88:92], "big")]) if 92 < at < len(data) else None
    return None


def of_bytes(data: bytes) -> dict[str, str]:
    block = exif_block(memoryview(data))
    return of_tiff(block) if block is not None else {}


def read_metadata(content: Column) -> Column:
    """The metadata map of a file's bytes, untrimmed; empty where there is none, null for null bytes. A task holds the files
    of one Arrow batch, which Spark bounds by bytes."""

    @F.pandas_udf("map<string,string>")
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else of_bytes(bytes(b)))

    return run(content)


def metadata(files: DataFrame) -> DataFrame:
    """path and exif (trimmed) of media_files(); videos are not opened."""
    rows = files.where("kind in ('native', 'raw')")
    return rows.select("path", trim_entries(read_metadata(F.col("content"))).alias("exif"))
