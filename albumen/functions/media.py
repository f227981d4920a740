"""Functions of photos, faces and their metadata, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumen.functions.text import file_extension

# File kinds by extension, and the least bytes of each.
NATIVE = ("tif", "tiff", "jpg", "jpeg", "png", "webp", "heic", "heif", "bmp", "gif")
RAW = (
    "cr2", "cr3", "crw", "nef", "nrw", "arw", "srf", "sr2", "dng", "orf", "rw2", "pef", "ptx", "raf", "raw", "rwl", "3fr", "fff", "mrw",
    "x3f", "erf", "mef", "mos", "kdc", "k25", "dcr", "dcs", "drf", "mdc", "srw", "rwz", "bay", "cap", "eip", "gpr", "pxn", "iiq",
)
CINEMA = ("ari", "braw", "r3d")
VIDEO = ("mp4", "mov", "m4v", "webm", "avi", "mkv", "3gp", "3g2", "mts", "m2ts", "mpg", "mpeg", "wmv")
# Gates of what faces are stored.
FACE_MIN, FACE_LOW, FACE_AREA, FACE_SIDE = 0.24, 0.32, 0.08, 0.42


def media_type(filename: Column) -> Column:
    return F.when(file_extension(filename).isin(*VIDEO), "video").otherwise("photo")


def first_filled(*values: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def exif_time(c: Column) -> Column:
    """`yyyy:MM:dd HH:mm:ss`, with or without an offset, from the first 26 characters; null for anything else."""
    text = F.left(F.trim(c), F.lit(26))
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ssXXX")))


def exif_local_date(c: Column) -> Column:
    """The date in the text's own offset."""
    return F.when(exif_time(c).isNotNull(), F.try_to_date(F.left(F.trim(c), F.lit(10)), "yyyy:MM:dd"))


CAPTURE_KEYS = ("DateTimeOriginal", "DateTime", "CreateDate", "MediaCreateDate", "TrackCreateDate")


def capture_text(exif: Column) -> Column:
    return first_filled(*[F.try_element_at(exif, F.lit(k)) for k in CAPTURE_KEYS])


def resolution(exif: Column) -> Column:
    """`width x height` from the first of three pairs of keys; 0 where there is no number."""
    keys = (("ImageWidth", "ImageHeight"), ("ExifImageWidth", "ExifImageHeight"), ("PixelXDimension", "PixelYDimension"))
    w, h = (first_filled(*[F.try_element_at(exif, F.lit(k[i])) for k in keys]).try_cast("int") for i in (0, 1))
    return F.struct(F.coalesce(w, F.lit(0)).alias("width"), F.coalesce(h, F.lit(0)).alias("height"))


def gps_decimal(text: Column, ref: Column, most: float = 180.0) -> Column:
    """Degrees, 7 places, from a decimal number within `most` or from degrees, minutes and seconds.

    A positive decimal number is turned by the references S and W; three numbers are turned by them whatever their
    sign. Six numbers are three fractions. Fewer than three numbers, or a fraction by 0, give null. A reference counts
    by its first letter.
    """
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.try_cast("double"))
    number = lambda i: F.try_element_at(parts, F.lit(i))
    ratio = lambda i: F.when(number(i + 1) != 0, number(i) / number(i + 1))
    d, m, s = (F.when(F.size(parts) >= 6, ratio(2 * k + 1)).when(F.size(parts) >= 3, number(k + 1)) for k in range(3))
    turned = F.left(F.upper(F.trim(F.coalesce(ref, F.lit("")))), F.lit(1)).isin("S", "W")
    plain = text.try_cast("double")
    plain = F.when(turned & (plain > 0), -plain).otherwise(plain)
    dms = (d + m / 60 + s / 3600) * F.when(turned, -1.0).otherwise(1.0)
    return F.round(F.when(F.abs(plain) <= most, plain).otherwise(dms), 7)


def coordinate(text: Column, most: float) -> Column:
    value = text.try_cast("double")
    return F.when(F.abs(value) <= most, F.round(value, 7))


def rotation(c: Column) -> Column:
    """Whole degrees within a turn; 0 for what is no number."""
    return F.coalesce(F.pmod(c.try_cast("int"), F.lit(360)), F.lit(0))


def truthy(c: Column) -> Column:
    """Booleans, numbers other than 0, and the words 1, true and yes."""
    text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(text.isin("1", "true", "yes") | (text.try_cast("double") != 0), F.lit(False))


def planar_distance(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """In degrees; absent coordinates are 0, unreadable ones give null."""
    y, x = (F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(c.try_cast("double")) for c in (lat, lon))
    return F.sqrt((y - lat0) * (y - lat0) + (x - lon0) * (x - lon0))


def face_passes(confidence: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """Confident enough, with a box; of low confidence only if the box is a small part of the image."""
    area = width * height / F.greatest(F.lit(1), image_width * image_height)
    side = F.greatest(width / F.greatest(F.lit(1), image_width), height / F.greatest(F.lit(1), image_height))
    trusted = (image_width <= 0) | (image_height <= 0) | (confidence >= FACE_LOW)
    return (confidence >= FACE_MIN) & (width > 0) & (height > 0) & (trusted | ((area <= FACE_AREA) & (side <= FACE_SIDE)))


def false_positive_face(confidence: Column, area: Column, side: Column) -> Column:
    return (confidence < 0.28) | ((confidence < 0.38) & ((area > 0.08) | (side > 0.42)))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (struct of left, top, width, height) over their union."""
    w = F.greatest(F.lit(0.0), F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"]))
    h = F.greatest(F.lit(0.0), F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"]))
    both = w * h
    union = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def clamp_box(left: Column, top: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    x = F.least(F.greatest(left, F.lit(0.0)), image_width)
    y = F.least(F.greatest(top, F.lit(0.0)), image_height)
    return F.struct(x.alias("left"), y.alias("top"), F.greatest(F.lit(0.0), F.least(width, image_width - x)).alias("width"), F.greatest(F.lit(0.0), F.least(height, image_height - y)).alias("height"))


# Fixed value: what identities of this form begin with.
FACE_PREFIX = "face-v1-"


def identity_key(user: Column, filename: Column, left: Column, top: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """A face's key: its owner, file and box in whole pixels (halves to even) within the image, as JSON by sorted names."""
    px = lambda c: F.greatest(F.lit(0), F.bround(F.coalesce(c.cast("double"), F.lit(0.0))).cast("long"))
    iw, ih = (F.greatest(F.lit(0), F.coalesce(c.cast("long"), F.lit(0))) for c in (image_width, image_height))
    x, y = (F.when(size > 0, F.least(px(c), size)).otherwise(px(c)) for c, size in ((left, iw), (top, ih)))
    w, h = (F.when(size > 0, F.least(px(c), F.greatest(F.lit(0), size - at))).otherwise(px(c)) for c, size, at in ((width, iw, x), (height, ih, y)))
    fields = {"filename": filename, "height": h, "imageHeight": ih, "imageWidth": iw, "left": x, "top": y, "userId": user, "v": F.lit(1), "width": w}
    return F.to_json(F.struct(*[c.cast("string" if k in ("filename", "userId") else "long").alias(k) for k, c in fields.items()]))


def face_id(*of: Column) -> Column:
    """The prefix and 40 hex digits of the SHA-256 of the identity key: one identity for every way in."""
    return F.concat(F.lit(FACE_PREFIX), F.left(F.sha2(identity_key(*of), 256), F.lit(40)))


def color_name(r: Column, g: Column, b: Column) -> Column:
    """A color's name from its hue, saturation and value (channels 0 to 255)."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = top - low
    saturation = F.when(top == 0, F.lit(0.0)).otherwise(spread / top)
    turn = F.when(spread == 0, F.lit(0.0)).when(top == r, (g - b) / spread).when(top == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4)
    hue = F.pmod(turn * 60, F.lit(360.0))
    return (
        F.when(top < 0.18, "black").when((saturation < 0.12) & (top > 0.82), "white").when(saturation < 0.12, "gray")
        .when((hue >= 18) & (hue < 48) & (top < 0.62) & (saturation > 0.32), "brown").when((hue >= 18) & (hue < 45), "orange")
        .when((hue >= 45) & (hue < 70), "yellow").when((hue >= 70) & (hue < 165), "green").when((hue >= 165) & (hue < 250), "blue")
        .when((hue >= 250) & (hue < 292), "purple").when((hue >= 292) & (hue < 340), "pink").otherwise("red")
    )
