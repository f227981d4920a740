"""Filters, projections and orders of photo listings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumen.functions import media, vectors
from albumen.functions.text import file_extension, normalize_phrase
from albumen.operators.once import computed_once

# What makes a RAW file's failure an integrity failure.
INTEGRITY_WORDS = ("too small", "header", "signature", "decode", "embedded preview", "sha256")
DEGREES_PER_KM = 0.01
PAGE = 24


def rated(df: DataFrame, least_rating: int = 0, least_likes: int = 0) -> DataFrame:
    """At least so much of both; missing counts as 0."""
    return df.where((F.coalesce("rating", F.lit(0)) >= least_rating) & (F.coalesce("likes", F.lit(0)) >= least_likes))


def captured_between(df: DataFrame, first: str | None, last: str | None, exif_col: str = "captured") -> DataFrame:
    """Capture date within both days; rows without a readable one go if a limit is given."""
    date = media.exif_local_date(F.col(exif_col))
    if first:
        df = df.where(date >= F.lit(first).cast("date"))
    return df.where(date <= F.lit(last).cast("date")) if last else df


def within_radius(df: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Within a planar radius; rows whose coordinates can't be read stay."""
    far = media.planar_distance(F.col("latitude"), F.col("longitude"), lat, lon)
    return df.where(far.isNull() | (far <= km * DEGREES_PER_KM))


def listing(df: DataFrame, by: str = "date", key: str = "photo_id") -> DataFrame:
    """The library's order: rating, likes, capture or date descending; `location` by lower-case file name."""
    orders = {
        "rating": [F.coalesce("rating", F.lit(0)).desc()],
        "likes": [F.coalesce("likes", F.lit(0)).desc()],
        "capture": [F.coalesce(media.exif_time(F.col("captured")), F.col("uploaded")).desc_nulls_last()],
        "location": [F.lower("filename").asc()],
    }
    return df.orderBy(*orders.get(by, [F.col("uploaded").desc_nulls_last()]), F.col(key).asc())


def page(df: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A slice of an ordered frame."""
    return df.offset(max(0, offset)).limit(max(0, limit))


def page_with_total(df: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A slice of an ordered frame, each row with `total`, the number of rows before slicing."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, offset, limit).crossJoin(F.broadcast(total))


def recent(df: DataFrame, limit: int, key: str = "photo_id") -> DataFrame:
    """The latest uploads; those without a time come last, as of 1970."""
    return df.withColumn("uploaded", F.coalesce("uploaded", F.lit("1970-01-01").cast("timestamp"))).orderBy(F.desc("uploaded"), F.col(key).asc()).limit(limit)


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Of rows that agree in the keys (columns; null agrees with null), the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


# The part of an image that is sampled (left, right, top, bottom), the pixels aimed at, the least alpha,
# weight and share of a color.
COLOR_BOX, COLOR_PIXELS, COLOR_ALPHA, COLOR_WEIGHT, COLOR_SHARE = (0.22, 0.78, 0.36, 0.92), 12_000, 32, 40.0, 0.18


def dominant_color(pixels: DataFrame, key: str = "photo_id") -> DataFrame:
    """(key, color, share) of images with a color that is heavy enough in their lower middle; lower rows weigh more.
    pixels: key, image_width, image_height, x, y, r, g, b and a (null: opaque)."""
    edge = lambda c, share, up: (F.ceil if up else F.floor)(F.col(c) * F.lit(share))
    left, right, top, bottom = (edge(c, s, up) for c, s, up in zip(("image_width", "image_width", "image_height", "image_height"), COLOR_BOX, (False, True, False, True)))
    stride = F.greatest(F.lit(1), F.floor(F.sqrt((right - left) * (bottom - top) / F.lit(COLOR_PIXELS))))
    inside = (F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= top) & (F.col("y") < bottom)
    sampled = ((F.col("x") - left) % stride == 0) & ((F.col("y") - top) % stride == 0) & (F.coalesce("a", F.lit(255)) >= COLOR_ALPHA)
    weight = F.lit(0.75) + (F.col("y") - top) / F.greatest(F.lit(1), bottom - top) * 0.5
    rows = pixels.where(inside & sampled).select(key, media.color_name(F.col("r"), F.col("g"), F.col("b")).alias("color"), weight.alias("w"))
    sums = rows.groupBy(key, "color").agg(F.sum("w").alias("w"))
    best = sums.groupBy(key).agg(F.sum("w").alias("total"), F.max(F.struct("w", "color")).alias("best"))
    share = F.col("best.w") / F.col("total")
    return best.where((F.col("total") >= COLOR_WEIGHT) & (share >= COLOR_SHARE)).select(key, "best.color", share.alias("share"))


def filtered(df: DataFrame, rating: int = 0, likes: int = 0, first: str | None = None, last: str | None = None, near: tuple | None = None) -> DataFrame:
    """All filters of the filter page, best first."""
    df = captured_between(rated(df, rating, likes), first, last)
    df = within_radius(df, *near) if near else df
    return df.orderBy(F.coalesce("rating", F.lit(0)).desc(), F.coalesce("likes", F.lit(0)).desc(), F.col("photo_id").asc())


def corrupted(df: DataFrame) -> DataFrame:
    """Failed uploads, typed; RAW files only for integrity failures. Latest first."""
    reason = F.coalesce(media.first_filled(F.col("verification_error"), F.col("last_error")), F.lit(""))
    serious = F.lit(False)
    for w in INTEGRITY_WORDS:
        serious = serious | F.lower(reason).contains(w)
    mismatch = F.lower(F.coalesce(F.col("sha256_match").cast("string"), F.lit(""))) == "false"
    raw = file_extension(F.col("filename")).isin(*media.RAW)
    failed = (F.coalesce("verification_status", F.lit("")) == "failed") | F.coalesce("corrupted", F.lit(False))
    kind = F.when(mismatch, "hash_mismatch").when(reason != "", "parse_error").otherwise("unknown")
    return df.where(failed & (~raw | serious | mismatch)).select("photo_id", "filename", reason.alias("reason"), kind.alias("corruption_type"), "uploaded").orderBy(F.col("uploaded").desc_nulls_last(), "photo_id")


def has_people(ids: Column, groups: list[list[str]]) -> Column:
    """At least one id of every group."""
    out = F.lit(True)
    for g in groups:
        out = out & F.arrays_overlap(ids, F.array(*map(F.lit, g)))
    return out


def in_places(address: Column, city: Column, country: Column, terms: list[str]) -> Column:
    """Any of the normalised terms is part of the normalised place."""
    text = normalize_phrase(F.concat_ws(" ", address, city, country))
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def album_view(df: DataFrame, liked: bool = False, rating: int = 0, text: str = "") -> DataFrame:
    """Liked only, rating and a text anywhere in name, tags, address or coordinates."""
    hay = F.lower(F.concat_ws(" ", "filename", F.array_join("tags", " "), "address", "latitude", "longitude", "captured"))
    df = df.where(F.col("liked")) if liked else df
    return df.where((F.coalesce("rating", F.lit(0)) >= rating) & hay.contains(text.lower()))


def summary(df: DataFrame, user: str) -> DataFrame:
    """What a listing shows of a photo."""
    size = media.resolution(F.col("exif"))
    return df.select(
        "photo_id", "filename", F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("likes", F.lit(0)).alias("likes"),
        F.coalesce(F.array_contains("liked_by", user), F.lit(False)).alias("liked"), F.array_join("tags", ",").alias("tags"),
        media.first_filled(F.col("city"), F.col("address")).alias("place"), size["width"].alias("width"), size["height"].alias("height"),
        media.capture_text(F.col("exif")).alias("captured"),
    )


def albums_open(df: DataFrame, now: Column) -> DataFrame:
    """Public albums with a token that has not expired."""
    return df.where(F.col("is_public") & (F.coalesce("token", F.lit("")) != "") & (F.col("expires").isNull() | (F.col("expires") > now)))


def album_photos(albums: DataFrame, photos: DataFrame) -> DataFrame:
    """The photos that an album lists and that exist, in its order. albums: album_id, filenames."""
    listed = albums.select("album_id", F.posexplode("filenames").alias("pos", "filename"))
    return listed.join(photos, "filename")


def duplicates(df: DataFrame, hash_col: str, key: str) -> DataFrame:
    """Rows that share a non-empty hash, with the smallest key and the number of their group."""
    groups = df.where(F.coalesce(hash_col, F.lit("")) != "").groupBy(hash_col).agg(F.min(key).alias("first_key"), F.count("*").alias("copies")).where("copies > 1")
    return df.join(groups, hash_col).select(key, hash_col, "first_key", "copies")


#: Bands beyond the differences: so many of a hash's bands are equal in two that are near each other.
EXTRA_BANDS = 3


def _differing(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Differing characters of two hashes of one length: of hexadecimal ones (numbers x and y) by counting the digits of
    their exclusive or that are not 0, of others one by one."""
    z = x.bitwiseXOR(y)
    digit = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
    return F.when(z.isNotNull(), F.bit_count(digit.bitwiseAND(F.lit(0x1111111111111111)))).otherwise(vectors.hamming(a, b))


def near_duplicates(df: DataFrame, hash_col: str = "perceptual_hash", key: str = "photo_id", most: int = 5, extra: int = EXTRA_BANDS) -> DataFrame:
    """Pairs of hashes of one length at `most` or fewer differing characters, with 100 - 5 for each.

    A hash is cut into most + extra bands (or as many as it has characters), so two such hashes are equal in `extra` of
    them: hashes meet where a combination of that many bands is equal, and a pair is made at the first combination that it
    shares. At 5 differences 56 combinations of three of 8 bands, which hold 3/8 of the characters. Hashes of `most`
    or fewer characters are all pairs of their length. Hashes are made distinct first: copies meet once. Returns
    pairs of representatives (smallest key of each hash).
    """
    reps = df.where(F.coalesce(hash_col, F.lit("")) != "").groupBy(F.col(hash_col).alias("h")).agg(F.min(key).alias("k"))
    number = F.when(F.col("h").rlike("^[0-9a-f]{1,16}$"), F.conv("h", 16, -10).cast("long"))
    # Of its own number of partitions: each row becomes dozens, which sizes before it do not show.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = reps.select("h", "k", number.alias("x")).repartition(tasks, "k")

    def bands(h: str) -> Column:
        count, n = F.least(F.length(h), F.lit(most + extra)), F.length(h)
        edge = lambda i: F.floor(n * i / count).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col(h), edge(i) + 1, edge(i + 1) - edge(i)))

    def chosen(count: int) -> Column:
        """The combinations of bands, each with a bit set for every band."""
        at = lambda c: [F.lit(c[j] if j < len(c) else None).cast("int").alias(f"b{j}") for j in range(extra)]
        return F.array(*[F.struct(F.lit(sum(1 << i for i in c)).alias("mask"), *at(c)) for c in combinations(range(count), count - most)])

    choice = F.when(F.length("h") <= most, chosen(most))
    for count in range(most + 1, most + extra):
        choice = choice.when(F.length("h") == count, chosen(count))
    hashed = F.transform(bands("h"), lambda part, i: F.xxhash64(F.length("h"), i, part))
    rows = computed_once(reps.select("*", hashed.alias("parts"))).select("*", F.explode(choice.otherwise(chosen(most + extra))).alias("c"))
    # A combination's hash is the exclusive or of its bands'.
    mixed = F.length("h").cast("long")
    for j in range(extra):
        mixed = mixed.bitwiseXOR(F.coalesce(F.get("parts", F.col(f"c.b{j}")), F.lit(0)))
    # A row is sent once a combination, so narrow: a hash that is a number is sent as that and its length.
    text = F.when(F.col("x").isNull(), F.col("h"))
    spread = rows.select(text.alias("h"), F.length("h").cast("short").alias("n"), "k", "x", F.col("c.mask").cast("short").alias("mask"), F.xxhash64("c.mask", mixed).alias("hash"))
    a, b = (spread.select("hash", *[F.col(c).alias(f"{c}{i}") for c in ("mask", "h", "n", "k", "x")]) for i in (1, 2))
    # By merging: sizes are estimated from before the rows were multiplied, so a large table could be broadcast. By one
    # number, which sorts fastest; that the combinations are equal, and not only their hashes, is no key of the join.
    pairs = a.hint("merge").join(b.hint("merge"), "hash").where("k1 < k2 and n1 - n2 = 0 and mask1 - mask2 = 0").withColumnRenamed("mask1", "mask")
    near = pairs.withColumn("distance", _differing(F.col("h1"), F.col("h2"), F.col("x1"), F.col("x2"))).where(F.col("distance") <= most)
    digits = lambda i: F.coalesce(f"h{i}", F.lpad(F.lower(F.hex(f"x{i}")), F.col(f"n{i}").cast("int"), F.lit("0")))
    near = near.withColumns({"h1": digits(1), "h2": digits(2)})
    # The lowest equal bands of a pair, as many as a combination has: the one at which the pair is made.
    equal = F.zip_with(bands("h1"), bands("h2"), lambda p, q: (p == q).cast("int"))
    left = F.aggregate(F.reverse(equal), F.lit(0), lambda bits, e: bits * 2 + e)
    near, taken = computed_once(near.withColumn("left", left)), F.lit(0)
    for i in range(extra):
        more = F.length("h1") - most > i
        taken = taken + F.when(more, F.col(f"left{i}").bitwiseAND(-F.col(f"left{i}"))).otherwise(0)
    lowest = [F.col("left")]
    for _ in range(extra - 1):
        lowest.append(lowest[-1].bitwiseAND(lowest[-1] - 1))
    near = near.select("*", *(c.alias(f"left{i}") for i, c in enumerate(lowest)))
    return near.where(F.col("mask") == taken).select("k1", "k2", "distance", (100 - 5 * F.col("distance")).alias("similarity"))
