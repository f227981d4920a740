"""Media files as binary rows: kinds, integrity, metadata entries and embedded previews."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumen.functions import media

# Least bytes by kind of file; the sizes to which metadata entries and all of them are cut.
LEAST_BYTES = {"raw": 512 * 1024, "cinema": 1024 * 1024, "video": 1024}
HEADER_BYTES = 4096
ENTRY_CHARS, ALL_CHARS, TRUNCATED = 512, 60_000, "EXIF.Truncated"
PREVIEW_BYTES = 1024


def kind_of(path: Column) -> Column:
    ext = media.file_extension(path)
    return F.when(ext.isin(*media.NATIVE), "native").when(ext.isin(*media.RAW), "raw").when(ext.isin(*media.CINEMA), "cinema").when(ext.isin(*media.VIDEO), "video")


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, length, modificationTime and content of files with a known extension; other files are not opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.withColumn("kind", kind_of(F.col("path"))).where("kind is not null")


def integrity(files: DataFrame) -> DataFrame:
    """path, kind, and what is wrong: too small, an empty header, a broken image, or nothing.

    RAW and cinema files and videos have a least size and a header that is not all zeros. Native images have no least
    size: their format is told by their first bytes, whatever their extension, and walked to its end.
    """
    from albumen.sources.structure import structure_problem

    least = F
    for k, n in LEAST_BYTES.items():
        least = least.when(F.col("kind") == k, n)
    native = F.col("kind") == "native"
    empty = ~F.hex(F.substring("content", 1, HEADER_BYTES)).rlike("[1-9A-F]")
    small = ~native & (F.octet_length("content") < least.otherwise(0))
    sized = files.withColumn("__problem", F.when(small, "too small").when(empty, "empty header"))
    # Only images that passed so far go to Python: the others' bytes are null there.
    walked = structure_problem(F.when(native & F.col("__problem").isNull(), F.col("content")))
    return sized.select("path", "kind", F.coalesce("__problem", walked).alias("problem"))


def trim_entries(entries: Column) -> Column:
    """A metadata map as it is stored: values of over 512 characters are cut there and end in `...`; if the map then has over
    60 000 characters as JSON, its first keys in order whose texts fit, with 6 characters more for each, and a mark."""
    texts = F.transform_values(entries, lambda k, v: F.coalesce(v, F.lit("")))
    cut = F.transform_values(texts, lambda k, v: F.when(F.length(v) > ENTRY_CHARS, F.concat(F.left(v, F.lit(ENTRY_CHARS)), F.lit("..."))).otherwise(v))
    pairs = F.array_sort(F.map_entries(cut))
    start = F.struct(F.lit(2).alias("n"), F.lit(True).alias("fits"), F.slice(pairs, 1, 0).alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        n = acc["n"] + F.length(e["key"]) + F.length(e["value"]) + 6
        fits = acc["fits"] & (n <= ALL_CHARS)
        return F.struct(n.alias("n"), fits.alias("fits"), F.when(fits, F.concat(acc["kept"], F.array(e))).otherwise(acc["kept"]).alias("kept"))

    kept = F.map_from_entries(F.aggregate(pairs, start, step)["kept"])
    mark = F.map_from_arrays(F.array(F.lit(TRUNCATED)), F.array(F.lit("true")))
    return F.when(F.length(F.to_json(cut)) > ALL_CHARS, F.map_concat(kept, mark)).otherwise(cut)


def merge_maps(first: Column, later: Column) -> Column:
    """Later keys win."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(later, k)), later)


def longest_jpeg(data: bytes, least: int = PREVIEW_BYTES) -> bytes | None:
    """The longest JPEG in a RAW file's bytes that is over `least` bytes and has a frame."""
    best, at = None, data.find(b"\xff\xd8\xff")
    while at >= 0:
        end = data.find(b"\xff\xd9", at + 2)
        if end < 0:
            break
        part = data[at : end + 2]
        if len(part) > least and any(bytes((255, m)) in part for m in (0xC0, 0xC1, 0xC2)) and (best is None or len(part) > len(best)):
            best = part
        at = data.find(b"\xff\xd8\xff", end + 2)
    return best


def previews(files: DataFrame) -> DataFrame:
    """path and the preview in each RAW file, where there is one."""

    @F.pandas_udf("binary")
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: longest_jpeg(bytes(b)), na_action="ignore")

    return files.where("kind = 'raw'").select("path", run("content").alias("preview")).where("preview is not null")


def best_preview(df: DataFrame, by: str) -> DataFrame:
    """Of an image's previews the one with the longest edge, then the largest area, then the smallest id."""
    rank = F.struct(F.greatest("width", "height").alias("edge"), (F.col("width") * F.col("height")).alias("area"), (-F.col("preview_id")).alias("first"))
    return df.groupBy(by).agg(F.max_by("preview_id", rank).alias("preview_id"), F.max(F.greatest("width", "height")).alias("edge"))


def sha256_matches(content: Column, expected: Column) -> Column:
    return F.sha2(content, 256) == F.lower(F.trim(expected))
