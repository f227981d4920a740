"""Keyed tables in Parquet: scans, lookups, upserts, vector indexes and their manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from albumen.functions import vectors
from albumen.sources.snapshots import Snapshots


def scan(spark: SparkSession, path: str, library: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table, of one library and some columns; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df.where(F.col("library_id") == library) if library is not None else df
    return df.select(*columns) if columns else df


def lookup(df: DataFrame, **keys) -> DataFrame:
    """The rows of a key; none if it is not there."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in keys.items()]))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str, deleted: str | None = None) -> DataFrame:
    """The latest version of every key; of equal versions, a change beats the base. A key whose latest row is
    marked deleted is gone, and changes to a key that the base marks deleted are refused."""
    if deleted:
        dead = base.where(F.coalesce(deleted, F.lit(False))).select(*keys)
        changes = changes.join(dead, keys, "left_anti")
    rows = base.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = W.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    rows = rows.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "__new")
    return rows.where(~F.coalesce(deleted, F.lit(False))) if deleted else rows


def vector_index(df: DataFrame, key: str, photo: str, text: str, version_col: str, version: str, size: int) -> DataFrame:
    """(key, embedding): the stored photo vector if its version and size fit, else the text vector; unit length;
    rows without a usable vector are left out."""
    fits = (F.col(version_col) == version) & (F.size(photo) == size)
    v = vectors.unit(F.when(fits, F.col(photo)).otherwise(F.col(text)).cast("array<double>"))
    return df.select(key, v.alias("embedding")).where("embedding is not null")


def save_index(index: DataFrame, path: str, source_version: str, embedding_version: str) -> None:
    """A version of the index; one that is being read stays as it is."""
    note = {"source_version": source_version, "embedding_version": embedding_version, "dirty": False}
    Snapshots(index.sparkSession, path).replace(index, note)


def mark_dirty(spark: SparkSession, path: str) -> None:
    """Let no reader use the latest index until it is built again; no vector is written."""
    log = Snapshots(spark, path)
    last = log.version()
    if last:
        log.restore(last.number, last.note | {"dirty": True}, after=last.number)


def load_index(spark: SparkSession, path: str, source_version: str, embedding_version: str) -> DataFrame | None:
    """The latest vectors, or None if there are none, or they are of other versions or marked dirty."""
    log = Snapshots(spark, path)
    last = log.version()
    if last is None or last.note["dirty"] or (last.note["source_version"], last.note["embedding_version"]) != (source_version, embedding_version):
        return None
    return log.read(last.number)


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def owners(df: DataFrame, col: str = "user_id", most: int = 200) -> DataFrame:
    """The first distinct owners."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(most)


def archive_selection(album: DataFrame, wanted: DataFrame) -> DataFrame:
    """The album's photos that were asked for; all of them if none was."""
    n = wanted.agg(F.count("*").alias("n"))
    hit = wanted.select("filename").distinct().withColumn("hit", F.lit(True))
    return album.join(hit, "filename", "left").crossJoin(F.broadcast(n)).where(F.col("hit") | (F.col("n") == 0)).drop("hit", "n")


def geocoded(photos: DataFrame, places: DataFrame) -> DataFrame:
    """Photos with the address, city and country of their place; the city falls back to town, then village."""
    rows = photos.join(F.broadcast(places) if places.isLocal() else places, "place_id", "left")
    return rows.select("photo_id", "address", F.coalesce("city", "town", "village", "state").alias("city"), "country")
