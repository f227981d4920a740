"""Smart albums: photos grouped by place, day, person or tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.functions import media
from albumen.functions.text import normalize_phrase, title_case


def keyed(df: DataFrame, rule: str, names: DataFrame | None = None) -> DataFrame:
    """(key, label, filename, at, pos) of every photo's groups under a rule: location, recent, event, tag or person.

    `at` is when the photo was uploaded for the rule recent, else when it was taken, or uploaded where that is unknown.
    """
    up = F.col("uploaded")
    taken = F.coalesce(media.exif_time(F.col("captured")), up)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    spoken = lambda c: F.date_format(c, "MMM d, yyyy")
    if rule == "location":
        point = F.when(media.first_filled("latitude").isNotNull() & media.first_filled("longitude").isNotNull(), F.concat(F.left("latitude", F.lit(8)), F.lit(", "), F.left("longitude", F.lit(8))))
        both = F.concat_ws(", ", media.first_filled("city"), media.first_filled("country"))
        label = F.coalesce(media.first_filled(both), media.first_filled("address"), point)
        rows = df.select(normalize_phrase(label).alias("key"), F.concat(F.lit("Location: "), title_case(label)).alias("label"), "filename", taken.alias("at"), "pos")
    elif rule == "recent":
        rows = df.select(day(up).alias("key"), F.concat(F.lit("Uploaded: "), spoken(up)).alias("label"), "filename", up.alias("at"), "pos")
    elif rule == "event":
        rows = df.select(day(taken).alias("key"), F.concat(F.lit("Event: "), spoken(taken)).alias("label"), "filename", taken.alias("at"), "pos")
    elif rule == "tag":
        terms = F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("objects", F.array().cast("array<string>"))))
        rows = df.select(F.posexplode(terms).alias("k", "term"), "filename", taken.alias("at"), "pos")
        rows = rows.select(normalize_phrase(F.col("term")).alias("key"), F.concat(F.lit("Tag/Object: "), title_case(F.col("term"))).alias("label"), "filename", "at", F.struct("pos", "k").alias("pos"))
    elif rule == "person":
        ids = F.array_distinct(F.filter(F.transform("people", lambda x: F.trim(x)), lambda x: x != ""))
        rows = df.select(F.explode(ids).alias("person_id"), "filename", taken.alias("at"), "pos").join(names, "person_id", "left")
        label = F.coalesce(media.first_filled("name"), F.concat(F.lit("Person "), F.left("person_id", F.lit(8))))
        rows = rows.select(F.col("person_id").alias("key"), F.concat(F.lit("Person: "), title_case(label)).alias("label"), "filename", "at", "pos")
    else:
        raise ValueError(f"no such rule: {rule}")
    return rows.where(F.coalesce("key", F.lit("")) != "")


def fold(rows: DataFrame) -> DataFrame:
    """One row per key: name of the first row, latest time, number of distinct files."""
    return rows.groupBy("key").agg(F.min_by("label", "pos").alias("name"), F.max("at").alias("latest"), F.count_distinct("filename").alias("n"))


def ranked(groups: DataFrame, rule: str) -> DataFrame:
    """By time for rules of time, else by size; both descending, then by name."""
    first = ["latest", "n"] if rule in ("recent", "event") else ["n", "latest"]
    return groups.orderBy(*[F.col(c).desc_nulls_last() for c in (*first, "name")], F.col("key"))


def next_album(groups: DataFrame, rule: str, existing: DataFrame) -> DataFrame:
    """The best group whose name no album has."""
    taken = existing.select(F.lower(F.trim("name")).alias("low")).distinct()
    fresh = groups.join(taken, F.lower(F.trim(groups["name"])) == taken["low"], "left_anti")
    return ranked(fresh, rule).limit(1)


def files_in_order(rows: DataFrame) -> DataFrame:
    """Each key's distinct files in the order first seen."""
    first = rows.groupBy("key", "filename").agg(F.min("pos").alias("pos"))
    return first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "filename"))), lambda x: x["filename"]).alias("filenames"))
