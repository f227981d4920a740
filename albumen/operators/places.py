"""The nearest place of each photo, exactly, on the sphere.

Coordinates become points of the unit sphere, so that neither the poles nor the date line are special: the nearest
place on the ground is the one with the shortest chord. Places are grouped into cubic cells of ever smaller edges, as
far as a cell holds many of them; each cell knows the box of its places. A search goes down level by level: of a
location's cells only those are kept whose box may hold something nearer than the furthest corner of another one's.
What is left at the end is joined with the places themselves.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from albumen.functions import media
from albumen.operators.graph import materialise, release

EARTH_KM = 6371.0088
#: Halvings of the cube around the sphere in all, at a step, and places of a cell that is not cut further.
DEPTH, STEP, LEAF_PLACES = 20, 2, 32
#: Rounding of a squared chord, by which boxes are kept too many rather than too few.
SLACK = 1e-12
_BOX = [f"{side}_{axis}" for axis in "xyz" for side in ("low", "high")]


def points(lat: Column, lon: Column) -> list[Column]:
    """x, y and z on the unit sphere."""
    lat, lon = F.radians(lat), F.radians(lon)
    return [(F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")]


def chord_km(squared: Column) -> Column:
    """Kilometres on the ground of a squared chord."""
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(squared) / 2))


def _cell(level: int) -> Column:
    part = lambda axis: F.shiftright(F.least(F.floor((F.col(axis) + 1) / 2 * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long"), DEPTH - level)
    return (F.shiftleft(part("x"), 2 * DEPTH) + F.shiftleft(part("y"), DEPTH) + part("z")).alias("cell")


def _cells(places: DataFrame, level: int) -> DataFrame:
    """parent, cell, n and the box of each cell of a level."""
    parent = _cell(max(0, level - STEP)).alias("parent")
    box = [getattr(F, f)(axis).alias(f"{side}_{axis}") for axis in "xyz" for side, f in (("low", "min"), ("high", "max"))]
    return places.groupBy(parent, _cell(level)).agg(F.count("*").alias("n"), *box)


def _bounds(get) -> tuple[Column, Column]:
    """Squared distances of a location to the nearest and the furthest point that a box can hold."""
    low = high = F.lit(0.0)
    for axis in "xyz":
        a, b = get(f"low_{axis}") - F.col(axis), F.col(axis) - get(f"high_{axis}")
        inside = F.greatest(F.lit(0.0), a, b)
        outside = F.greatest(F.abs(a), F.abs(b))
        low, high = low + inside * inside, high + outside * outside
    return low, high


def _search(locations: DataFrame, places: DataFrame) -> DataFrame:
    """(lat, lon, place_id, squared): of equally near places the one with the smallest id. Both have x, y and z."""
    top = [r.asDict() for r in _cells(places, STEP).drop("parent").collect()]  # 64 cells at most
    kind = "array<struct<cell:long,n:long," + ",".join(f"{c}:double" for c in _BOX) + ">>"
    node = F.explode(F.from_json(F.lit(json.dumps(top)), kind)).alias("node")
    own = ["lat", "lon", "x", "y", "z"]
    frontier = locations.select(*own, node).select(*own, F.lit(STEP).alias("level"), "node.*")
    nearest = W.partitionBy("lat", "lon")

    def kept(rows: DataFrame, level: int) -> DataFrame:
        """The cells that may hold a location's nearest place, written."""
        low, high = _bounds(F.col)
        rows = rows.withColumn("__low", low).withColumn("__best", F.min(high).over(nearest))
        return materialise(rows.where(F.col("__low") <= F.col("__best") + SLACK).drop("__low", "__best"), f"cells{level}")

    frontier, level = kept(frontier, STEP), STEP
    while level < DEPTH:
        cut = (F.col("level") == level) & (F.col("n") > LEAF_PLACES)
        if frontier.where(cut).isEmpty():
            break
        level += STEP
        below = frontier.where(cut).select(*own, F.col("cell").alias("parent")).join(_cells(places, level), "parent").select(*own, F.lit(level).alias("level"), "cell", "n", *_BOX)
        after = kept(frontier.where(~cut).unionByName(below), level)
        release(frontier)
        frontier = after
    found = None
    for at in range(STEP, level + 1, STEP):
        inside = places.select("place_id", *(F.col(axis).alias(f"p{axis}") for axis in "xyz"), _cell(at))
        rows = frontier.where(F.col("level") == at).select(*own, "cell").join(inside, "cell")
        found = rows if found is None else found.unionByName(rows)
    d = sum(((F.col(axis) - F.col(f"p{axis}")) * (F.col(axis) - F.col(f"p{axis}")) for axis in "xyz"), F.lit(0.0))
    best = found.withColumn("squared", d).groupBy("lat", "lon").agg(F.min(F.struct("squared", "place_id")).alias("best"))
    return best.select("lat", "lon", F.col("best.place_id").alias("place_id"), F.col("best.squared").alias("squared"))


def nearest_places(photos: DataFrame, places: DataFrame, within_km: float | None = None, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """photos with place_id and distance_km of the nearest place; null where the coordinates are not two numbers within
    range (texts are read), where places are none, or where none is within `within_km`.

    places: place_id, latitude and longitude; places out of range are left out, and of places at one point the
    smallest id stands for all. A location is searched once, however many photos share it. Columns of photos must not be
    named place_id or distance_km.
    """
    read = lambda df: (media.coordinate(F.col(lat).cast("string"), 90.0), media.coordinate(F.col(lon).cast("string"), 180.0))
    at = places.select("place_id", media.coordinate(F.col("latitude").cast("string"), 90.0).alias("lat"), media.coordinate(F.col("longitude").cast("string"), 180.0).alias("lon")).where("lat is not null and lon is not null")
    at = materialise(at.select("place_id", *points(F.col("lat"), F.col("lon"))).groupBy("x", "y", "z").agg(F.min("place_id").alias("place_id")), "places")
    y, x = read(photos)
    rows = photos.withColumns({"__lat": y, "__lon": x})
    located = F.col("__lat").isNotNull() & F.col("__lon").isNotNull()
    spots = rows.where(located).select(F.col("__lat").alias("lat"), F.col("__lon").alias("lon")).distinct()
    found = materialise(_search(spots.select("lat", "lon", *points(F.col("lat"), F.col("lon"))), at), "nearest")
    release(at)
    found = found.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "place_id", chord_km(F.col("squared")).alias("distance_km"))
    if within_km is not None:
        found = found.where(F.col("distance_km") <= within_km)
    # Rows without coordinates stay out of the join, where they would all have one key.
    none = {"place_id": F.lit(None).cast(places.schema["place_id"].dataType), "distance_km": F.lit(None).cast("double")}
    joined = rows.where(located).join(found, ["__lat", "__lon"], "left").select(*photos.columns, "place_id", "distance_km")
    return joined.unionByName(rows.where(~located).select(*photos.columns).withColumns(none))


def address_of(places: DataFrame) -> DataFrame:
    """place_id, address, city (else town, village, state, else empty) and country of places."""
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("city", "town", "village", "state")]
    return places.select("place_id", F.coalesce("address", F.lit("")).alias("address"), F.coalesce(*filled, F.lit("")).alias("city"), F.coalesce("country", F.lit("")).alias("country"))
