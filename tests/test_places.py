"""Nearest places against brute force: poles, the date line, clusters, ties and unreadable coordinates."""

import math
import random

import pytest

from albumen.operators import places


def point(lat, lon):
    lat, lon = math.radians(lat), math.radians(lon)
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def nearest(lat, lon, rows):
    p = point(lat, lon)
    return min((sum((a - b) ** 2 for a, b in zip(p, point(y, x))), i) for i, y, x in rows)


def photos_df(spark, rows):
    return spark.createDataFrame([(i, None if y is None else str(y), None if x is None else str(x), "clash") for i, y, x in rows], "photo_id long, latitude string, longitude string, cell string")


def places_df(spark, rows):
    return spark.createDataFrame(rows, "place_id long, latitude double, longitude double")


@pytest.mark.parametrize("kind", ["spread", "clusters", "poles", "few"])
def test_nearest_against_brute_force(spark, kind):
    random.seed(kind)
    r = random.uniform
    spots = {
        "spread": [(k, r(-90, 90), r(-180, 180)) for k in range(400)],
        "clusters": [(k, 48.0 + (k % 3) * 5 + r(-0.01, 0.01), 179.99 + r(-0.01, 0.0099)) for k in range(400)],
        "poles": [(k, random.choice((1, -1)) * (90 - abs(r(0, 0.5))), r(-180, 180)) for k in range(300)] + [(900, 90.0, 0.0), (901, -90.0, 77.0)],
        "few": [(1, 0.0, 180.0), (2, 0.0, 0.0)],
    }[kind]
    asked = [(k, r(-90, 90), r(-180, 180)) for k in range(60)] + [(100 + k, y + r(-0.02, 0.02) if abs(y) < 89 else y, x) for k, (_, y, x) in enumerate(spots[:60])]
    asked += [(200, 90, 0), (201, -90, 13), (202, 0, 180), (203, 0, -180), (204, 48, -179.999), (205, 48, 179.999), (206, 48, 179.999)]
    got = places.nearest_places(photos_df(spark, asked), places_df(spark, spots).repartition(3)).collect()
    assert len(got) == len(asked)
    for row in got:
        y, x = float(row.latitude), float(row.longitude)
        squared, place = nearest(round(y, 7), round(x, 7), [(i, round(a, 7), round(b, 7)) for i, a, b in spots])
        assert row.place_id == place, row
        assert row.distance_km == pytest.approx(2 * places.EARTH_KM * math.asin(min(1.0, math.sqrt(squared) / 2)), abs=1e-6)


def test_ties_nulls_and_limits(spark):
    spots = places_df(spark, [(5, 10.0, 20.0), (3, 10.0, 20.0), (9, 95.0, 0.0), (8, None, 1.0)])
    asked = photos_df(spark, [(1, "10", "20"), (2, "n/a", "20"), (3, None, None), (4, "11", "20"), (5, "91", "0"), (6, "10", "200")])
    assert sorted((r.photo_id, r.place_id) for r in places.nearest_places(asked, spots).collect()) == [(1, 3), (2, None), (3, None), (4, 3), (5, None), (6, None)]
    assert sorted((r.photo_id, r.place_id) for r in places.nearest_places(asked, spots, within_km=100).collect())[3] == (4, None)
    assert {r.place_id for r in places.nearest_places(asked, spots.limit(0)).collect()} == {None}
    assert places.nearest_places(asked.limit(0), spots).collect() == []


def test_one_crowded_spot(spark):
    """Most places within some metres, many photos there: each location is searched once."""
    spots = [(k, 1.0 + k * 1e-6, 2.0) for k in range(500)] + [(1000, 50.0, 50.0)]
    asked = [(k, 1.0 + (k % 7) * 1e-6 + 4e-7, 2.0) for k in range(300)] + [(999, 49.0, 51.0)]
    got = {r.photo_id: r.place_id for r in places.nearest_places(photos_df(spark, asked), places_df(spark, spots)).collect()}
    assert got == {k: k % 7 for k in range(300)} | {999: 1000}


def test_addresses(spark):
    rows = [(1, "a", "", None, "v", "s", "c"), (2, None, None, None, None, None, None), (3, "b", "x", "y", "z", "w", "")]
    df = spark.createDataFrame(rows, "place_id long, address string, city string, town string, village string, state string, country string")
    assert sorted(map(tuple, places.address_of(df).collect())) == [(1, "a", "v", "c"), (2, "", "", ""), (3, "b", "x", "")]
