"""Order-dependent and binary operators against values worked out by hand or by plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from albumen.functions import media, text
from albumen.operators import membership, people, search
from albumen.sources import files, tables
from albumen.streaming import pipelines


def test_query_parts():
    q = search.parse("woman wearing a red dress in Malmö with hat")
    assert q.location == ["malmo"] and (q.modifier, q.thing) == ("red", "dress") and q.phrases[0] == "red dress"
    q = search.parse("car color blue")
    assert (q.modifier, q.thing) == ("blue", "car")
    assert search.parse("").words == [] and search.parse("in").words == ["in"]
    assert "rose" in search.parse("red").expanded and len(search.expand(["water"])) <= 8 + 3


def test_token_rules(spark):
    cases = {"horses": "hors", "people": "person", "wolves": "wolf", "berries": "berry", "Ünïcode-Boxes": "unicode box", "nyc": "new york", "glass": "glass"}
    rows = spark.createDataFrame(list(cases.items()), "raw string, want string").select("raw", "want", text.normalize_token(F.col("raw")).alias("got")).collect()
    assert all(r.got == search.normalize(r.raw) for r in rows)
    assert {r.raw: r.got for r in rows} == cases
    assert text.token_variants("ties") == ["ties", "tie", "tieses", "ties"][:2] + ["tieses"]
    assert text.token_variants("berries")[:2] == ["berries", "berry"] and text.token_variants("glass") == ["glass", "glasses"]


def test_limits():
    assert membership.lockouts(range(0, 10)) == [0] * 5 + [30, 60, 120, 240, 480]
    assert membership.lockouts([0, 1, 2, 3, 4, 5, 5000]) == [0] * 5 + [30, 0]
    assert membership.allow_in_window([0, 10, 30, 60, 4000], 30, 2) == [True, False, True, False, True]


def split_by_loops(d, most):
    left, out = list(range(len(d))), []
    while left:
        seed = min(left, key=lambda i: (sum(d[i][j] for j in left if j != i), i))
        group = [seed]
        left.remove(seed)
        while True:
            fits = []
            for i in left:
                widest = max(d[a][b] for a in [*group, i] for b in [*group, i] if a != b)
                if widest <= most:
                    fits.append((widest, sum(d[i][j] for j in group), i))
            if not fits:
                break
            group.append(min(fits)[2])
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def test_diameter_split_against_loops():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = rng.integers(0, 40, (14, 1)) / 8
        d = np.abs(x - x.T)
        assert people.split_by_diameter(d, 1.0) == split_by_loops(d.tolist(), 1.0)
        y = rng.normal(size=(14, 3)).round(1)
        y /= np.linalg.norm(y, axis=1)[:, None]
        y = np.vstack([y, y[:4]])
        assert people.split_vectors(y, 0.6) == split_by_loops((1 - y @ y.T).clip(0, 2).round(12).tolist(), 0.6)


@pytest.mark.parametrize("least", [-0.2, 0.0, 0.4, 0.9, 0.999])
def test_pairs_by_pivots_against_all_pairs(spark, least):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(8, 6))
    rows = [(i, [float(v) for v in centers[i % 8] + rng.normal(scale=0.15 * (i % 3), size=6)][: 6 - i % 2]) for i in range(120)]
    rows += [(200, []), (201, None), (202, [float("nan")] * 6), (203, [0.0] * 6), (204, rows[0][1]), (205, [2 * v for v in rows[0][1]])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    pad = {k: np.pad(v, (0, 6 - len(v))) for k, v in rows if v and np.isfinite(v).all() and any(v)}
    unit = {k: v / np.linalg.norm(v) for k, v in pad.items()}
    want = {(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= least}
    edge = {(a, b) for a in unit for b in unit if a < b and abs(unit[a] @ unit[b] - least) < 1e-9}
    got = [(r.a, r.b) for r in people.similar_pairs(df, "k", "v", least, rows_of_block=9).collect()]
    assert len(got) == len(set(got)) and set(got) - edge == want - edge


def test_blocks_that_cannot_meet_are_not_sent(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(20, 16))
    rows = [(i, [float(v) for v in centers[min(i % 30, 19)] + rng.normal(scale=0.02, size=16)]) for i in range(1200)]
    near = people.located(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", rows_of_block=30)
    blocks = near.select("block").distinct().count()
    sent = people.meeting_blocks(near, 0.95).count()
    # A third of the rows is one person: its 15 blocks meet each other, all else only itself.
    assert blocks >= 40 and sent < 0.25 * blocks * (blocks + 1) / 2
    assert near.groupBy("block").count().agg(F.max("count")).first()[0] < 100


def test_pairs_of_no_vectors(spark):
    assert people.similar_pairs(spark.createDataFrame([], "k long, v array<double>"), "k", "v", 0.5).collect() == []
    assert people.similar_pairs(spark.createDataFrame([(1, [0.0]), (2, None)], "k long, v array<double>"), "k", "v", 0.5).collect() == []


def test_clusters_of_planted_faces(spark):
    rng = np.random.default_rng(1)
    centers = np.linalg.qr(rng.normal(size=(32, 5)))[0].T
    rows = [(i, [float(v) for v in centers[i % 5] + rng.normal(scale=0.002, size=32)]) for i in range(60)] + [(100, [0.0] * 32), (101, [float(i == 31) for i in range(32)])]
    df = spark.createDataFrame(rows, "face_id long, embedding array<double>")
    eps = people.PRESETS["strictest"][0]
    got = {r.face_id: r.cluster for r in people.dbscan(df, "face_id", "embedding", eps).collect()}
    assert got == {i: i % 5 for i in range(60)} | {100: 100, 101: 101}
    few = {tuple(sorted((r.a, r.b))) for r in people.similar_pairs(df, "face_id", "embedding", 0.9, rows_of_block=7).collect()}
    assert few == {(r.a, r.b) for r in people.similar_pairs_plain(df, "face_id", "embedding", 0.9).collect()}


def test_assignment_in_order():
    e = np.eye(3)
    faces = pd.DataFrame({"face_id": ["a", "b", "c"], "embedding": [e[0], e[1], e[1] + 0.01 * e[2]]})
    got = people.assign_in_order(faces, {"ann": e[0]}, 0.9, 0.2)
    assert got["person_id"].tolist() == ["ann", "person-b", "person-b"] and got["created"].tolist() == [False, True, False]


def test_suggestions_hold_their_caps(spark):
    # a takes b, c and d, as only sources are held to two; b has one and takes c, which then has two and no turn; d has
    # one and is a source to c, which may have any number as a target.
    rows = [("b", "a", 0.99), ("c", "a", 0.98), ("d", "a", 0.97), ("c", "b", 0.96), ("d", "c", 0.95)]
    pairs = spark.createDataFrame([(lib, *r) for lib in ("x", "y") for r in rows], "library_id string, source string, target string, similarity double")
    got = lambda limit: sorted(tuple(r) for r in people.suggestions(pairs, 2, limit).where("library_id = 'x'").drop("library_id").collect())
    assert got(3) == [("b", "a", 0.99), ("c", "a", 0.98), ("d", "a", 0.97)]
    assert got(20) == [("b", "a", 0.99), ("c", "a", 0.98), ("c", "b", 0.96), ("d", "a", 0.97), ("d", "c", 0.95)]


def test_box_suppression():
    boxes = pd.DataFrame({"box_id": [1, 2, 3], "left": [0, 1, 50], "top": [0, 1, 50], "width": [10, 10, 5], "height": [10, 10, 5], "score": [0.5, 0.9, 0.1]})
    assert people.suppress_boxes(boxes)["box_id"].tolist() == [2, 3]


def test_embedded_preview():
    small, large = b"\xff\xd8\xff\xc0" + b"a" * 1500 + b"\xff\xd9", b"\xff\xd8\xff\xc2" + b"b" * 3000 + b"\xff\xd9"
    assert files.longest_jpeg(b"raw" + small + b"mid" + large + b"end") == large
    assert files.longest_jpeg(b"\xff\xd8\xff" + b"c" * 5000 + b"\xff\xd9") is None


def test_media_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0\xff\xda\0\x08\1\1\0\0\x3f\0" + b"x" * 300 + b"\xff\xd9")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "c.jpg").write_bytes(b"\x00" * 400)
    (tmp_path / "d.txt").write_text("no")
    (tmp_path / "e.png").write_bytes(b"\x89PNG")
    (tmp_path / "f.nef").write_bytes(b"II*\x00" + b"x" * (512 * 1024 - 5))
    (tmp_path / "g.nef").write_bytes(b"II*\x00" + b"x" * (512 * 1024 - 4))
    (tmp_path / "h.r3d").write_bytes(b"RED" + b"x" * (1024 * 1024 - 4))
    (tmp_path / "i.mp4").write_bytes(b"\x00" * 4096 + b"x" * 10)
    (tmp_path / "j.mp4").write_bytes(b"x" * 1023)
    got = {r.path[-5:]: r.problem for r in files.integrity(files.media_files(spark, str(tmp_path))).collect()}
    want = {"a.jpg": None, "b.png": "truncated", "c.jpg": "empty header", "e.png": "header mismatch", "f.nef": "too small", "g.nef": None, "h.r3d": "too small", "i.mp4": "empty header", "j.mp4": "too small"}
    assert got == want


def test_index_versions(spark, tmp_path):
    index = spark.createDataFrame([(1, [1.0])], "k long, embedding array<double>")
    tables.save_index(index, str(tmp_path), "s1", "e1")
    assert tables.load_index(spark, str(tmp_path), "s1", "e1").count() == 1
    assert tables.load_index(spark, str(tmp_path), "s2", "e1") is None


def test_capture_times(spark):
    df = spark.createDataFrame([("2020:01:31 23:30:00+02:00",), ("2020:01:31 23:30:00",), ("bad",), (None,)], "t string")
    got = [(r.a is not None, str(r.d)) for r in df.select(media.exif_time(F.col("t")).alias("a"), media.exif_local_date(F.col("t")).alias("d")).collect()]
    assert got == [(True, "2020-01-31"), (True, "2020-01-31"), (False, "None"), (False, "None")]


def test_streams(spark, tmp_path):
    actions = [("k", "a", "claim", 0.0), ("k", "b", "claim", 50.0), ("k", "a", "heartbeat", 100.0), ("k", "b", "claim", 219.0), ("k", "b", "claim", 220.0), ("k", "b", "release", 221.0)]
    random.shuffle(actions)
    schema = "key string, owner string, action string, at double"
    spark.createDataFrame(actions, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pipelines.leases(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.owner, r.event, r.accepted) for r in spark.table("leases").collect()]
    assert got == [("a", "claim", True), ("b", "claim", False), ("a", "heartbeat", True), ("b", "claim", False), ("b", "claim", True), ("b", "release", True)]
