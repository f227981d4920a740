"""Timers of keyed state, and results that come late or never."""

import uuid
from datetime import datetime

import pytest

from albumen.operators import membership
from albumen.streaming import pipelines


class Feed:
    """A folder that a stream reads, fed one batch at a time."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        path.mkdir()

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)


@pytest.fixture
def running(spark, tmp_path):
    started = []

    def start(df):
        name = f"out_{uuid.uuid4().hex}"
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        started.append(q)
        return q, lambda: spark.table(name).collect()

    yield start
    for q in started:
        q.stop()


def state_rows(q):
    return sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"])


def test_leases_leave_the_state(spark, tmp_path, running):
    feed = Feed(spark, tmp_path / "in", "key string, owner string, action string, at double")
    q, out = running(pipelines.leases(feed.stream()))
    feed.add([("a", "x", "claim", 1000.0), ("b", "x", "claim", 1000.0), ("c", "y", "claim", 1100.0)])
    q.processAllAvailable()
    assert state_rows(q) == 3
    feed.add([("d", "z", "claim", 1200.0)])  # the watermark becomes 1140: a and b ran out at 1120, c holds until 1220
    q.processAllAvailable()
    assert state_rows(q) == 2
    feed.add([("c", "z", "claim", 1210.0), ("a", "z", "claim", 1215.0)])
    q.processAllAvailable()
    assert {(r.key, r.owner, r.accepted) for r in out()[4:]} == {("c", "z", False), ("a", "z", True)}


def test_idle_keys_leave_the_limiter(spark, tmp_path, running):
    feed = Feed(spark, tmp_path / "in", "key string, event_id long, at double")
    q, out = running(pipelines.rate_limits(feed.stream(), 30, 2))
    times = [0.0, 10.0, 30.0, 60.0]
    feed.add([("a", i, t) for i, t in enumerate(times)] + [("b", 10, 0.0)])
    q.processAllAvailable()
    assert state_rows(q) == 2
    feed.add([("c", 20, 4000.0)])
    q.processAllAvailable()
    assert state_rows(q) == 1
    feed.add([("a", 4, 4000.0), ("a", 5, 4010.0), ("a", 6, 4100.0)])
    q.processAllAvailable()
    got = [r.allowed for r in sorted(out(), key=lambda r: r.event_id) if r.key == "a"]
    assert got == membership.allow_in_window([*times, 4000, 4010, 4100], 30, 2)


def test_forgotten_failures_leave_the_state(spark, tmp_path, running):
    feed = Feed(spark, tmp_path / "in", "key string, event_id long, at double")
    q, out = running(pipelines.lockouts(feed.stream()))
    feed.add([("a", i, float(i)) for i in range(7)])
    q.processAllAvailable()
    feed.add([("b", 50, 7.0 + membership.FORGET_SECONDS + 61)])
    q.processAllAvailable()
    assert state_rows(q) == 1
    feed.add([("a", 7, 8.0 + membership.FORGET_SECONDS + 61)])
    q.processAllAvailable()
    want = membership.lockouts([*range(7), 8 + membership.FORGET_SECONDS + 61])
    assert [r.lock_seconds for r in sorted(out(), key=lambda r: r.event_id) if r.key == "a"] == want


def test_late_and_missing_results(spark, tmp_path, running):
    ups = Feed(spark, tmp_path / "ups", "key string, uploaded timestamp")
    res = Feed(spark, tmp_path / "res", "key string, step string, status string, reported timestamp")
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s)
    q, out = running(pipelines.late_results(ups.stream(), res.stream(), steps=("exif", "ocr", "face")))
    ups.add([("p", at(0))])
    res.add([("p", "exif", "done", at(10)), ("stranger", "exif", "done", at(10))])
    q.processAllAvailable()
    assert [(r.key, r.step, r.status) for r in out()] == [("p", "exif", "done")]
    res.add([("p", "ocr", "failed", at(700)), ("p", "face", "done", at(751))])  # late, and too late
    ups.add([("q", at(700))])
    q.processAllAvailable()
    assert {(r.key, r.step, r.status) for r in out()} == {("p", "exif", "done"), ("p", "ocr", "failed")}
    ups.add([("q2", at(2000))])
    res.add([("q2", "exif", "done", at(2000))])
    q.processAllAvailable()
    got = [(r.key, r.step, r.status) for r in out()]
    first = [(k, s, x) for k, s, x in got if k in ("p", "q")]
    assert sorted(first) == [("p", "exif", "done"), ("p", "face", "no_data"), ("p", "ocr", "failed"), ("q", "exif", "no_data"), ("q", "face", "no_data"), ("q", "ocr", "no_data")]
    assert [x for x in got if x[0] == "q2"] == [("q2", "exif", "done")]
