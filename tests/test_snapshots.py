"""The log of versions, and terms of many queries."""

import pytest
from pyspark.sql import functions as F

from albumen.operators import search
from albumen.sources import tables
from albumen.sources.snapshots import Conflict, Snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_stay_whole(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path / "log"))
    assert log.version() is None and log.read() is None
    log.replace(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string"), {"by": "upload"})
    before = log.read()
    held = log.read(1)
    log.change(spark.createDataFrame([(2, "B", False), (3, "c", False), (None, "N", False)], "k long, v string, gone boolean"), ["k"], "gone")
    log.change(spark.createDataFrame([(1, None, True), (3, "C", None)], "k long, v string, gone boolean"), ["k"], "gone", {"by": "merge"})
    full = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert full(before) == full(held) == full(log.read(1)) == [(1, "a"), (2, "b"), (None, "n")]
    assert full(log.read(2)) == [(1, "a"), (2, "B"), (3, "c"), (None, "N")]
    assert full(log.read()) == full(log.read(3)) == [(2, "B"), (3, "C"), (None, "N")]
    assert log.version().note == {"by": "merge"} and log.numbers() == [1, 2, 3]
    # Undo is a new version that is an older one.
    assert log.restore(1).number == 4 and full(log.read()) == full(log.read(1))
    log.restore(3)
    assert log.compact().changes == [] and full(log.read()) == full(log.read(3))
    log.append(spark.createDataFrame([(9, "z")], "k long, v string"))
    log.forget(1)
    assert log.numbers() == [7] and full(log.read()) == [(2, "B"), (3, "C"), (9, "z"), (None, "N")] and log.read(3) is None


def test_of_two_writers_one_fails(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path / "log"))
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    seen = log.replace(df).number
    other = Snapshots(spark, str(tmp_path / "log"))
    other.change(df.withColumn("v", F.lit("x")), ["k"], after=seen)
    with pytest.raises(Conflict):
        log.change(df.withColumn("v", F.lit("y")), ["k"], after=seen)
    assert rows(log.read()) == [(1, "x")] and log.numbers() == [1, 2]
    with pytest.raises(ValueError):
        log.append(df)
    with pytest.raises(ValueError):
        log.change(df, ["v"])


def test_a_failed_write_is_not_seen(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path / "log"))
    log.replace(spark.createDataFrame([(1,)], "k long"))
    with pytest.raises(Exception):
        log.replace(spark.range(1).select(F.raise_error("stop").cast("long").alias("k")))
    assert log.numbers() == [1] and rows(log.read()) == [(1,)]


def test_index_under_its_readers(spark, tmp_path):
    index = lambda k: spark.createDataFrame([(k, [1.0])], "k long, embedding array<double>")
    path = str(tmp_path / "index")
    assert tables.load_index(spark, path, "s1", "e1") is None
    tables.save_index(index(1), path, "s1", "e1")
    reader = tables.load_index(spark, path, "s1", "e1")
    tables.save_index(index(2), path, "s2", "e1")
    assert [r.k for r in reader.collect()] == [1] and [r.k for r in tables.load_index(spark, path, "s2", "e1").collect()] == [2]
    tables.mark_dirty(spark, path)
    assert tables.load_index(spark, path, "s2", "e1") is None


def test_terms_of_many_queries(spark):
    vocabulary = spark.createDataFrame([("New York",), ("york",), ("Malmö",), ("a b c d",), ("",), (None,), ("York",)], "term string")
    asked = ["new york at night", "York, York and Malmo", "a b c d e", "newyork", "", None, "the a b c"]
    queries = spark.createDataFrame([*enumerate(asked), (None, "york")], "id long, q string")
    got = {}
    for r in search.terms_of(queries, vocabulary, "id", "q").collect():
        got.setdefault(r.id, []).append(r.term)
    want = {i: sorted(r.term for r in search.known_terms(q, vocabulary).collect()) for i, q in enumerate(asked) if q}
    assert {i: sorted(t) for i, t in got.items()} == {i: t for i, t in want.items() if t}
    assert search.terms_of(queries, vocabulary.where("false"), "id", "q").collect() == []
