"""Functions that no query's SQL covers: floored cosine, the bonus of confirmed faces, the audit log, hashed embeddings."""

import math

import pytest
from pyspark.sql import functions as F

from albumen.functions import text, vectors
from albumen.sources import tables


def test_floored_cosine_and_bonus(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([1.0, 0.0, 9.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([0.0], [0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r.c for r in df.select(vectors.cosine_floored(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == pytest.approx([0.96, 1.0, 0.0, 0.0])
    bonus = spark.createDataFrame([(0.5, 0), (0.5, 1), (0.5, 2), (0.5, 7), (0.97, 2)], "s double, n int").select(vectors.confirmed_bonus(F.col("s"), F.col("n")).alias("x"))
    assert [r.x for r in bonus.collect()] == pytest.approx([0.5, 0.55, 0.6, 0.6, 1.0])


def test_audit_rows_are_appended(spark, tmp_path):
    for k in (1, 2, 2):
        tables.append_audit(spark.createDataFrame([(k, "merge")], "k int, action string"), f"file://{tmp_path}/audit")
    assert sorted(r.k for r in spark.read.parquet(f"file://{tmp_path}/audit").collect()) == [1, 2, 2]


def test_hashed_embeddings(spark):
    df = spark.createDataFrame([(1, "red boat at sea"), (2, "red boat at sea"), (3, "a quiet library of old maps"), (4, ""), (5, None)], "k int, t string")
    got = {r.k: r.v for r in df.select("k", text.hashed_embedding(F.col("t")).alias("v")).collect()}
    assert got[1] == got[2] and got[1] != got[3]
    assert len(got[1]) == len(got[3]) == 1024
    assert math.sqrt(sum(x * x for x in got[1])) == pytest.approx(1.0)
    assert all(not got[k] or not any(got[k]) for k in (4, 5))
