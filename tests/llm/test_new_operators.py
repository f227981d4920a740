"""Sharding, fill-in-the-middle and ball k-means against brute force, and their SQL on the smallest tables."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from albumen.llm import ball_clustering, fill_in_middle, queries, sharding

DATA = "/root/testdata/sf0.001"


def docs_df(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, shard string, size int, n int")


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "a b c"), (5, "a b c"), (5, "other"), (None, "a b c"), (None, None), (7, "é" * 50_000), (8, "\n\n\nx\n\n"), (9, "one\r\ntwo\rthree"), (10, "\U0001f600\nlast")]


@pytest.mark.parametrize("name", ["op11_sharding", "op12_fill_in_middle", "op13_ball_clustering"])
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


# Sharding


def shards_brute(rows, n):
    keys = sorted(((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows))
    total, before, out, slots = sum(k[2] for k in keys), 0, [], {}
    for known, i, size, crc in keys:
        shard = (2 * before + size) * n // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i if known else None, size, crc, "bytes", shard, slots[shard], None))
        before += size
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_shards_against_brute_force(spark, n):
    random.seed(n)
    rows = EDGE + [(random.randrange(60), "w" * random.randrange(200)) for _ in range(300)]
    got = sharding.assign(docs_df(spark, rows).repartition(5), n).collect()
    assert sorted(map(tuple, got), key=str) == shards_brute(rows, n)


def test_shards_are_near_equal_with_one_hot_row(spark):
    """A third of all rows are one document, a third have no id."""
    rows = [(1, "same")] * 700 + [(None, f"t{k:04}") for k in range(700)] + [(k, f"u{k:04}") for k in range(2, 702)]
    got = sharding.assign(docs_df(spark, rows)).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 40
    assert max(r.b for r in got) - min(r.b for r in got) <= 2 * 21
    assert all(r.m == r.n - 1 for r in got)


def test_shards_of_nothing(spark):
    assert sharding.assign(docs_df(spark, [])).collect() == []


def test_written_shards(spark, tmp_path):
    rows = [r for r in EDGE if r != (5, "a b c")] + [(100 + k, "w" * (k % 50)) for k in range(200)]
    df = docs_df(spark, rows).drop("shard").repartition(3)
    sharding.write_shards(df, f"file://{tmp_path}/shards", 6, file_rows=20)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted((r.shard, str(r.doc_id), str(r.text)) for r in back.collect()) == sorted(
        (r.shard, str(r.doc_id), str(r.text)) for r in sharding.assign(df, 6).join(df.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.crc32(F.coalesce("text", F.lit(""))) == F.col("text_crc32"))).collect()
    )
    assert set(back.columns) == {*df.columns, "shard"}


def test_sharding_runs_no_python(spark):
    plan = sharding.assign(docs_df(spark, EDGE).where("doc_id > 1"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Fill-in-the-middle


def units_brute(text, unit):
    if unit == "char":
        return list(text)
    return re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+", text)


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_every_cut(unit):
    random.seed(5)
    texts = [t or "" for _, t in EDGE if len(t or "") < 100] + ["".join(random.choice("ab \né") for _ in range(k)) for k in range(40)]
    for text in texts:
        runs, units = fill_in_middle.Runs(text, unit), units_brute(text, unit)
        assert runs.n == len(units)
        assert [runs.cut(u) for u in range(len(units) + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)], repr(text)


def middle_brute(doc_id, text):
    text = text or ""
    units, digest = units_brute(text, "line"), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted([h[0] % (len(units) + 1), h[1] % (len(units) + 1)])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_against_brute_force_and_back(spark):
    random.seed(6)
    rows = EDGE + [(20, "has <P> inside"), (21, "<S"), (22, "<\nM\n>\n<"), (23, "a<M>b"), (24, "line\n" * 40_000)]
    rows += [(30 + k, "".join(random.choice("ab<>PSM\n é") for _ in range(random.randrange(120)))) for k in range(200)]
    out = fill_in_middle.fill_in_middle(docs_df(spark, rows).repartition(3))
    assert sorted(map(tuple, out.collect()), key=str) == sorted((middle_brute(*r) for r in rows), key=str)
    back = out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((i, t or "")) for i, t in rows)
    assert fill_in_middle.fill_in_middle(docs_df(spark, [])).collect() == []


def test_rates():
    h = fill_in_middle.draws(3)
    assert fill_in_middle.transform("a\nb", h, rate=0)[1] == "plain"
    assert fill_in_middle.transform("a\nb", h, spm_rate=100)[1] == "spm" and fill_in_middle.transform("a\nb", h, spm_rate=0)[1] == "psm"


# Ball k-means


def clusters_brute(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted([(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], key=str), centroids


def vectors_df(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster int")


@pytest.mark.parametrize("spread", [0.02, 0.5, 4.0])
def test_clusters_against_brute_force(spark, spread):
    """From far apart (most members in stable cores) to one cloud; repeated rows, ties and unusable vectors with them."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5))
    rows = [(k, (centres[k % 6] + spread * rng.normal(size=5)).tolist()) for k in range(240)]
    rows += [(7, rows[7][1])] * 40 + [(None, [0.0] * 5), (None, [0.5] * 5), (500, None), (501, [1.0] * 4), (502, [1.0, None, 1.0, 1.0, 1.0]), (503, [float("nan")] * 5), (504, [float("inf")] * 5), (505, []), (506, [-0.0] * 5)]
    rows += [(600 + k, [float(k % 2)] * 5) for k in range(20)]
    got, centroids, inertia = ball_clustering.ball_kmeans(vectors_df(spark, rows).repartition(4), k=9, rounds=4, dimensions=5)
    want, means = clusters_brute(rows, 9, 4, 5)
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got.collect()], key=str) == want
    assert centroids.tolist() == means
    assert inertia == [sum(d for _, c, d in want if c == j) for j in range(9)]


def test_few_vectors_and_none(spark):
    got, centroids, _ = ball_clustering.ball_kmeans(vectors_df(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), k=9, rounds=2, dimensions=2)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == [(1, 0, 0), (2, 0, 0)] and len(centroids) == 2
    assert ball_clustering.ball_kmeans(vectors_df(spark, []))[0].collect() == []


def test_large_integers_are_exact_and_larger_ones_an_error():
    rng = np.random.default_rng(2)
    for size in (1 << 21, 1 << 25):
        x, c = rng.integers(-size, size, (20, 64)), rng.integers(-size, size, (7, 64))
        assert ball_clustering.squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    with pytest.raises(ValueError):
        ball_clustering.squared(np.full((1, 64), 1 << 27), np.zeros((1, 64), np.int64))


def test_cores_and_annuli_skip_comparisons(monkeypatch):
    """Clusters far apart: later passes compare members with their own centroid alone."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-5000, 5000, (8, 16))
    x = (centres[:, None] + rng.integers(-20, 20, (8, 50, 16))).reshape(-1, 16)
    cluster, distance = ball_clustering.Balls(centres).assign(x, None)
    farthest = np.array([distance[cluster == k].max() for k in range(8)])
    seen, real = [], ball_clustering.squared
    balls = ball_clustering.Balls(centres + 1, centres, farthest)
    monkeypatch.setattr(ball_clustering, "squared", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    assert (balls.assign(x, cluster)[0] == cluster).all()
    assert sum(seen) == len(x)
