"""Ball k-means over integer vectors, exact.

A cluster is a ball: its centroid and a radius that holds its members. After centroids have moved, a ball's
radius grows by its centroid's step at most, and only centroids within twice the radius can take a member: its
neighbours, by distance. A member at distance d of its centroid can only go to neighbours within 2 d of it. Those
without any are the stable core and stay; the others lie in annuli, of which the j-th is compared with the nearest j
neighbours, exactly. All is integer arithmetic, so results depend neither on the order of rows nor on their tasks.

Vectors never move between tasks: each pass writes them with their clusters, and a row of sums for each cluster that
a task met. What comes to the driver is a row of each cluster's every component, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumen.llm.common import materialise, release

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Components up to this: squared distances of up to 64 of them are exact in doubles, and beyond it up to MOST in longs.
IN_DOUBLES, MOST = 1 << 22, 1 << 26
SCHEMA = "vec_id long, v array<long>, cluster int, distance long, members long, farthest long"


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)))


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Of the right size, without a null or a number that is not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dimensions) & fine


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of c, as exact longs."""
    largest = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if largest > MOST or x.shape[1] > DIMENSIONS and largest * x.shape[1] > MOST:
        raise ValueError(f"components beyond {MOST}: squared distances would not fit a long")
    if largest <= IN_DOUBLES and x.shape[1] <= DIMENSIONS:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for k, row in enumerate(c):
        out[:, k] = ((x - row) ** 2).sum(1)
    return out


class Balls:
    """The centroids of a pass, and each one's neighbours by distance (squared) and number."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None, farthest: np.ndarray | None = None):
        """before, farthest: the centroids and largest squared distances of the last pass; none at the first."""
        self.centroids, self.first = centroids, before is None
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        if self.first:
            return
        apart = squared(centroids, centroids)
        step = np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64))
        # Rounded up: a neighbour too many costs a comparison, one too few would be wrong.
        reach = 4 * (np.sqrt(farthest.astype(np.float64)) + step) ** 2 * (1 + 1e-9) + 1
        for k in range(len(centroids)):
            order = np.argsort(apart[k], kind="stable")
            order = order[(order != k) & (apart[k][order] <= reach[k])]
            self.near.append((apart[k][order], order))

    def assign(self, x: np.ndarray, cluster: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row of x; of equal distances the smaller number."""
        if self.first:
            d = squared(x, self.centroids)
            best = d.argmin(1)
            return best.astype(np.int32), d[np.arange(len(x)), best]
        best, distance = cluster.astype(np.int32), np.zeros(len(x), np.int64)
        for k in np.unique(cluster):
            rows = np.flatnonzero(cluster == k)
            own = squared(x[rows], self.centroids[k : k + 1])[:, 0]
            distance[rows] = own
            apart, near = self.near[k]
            # d(x, j) >= d(k, j) - d(x, k): only where d(k, j) <= 2 d(x, k) can j be as near.
            annulus = np.searchsorted(apart, 4 * own, side="right")
            for j in np.unique(annulus[annulus > 0]):
                at = annulus == j
                numbers = np.append(k, near[:j])
                numbers.sort()
                d = squared(x[rows[at]], self.centroids[numbers])
                least = d.argmin(1)
                best[rows[at]], distance[rows[at]] = numbers[least], d[np.arange(len(d)), least]
        return best, distance


def _assign(balls: Balls):
    """Rows of vectors with cluster and distance, then a row of sums (members not null) for each cluster of the task."""
    size = balls.centroids.shape[1]
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("members", pa.int64()), ("farthest", pa.int64())])

    def batch(ids, x, cluster, distance, members=None, farthest=None):
        offsets = pa.array(np.arange(0, x.size + 1, size, dtype=np.int32))
        vectors = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel()))
        none = pa.nulls(len(x), pa.int64())
        columns = [none if ids is None else ids, vectors, pa.array(cluster.astype(np.int32)), pa.array(distance), none if members is None else pa.array(members), none if farthest is None else pa.array(farthest)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        k = len(balls.centroids)
        sums, inertia, members, farthest = np.zeros((k, size), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            cluster, distance = balls.assign(x, None if balls.first else b.column("cluster").to_numpy(zero_copy_only=False))
            np.add.at(sums, cluster, x)
            np.add.at(inertia, cluster, distance)
            members += np.bincount(cluster, minlength=k)
            np.maximum.at(farthest, cluster, distance)
            yield batch(b.column("vec_id"), x, cluster, distance)
        met = np.flatnonzero(members)
        if len(met):
            yield batch(None, sums[met], met, inertia[met], members[met], farthest[met])

    return run


def _gather(state: DataFrame, centroids: np.ndarray):
    """(means, farthest, inertia): of each cluster the exact floor of its members' mean (an empty one's centroid stays),
    its largest squared distance and their sum."""
    sums = state.where("members is not null")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    means, farthest, inertia, members = centroids.copy(), np.zeros(len(centroids), np.int64), [0] * len(centroids), {}
    for r in sums.groupBy("cluster").agg(exact("members").alias("n"), F.max("farthest").alias("far"), exact("distance").alias("total")).collect():
        members[r.cluster], farthest[r.cluster], inertia[r.cluster] = int(r.n), r.far, int(r.total)
    for r in sums.select("cluster", F.posexplode("v").alias("at", "x")).groupBy("cluster", "at").agg(exact("x").alias("total")).collect():
        means[r.cluster, r.at] = int(r.total) // members[r.cluster]
    return means, farthest, inertia


def initial(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and id (a null id: an empty one); of equal hashes, by the vector."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def ball_kmeans(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(rows, centroids, inertia of each cluster). rows: vec_id, v (the integers), cluster, distance (squared), one per
    row of df whose vector has exactly `dimensions` components, none of them null, NaN or infinite; the others are left
    out. Components become floor(scale * x).

    Each of the rounds assigns every vector to its nearest centroid and then moves centroids; at the end vectors are
    assigned once more. Equal distances go to the smaller number, empty clusters keep their centroids, and equal
    centroids leave all but the first one empty. Repeated rows and null ids are vectors of their own. With fewer than
    k vectors there are as many clusters; without any, no rows. Integers beyond 2^26 are an error, as their
    distances would not fit a long. Only id and vector are read.
    """
    vectors = df.where(usable(F.col(vector_col), dimensions)).select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("v"))
    centroids = initial(vectors, k, seed)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], "vec_id long, v array<long>, cluster int, distance long"), np.zeros((0, dimensions), np.int64), []
    state = materialise(vectors.mapInArrow(_assign(Balls(centroids)), SCHEMA), "assigned")
    means, farthest, inertia = _gather(state, centroids)
    for _ in range(rounds):
        members = state.where("members is null").select("vec_id", "v", "cluster")
        after = materialise(members.mapInArrow(_assign(Balls(means, centroids, farthest)), SCHEMA), "assigned")
        release(state)
        state, centroids = after, means
        means, farthest, inertia = _gather(state, centroids)
    return state.where("members is null").select("vec_id", "v", "cluster", "distance"), centroids, inertia


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same clusters by comparing every vector with every centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT v.row, min_by({{'c': c.c, 'd': list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT}},
         {{'d': list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) AS best
  FROM v, c{r} c GROUP BY v.row
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT c, list(mean ORDER BY pos) AS v FROM (
    SELECT c, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean
    FROM (SELECT a.best.c AS c, unnest(v.v) AS x, unnest(range(len(v.v))) AS pos FROM a{r} a JOIN v ON a.row = v.row) GROUP BY c, pos
  ) GROUP BY c
), c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM v
  QUALIFY c < {k}
), {", ".join(steps)}
SELECT v.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia,
       sum(a.best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON a.row = v.row JOIN c{rounds} c ON c.c = a.best.c
"""


SQL = _sql()


def op13_ball_clustering(spark, sf_dir: str) -> DataFrame:
    """Every usable vector with its cluster of 40 after 5 rounds. Unusable vectors, nulls, ties and an empty table: as ball_kmeans() says."""
    rows, centroids, inertia = ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(k, n, sum(inertia), digest) for k, (n, digest) in enumerate(zip(inertia, digests))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("v").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
