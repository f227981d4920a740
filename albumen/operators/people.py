"""Faces and people: similarity pairs, clusters, matching, suggestions and membership."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from albumen.functions import media, vectors
from albumen.operators import large_cuts
from albumen.operators.graph import connected_components, materialise, release

# Clustering presets: eps, largest pair distance, match threshold and margin, assign threshold and margin.
PRESETS = {
    "strictest": (0.03, 0.025, 0.99, 0.20, 0.99, 0.20),
    "strict": (0.10, 0.08, 0.95, 0.12, 0.97, 0.14),
    "balanced": (0.12, 0.10, 0.90, 0.08, 0.94, 0.12),
    "loose": (0.14, 0.12, 0.88, 0.06, 0.92, 0.10),
}
SUGGEST, SUGGESTIONS, PER_PERSON, SUSPICIOUS = 0.78, 20, 2, 0.60
#: Vectors of a block of the pair computation: at least so many, and more for a table of more than BLOCKS such blocks,
#: as a vector is sent to every block that its own can meet; but of no more components than a task can hold twice.
BLOCK_ROWS, BLOCKS, BLOCK_COMPONENTS = 2000, 24, 3_000_000
#: Vectors whose angles tell which blocks can meet, and the rows of the sample that they are taken from.
PIVOTS, PIVOT_SAMPLE = 24, 1000
#: What rounding can add to an angle (a cosine's last digit is 1.5e-8 near an angle of 0).
ANGLE_SLACK = 1e-6
#: Rows of a cluster that is cut with its near rows found before: smaller ones take seconds.
LARGE = 20_000


def rejected() -> Column:
    return F.coalesce("rejected", F.lit(False)) | (F.lower(F.coalesce("review", F.lit(""))) == "rejected")


def confirmed() -> Column:
    return F.coalesce("confirmed", F.lit(False)) | (F.lower(F.coalesce("review", F.lit(""))) == "confirmed")


def suspicious() -> Column:
    return ~confirmed() & ~rejected() & ((F.lower(F.coalesce("review", F.lit(""))) == "suspicious") | (F.coalesce("confidence", F.lit(0.0)) < SUSPICIOUS))


def clusterable() -> Column:
    sure = F.coalesce(F.col("confidence") >= SUSPICIOUS, F.lit(True))
    return ~rejected() & (confirmed() | ((F.lower(F.coalesce("review", F.lit(""))) != "suspicious") & sure))


def _matrix(vs: pd.Series) -> np.ndarray:
    """Vectors as rows, padded to one size."""
    width = max(map(len, vs), default=0)
    if all(len(v) == width for v in vs):
        return np.array(list(vs), float).reshape(len(vs), width)
    return np.array([np.pad(np.asarray(v, float), (0, width - len(v))) for v in vs]).reshape(len(vs), width)


def _units(vs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have a direction, and those vectors at length 1, padded to one size."""
    x = _matrix(vs)
    size = np.sqrt((x * x).sum(axis=1))
    ok = np.flatnonzero(np.isfinite(size) & (size > 0))
    return ok, x[ok] / size[ok, None]


def _pivots(rows: DataFrame, count: int) -> np.ndarray:
    """`count` unit vectors far from each other: of a sample (PIVOT_SAMPLE rows, by the hash of their keys) the first,
    then each time the one whose nearest pivot is furthest. They bear on what is pruned, never on the result."""
    sample = rows.where(F.size("v") > 0).orderBy(F.xxhash64("k"), "k").limit(PIVOT_SAMPLE).select("v").toPandas()["v"]
    _, x = _units(sample)
    if not len(x):
        return np.zeros((1, 1))
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def block_rows(largest: int, width: int) -> int:
    """Vectors of a block where the largest group has so many, of so many components: about BLOCKS blocks a group."""
    return max(BLOCK_ROWS, min(BLOCK_COMPONENTS // max(1, width), -(-largest // BLOCKS)))


def located(df: DataFrame, key: str, col: str, rows_of_block: int | None = None, by: str | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(g, k, v, angles, cell, block), written: the vectors that have a direction, at length 1, with their angles to the
    pivots, the nearest pivot, and the block they are dealt to. A group that fits one block is one; the cells of a
    larger one are cut by hash into blocks of about `rows_of_block` (none: block_rows of the largest group), so a cell
    that holds most of a group is many."""
    group = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = df.select(F.col(key).alias("k"), F.col(col).cast("array<double>").alias("v"), group.alias("g"))
    # Where every group is one block, there is nothing that pivots could tell apart.
    largest, width = rows.groupBy("g").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("width"), F.lit(0))).first()
    rows_of_block = rows_of_block or block_rows(largest, width)
    crowded = largest > rows_of_block
    points = _pivots(rows, pivots) if crowded else np.zeros((1, 1))

    def locate(batches):
        for pdf in batches:
            ok, x = _units(pdf["v"])
            if len(ok):
                width = min(x.shape[1], points.shape[1])
                angles = np.arccos(np.clip(x[:, :width] @ points[:, :width].T, -1, 1))
                yield pd.DataFrame({"g": pdf["g"].to_numpy()[ok], "k": pdf["k"].to_numpy()[ok], "v": list(x), "angles": list(angles), "cell": angles.argmin(axis=1)})

    kind = df.schema[key].dataType.simpleString()
    rows = materialise(rows.where(F.size("v") > 0).mapInPandas(locate, f"g string, k {kind}, v array<double>, angles array<double>, cell int"), "located")
    if not crowded:
        return rows.withColumn("block", F.lit(0))
    cells = materialise(rows.groupBy("g", "cell").agg(F.count("*").alias("n")), "cells")
    whole = W.partitionBy("g")
    first = F.sum("blocks").over(whole.orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumn("cut", F.sum("n").over(whole) > rows_of_block).withColumn("blocks", F.ceil(F.col("n") / rows_of_block))
    cells = cells.select("g", "cell", F.when(F.col("cut"), F.coalesce(first, F.lit(0))).otherwise(0).alias("first"), F.when(F.col("cut"), F.col("blocks")).otherwise(1).alias("blocks"))
    dealt = (F.col("first") + F.pmod(F.xxhash64("k"), F.col("blocks"))).cast("int")
    out = materialise(rows.join(cells, ["g", "cell"]).withColumn("block", dealt).drop("first", "blocks"), "blocks")
    release(rows)
    return out


def meeting_blocks(rows: DataFrame, least: float) -> DataFrame:
    """(g, i, j), i <= j, of the blocks that may hold a pair with cosine of at least `least`.

    Angles keep the triangle inequality: two vectors at most t apart differ by t at most in their angles to any
    pivot, so blocks whose ranges of angles to some pivot lie further apart hold no pair. A block is one narrow row
    of ranges, met by cell of the other side, so a group's blocks are not met in one task.
    """
    widest = float(np.arccos(np.clip(least, -1, 1))) + ANGLE_SLACK
    some = rows.select("angles").first()
    count = len(some["angles"]) if some else 0
    angle = [F.col("angles")[p] for p in range(count)]
    spans = [f(a).alias(f"{n}{p}") for p, a in enumerate(angle) for n, f in (("low", F.min), ("high", F.max))]
    spans = materialise(rows.groupBy("g", "block").agg(F.min("cell").alias("cell"), *spans), "spans")
    # A block of a group that is one block spans cells; it is met through its first.
    rest = [c for c in spans.columns if c not in ("g", "cell")]
    cells = spans.select("g", "cell").distinct()
    right = spans.drop("cell").join(cells, "g").select("g", "cell", *[F.col(c).alias(f"o_{c}") for c in rest])
    near = F.col("block") <= F.col("o_block")
    for p in range(count):
        near = near & (F.col(f"low{p}") - F.col(f"o_high{p}") <= widest) & (F.col(f"o_low{p}") - F.col(f"high{p}") <= widest)
    return spans.join(right, ["g", "cell"]).where(near).select("g", F.col("block").alias("i"), F.col("o_block").alias("j"))


def similar_pairs(df: DataFrame, key: str, col: str, least: float, rows_of_block: int | None = None, by: str | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of all vectors with cosine of at least `least`; with `by` (a library, say) only of
    those that share it.

    A group's vectors are dealt to blocks around pivots; blocks that may hold a pair meet, each two as one matrix
    product: memory is two blocks, a small group is one block, and a vector is sent once per block that its own can
    meet. Zero and non-finite vectors match nothing; no vectors give no pairs.
    """
    rows = located(df, key, col, rows_of_block, by)
    if rows.where("block > 0").isEmpty():
        spread = rows.select("g", "k", "v", "block", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        meets = materialise(meeting_blocks(rows, least), "meets")
        sides = meets.select("g", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        spread = rows.select("g", "k", "v", "block").join(sides, ["g", "block"])
    kind = df.schema[key].dataType.simpleString()

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        x = _matrix(pdf["v"])
        a, b = (np.flatnonzero(pdf["block"].to_numpy() == n) for n in (i, j))
        out, keys = [], pdf["k"].to_numpy()
        for at in range(0, len(a), 512):
            s = x[a[at : at + 512]] @ x[b].T
            r, c = np.nonzero(s >= least)
            out.append(pd.DataFrame({"x": keys[a[at + r]], "y": keys[b[c]], "similarity": s[r, c]}))
        got = pd.concat(out)
        got = got[got["x"] < got["y"]] if i == j else got
        x, y = got["x"].to_numpy(), got["y"].to_numpy()
        low = x < y
        return pd.DataFrame({"a": np.where(low, x, y), "b": np.where(low, y, x), "similarity": got["similarity"].to_numpy()})

    return spread.groupBy("g", "i", "j").applyInPandas(product, f"a {kind}, b {kind}, similarity double")


def similar_pairs_plain(df: DataFrame, key: str, col: str, least: float) -> DataFrame:
    """The same by a join and array functions: a cross-check for small tables."""
    a, b = (df.select(F.col(key).alias(n), vectors.unit(F.col(col)).alias(f"v{n}")) for n in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", vectors.dot(F.col("va"), F.col("vb")).alias("similarity")).where(F.col("similarity") >= least)


def dbscan(df: DataFrame, key: str, col: str, eps: float, min_samples: int = 2, by: str | None = None) -> DataFrame:
    """(key, cluster): the smallest core key of each cluster; noise is a cluster of its own (its key). With `by`, each
    library is clustered by itself.

    Cores have min_samples - 1 or more neighbours within eps; clusters are components of cores, and a border
    point joins the cluster of the smallest core key near it. With 2 samples all of it is components.
    """
    pairs = materialise(similar_pairs(df, key, col, 1 - eps, by=by).select("a", "b"), "pairs")
    if not isinstance(df.schema[key].dataType, IntegralType):
        return _named(df, key, pairs, min_samples)
    found = _components(pairs, key, min_samples)
    return df.select(key).join(found, key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def _named(df: DataFrame, key: str, pairs: DataFrame, min_samples: int) -> DataFrame:
    """dbscan's result for keys that are no numbers: components are found over numbers that stand for them."""
    ids = materialise(df.select(F.col(key).alias("k")).distinct().withColumn("n", F.monotonically_increasing_id()), "ids")
    sides = {c: ids.select(F.col("k").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab"}
    numbered = materialise(pairs.join(sides["a"], "a").join(sides["b"], "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b")), "numbered")
    found = _components(numbered, "n", min_samples).join(ids, "n").select("k", F.col("cluster").alias("c"))
    # A cluster goes by its smallest core, which is a core and not a border point: of those in it with enough neighbours.
    both = numbered.select("a").unionByName(numbered.select(F.col("b").alias("a")))
    cores = both.groupBy("a").agg(F.count("*").alias("d")).where(F.col("d") + 1 >= max(2, min_samples)).join(ids, F.col("a") == F.col("n")).select(F.col("k").alias("core"))
    names = found.join(cores, F.col("k") == F.col("core")).groupBy("c").agg(F.min("k").alias("cluster"))
    named = found.join(names, "c").select(F.col("k").alias(key), "cluster")
    return df.select(key).join(named, key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def _components(pairs: DataFrame, key: str, min_samples: int) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cores = materialise(both.groupBy("a").count().where(F.col("count") + 1 >= max(2, min_samples)).select(F.col("a").alias("core")), "cores")
    inner = pairs.join(cores.withColumnRenamed("core", "a"), "a", "left_semi").join(cores.withColumnRenamed("core", "b"), "b", "left_semi")
    roots = connected_components(inner)
    core = cores.join(roots, cores["core"] == roots["node"], "left").select("core", F.coalesce("root", "core").alias("cluster"))
    border = both.join(cores.withColumnRenamed("core", "a"), "a", "left_anti").join(core, F.col("b") == F.col("core")).groupBy("a").agg(F.min("cluster").alias("cluster"))
    return core.select(F.col("core").alias(key), "cluster").unionByName(border.select(F.col("a").alias(key), "cluster"))


def split_in_order(n: int, distances: Callable[[int, np.ndarray], np.ndarray], sums: Callable[[np.ndarray], np.ndarray], most: float) -> list[list[int]]:
    """Groups of the rows 0 to n - 1 in which no distance is over `most`: each grows from the row nearest to all
    others by the row that keeps the largest distance, then the sum, then the number least.

    Only rows that are within `most` of the whole group so far are looked at again, and only their distances to the
    latest member are asked for: `distances(row, rows)`; `sums(rows)` is each row's sum of distances to all of them.
    """
    left, out = np.arange(n), []
    while len(left):
        seed = left[np.lexsort((left, sums(left)))[0]]
        group, widest, latest = [seed], 0.0, seed
        rest = left[left != seed]
        far, total = np.zeros(len(rest)), np.zeros(len(rest))
        while len(rest):
            d = distances(latest, rest)
            far, total = np.maximum(far, d), total + d
            ok = far <= most
            rest, far, total = rest[ok], far[ok], total[ok]
            if not len(rest):
                break
            k = np.lexsort((rest, total, np.maximum(far, widest)))[0]
            latest, widest = rest[k], max(widest, float(far[k]))
            group.append(latest)
            rest, far, total = np.delete(rest, k), np.delete(far, k), np.delete(total, k)
        out.append(sorted(int(x) for x in group))
        left = left[~np.isin(left, group)]
    return out


def split_by_diameter(matrix: np.ndarray, most: float) -> list[list[int]]:
    """split_in_order of a matrix of distances."""
    return split_in_order(len(matrix), lambda i, rows: matrix[i, rows], lambda rows: matrix[np.ix_(rows, rows)].sum(axis=1) - np.diag(matrix)[rows], most)


def split_vectors(x: np.ndarray, most: float) -> list[list[int]]:
    """split_in_order of unit vectors by cosine distance, without a matrix of distances: memory is the vectors, some
    times over. Distances and sums are rounded, so that equal ones are equal by whichever product they are found.

    A group costs two products of all rows that are left with one vector, the rows' sum (which tells their sums of
    distances) and the first row; in single precision, whose error is bounded, so that in double precision only the
    rows are looked at that can be the first or near it. Rows that are gone are passed over, and cut off by the quarter.
    """
    left, out = np.arange(len(x)), []
    error = large_cuts.rounding(x.shape[1])
    while len(left):
        v = x[left]
        single, alive, count, total = v.astype(np.float32), np.ones(len(left), bool), len(left), v.sum(axis=0)
        while count > (len(left) * 3 // 4 if len(left) > 256 else 0):
            near = single @ total.astype(np.float32)
            near[~alive] = -np.inf
            seeds = np.flatnonzero(near >= near.max() - 2 * error * np.linalg.norm(total) - 1e-8)
            seed = int(seeds[np.lexsort((seeds, (count - v[seeds] @ total).round(9)))[0]])
            rest = np.flatnonzero((single @ single[seed] >= 1 - most - error) & alive)
            group = large_cuts.grow(v, seed, rest[rest != seed], most)
            out.append(sorted(left[group].tolist()))
            alive[group], count, total = False, count - len(group), total - v[group].sum(axis=0)
        left = left[alive]
    return out


def _runs(batches: Iterable[pd.DataFrame], by: str) -> Iterator[list[pd.DataFrame]]:
    """Rows sorted by a column, as lists of whole groups: a batch's, of which the last waits for the next batch."""
    begun: list[pd.DataFrame] = []
    for pdf in batches:
        keys = pdf[by].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        groups = [pdf.iloc[x:y] for x, y in zip(cuts, cuts[1:]) if x < y]
        whole = []
        for group in groups:
            if begun and begun[0][by].iloc[0] != group[by].iloc[0]:
                whole.append(pd.concat(begun, ignore_index=True))
                begun = []
            begun.append(group)
        if whole:
            yield whole
    if begun:
        yield [pd.concat(begun, ignore_index=True)]


def refine(clusters: DataFrame, df: DataFrame, key: str, col: str, most: float, large: int = LARGE) -> DataFrame:
    """(key, cluster, part): clusters cut so that no pair in a part is further apart than `most`; part is the
    smallest key in it. A cluster of one is left as it is, and its vector is not moved; the others are read in order,
    and one task holds one cluster's vectors at a time, as the greedy order needs them all, but no distances. Clusters
    of more than `large` rows are cut by large_cuts."""
    kind = df.schema[key].dataType.simpleString()
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    sized = materialise(clusters.select(key, "cluster").join(sizes, "cluster").select(key, "cluster", "n"), "sized")
    one = sized.where("n = 1").join(df.where(vectors.has_length(vectors.norm(F.col(col)))).select(key), key).select(key, "cluster", F.col(key).alias("part"))
    rows = sized.where("n > 1").join(df.select(key, F.col(col).alias("v")), key)
    rows = rows.select(key, "cluster", "n", vectors.unit(F.col("v")).alias("v")).where("v is not null")
    largest, width = sized.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], 0
    if largest > large:
        width = rows.where(F.col("n") > large).agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    large = large if width <= large_cuts.WIDEST else largest
    whole, rows = rows.where(F.col("n") > large).drop("n"), rows.where(F.col("n") <= large).drop("n")

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.empty(len(pdf), object)
        for group in split_vectors(_matrix(pdf["v"]), most):
            part[group] = pdf[key].iloc[group[0]]
        return pd.DataFrame({key: pdf[key], "cluster": pdf["cluster"], "part": list(part)})

    def cut(batches):
        for groups in _runs(batches, "cluster"):
            yield pd.concat([parts(pdf) for pdf in groups])

    rows = rows.repartition("cluster").sortWithinPartitions("cluster", key)
    out = one.unionByName(rows.mapInPandas(cut, f"{key} {kind}, cluster {kind}, part {kind}"))
    if largest <= large:
        return out
    whole = whole.withColumn("v", vectors.align(F.col("v"), width))
    return out.unionByName(large_cuts.cut_large(whole, key, most, block_rows(largest, width)))


def face_weight() -> Column:
    """Confidence, where none or 0 is 0.5; 1 at least if confirmed, 0.35 at most if suspicious, 0.05 at least."""
    c = F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.5))
    c = F.when(F.coalesce("confirmed", F.lit(False)), F.greatest(c, F.lit(1.0))).when(suspicious(), F.least(c, F.lit(0.35))).otherwise(c)
    return F.greatest(F.lit(0.05), c)


#: Groups whose sums a task holds at a time.
SUM_GROUPS = 2000


def _mean(df: DataFrame, by: str, weight: str) -> DataFrame:
    """The unit weighted mean of vectors v per group: (by, m). Shorter vectors count as if they ended in zeros.

    A task adds up its rows of each group, so a group of any size is a few rows of sums to shuffle, whole and not by
    component: those of a group meet in order of groups, one sum at a time.
    """

    def longer(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = max(len(a), len(b))
        return np.pad(a, (0, n - len(a))), np.pad(b, (0, n - len(b)))

    def plus(old: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        if old is None:
            return x
        if len(old) != len(x):
            old, x = longer(old, x)
        return old + x

    def add(batches):
        sums: dict = {}
        for pdf in batches:
            for key, w, v in zip(pdf[by], pdf[weight], pdf["v"]):
                sums[key] = plus(sums.get(key), np.asarray(v, float) * w)
            if len(sums) > SUM_GROUPS:
                yield pd.DataFrame({by: list(sums), "v": list(sums.values())})
                sums = {}
        if sums:
            yield pd.DataFrame({by: list(sums), "v": list(sums.values())})

    def mean(batches):
        # The weights' sum only scales the mean, which has length 1 in the end.
        unit = lambda x: x / (np.sqrt(x @ x) + 1e-12)
        key, whole = None, None
        for pdf in batches:
            keys, out = [], []
            for k, v in zip(pdf[by], pdf["v"]):
                if whole is not None and k != key:
                    keys.append(key)
                    out.append(unit(whole))
                    whole = None
                key, whole = k, plus(whole, np.asarray(v, float))
            if keys:
                yield pd.DataFrame({by: keys, "m": out})
        if whole is not None:
            yield pd.DataFrame({by: [key], "m": [unit(whole)]})

    kind = df.schema[by].dataType.simpleString()
    sums = df.select(by, weight, "v").mapInPandas(add, f"{by} {kind}, v array<double>")
    return sums.repartition(by).sortWithinPartitions(by).mapInPandas(mean, f"{by} {kind}, m array<double>")


def representatives(faces: DataFrame, by: str = "person_id", col: str = "embedding", versions: tuple[str, ...] = ()) -> DataFrame:
    """(by, rep): weighted mean of a group's faces, then again with weights times how near each face is to it.

    Rejected faces, empty vectors and, where `versions` are given, vectors of others (column embedding_version) are
    left out.
    """
    fit = F.col("embedding_version").isin(*versions) if versions else F.lit(True)
    rows = faces.where(~rejected() & fit & (F.size(col) > 0) & F.col(by).isNotNull()).select(by, face_weight().alias("w"), F.col(col).cast("array<double>").alias("v"))
    first = _mean(rows, by, "w")
    near = rows.join(first, by).withColumn("s", vectors.dot(F.col("v"), F.col("m")) / (vectors.norm(F.col("v")) + 1e-12))
    again = near.withColumn("w2", F.col("w") * F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("s"))))
    return _mean(again.select(by, "v", "w2"), by, "w2").withColumnRenamed("m", "rep")


def scores_of(faces: DataFrame, people: DataFrame, key: str, col: str, rep: str, rows_of_block: int = BLOCK_ROWS) -> DataFrame:
    """(key, person_id, score): each face's best two people by dot product, rounded to 9 places, ties by person_id.

    People are dealt to blocks of about `rows_of_block`, faces to blocks alike, and each face block meets each people
    block as one matrix product that keeps two a face: what is shuffled is a vector once per block of the other side.
    """
    blocks = [max(1, -(-df.count() // rows_of_block)) for df in (faces, people)]
    side = lambda df, k, v, own, other: df.select(F.col(k).alias("k"), F.col(v).cast("array<double>").alias("v"), F.pmod(F.xxhash64(k), F.lit(own)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))
    a, b = side(faces, key, col, *blocks), side(people, "person_id", rep, *blocks[::-1])
    kinds = faces.schema[key].dataType.simpleString(), people.schema["person_id"].dataType.simpleString()

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: [], "person_id": [], "score": []})
        b, out = b.sort_values("k", ignore_index=True), []
        y = np.stack(b["v"].to_list())
        for at in range(0, len(a), 512):
            s = (np.stack(a["v"].iloc[at : at + 512].to_list()) @ y.T).round(9)
            for _ in range(min(2, len(b))):
                best = s.argmax(axis=1)
                out.append(pd.DataFrame({key: a["k"].to_numpy()[at : at + 512], "person_id": b["k"].to_numpy()[best], "score": s[np.arange(len(s)), best]}))
                s[np.arange(len(s)), best] = -np.inf
        return pd.concat(out)

    return a.groupBy("own", "other").cogroup(b.groupBy("other", "own")).applyInPandas(product, f"{key} {kinds[0]}, person_id {kinds[1]}, score double")


def best_match(scores: DataFrame, key: str, threshold: float, margin: float) -> DataFrame:
    """(key, person_id, score, second, accepted). scores: key, person_id, score."""
    w = W.partitionBy(key).orderBy(F.desc("score"), "person_id")
    rows = scores.select(key, "person_id", "score", F.row_number().over(w).alias("k"), F.lead("score").over(w).alias("second")).where("k = 1")
    ok = (F.col("score") >= threshold) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= margin))
    return rows.select(key, "person_id", "score", "second", ok.alias("accepted"))


def overlap_vote(clusters: DataFrame, faces: DataFrame, key: str = "face_id") -> DataFrame:
    """(cluster, person_id, votes, rank): existing owners of each cluster's faces."""
    votes = clusters.join(faces.where("person_id is not null").select(key, "person_id"), key).groupBy("cluster", "person_id").agg(F.count("*").alias("votes"))
    return votes.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("votes"), "person_id")))


def active_faces(people: DataFrame, faces: DataFrame) -> DataFrame:
    """(person_id, face_id, ...) of the faces that a person lists, owns, and that are not rejected. people: person_id, face_ids."""
    listed = people.select("person_id", F.explode("face_ids").alias("face_id"))
    return listed.join(faces.where(~rejected()), ["face_id", "person_id"])


def representative_faces(active: DataFrame) -> DataFrame:
    """Count, confirmed count, and the best face: confirmed, then confident, then first."""
    best = F.struct(F.coalesce("confirmed", F.lit(False)).cast("int").alias("c"), F.coalesce("confidence", F.lit(0.0)).alias("s"), (-F.col("pos")).alias("p"))
    return active.groupBy("person_id").agg(F.count("*").alias("faces"), F.count_if(F.coalesce("confirmed", F.lit(False))).alias("confirmed_faces"), F.max_by("face_id", best).alias("face_id"))


def suggestion_pairs(people: DataFrame, least: float = SUGGEST) -> DataFrame:
    """(library_id, source, target, similarity) of a library's people alike enough whom neither declined; the target is
    the named one, then the one with more faces, then the smaller id. people: library_id, person_id (unique), name,
    faces, rep, declined."""
    pairs = similar_pairs(people, "person_id", "rep", least, by="library_id").join(people.select(F.col("person_id").alias("a"), "library_id"), "a")
    return _directed(pairs, people).select("library_id", "source", "target", "similarity")


def _directed(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """Pairs (library_id, a, b, similarity, ...), a < b, that neither declined, with source and target."""
    side = lambda n: people.select(F.col("person_id").alias(n), F.trim(F.coalesce("name", F.lit(""))).alias(f"name_{n}"), F.col("faces").alias(f"faces_{n}"), F.coalesce("declined", F.array().cast("array<string>")).alias(f"declined_{n}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.where(~F.array_contains("declined_a", F.col("b").cast("string")) & ~F.array_contains("declined_b", F.col("a").cast("string")))
    named_a, named_b = F.col("name_a") != "", F.col("name_b") != ""
    a_wins = F.when(named_a != named_b, named_a).when(F.col("faces_a") != F.col("faces_b"), F.col("faces_a") > F.col("faces_b")).otherwise(F.col("a") <= F.col("b"))
    return rows.select(*pairs.columns, F.when(a_wins, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(a_wins, F.col("a")).otherwise(F.col("b")).alias("target"))


def _suggest(per_person: int, limit: int):
    def run(pdf: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
        out = [] if before is None else list(before[["library_id", "source", "target", "similarity"]].itertuples(index=False, name=None))
        used, counts = {x[1:3] for x in out}, Counter(p for x in out for p in x[1:3])
        pdf = pdf.sort_values(["person_id", "similarity", "other"], ascending=[True, False, True])
        for person, ranked in pdf.groupby("person_id", sort=True):
            if counts.get(person, 0) >= per_person:
                continue
            for lib, source, target, s in zip(ranked["library_id"], ranked["source"], ranked["target"], ranked["similarity"]):
                if (source, target) in used or counts.get(source, 0) >= per_person:
                    continue
                used.add((source, target))
                for x in (source, target):
                    counts[x] = counts.get(x, 0) + 1
                out.append((lib, source, target, s))
                if len(out) >= limit:
                    break
            if len(out) >= limit:
                break
        return pd.DataFrame(sorted(out, key=lambda x: -x[3]), columns=["library_id", "source", "target", "similarity"])

    return run


def suggestions(pairs: DataFrame, per_person: int = PER_PERSON, limit: int = SUGGESTIONS) -> DataFrame:
    """Each library's report of at most `limit` suggestions: people in the order of their ids each take their most
    alike, until `limit` is reached; no source is taken that has `per_person` already, and no person with as many
    takes. pairs: library_id, source, target, similarity.

    Each choice depends on those before it, so a library's candidates are one group of at most 8 * limit + 2 rows a
    person: a pair is passed over only if it is used or its source is full, and by then there are at most `limit`
    suggestions with 2 * limit people in them; so of the pairs in which a person has one role, no more can matter.
    """
    roles = F.array(*[F.struct(F.col(p).alias("person_id"), F.col(o).alias("other"), F.lit(p).alias("role")) for p, o in (("source", "target"), ("target", "source"))])
    both = pairs.select("library_id", "source", "target", "similarity", F.explode(roles).alias("x")).select("library_id", "source", "target", "similarity", "x.*")
    near = W.partitionBy("library_id", "person_id", "role").orderBy(F.desc("similarity"), "other")
    both = both.withColumn("k", F.row_number().over(near)).where(F.col("k") <= 4 * limit + 1).drop("k", "role")
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("library_id", "source", "target")}
    run = _suggest(per_person, limit)
    return both.groupBy("library_id").applyInPandas(lambda pdf: run(pdf), ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", similarity double")


#: People of a library whose pairs are looked at in the first turn of a report, and in one turn at most.
TURN, TURN_MOST = 64, 4096


def suggestion_report(people: DataFrame, least: float = SUGGEST, per_person: int = PER_PERSON, limit: int = SUGGESTIONS, turn: int = TURN) -> DataFrame:
    """suggestions of suggestion_pairs, without making all pairs: people are asked in the order of their ids until a
    library has `limit`, so each turn compares the next people of the libraries that have fewer with all of their
    library. A turn of `turn` people (four times as many in the next, TURN_MOST at most) is what one task holds."""
    people = materialise(people, "people")
    lib, kinds = people.schema["library_id"].dataType.simpleString(), people.schema["person_id"].dataType.simpleString()
    count = people.groupBy("library_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks = max(1, -(-count // BLOCK_ROWS))
    side = people.select("library_id", F.col("person_id").alias("k"), F.col("rep").cast("array<double>").alias("v"), F.pmod(F.xxhash64("person_id"), F.lit(blocks)).cast("int").alias("block")).where(F.size("v") > 0)

    def alike(asked: pd.DataFrame, everyone: pd.DataFrame) -> pd.DataFrame:
        vs, n = pd.concat([asked["v"], everyone["v"]], ignore_index=True), len(asked)
        ok, x = _units(vs)
        a, b = ok[ok < n], ok[ok >= n] - n
        s = (x[: len(a)] @ x[len(a) :].T).round(12)
        r, c = np.nonzero(s >= least)
        one, other = asked["k"].to_numpy()[a[r]], everyone["k"].to_numpy()[b[c]]
        out = pd.DataFrame({"library_id": asked["library_id"].iloc[0] if n else None, "person_id": one, "other": other, "similarity": s[r, c]})
        return out[out["person_id"] != out["other"]]

    run = _suggest(per_person, limit)
    found = people.sparkSession.createDataFrame([], f"library_id {lib}, source {kinds}, target {kinds}, similarity double")
    left = people.select("library_id", "person_id")
    while True:
        asked = left.withColumn("n", F.row_number().over(W.partitionBy("library_id").orderBy("person_id"))).where(F.col("n") <= turn)
        asked = materialise(asked.select("library_id", "person_id"), "asked")
        if asked.isEmpty():
            return found
        ask = side.join(F.broadcast(asked.select(F.col("library_id").alias("l"), F.col("person_id").alias("k"))), "k").where(F.col("library_id").eqNullSafe(F.col("l")))
        ask = ask.select(*[F.col(c).alias(c) for c in ("library_id", "k", "v")], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        near = ask.groupBy("library_id", "block").cogroup(side.groupBy("library_id", "block")).applyInPandas(alike, f"library_id {lib}, person_id {kinds}, other {kinds}, similarity double")
        pairs = _directed(near.withColumns({"a": F.least("person_id", "other"), "b": F.greatest("person_id", "other")}), people)
        role = F.col("source") == F.col("person_id")
        best = W.partitionBy("library_id", "person_id", role).orderBy(F.desc("similarity"), "other")
        pairs = pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= 4 * limit + 1).select("library_id", "person_id", "other", "source", "target", "similarity")
        found = materialise(pairs.groupBy("library_id").cogroup(found.groupBy("library_id")).applyInPandas(run, found.schema), "found")
        last = asked.groupBy(F.col("library_id").alias("l")).agg(F.max("person_id").alias("last"))
        full = found.groupBy(F.col("library_id").alias("f")).count().where(F.col("count") >= limit)
        rest = left.join(last, F.col("library_id").eqNullSafe(F.col("l"))).where(F.col("person_id") > F.col("last")).select("library_id", "person_id")
        left = materialise(rest.join(full, F.col("library_id").eqNullSafe(F.col("f")), "left_anti"), "left")
        turn = min(TURN_MOST, 4 * turn)


def assign_incrementally(faces: DataFrame, people: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(library_id, face_id, person_id, created) of each library's new faces in the order of `pos`: see
    assign_in_order. faces: library_id, pos, face_id, embedding (and the columns that tell a clusterable face);
    people: library_id, person_id, rep. One task holds one library's new faces and its people's vectors, as each
    face can become a person that later ones match."""
    new = faces.where(clusterable() & (F.size("embedding") > 0)).select("library_id", "pos", "face_id", F.col("embedding").cast("array<double>").alias("embedding"))
    known = people.where(F.size("rep") > 0).select("library_id", "person_id", F.col("rep").cast("array<double>").alias("rep"))
    kind = faces.schema["library_id"].dataType.simpleString()

    def assign(key, new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        reps = {}
        for person, v in zip(known["person_id"], known["rep"]):
            v = np.asarray(v, float)
            reps[person] = v / (np.linalg.norm(v) + 1e-12)
        out = assign_in_order(new.sort_values(["pos", "face_id"]), reps, threshold, margin)
        out.insert(0, "library_id", key[0])
        return out

    return new.groupBy("library_id").cogroup(known.groupBy("library_id")).applyInPandas(assign, f"library_id {kind}, face_id string, person_id string, created boolean")


#: Faces that are scored against all people at once; those that they make people of are scored among themselves.
ASSIGN_ROWS = 512


class _Known:
    """Unit vectors of one size and whose they are, in the order that they came in."""

    def __init__(self, width: int):
        self.x, self.ids = np.empty((64, width)), []

    def add(self, who: str, v: np.ndarray) -> None:
        if len(self.ids) == len(self.x):
            self.x = np.concatenate([self.x, np.empty_like(self.x)])
        self.x[len(self.ids)] = v
        self.ids.append(who)


def _top_two(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the place of the greatest number, the first of equals, that number and the next."""
    s[np.isnan(s)] = -np.inf
    at = s.argmax(axis=1)
    rows = np.arange(len(s))
    best = s[rows, at]
    s[rows, at] = -np.inf
    return at, best, s.max(axis=1)


def assign_in_order(faces: pd.DataFrame, people: dict[str, np.ndarray], threshold: float, margin: float) -> pd.DataFrame:
    """(face_id, person_id, created) of a library's new faces in their order; a face that nobody matches by the
    threshold and the margin becomes a person whom later faces can match.

    Faces are taken by ASSIGN_ROWS: one matrix product gives each its best two of the people there were before, and one
    its likeness to the others of its lot, of whom those that became people count."""
    known: dict[int, _Known] = {}
    for who, rep in people.items():
        known.setdefault(len(rep), _Known(len(rep))).add(who, rep)
    out, ids, vectors_ = [], faces["face_id"].to_numpy(), faces["embedding"].to_numpy()
    for start in range(0, len(ids), ASSIGN_ROWS):
        units = [np.asarray(v, float) for v in vectors_[start : start + ASSIGN_ROWS]]
        units = [v / (np.linalg.norm(v) + 1e-12) for v in units]
        lots: dict[int, list[int]] = {}
        for i, v in enumerate(units):
            lots.setdefault(len(v), []).append(i)
        scores = {}
        for width, lot in lots.items():
            own, x = known.setdefault(width, _Known(width)), np.stack([units[i] for i in lot])
            # Before all there is nobody, at 0.
            best = np.zeros(len(lot)), np.zeros(len(lot)), np.full(len(lot), -1)
            for at in range(0, len(own.ids), 8192):
                place, one, two = _top_two(np.concatenate([x @ own.x[at : min(at + 8192, len(own.ids))].T, np.zeros((len(lot), 1))], axis=1))
                more = one > best[0]
                best = np.where(more, one, best[0]), np.where(more, np.maximum(best[0], two), np.maximum(best[1], one)), np.where(more, place + at, best[2])
            among, made = np.nan_to_num(x @ x.T, nan=-np.inf), []
            for row, i in enumerate(lot):
                scores[i] = (row, best[0][row], best[1][row], best[2][row], among, made)
        for i, v in enumerate(units):
            row, first, second, place, among, made = scores[i]
            own = known[len(v)]
            who = own.ids[place] if place >= 0 else None
            if made:
                rows, names = zip(*made)
                s = among[row, list(rows)]
                k = int(s.argmax())
                if s[k] > first:
                    rest = np.delete(s, k)
                    first, second, who = s[k], max(first, rest.max(initial=0.0)), names[k]
                else:
                    second = max(second, s[k])
            new = who is None or first < threshold or first - second < margin
            if new:
                who = f"person-{ids[start + i]}"
                own.add(who, v)
                made.append((row, who))
            out.append((ids[start + i], who, bool(new)))
    return pd.DataFrame(out, columns=["face_id", "person_id", "created"])


def suppress_boxes(boxes: pd.DataFrame, most: float = 0.35) -> pd.DataFrame:
    """Greedy suppression: boxes by score, each kept unless it overlaps a kept one by more than `most`."""
    boxes, kept = boxes.sort_values(["score", "box_id"], ascending=[False, True], ignore_index=True), []
    x1, y1 = boxes["left"].to_numpy(float), boxes["top"].to_numpy(float)
    x2, y2 = x1 + boxes["width"].to_numpy(float), y1 + boxes["height"].to_numpy(float)
    area = (x2 - x1) * (y2 - y1)
    for i in range(len(boxes)):
        k = np.array(kept, int)
        both = np.clip(np.minimum(x2[i], x2[k]) - np.maximum(x1[i], x1[k]), 0, None) * np.clip(np.minimum(y2[i], y2[k]) - np.maximum(y1[i], y1[k]), 0, None)
        if not (both / np.maximum(area[i] + area[k] - both, 1e-12) > most).any():
            kept.append(i)
    return boxes.iloc[kept]


def suppress(df: DataFrame, by: str, most: float = 0.35) -> DataFrame:
    """suppress_boxes for each image."""
    return df.groupBy(by).applyInPandas(lambda pdf: suppress_boxes(pdf, most), df.schema)


def dedupe_faces(faces: DataFrame, pos: str | None = None) -> DataFrame:
    """Groups of faces of one identity key, as the entity that stays: the fields of the best face (confirmed, then
    owned, then confident, then of a deterministic id, then first by id, then by the column `pos`), the best
    confidence, any confirmation, and the deterministic id, under which it is stored. `deleted` counts the faces of
    other ids, which go. Faces that are stored already share the deterministic id: without `pos`, of equal ones the one
    of the smallest person counts.

    faces: library_id, face_id, filename, left, top, width, height, image_width, image_height, person_id, confidence, confirmed.
    """
    box = ("left", "top", "width", "height", "image_width", "image_height")
    key = media.identity_key(*(F.col(c) for c in ("library_id", "filename", *box))).alias("identity_key")
    flag = lambda c: (~c).cast("int")
    order = F.struct(
        flag(F.coalesce("confirmed", F.lit(False))).alias("c"), flag(F.coalesce("person_id", F.lit("")) != "").alias("a"),
        (-F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))).alias("s"), flag(F.col("face_id").startswith(media.FACE_PREFIX)).alias("d"), F.col("face_id").alias("id"),
        F.col(pos or "person_id").alias("p"),
    )
    fields = F.struct("face_id", "filename", "person_id", *box)
    rows = faces.withColumn("stored", media.face_id(*(F.col(c) for c in ("library_id", "filename", *box)))).withColumn("key", key)
    groups = rows.groupBy("library_id", F.col("key").alias("identity_key"), F.col("stored").alias("face_id")).agg(
        F.count("*").alias("copies"), F.count_if(F.col("face_id") != F.col("stored")).alias("deleted"), F.min_by(fields, order).alias("best"),
        F.max(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))).alias("confidence"), F.bool_or(F.coalesce("confirmed", F.lit(False))).alias("confirmed"),
    )
    return groups.where("copies > 1").select("library_id", "face_id", "copies", "deleted", F.col("best.face_id").alias("canonical"), "best.filename", F.nullif("best.person_id", F.lit("")).alias("person_id"), "confidence", "confirmed")


def repair_report(people: DataFrame, faces: DataFrame) -> DataFrame:
    """Counts of what a repair of memberships changes: one row. people: person_id, face_ids.

    A listed face counts once, by the first of: listed again in the same list, missing, rejected, not owned by the
    person. Faces that their owner does not list are added, owners that do not exist are cleared, and people left
    without faces are deleted; a person is changed by any removal or addition.
    """
    listed = people.select("person_id", F.explode("face_ids").alias("face_id")).where(F.coalesce("face_id", F.lit("")) != "")
    times = listed.groupBy("person_id", "face_id").agg((F.count("*") - 1).alias("again"))
    side = faces.select("face_id", F.col("person_id").alias("owner"), "filename", rejected().alias("bad"))
    what = F.when(F.col("bad").isNull(), "missing").when(F.col("bad"), "rejected").when(~F.coalesce(F.col("owner") == F.col("person_id"), F.lit(False)), "stale").otherwise("kept")
    members = times.join(side, "face_id", "left").withColumn("what", what)
    owned = faces.where(~rejected() & (F.coalesce("person_id", F.lit("")) != "")).select("face_id", "person_id", "filename")
    ids = people.select("person_id").distinct().withColumn("there", F.lit(True))
    owned = owned.join(ids, "person_id", "left").join(members.where("what = 'kept'").select("person_id", "face_id", F.lit(True).alias("listed")), ["person_id", "face_id"], "left")
    owned = owned.withColumn("what", F.when(F.col("there").isNull(), "orphan").when(F.col("listed").isNull(), "added").otherwise("kept"))
    rows = members.select("person_id", "face_id", "filename", "what", "again").unionByName(owned.where("what <> 'kept'").select("person_id", "face_id", "filename", "what", F.lit(0).cast("long").alias("again")))
    files = rows.unionByName(owned.select("person_id", "face_id", "filename", "what", F.lit(0).cast("long").alias("again"))).where(F.coalesce("filename", F.lit("")) != "")
    files = files.agg(F.count_distinct("filename").alias("affected_files"))
    # One row per person, with partial counts before the shuffle; then one row.
    n = lambda x: F.count_if(F.col("what") == x).alias(x)
    per = rows.groupBy("person_id").agg(F.sum("again").alias("duplicate"), *map(n, ("missing", "rejected", "stale", "kept", "added", "orphan")))
    per = ids.join(per, "person_id", "full_outer").fillna(0)
    gone = F.col("duplicate") + F.col("missing") + F.col("rejected") + F.col("stale") + F.col("added")
    sums = per.agg(
        F.count_if("there").alias("scanned_people"), F.count_if(gone > 0).alias("changed_people"), F.count_if(F.col("there") & (F.col("kept") + F.col("added") == 0)).alias("deleted_people"),
        *[F.coalesce(F.sum(x), F.lit(0)).alias(f"{x}_faces") for x in ("duplicate", "missing", "rejected", "stale", "added", "orphan")],
    )
    return sums.crossJoin(files).crossJoin(faces.agg(F.count("*").alias("scanned_faces")))
