"""Cuts by diameter of clusters that are too large to ask every row for every group.

The greedy order is one chain: which row begins a group depends on all groups before. What can be spread is found before
it by block products on all tasks: the rows near each row. The chain is then left with one look at all rows a group, for
the row nearest to all others; that goes over integers of which two rows share a number, with a bound of their error.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from albumen.operators.graph import materialise

#: Rows of a block at most: a row's place in its block is 16 bits.
MOST_ROWS = 65_536
#: Two integers in one single-precision number: the lower one is below half of this, all sums are below 2^24 and exact.
FIELD = 4096.0
#: Components of a vector at most: of longer ones, the integers would be too small to tell rows apart.
WIDEST = 5000
#: Rows that are looked at by the greatest of their numbers first.
STRIP = 128


def rounding(width: int) -> float:
    """A bound of the error of a product of two unit vectors in single precision."""
    return 2.4e-7 * (width + 2)


def grow(x: np.ndarray, seed: int, rest: np.ndarray, most: float) -> list[int]:
    """A group of split_in_order: the seed and those of `rest` that join it."""
    group, widest, latest = [seed], 0.0, seed
    far, total = np.zeros(len(rest)), np.zeros(len(rest))
    while len(rest):
        d = np.clip(1 - x[rest] @ x[latest], 0, 2).round(12)
        far, total = np.maximum(far, d), total + d
        ok = far <= most
        rest, far, total = rest[ok], far[ok], total[ok]
        if not len(rest):
            break
        k = np.lexsort((rest, total, np.maximum(far, widest)))[0]
        latest, widest = int(rest[k]), max(widest, float(far[k]))
        group.append(latest)
        rest, far, total = np.delete(rest, k), np.delete(far, k), np.delete(total, k)
    return group


class _Packed:
    """Unit vectors times one scale as integers, two rows a number, by component; and which rows they are.

    With the integers of a vector t, each product's two halves are whole, and an exact product is off by `error` at most:
    the rows' greatest rounding, and t's own."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        n, width = len(rows), x.shape[1]
        self.scale = np.floor(np.sqrt(FIELD / 2 - 1) - np.sqrt(width) / 2)
        self.x, self.rows, self.half = x, rows, -(-n // (2 * STRIP)) * STRIP
        self.packed = np.zeros((width, self.half), np.float32)
        # Rows that are gone, or never were, are below all others.
        self.below = np.full((2, self.half), -np.inf, np.float32)
        # Fresh pages for each group cost as much as the numbers in them.
        self.both, self.scores, self.spare = np.empty(self.half, np.float32), np.empty((2, self.half), np.float32), np.empty(self.half, np.float32)
        self.lost = 0.0
        for side in (0, 1):
            mine = rows[side * self.half : (side + 1) * self.half]
            self.below[side, : len(mine)] = 0
            for at in range(0, len(mine), 8192):
                v = x[mine[at : at + 8192]]
                q = np.rint(v * self.scale)
                self.lost = max(self.lost, float(np.sqrt(((v - q / self.scale) ** 2).sum(axis=1)).max()))
                self.packed[:, at : at + len(q)] += (q * (FIELD if side else 1.0)).T.astype(np.float32)

    def drop(self, rows: np.ndarray) -> None:
        at = np.searchsorted(self.rows, rows)
        self.below[at // self.half, at % self.half] = -np.inf

    def nearest(self, t: np.ndarray, count: int) -> int:
        """The row with the least sum of distances, rounded, to `count` rows whose sum is t; the first of equal ones."""
        length = float(np.sqrt(t @ t))
        unit = t / length if length > 0 else t
        q = np.rint(unit * self.scale)
        both, scores, spare = self.both, self.scores, self.spare
        np.dot(q.astype(np.float32), self.packed, out=both)
        np.rint(np.multiply(both, np.float32(1 / FIELD), out=spare), out=scores[1])
        np.subtract(both, np.multiply(scores[1], np.float32(FIELD), out=spare), out=scores[0])
        np.add(scores, self.below, out=scores)
        # A strip is a column: numpy finds the maxima of columns much faster than those of short rows.
        scores = scores.reshape(STRIP, -1)
        tops = scores.max(axis=0)
        strip = int(tops.argmax())
        best = self.rows[int(scores[:, strip].argmax()) * len(tops) + strip]
        rest = unit - q / self.scale
        error = self.lost * float(np.sqrt(q @ q)) / self.scale + float(np.sqrt(rest @ rest)) + 1e-6
        # Sums are rounded to 9 places, so what is a little less near can be equal.
        least = float(self.x[best] @ unit) - error - (2e-9 / length if length > 0 else 0.0)
        least *= self.scale**2
        strips = np.flatnonzero(tops >= least)
        at = np.flatnonzero(scores[:, strips].ravel() >= least)
        rows = self.rows[at // len(strips) * len(tops) + strips[at % len(strips)]]
        return int(rows[np.lexsort((rows, (count - self.x[rows] @ t).round(9)))[0]])


def split_with_near(x: np.ndarray, most: float, near: Callable[[int], np.ndarray]) -> list[list[int]]:
    """people.split_vectors, where `near(row)` gives all rows that can be within `most` of a row, and maybe others."""
    left, out = np.arange(len(x)), []
    alive = np.ones(len(x), bool)
    while len(left):
        packed, count, total = _Packed(x, left), len(left), x[left].sum(axis=0)
        while count > (len(left) * 7 // 8 if len(left) > STRIP else 0):
            seed = packed.nearest(total, count)
            rest = near(seed)
            rest = np.sort(rest[alive[rest] & (rest != seed)])
            group = np.sort(grow(x, seed, rest, most))
            out.append(group.tolist())
            alive[group] = False
            packed.drop(group)
            count, total = count - len(group), total - x[group].sum(axis=0)
        left = left[alive[left]]
    return out


def near_rows(rows: DataFrame, least: float, block: int) -> DataFrame:
    """(cluster, i, j, counts, near): for each block i of a cluster's rows, of `block` rows in the order of `at`, which rows
    of block j have a cosine of at least `least` with each, a little below it too. `counts` (int32) tells how many for
    each row of i, `near` (uint16) their places in j. rows: cluster, at (0, 1, ...), n, v (array<float>, length 1)."""
    kind = rows.schema["cluster"].dataType.simpleString()
    own = F.floor(F.col("at") / block).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int")))
    sides = rows.select("cluster", "at", "v", own.alias("own"), other.alias("other"))
    sides = sides.select("cluster", "at", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x = np.array(pdf["v"].to_list(), np.float32)
        mine = pdf["at"].to_numpy() // block == i
        a, b = (x, x) if i == j else (x[mine], x[~mine])
        limit, counts, found = least - rounding(x.shape[1]), [], []
        for at in range(0, len(a), 512):
            hit = a[at : at + 512] @ b.T >= limit
            counts.append(np.count_nonzero(hit, axis=1))
            found.append((np.flatnonzero(hit) % len(b)).astype(np.uint16))
        counts, found = np.concatenate(counts), np.concatenate(found)
        out = [(i, j, counts, found)]
        if i != j:
            whose = np.repeat(np.arange(len(a), dtype=np.uint16), counts)
            out.append((j, i, np.bincount(found, minlength=len(b)), whose[np.argsort(found, kind="stable")]))
        return pd.DataFrame([(pdf["cluster"].iloc[0], r, c, n.astype(np.int32).tobytes(), near.tobytes()) for r, c, n, near in out], columns=["cluster", "i", "j", "counts", "near"])

    return sides.groupBy("cluster", "i", "j").applyInPandas(product, f"cluster {kind}, i int, j int, counts binary, near binary")


class _Near:
    """near_rows of one cluster, kept in a file of the task's own: only which places of it are a row's is held."""

    def __init__(self, block: int):
        self.block, self.file, self.size, self.starts = block, tempfile.TemporaryFile(), 0, {}  # noqa: SIM115

    def add(self, i: int, j: int, counts: bytes, near: bytes) -> None:
        ends = self.size + np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)
        self.starts.setdefault(i, []).append((j, np.concatenate([[self.size], ends])))
        self.file.write(near)
        self.size += len(near) // 2

    def lookup(self) -> Callable[[int], np.ndarray]:
        self.file.flush()
        places = np.asarray(np.memmap(self.file, np.uint16, "r")) if self.size else np.empty(0, np.uint16)
        table = {i: (np.array([j for j, _ in of]) * self.block, np.stack([s for _, s in of])) for i, of in self.starts.items()}
        self.starts = {}

        def near(row: int) -> np.ndarray:
            first, starts = table[row // self.block]
            low, high = starts[:, row % self.block], starts[:, row % self.block + 1]
            return np.concatenate([places[a:b] for a, b in zip(low.tolist(), high.tolist())]) + np.repeat(first, high - low)

        return near


def cut_large(rows: DataFrame, key: str, most: float, block: int) -> DataFrame:
    """(key, cluster, part) of large clusters' rows (key, cluster, v of length 1): as people.refine cuts them. Near rows
    are found by products of blocks, spread over all tasks; then one task holds a cluster's vectors and reads its near rows
    from a file of its own."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, "cluster")}
    block = min(block, MOST_ROWS)
    places = W.partitionBy("cluster")
    narrow = rows.select(key, "cluster").select(key, "cluster", (F.row_number().over(places.orderBy(key)) - 1).alias("at"), F.count("*").over(places).alias("n"))
    rows = materialise(rows.join(narrow, [key, "cluster"]).select(key, "cluster", "at", "n", "v"), "numbered")
    near = materialise(near_rows(rows.select("cluster", "at", "n", F.col("v").cast("array<float>").alias("v")), 1 - most, block), "near")

    def parts(keys: list, vs: list, near: _Near) -> dict:
        x = np.array(vs)
        part = np.empty(len(x), object)
        for group in split_with_near(x, most, near.lookup()):
            part[group] = keys[group[0]]
        return {key: keys, "part": list(part)}

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whose, keys, vs, near_of = None, [], [], None
        for pdf in batches:
            for cluster, pdf in pdf.groupby("cluster", sort=False):
                if near_of is None or cluster != whose:
                    if keys:
                        yield pd.DataFrame(parts(keys, vs, near_of) | {"cluster": whose})
                    whose, keys, vs, near_of = cluster, [], [], _Near(block)
                own = pdf[pdf["i"] < 0]
                keys += own[key].tolist()
                vs += own["v"].tolist()
                for i, j, counts, found in pdf.loc[pdf["i"] >= 0, ["i", "j", "counts", "near"]].itertuples(index=False):
                    near_of.add(i, j, counts, found)
        if keys:
            yield pd.DataFrame(parts(keys, vs, near_of) | {"cluster": whose})

    # A cluster's vectors come first, in their order, then what is near.
    none = lambda kind: F.lit(None).cast(kind)
    # Not null: pandas would read whole numbers beside nulls as floating ones.
    blank = F.lit("0").try_cast(kinds[key])
    own = rows.select("cluster", F.lit(-1).alias("i"), F.col("at").alias("j"), key, "v", none("binary").alias("counts"), none("binary").alias("near"))
    found = near.select("cluster", "i", "j", blank.alias(key), none("array<double>").alias("v"), "counts", "near")
    both = own.unionByName(found).repartition("cluster").sortWithinPartitions("cluster", "i", "j")
    return both.mapInPandas(cut, f"{key} {kinds[key]}, part {kinds[key]}, cluster {kinds['cluster']}").select(key, "cluster", "part")
