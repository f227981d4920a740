"""URL filter by a cascade of Bloom filters.

Rules are keys of host and path, like `example.com/en/`. A url's candidate keys are its host and parent
domains with the starts of its path that are as long as some rule's. The candidates of all urls are the
universe. Level 1 encodes the listed keys; level 2 the keys of the universe that level 1 wrongly holds; level
3 the listed keys that level 2 wrongly holds; and so on until none is left. Membership is then exact for the
universe, with no join and no key stored. One cascade holds the blocking and one the allowing rules.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rules of the registered query: fixed values.
ALLOW = ("com/", "www.example.com/en/")
BLOCK = ("example.com/en/", "net/es/", "net/fr/")
#: False-positive rate of later levels, and levels and bytes that a cascade may have.
RATE, MOST_LEVELS, MOST_BYTES = 0.5, 64, 256 << 20
#: False positives of the first level, a listed key, over which the build stops with an error: a rate gone wrong.
WRONG_KEYS = 64


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def candidates(host, path, sizes: list[int], most_labels: int) -> F.Column:
    """A url's possible keys, the longest first: parent domains of up to most_labels labels (no rule has more) times
    starts of the path of the given lengths. Their number does not grow with the url."""
    labels = F.split(host, r"\.")
    last = F.slice(labels, -F.least(F.size(labels), F.lit(most_labels)), most_labels)
    domains = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
    starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(sizes, reverse=True)]
    keys = F.flatten(F.transform(domains, lambda d: F.array(*[F.concat(d, s) for s in starts])))
    keys = F.filter(keys, lambda k: k.isNotNull())
    longer = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(keys, longer))


class Level:
    """One Bloom filter: k positions by double hashing of a key's two 64-bit hashes, stirred by the level."""

    def __init__(self, number: int, keys: int, rate: float):
        self.number = number
        self.bits = max(64, math.ceil(keys * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
        self.hashes = max(1, round(self.bits / max(keys, 1) * math.log(2)))
        self.hashes = min(self.hashes, 32)
        self.data = np.zeros(self.bits // 64, np.uint64)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a, b = h1.astype(np.uint64), h2.astype(np.uint64)
        stir = np.uint64((self.number * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1)
        with np.errstate(over="ignore"):
            a = (a ^ stir) * np.uint64(0xBF58476D1CE4E5B9)
            a ^= a >> np.uint64(31)
            b = ((b + stir) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
            b ^= (b >> np.uint64(29)) << np.uint64(1)
            out = a[:, None] + np.arange(self.hashes, dtype=np.uint64) * b[:, None]
            out ^= out >> np.uint64(33)
        return out % np.uint64(self.bits)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        p = self.places(h1, h2).ravel()
        np.bitwise_or.at(self.data, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if not len(h1):
            return np.zeros(0, bool)
        p = self.places(h1, h2)
        return ((self.data[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade:
    def __init__(self):
        self.levels: list[Level] = []

    def reaches(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How many levels in a row hold each key."""
        depth, live = np.zeros(len(h1), np.int64), np.arange(len(h1))
        for level in self.levels:
            live = live[level.holds(h1[live], h2[live])]
            depth[live] += 1
        return depth

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for listed keys and the universe: the last level that a key passes is one of listed keys."""
        return self.reaches(h1, h2) % 2 == 1


def _hashes(keys: F.Column) -> tuple[F.Column, F.Column]:
    return F.transform(keys, lambda k: F.xxhash64(k, F.lit(1))), F.transform(keys, lambda k: F.xxhash64(k, F.lit(2)))


def _among(a: np.ndarray, b: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which pairs of a and b are among those of first (sorted) and second."""
    at, end = np.searchsorted(first, a), np.searchsorted(first, a, side="right")
    out = np.zeros(len(a), bool)
    while (live := np.flatnonzero(at < end)).size:
        out[live] |= second[at[live]] == b[live]
        at[live] += 1
    return out


def build(spark, listed: list[str], universe: DataFrame) -> Cascade:
    """universe: one column `key`; repeats are fine. Only keys that pass level 1 wrongly are made distinct, about
    as many as are listed, whatever the universe's size. What is broadcast and collected is bound by the list: its
    hashes, its bits, and at most WRONG_KEYS hashes a listed key and WRONG_KEYS more."""
    out = Cascade()
    listed = sorted(set(listed))
    if not listed:
        return out
    if len(listed) * 16 > MOST_BYTES:
        raise ValueError("the list is too long for one cascade")
    own = spark.createDataFrame([(k,) for k in listed], "key string").select("key", F.xxhash64("key", F.lit(1)).alias("h1"), F.xxhash64("key", F.lit(2)).alias("h2")).collect()
    mine = np.array([r.h1 for r in own], np.int64), np.array([r.h2 for r in own], np.int64)
    size = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
    first = Level(1, len(listed), min(RATE, max(1e-12, len(listed) * math.sqrt(0.5) / size)))
    first.add(*mine)
    out.levels.append(first)
    order = np.lexsort(mine[::-1])
    known = mine[0][order], mine[1][order]
    shared = spark.sparkContext.broadcast((out, known))

    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """Held by level 1, and not listed."""
        cascade, listed = shared.value
        a, b = h1.to_numpy(), h2.to_numpy()
        held = cascade.holds(a, b)
        at = np.flatnonzero(held)
        held[at[_among(a[at], b[at], *listed)]] = False
        return pd.Series(held)

    hashed = universe.select(F.xxhash64("key", F.lit(1)).alias("h1"), F.xxhash64("key", F.lit(2)).alias("h2"))
    wrong = hashed.where(passes("h1", "h2")).distinct()
    # The rate is such that about as many keys pass wrongly as are listed.
    most = WRONG_KEYS * (len(listed) + 1)
    rows = wrong.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} false positives at the first level; the list is too long for one cascade")
    other = np.array([r.h1 for r in rows], np.int64), np.array([r.h2 for r in rows], np.int64)
    while len(other[0]):
        if len(out.levels) >= MOST_LEVELS:
            raise ValueError("two keys have equal hashes; the cascade cannot tell them apart")
        level = Level(len(out.levels) + 1, len(other[0]), RATE)
        level.add(*other)
        out.levels.append(level)
        hit = level.holds(*mine)
        mine, other = other, tuple(x[hit] for x in mine)
    return out


def judge(pages: DataFrame, allow: list[str], block: list[str], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    The longest rule that fits wins (of equally long ones, the first by code points; a rule in both lists
    allows); where none fits, rule is null and the verdict is `default`. Null urls and urls without :// have
    an empty host and path and fit no rule. Null ids and repeated rows are kept, and urls of any length have a
    bounded number of keys. An empty table gives no rows. Only id and url are read, and pages are never shuffled.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("__url"))
    sizes = sorted({len(split_rule(r)[1]) for r in [*allow, *block]})
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    labels = max((split_rule(r)[0].count(".") + 1 for r in [*allow, *block]), default=1)
    rows = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), sizes, labels) if sizes else F.array().cast("array<string>"))
    universe = rows.select(F.explode("keys").alias("key"))
    both = spark.sparkContext.broadcast([build(spark, list(x), universe) for x in (allow, block)])

    @F.pandas_udf("int")
    def first(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """Place of the first listed key, from 1; below 0 if it blocks; 0 for none."""
        n = h1.map(len).to_numpy()
        out = np.zeros(len(n), np.int32)
        if n.sum():
            a, b = np.concatenate(h1.to_list()).astype(np.int64), np.concatenate(h2.to_list()).astype(np.int64)
            yes, no = (c.holds(a, b) for c in both.value)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + 1
            at = np.flatnonzero(yes | no)[::-1]
            out[row[at]] = np.where(yes[at], place[at], -place[at])
        return pd.Series(out)

    found = rows.withColumn("at", first(*_hashes(F.col("keys"))))
    rule = F.when(F.col("at") != 0, F.element_at("keys", F.when(F.col("at") == 0, 1).otherwise(F.abs("at"))))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.when(F.col("at") > 0, "allow").when(F.col("at") < 0, "block").otherwise(default).alias("verdict"))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule, host, path, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), m AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC, r.rule) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the fixed rules. Null and long urls, repeated rows and an empty table: as judge() says."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), list(ALLOW), list(BLOCK))
