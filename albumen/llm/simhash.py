"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits are split into blocks. At T or fewer differing bits, some block differs in few
(`near`) bits. In each block the anchors are the words of a covering code: Hamming(15,11) with covering
radius 1 on 15 of the bits (twice, radius 2, where the block has 30 or more), and every word on the rest. A
fingerprint lives at its nearest anchor and is replicated to every anchor within covering radius plus
`near`; so of two fingerprints that are that near in a block, one meets the other at its home. Fingerprints
are compared per anchor only.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.llm.common import connected_components, local_components, materialise, release

#: Words, as the contract has them, and what is lower-cased.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles hashed at a time, pairs compared at a time, and the size from which a group is searched by frontier.
HASHES, PAIRS, LARGE = 1 << 16, 1 << 21, 1 << 20
#: Rows of an anchor from which it is cut into cells.
HOT = 1 << 16
#: XXH64's seed.
SEED = 42


def fingerprint(text: str | None, words: int = 4) -> int:
    """A bit is 1 if over half of the shingles' XXH64 have it. No words: 0. Fewer than `words`: one shingle."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    # bytes.split() cuts at exactly these white spaces: \x20 and \x09-\x0d
    parts = data.split()
    if not parts:
        return 0
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    ones, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, HASHES):
        h = np.array([h64(line[a:b], SEED) for a, b in zip(starts[at : at + HASHES], ends[at : at + HASHES])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text_col: str = "text", words: int = 4, name: str = "fp") -> DataFrame:
    """df with its texts' fingerprints as signed longs in column `name`."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).astype(np.int64))

    return df.withColumn(name, run(F.col(text_col).cast("string")))


def _layout(blocks: int) -> list[tuple[int, int, int]]:
    """(shift, bits, Hamming codes) of each block."""
    base, more = divmod(64, blocks)
    out, at = [], 0
    for k in range(blocks):
        n = base + (k >= blocks - more)
        out.append((at, n, 2 if n >= 30 else 1))
        at += n
    return out


def _syndrome(h: np.ndarray) -> np.ndarray:
    """Of 15-bit words; bit i stands for column i + 1."""
    s = np.zeros(len(h), np.int64)
    for i in range(15):
        s ^= np.where((h >> i) & 1, i + 1, 0)
    return s


def _words_near(h: np.ndarray, radius: int):
    """Yields (rows, codeword, distance): all codewords of Hamming(15,11) within `radius` of h."""
    s = _syndrome(h)
    at = np.flatnonzero(s == 0)
    yield at, h[at], 0
    if radius >= 1:
        at = np.flatnonzero(s > 0)
        yield at, h[at] ^ (1 << (s[at] - 1)), 1
    if radius >= 2:
        at = np.flatnonzero(s > 0)
        for i in range(1, 16):
            j = i ^ s[at]
            k = at[(j > i) & (j > 0)]
            yield k, h[k] ^ (1 << (i - 1)) ^ (1 << ((i ^ s[k]) - 1)), 2
    if radius >= 3:
        for i in range(1, 16):  # three columns that sum to the syndrome
            for j in range(i + 1, 16):
                m = (i ^ j) ^ s
                k = np.flatnonzero(m > j)
                yield k, h[k] ^ (1 << (i - 1)) ^ (1 << (j - 1)) ^ (1 << (m[k] - 1)), 3
    if radius >= 4:
        for i in range(1, 16):
            for j in range(i + 1, 16):
                for g in range(j + 1, 16):
                    m = (i ^ j ^ g) ^ s
                    k = np.flatnonzero(m > g)
                    yield k, h[k] ^ (1 << (i - 1)) ^ (1 << (j - 1)) ^ (1 << (g - 1)) ^ (1 << (m[k] - 1)), 4


def _flips(bits: int, most: int):
    """(mask, flipped bits) of all words of `bits` bits and at most `most` ones."""
    masks = [(0, 0)]
    for i in range(bits):
        masks += [(m | 1 << i, d + 1) for m, d in masks if d < most]
    return masks


def home_anchor(fp: np.ndarray, block: tuple[int, int, int]) -> np.ndarray:
    shift, bits, codes = block
    x = (fp >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
    out = x.copy()
    for c in range(codes):
        h = (x >> 15 * c) & 0x7FFF
        s = _syndrome(h)
        out ^= np.where(s > 0, 1 << np.maximum(s - 1, 0), 0) << 15 * c
    return out


def anchors(fp: np.ndarray, block: tuple[int, int, int], near: int):
    """Yields (rows, anchor): every anchor within covering radius plus `near` of each fingerprint's block."""
    shift, bits, codes = block
    x = (fp >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
    radius = codes + near
    for mask, d in _flips(bits - 15 * codes, radius):
        rest = (x >> 15 * codes) ^ mask
        for rows, word, e in _words_near(x & 0x7FFF, radius - d):
            if codes == 1:
                yield rows, (rest[rows] << 15) | word
            else:
                for more, word2, _ in _words_near((x[rows] >> 15) & 0x7FFF, radius - d - e):
                    yield rows[more], (rest[rows[more]] << 30) | (word2 << 15) | word[more]


def near_anchors(words: np.ndarray, block: tuple[int, int, int], near: int):
    """(rows, anchor, home): each fingerprint's anchors, its home among them, each once."""
    home = home_anchor(words, block)
    got = [(rows, a) for rows, a in anchors(words, block, near) if len(rows)]
    rows, at = np.concatenate([r for r, _ in got]), np.concatenate([a for _, a in got])
    return rows, at, (at == home[rows]).astype(np.int8)


def _spread(blocks: int, near: int):
    def run(batches):
        layout = _layout(blocks)
        for pdf in batches:
            for at in range(0, len(pdf), 8192):
                fp = pdf["fp"].to_numpy()[at : at + 8192]
                for k, block in enumerate(layout):
                    rows, anchor, home = near_anchors(fp.view(np.uint64), block, near)
                    yield pd.DataFrame({"anchor": anchor | np.int64(k) << 40, "home": home, "fp": fp[rows]})

    return run


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, of fingerprints of one or more words (rows)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _frontier(nodes: np.ndarray, fps: np.ndarray, most: int) -> tuple[list, list]:
    """Links that span the components of a large group: each fingerprint is compared with those not reached yet."""
    nodes, first = np.unique(nodes, return_index=True)
    rest, a, b = np.arange(len(nodes)), [], []
    fps = fps[first]
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue:
            for x in queue.pop():
                hit = _differing(fps[rest], fps[x]) <= most
                if hit.any():
                    found, rest = rest[hit], rest[~hit]
                    a.append(np.full(len(found), nodes[x])), b.append(nodes[found])
                    queue.append(found)
    return a, b


def _compare(most: int, bits: list[str], node: str):
    """Among the fingerprints (columns `bits`) that meet at an anchor, spanning links. The partition is sorted by anchor
    and cell, homes first."""

    def links(key: np.ndarray, home: np.ndarray, ids: np.ndarray, fp: np.ndarray):
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        ends = np.r_[cuts[1:], len(key)]
        homes = np.add.reduceat(home.astype(np.int64), cuts)
        sizes = ends - cuts
        a, b = [], []
        large = homes * sizes > LARGE
        for k in np.flatnonzero(large):
            x, y = _frontier(ids[cuts[k] : ends[k]], fp[cuts[k] : ends[k]], most)
            a += x
            b += y
        use = np.flatnonzero(~large & (homes > 0) & (sizes > 1))
        # One row for each home, so that no step takes more than PAIRS comparisons or one home's.
        of = np.repeat(cuts[use], homes[use]) + np.arange(homes[use].sum()) - np.repeat(np.cumsum(homes[use]) - homes[use], homes[use])
        group = np.repeat(use, homes[use])
        cost = np.cumsum(sizes[group])
        for part in np.split(np.arange(len(of)), np.searchsorted(cost, np.arange(PAIRS, cost[-1] if len(cost) else 0, PAIRS))):
            if not len(part):
                continue
            n = sizes[group[part]]
            x = np.repeat(of[part], n)
            y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cuts[group[part]], n)
            hit = np.flatnonzero(ids[x] != ids[y])
            hit = hit[_differing(fp[x[hit]], fp[y[hit]]) <= most]
            a.append(ids[x[hit]]), b.append(ids[y[hit]])
        if a and len(x := np.concatenate(a)):
            nodes, least = local_components(x, np.concatenate(b))
            far = nodes != least
            yield pd.DataFrame({"a": nodes[far], "b": least[far]})

    def run(batches):
        held: list = []
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf[["anchor", "cell"]].to_numpy()
            fp = np.stack([pdf[c].to_numpy().view(np.uint64) for c in bits], axis=1)
            part = key, pdf["home"].to_numpy(), pdf[node].to_numpy(), fp
            if held and (held[0][0][0] == key[-1]).all():
                held.append(part)
                continue
            last = len(key) - int((key[::-1] == key[-1]).all(axis=1).argmin()) if (key != key[-1]).any() else 0
            held.append(tuple(x[:last] for x in part))
            whole = tuple(np.concatenate(x) for x in zip(*held))
            if len(whole[0]):
                yield from links(*whole)
            held = [tuple(x[last:] for x in part)]
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held)))

    return run


def meet(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """rows (anchor, home, ...) dealt out so that each partition has whole anchors, homes first.

    An anchor of more than `hot` rows is cut into cells: its rows are dealt to g parts, a home goes to the cells
    of its part with all others and every row to those of all parts with its own, so each home still meets each
    row, and no task holds more than about twice `hot` rows of an anchor.
    """
    many = rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    many = materialise(many.select("anchor", F.ceil(F.col("n") / hot).cast("int").alias("g")), "hot")
    if many.isEmpty():
        rows = rows.withColumn("cell", F.lit(0).cast("long"))
    else:
        g = F.coalesce("g", F.lit(1))
        part = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("anchor", "home")]), g)
        other = F.sequence(F.lit(0), g - 1)
        # (part as a home, all) with home 1, and (all, part) with home 0.
        cells = F.transform(other, lambda k: F.struct((k * g + part).cast("long").alias("cell"), F.lit(0).cast("byte").alias("home")))
        own = F.transform(other, lambda k: F.struct((part * g + k).cast("long").alias("cell"), F.lit(1).cast("byte").alias("home")))
        dealt = F.when(g == 1, F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.col("home")))).when(F.col("home") == 1, F.concat(own, cells)).otherwise(cells)
        rest = [c for c in rows.columns if c != "home"]
        rows = rows.join(many, "anchor", "left").select(*rest, F.explode(dealt).alias("to")).select(*rest, "to.home", "to.cell")
    return rows.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", F.desc("home"))


def near_links(fps: DataFrame, most: int = 4, blocks: int | None = None, hot: int = HOT) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints (fp long) at `most` or fewer differing bits.

    Exact: with b blocks some block differs in at most floor(most / b) bits. Blocks are chosen by the number of
    fingerprints, so that few share an anchor: 3 of 21 or 22 bits, and from 2**25 fingerprints on 2 of 32.
    """
    blocks = blocks or (3 if fps.count() < 1 << 25 else 2)
    rows = fps.select("fp").mapInPandas(_spread(blocks, most // blocks), "anchor long, home byte, fp long")
    return meet(rows, hot).mapInPandas(_compare(most, ["fp"], "fp"), "a long, b long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """One row per row of df: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null or wordless texts have fingerprint zero and link like any other. Copies share a fingerprint and are
    linked through it. Null ids stay null and never name a component unless it has no other id. An empty table
    gives no rows. Columns besides id and text are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = materialise(with_fingerprint(docs, "text", words).select("doc_id", "fp"), "fingerprints")
    fps = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # Written first: two Python stages in one task would need twice the workers.
    links = materialise(near_links(fps, most), "links")
    roots = connected_components(links).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialise(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "components")
    for old in (fps, links, rooted, least):
        release(old)
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row with its fingerprint and component. Null texts and ids and an empty table: as near_groups() says."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
