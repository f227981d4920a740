"""Similarity digests from improbable features.

Every window of B bytes has an entropy; the rarer its entropy is among all windows of the corpus, the rarer
the window. In each run of W windows the rarest one (leftmost of equals) gets a vote; windows of T or more
votes are a text's features; in stretches without any, the windows of any vote are. Their hashes go, in the order of the text, into a chain of Bloom filters, and
two chains are compared by normalised overlap of bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, windows of a run, votes of a feature; texts of up to FEW windows use all.
B, W, T, FEW = 32, 64, 16, 128
#: Short texts use all windows of SMALL bytes; texts of a length between these use both kinds.
SHORT, SMALL = (144, 256), 8
#: Windows with no feature this near on either side are in a stretch without features.
BARE = 2 * W
#: Bits of a filter, features it holds, bits a feature sets, classes of entropy.
BITS, HELD, SET, CLASSES = 2048, 160, 5, 1001
#: Windows with less than this share of the highest entropy (runs of a few bytes) are never features.
FLAT = 0.1
#: Characters worked on together, rows of a range of ids, and most ranges: one bound of each goes through the driver. A
#: task reads its range in order and holds two texts of it, so a range may be of any size.
CHUNK, RANGE_ROWS, MOST_RANGES = 1 << 20, 2000, 20_000
_G = np.array([0.0, *(c * np.log2(c) for c in range(1, B + 1))])
_STEP = np.rint((_G[1:] - _G[:-1]) * 4096).astype(np.int32)
_MOST = int(_STEP.sum())


def entropy_classes(buf: np.ndarray) -> np.ndarray:
    """The class, 0 (all bytes differ) to 1000 (all equal), of the window at each place of a byte array.

    A window's sum of c log c over its byte counts changes, from one window to the next, by what the byte
    that leaves and the byte that comes are worth at their counts; a running sum in integers is exact.
    """
    n = len(buf)
    if n < B:
        return np.zeros(0, np.int32)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, B):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = sum(int(_STEP[int((buf[:k] == buf[k]).sum())]) for k in range(B))
    change = _STEP[before[B:]] - _STEP[after[: n - B]]
    total = first + np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
    return (total * (CLASSES - 1) // _MOST).astype(np.int32)


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end: first byte, and number of windows."""
    return np.cumsum(sizes) - sizes, np.maximum(sizes - B + 1, 0)


def _within(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def histogram(texts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], np.int64)
    starts, counts = _places(sizes)
    classes = entropy_classes(np.frombuffer(b"".join(texts), np.uint8))
    return np.bincount(classes[_within(starts, counts)], minlength=CLASSES) if counts.sum() else np.zeros(CLASSES, np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Of each class by rarity in the corpus, 0 the rarest; CLASSES for flat windows."""
    out = np.empty(CLASSES, np.int64)
    out[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    entropy = np.log2(B) - np.arange(CLASSES) / (CLASSES - 1) * np.log2(B)
    out[entropy < FLAT * np.log2(B)] = CLASSES
    return out


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for word in rows.view("<u8").T:
            h = (h ^ word) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
    return h


def chains(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The filters, as rows of BITS // 8 bytes, of each text. No bytes: no filter."""
    # A short text's features are its small windows; one shorter than that is padded.
    texts = [t.ljust(SMALL, b"\0") if t else t for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    starts, counts = _places(sizes)
    if not sizes.sum():
        return [np.zeros((0, BITS // 8), np.uint8)] * len(texts)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    short, long = sizes < SHORT[1], sizes >= SHORT[0]
    few, many = long & (counts <= FEW), long & (counts > FEW)
    picked = [_within(starts[few], counts[few])]
    if many.any():
        worth = rank[entropy_classes(buf)]
        # The leftmost rarest of each W windows, by doubling.
        low, reach = (worth << 40) | np.arange(len(worth)), 1
        while reach < W:
            low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
        runs = _within(starts[many], counts[many] - W + 1)
        votes = np.bincount(low[runs] & ((1 << 40) - 1), minlength=len(worth))
        chosen = np.flatnonzero(votes)
        voted = (votes[chosen] >= T) & (worth[chosen] < CLASSES)
        # Where a text is too repetitive for T votes, windows of any vote are features, flat ones too: never none.
        place = chosen + 2 * BARE * (np.searchsorted(starts[many], chosen, side="right") - 1)
        known = np.concatenate([[-BARE - 1], place[voted], [place[-1] + BARE + 1]])
        after = np.searchsorted(known, place)
        bare = np.minimum(place - known[np.maximum(after - 1, 0)], known[after] - place) > BARE
        picked.append(chosen[voted | bare])
    at = np.concatenate(picked)
    view = np.lib.stride_tricks.sliding_window_view
    h = _hash(view(buf, B)[at]) if len(at) else np.zeros(0, np.uint64)
    small = _within(starts[short], np.maximum(sizes[short] - SMALL + 1, 0))
    at, h = np.concatenate([at, small]), np.concatenate([h, _hash(view(buf, SMALL)[small])])
    full = np.flatnonzero(sizes > 0)
    doc = full[np.searchsorted(starts[full], at, side="right") - 1]
    # The first of a text's equal features.
    order = np.lexsort((at, h, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    keep = order[fresh]
    keep = keep[np.lexsort((at[keep], doc[keep]))]
    doc, h = doc[keep], h[keep]
    each = np.bincount(doc, minlength=len(texts))
    filters = -(-each // HELD)
    base = np.cumsum(filters) - filters
    slot = base[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) // HELD
    bits = np.zeros((int(filters.sum()), BITS), np.uint8)
    for k in range(SET):
        bits[slot, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    return np.split(packed, np.cumsum(filters)[:-1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the smaller chain its best overlap with one of the other chain, weighted by its bits.

    An overlap counts by how far it is from what chance gives, three deviations added, to all that could be.
    """
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    pa, pb = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    if (len(a), pa.sum(), a.tobytes()) > (len(b), pb.sum(), b.tobytes()):
        a, b, pa, pb = b, a, pb, pa
    best = np.zeros(len(a))
    wide = np.unpackbits(b, axis=1).astype(np.float32)
    for i in range(0, len(a), 256):
        both = np.unpackbits(a[i : i + 256], axis=1).astype(np.float32) @ wide.T
        chance = pa[i : i + 256, None] * pb[None] / BITS
        floor = chance + 3 * np.sqrt(chance)
        most = np.minimum(pa[i : i + 256, None], pb[None])
        score = np.where(most > floor, (both - floor) / np.maximum(most - floor, 1e-9), both == most)
        best[i : i + 256] = np.clip(score.max(axis=1), 0, 1)
    return float((best * pa).sum() / pa.sum())


def edited(text: str, after: str) -> str:
    """The text with its last quarter (floor) replaced by as many characters of the next one, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _histograms(batches):
    for pdf in batches:
        total, held, size = np.zeros(CLASSES, np.int64), [], 0
        for t in pdf["text"]:
            held.append(_bytes(t or ""))
            size += len(held[-1])
            if size > CHUNK:
                total, held, size = total + histogram(held), [], 0
        total += histogram(held)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"class": at.astype(np.int32), "n": total[at]})


def corpus_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks from the entropies of all windows of all texts; the driver gets one row per class."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(_histograms, "class int, n long")
    counts = np.zeros(CLASSES, np.int64)
    for r in rows.groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[r["class"]] = r.n
    return ranks(counts)


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs dealt to ranges of ids and sorted: part, doc_id, text, ahead. A range ends with a copy (`ahead`) of
    the next one's first document, the last range with one of the first, so each task sees every successor."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n, nulls, least = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    parts = min(MOST_RANGES, max(1, n // RANGE_ROWS))
    bounds: list[int] = []
    if parts > 1:
        found = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10_000, 20 * parts))).first()[0]
        bounds = [b for b in sorted(set(found or [])) if b > least]
    cut = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        out = np.zeros(len(x), np.int32)
        out[known] = np.searchsorted(cut, x[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", part_of("doc_id"))
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id").eqNullSafe(F.lit(least))
    own = F.struct("part", F.lit(0).alias("ahead"))
    starts_part = F.col("doc_id").isin(bounds) if len(bounds) <= 2000 else _member(cut)(F.col("doc_id"))
    copy = F.when(starts_part, F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("ahead")))
    copy = F.when(is_first, F.struct(F.lit(len(bounds)).alias("part"), F.lit(2).alias("ahead"))).otherwise(copy)
    dealt = rows.select("doc_id", "text", F.explode(F.array_compact(F.array(own, copy))).alias("to")).select("to.part", "to.ahead", "doc_id", "text")
    return dealt.repartition("part").sortWithinPartitions("part", "ahead", F.asc_nulls_first("doc_id"), F.xxhash64("text"))


def _member(values: np.ndarray):
    @F.pandas_udf("boolean")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.isin(x.fillna(values[0] - 1).to_numpy().astype(np.int64), values))

    return run


def _digest(rank: np.ndarray):
    def finish(pairs: list):
        texts = [a for _, a, _ in pairs]
        changed = [edited(a, b) for _, a, b in pairs]
        after = {k + 1: k for k in range(len(pairs) - 1) if pairs[k][2] is pairs[k + 1][1]}
        apart = [k for k in range(len(pairs)) if k + 1 not in after]
        own = chains([_bytes(t) for t in texts], rank)
        new = chains([_bytes(t) for t in changed], rank)
        far = dict(zip(apart, chains([_bytes(pairs[k][2]) for k in apart], rank))) if apart else {}
        out = []
        for k, (doc_id, text, _) in enumerate(pairs):
            succ = far[k] if k in far else own[k + 1]
            out.append((doc_id, len(text), hashlib.sha256(_bytes(changed[k])).hexdigest(), own[k].tobytes().hex(), new[k].tobytes().hex(), likeness(own[k], new[k]), likeness(own[k], succ)))
        frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        return frame.astype({"doc_id": "Int64"})

    def run(batches):
        held, part, pairs, size = None, None, [], 0
        for pdf in batches:
            for p, ahead, doc_id, text in zip(pdf["part"], pdf["ahead"], pdf["doc_id"], pdf["text"]):
                if held is not None and p == part:
                    pairs.append((*held, text))
                    size += 2 * len(held[1])
                held, part = (None if ahead else (None if pd.isna(doc_id) else int(doc_id), text)), p
                if size > CHUNK:
                    yield finish(pairs)
                    pairs, size = [], 0
        if pairs:
            yield finish(pairs)

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty; an empty text has an empty fingerprint, like 1 to its equal and 0 to others.
    Null ids come first; rows of one id are ordered by a hash of their text. A lone row is its own successor. An
    empty table gives no rows. Texts are shuffled once, by range of ids.
    """
    return in_order(docs, id_col, text_col).mapInPandas(
        _digest(corpus_ranks(docs, text_col)),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op4_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Digests of every text and its edited form. Null and empty texts, null ids and an empty table: as digests() says."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
