"""SimHash near-dedup of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity 15 % of a fingerprint's bits differ on average, too many for one fingerprint of 64 bits and
a fixed radius. So fingerprints have 256 bits, and anchors are chosen in many blocks: each block is a draw of
bits, its anchors are the words of Hamming(15,11) on 15 of them and every word on the rest, and a fingerprint is
replicated to every anchor within the covering radius. Those that meet at an anchor and differ in few of 128
bits are candidates; candidates are decided by the similarity of the whole sets. In each group of candidates, texts
meet first the one nearest to the group's centre, then more; pairs that are then linked through others need no
comparison. Of what is left, those meet that share one of their rarest shingles: two sets of 0.8 must, so texts that
are held together by what the whole group has never make a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumen.llm.common import connected_components, materialise, release
from albumen.llm.simhash import LOWER, _compare, meet, near_anchors

WORDS, SIMILAR = 5, 0.8
#: Bits of a fingerprint, of a comparison, and that candidates may differ in: at 0.8, 19.4 on average, deviation 4.1.
BITS, COMPARED, MOST = 256, 128, 34
#: Bits of a block: 18 at least, and as many as it takes to number the texts. Blocks: so many that at 0.8, where a
#: bit is equal with probability EQUAL, a pair meets in none with probability exp(-SURE). Anchors hold WIDER times
#: the pairs that are equal in all bits of a block.
LEAST_BITS, MOST_BITS, EQUAL, WIDER, SURE = 18, 38, 0.8485, 1.65, 5.0
#: Bits by which the last pairs are told apart, and that those may differ in: at 0.8, 155 on average, deviation 11.5.
WIDE_BITS, MOST_WIDE = 1024, 187
#: Shingles worked on together; pivots of a group in each round; pairs a text, on average, that may be left by then.
CHUNK, PIVOTS, EACH = 255, (1, 8), 8
#: Texts of a group that its centre is taken from. It only says which text is the first pivot.
CENTRE = 64
_PLACE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The set, sorted, as hashes. Words and case as in SimHash; fewer than five words, or none: one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    h64 = xxhash.xxh64_intdigest
    if len(parts) < WORDS:
        return np.array([h64(b" ".join(parts), 1)], np.uint64)
    w = np.array([h64(p) for p in parts], np.uint64)
    n = len(w) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for k, c in enumerate(_PLACE):
        h = _mixed(h + w[k : k + n] * np.uint64(c))
    return np.unique(h)


def fingerprint(h: np.ndarray, bits: int = BITS, first: int = 0) -> np.ndarray:
    """bits // 64 words: a bit is 1 if over half of the set's hashes have it. `first` tells apart families of hashes."""
    stirred = np.stack([_mixed(_mixed(h * np.uint64(_PLACE[k % 4])) + np.uint64(k // 4)) if k >= 4 else _mixed(h * np.uint64(_PLACE[k])) for k in range(first, first + bits // 64)], axis=1)
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(h), CHUNK):
        bits = np.unpackbits(stirred[at : at + CHUNK].view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def layout(n: int) -> tuple[int, int]:
    """Bits of a block, and number of blocks, for n texts."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 2)))))
    return bits, math.ceil(SURE / (WIDER * EQUAL**bits))


def draws(bits: int, blocks: int) -> np.ndarray:
    """BITS x blocks: a fingerprint's bits times this are its blocks' words. Each shuffle of the bits is dealt out in turn."""
    rng, out = np.random.default_rng(8), np.zeros((BITS, blocks))
    for k in range(blocks):
        at = k % (BITS // bits) * bits
        order = rng.permutation(BITS) if not at else order
        out[order[at : at + bits], k] = 2.0 ** np.arange(bits)
    return out


def _sign(batches):
    for pdf in batches:
        for at in range(0, len(pdf), 2048):
            part = pdf.iloc[at : at + 2048]
            sizes, rows = [], []
            for text in part["text"]:
                h = shingles(text)
                sizes.append(len(h)), rows.append(fingerprint(h).view(np.int64))
            frame = pd.DataFrame(np.array(rows).reshape(-1, BITS // 64), columns=FP)
            frame.insert(0, "size", np.array(sizes, np.int64))
            frame.insert(0, "name", part["name"].to_numpy())
            frame.insert(0, "node", part["node"].to_numpy())
            yield frame


FP = [f"f{k}" for k in range(BITS // 64)]
WIDE = [f"w{k}" for k in range(WIDE_BITS // 64)]
_COMPARED = FP[: COMPARED // 64]


def _spread(bits: int, blocks: int):
    def run(batches):
        deal = draws(bits, blocks)
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                fp = np.ascontiguousarray(part[FP].to_numpy())
                words = np.unpackbits(fp.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little") @ deal
                keep = part.drop(columns=FP[COMPARED // 64 :])
                for k in range(blocks):
                    rows, anchor, home = near_anchors(words[:, k].astype(np.uint64), (0, bits, 1), 0)
                    frame = keep.iloc[rows].reset_index(drop=True)
                    frame.insert(0, "home", home)
                    frame.insert(0, "anchor", anchor | np.int64(k) << 40)
                    yield frame

    return run


def candidates(signed: DataFrame, n: int) -> DataFrame:
    """(a, b): links that span the groups of nodes that meet and differ in at most MOST bits. signed: node, FP and n
    rows about."""
    bits, blocks = layout(n)
    columns = ["node", *_COMPARED]
    rows = signed.select("node", *FP).mapInPandas(_spread(bits, blocks), f"anchor long, home byte, {', '.join(f'{c} long' for c in columns)}")
    return meet(rows).mapInPandas(_compare(MOST, _COMPARED, "node"), "a long, b long")


def _widen(batches):
    for pdf in batches:
        words = np.array([fingerprint(shingles(t), WIDE_BITS, BITS // 64).view(np.int64) for t in pdf["text"]]).reshape(-1, len(WIDE))
        yield pd.concat([pdf.drop(columns="text"), pd.DataFrame(words, columns=WIDE, index=pdf.index)], axis=1)


def widened(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with WIDE bits of their texts, by which pairs near the bound are told apart four times as well."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"{c} long" for c in WIDE])
    return rows.join(texts, "node").select(*rows.columns, "text").mapInPandas(_widen, schema)


def _decide(batches):
    for pdf in batches:
        known: dict = {}
        a, b = [], []
        for x, y, s, t in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
            # A pivot comes many times.
            if y not in known:
                if len(known) > 64:
                    known.clear()
                known[y] = shingles(t)
            if similarity(shingles(s), known[y]) >= SIMILAR:
                a.append(x), b.append(y)
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _links(pairs: DataFrame, texts: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, decided): of pairs (a, b) that are not among those decided before, the ones similar enough; and all decided."""
    side = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    new = pairs.select("a", "b", *(c.alias(n) for c, n in zip(side, ("low", "high")))).distinct()
    new = new.join(decided.toDF("low", "high"), ["low", "high"], "left_anti").select("a", "b")
    pairs = materialise(new, "pairs")
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    links = materialise(both.select("a", "b", "text_a", "text_b").mapInPandas(_decide, "a long, b long"), "links")
    every = materialise(decided.unionByName(pairs.select(*side)), "decided")
    for old in (pairs, decided):
        release(old)
    return links, every


def _far(prefix: str):
    return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(prefix + c))) for c in WIDE), F.lit(0))


def _centre(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.unpackbits(np.ascontiguousarray(pdf[WIDE].to_numpy()).view(np.uint8), axis=1, bitorder="little")
    words = np.packbits(bits.sum(axis=0) * 2 > len(bits), bitorder="little").view(np.int64)
    return pd.DataFrame([[pdf["bucket"].iloc[0], *words]], columns=["bucket", *("c_" + c for c in WIDE)])


def _central(members: DataFrame, order) -> DataFrame:
    """Of each group the text nearest to the centre of some of its texts: where edits of one text are a group, an edit
    is nearer to that text than to other edits, so most are linked to what is nearest to it."""
    some = members.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(order))).where(F.col("k") <= CENTRE).select("bucket", *WIDE)
    centres = materialise(some.groupBy("bucket").applyInPandas(_centre, f"bucket long, {', '.join(f'c_{c} long' for c in WIDE)}"), "centres")
    near = F.struct(_far("c_").alias("far"), order.alias("order"))
    pivots = members.join(centres, "bucket").groupBy("bucket").agg(F.min_by(F.struct("node", "size", *WIDE), near).alias("p")).select("bucket", "p.*")
    pivots = materialise(pivots, "pivots")
    release(centres)
    return pivots


def _alike(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """(a, b): members and pivots of one group that sizes and WIDE bits do not rule out."""
    p = pivots.select("bucket", *(F.col(c).alias("p_" + c) for c in ("node", "size", *WIDE)))
    far = _far("p_")
    fit = (F.least("size", "p_size") >= SIMILAR * F.greatest("size", "p_size")) & (far <= MOST_WIDE) & (F.col("node") != F.col("p_node"))
    return members.join(p, "bucket").where(fit).select(F.col("node").alias("a"), F.col("p_node").alias("b"))


def _tokens(batches):
    for pdf in batches:
        for at in range(0, len(pdf), 256):
            part = pdf.iloc[at : at + 256]
            sets = [shingles(t).view(np.int64) for t in part["text"]]
            sizes = [len(h) for h in sets]
            yield pd.DataFrame({"bucket": np.repeat(part["bucket"].to_numpy(), sizes), "node": np.repeat(part["node"].to_numpy(), sizes), "token": np.concatenate(sets)})


def rarest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, token, node, size, at): of each text the shingles, from its group's rarest, of which it shares one with
    every text of the group that is similar enough; at: shingles before it. Those that no other text of the group has
    are counted only. members: bucket, node, size."""
    tokens = members.select("bucket", "node").join(texts, "node").select("bucket", "node", "text").mapInPandas(_tokens, "bucket long, node long, token long")
    tokens = materialise(tokens, "tokens")
    counts = materialise(tokens.groupBy("bucket", "token").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    shared = tokens.join(counts, ["bucket", "token"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("shared"))
    # At 4/5 at least 4/5 of the larger set are in both: one of any fifth of it and one more.
    first = F.col("size") - F.size("shared")
    most = F.greatest(F.floor(F.col("size") / 5) + 1 - first, F.lit(0)).cast("int")
    rows = members.select("bucket", "node", "size").join(shared, "node")
    rows = rows.select("bucket", "node", "size", first.alias("first"), F.posexplode(F.slice("shared", F.lit(1), most)).alias("pos", "x"))
    rows = materialise(rows.select("bucket", "x.token", "node", "size", (F.col("first") + F.col("pos")).alias("at")), "rarest")
    for old in (tokens, counts):
        release(old)
    return rows


def _sharing(rows: DataFrame, roots: DataFrame, star: bool) -> DataFrame:
    """(a, b): texts of different roots that share a shingle of `rarest` and may be similar enough by sizes and by what
    is left behind it; with `star`, each with one text of a shingle, at most as many as there are rows."""
    own = ["node", "size", "at", "root"]
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pick = F.min_by(F.struct(*own), F.struct(F.xxhash64("node"), "node")).alias("p")
    mixed = rooted.groupBy("bucket", "token").agg(pick, F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    mixed = mixed.select("bucket", "token", *(F.col(f"p.{c}").alias(f"p_{c}") for c in own))
    # 9 x both >= 4 x (sum of sizes) at a similarity of 4/5; at the first shingle that is in both, no more can be than follow.
    fit = (F.col("root") != F.col("p_root")) & (9 * F.least(F.col("size") - F.col("at"), F.col("p_size") - F.col("p_at")) >= 4 * (F.col("size") + F.col("p_size")))
    other = mixed
    if not star:
        rooted = rooted.join(mixed.select("bucket", "token"), ["bucket", "token"])
        other = rooted.select("bucket", "token", *(F.col(c).alias(f"p_{c}") for c in own))
        fit &= F.col("node") < F.col("p_node")
    return rooted.join(other, ["bucket", "token"]).where(fit).select(F.col("node").alias("a"), F.col("p_node").alias("b"))


def near_roots(docs: DataFrame) -> DataFrame:
    """(node, root, name) of each text that has a near copy: components of pairs at 0.8 or more. docs: node (long, the
    same for the same text), text, and name, which tells apart texts that share a node: one of them is looked at."""
    signed = docs.select("node", "text", "name").mapInPandas(_sign, f"node long, name string, size long, {', '.join(f'{c} long' for c in FP)}")
    signed = materialise(signed.groupBy("node").agg(F.min_by(F.struct("name", "size", *FP), "name").alias("s")).select("node", "s.*"), "signed")
    n = signed.count()
    met = materialise(candidates(signed, n), "met")
    groups = materialise(connected_components(met), "groups")
    # Few of the texts: all that follows is about these.
    members = materialise(signed.join(groups.withColumnRenamed("root", "bucket"), "node"), "members")
    for old in (signed, met, groups):
        release(old)
    # Sorted and merged at every size: the members of a large corpus are too many to broadcast.
    texts = docs.hint("merge").join(members.select("node", "name"), ["node", "name"], "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = materialise(texts, "texts")
    names = materialise(members.select("node", "name"), "names")
    told = materialise(widened(members.drop("name"), texts), "members")
    release(members)
    members = told
    none = texts.sparkSession.createDataFrame([], "a long, b long")
    links, decided, alone = materialise(none, "links"), materialise(none, "decided"), members
    for k, each in enumerate(PIVOTS):
        # Pivots of a group come from its texts that no pivot is like so far.
        order = F.struct(F.xxhash64("node", F.lit(k)), "node")
        if each == 1:
            pivots = _central(alone, order)
        else:
            pivots = alone.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(order))).where(F.col("k") <= each).drop("k")
            pivots = materialise(pivots, "pivots")
        found, decided = _links(_alike(members, pivots), texts, decided)
        both = materialise(links.unionByName(found), "links")
        linked = both.select(F.explode(F.array("a", "b")).alias("node")).unionByName(pivots.select("node")).distinct()
        rest = materialise(alone.join(linked, "node", "left_anti"), "alone")
        for old in (links, found, pivots, *([alone] if alone is not members else [])):
            release(old)
        links, alone = both, rest
        work = alone.groupBy("bucket").agg((F.count("*") * F.count("*")).alias("w")).agg(F.sum("w")).first()[0] or 0
        if work <= EACH * n:
            break
    release(alone)
    roots = materialise(connected_components(links), "roots")
    release(links)
    # What pivots have left, of groups of three or more (a pivot has met the other of two): first each text with one
    # for each of its shingles, then every pair.
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2")
    rest = materialise(members.select("bucket", "node", "size").join(left.select("bucket"), "bucket", "left_semi"), "rest")
    rows = rarest(rest, texts)
    release(rest)
    for star in (True, False):
        more, decided = _links(_sharing(rows, roots, star), texts, decided)
        every = materialise(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "links")
        found = materialise(connected_components(every), "roots")
        for old in (roots, more, every):
            release(old)
        roots = found
    release(rows)
    named = materialise(roots.join(names, "node"), "roots")
    for old in (roots, names, members, texts, decided):
        release(old)
    return named


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, name) of the rows to drop: all of a group but the one with the smallest id, nulls last, then the
    smallest name. name is the MD5 of the text; rows of one id and text are one document and go or stay together.
    Null texts count as empty; texts without words are copies of each other. An empty table gives no rows. Of two
    texts that share 64 bits of hash only one is looked at, and the other stays."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"node": F.xxhash64("text"), "name": F.md5("text")})
    # A text of several ids is a group of its own; other texts without near copies have one row.
    roots = near_roots(docs)
    known = roots.select("node", "name", "root")
    rows = docs.select("doc_id", "node", "name").distinct().join(known, ["node", "name"], "left")
    rows = rows.select("doc_id", "name", F.coalesce(F.col("root").cast("string"), "name").alias("group"))
    rows = materialise(rows, "rows")
    release(roots)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), "name")
    first = materialise(rows.groupBy("group").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    dropped = materialise(rows.join(first, "group").where(rank != F.col("first")).select("doc_id", "name"), "dropped")
    for old in (rows, first):
        release(old)
    return dropped
