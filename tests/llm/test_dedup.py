import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from albumen.llm import exact_dedup, simhash
from albumen.llm.common import connected_components


def docs_df(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, fp string, name int")


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "only null id"), (7, "x" * 50_000), (8, "x" * 50_000), (9, "x" * 49_999 + "y"), (10, "é" * 9000)]


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_groups_against_brute_force(spark, block):
    random.seed(3)
    words = [random.choice(["aa", "b", "ccc d"]) for _ in range(60)]
    rows = EDGE + [(100 + k, " ".join(words[: k % 40])) for k in range(80)]
    got = exact_dedup.exact_groups(docs_df(spark, rows).repartition(4), block_chars=block).collect()
    assert sorted(map(tuple, got), key=str) == exact_brute(rows)


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(docs_df(spark, [])).collect() == []


def fingerprint_brute(text, words=4):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = simhash.WORDS.findall(t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint(spark):
    for t in [None, "", "One", "A b\tC d É e\x0bf", "a b c d", "w " * 100_001, "\x85   x  y z q"]:
        assert simhash.fingerprint(t) == fingerprint_brute(t)


def groups_brute(fps, most=4):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("blocks", [3, 2])
def test_anchor_cover_finds_every_near_pair(blocks):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for flips in range(5):
        y = x.copy()
        for k in range(len(y)):
            for bit in rng.choice(64, flips, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(bit)
        met = np.zeros(len(x), bool)
        for block in simhash._layout(blocks):
            home = simhash.home_anchor(y, block)
            for rows, anchor in simhash.anchors(x, block, 4 // blocks):
                np.logical_or.at(met, rows, home[rows] == anchor)
        assert met.all()


@pytest.mark.parametrize("blocks,hot", [(3, simhash.HOT), (2, simhash.HOT), (3, 5)])
def test_near_links_against_brute_force(spark, blocks, hot):
    random.seed(blocks)
    fps = [random.getrandbits(64) for _ in range(150 if blocks == 3 else 40)]
    for f in fps[:60] if blocks == 3 else fps[:20]:
        g = f
        for _ in range(3):
            for b in random.sample(range(64), random.randint(1, 5)):
                g ^= 1 << b
            fps.append(g)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.near_links(df, 4, blocks, hot)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want, got = groups_brute(fps), [roots.get(f, f) for f in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_frontier_equals_pairs():
    random.seed(1)
    base = random.getrandbits(63)
    fps = [base ^ (1 << random.randrange(60)) ^ (1 << random.randrange(60)) for _ in range(200)] + [random.getrandbits(63) for _ in range(50)]
    fps = sorted(set(fps))
    a, b = simhash._frontier(np.array(fps, np.int64), np.array(fps, np.uint64)[:, None], 4)
    nodes, root = simhash.local_components(np.concatenate(a), np.concatenate(b))
    got = dict(zip(nodes.tolist(), root.tolist()))
    want = groups_brute(fps)
    assert len(set(zip(want, [got.get(f, f) for f in fps]))) == len(set(want))


def test_near_groups(spark):
    random.seed(9)
    long = " ".join(str(random.randrange(900)) for _ in range(3000))
    rows = EDGE + [(20, long), (21, long + " end"), (22, long.replace(" 7 ", " 8 ", 1))]
    got = simhash.near_groups(docs_df(spark, rows)).collect()
    fps = [fingerprint_brute(t) for _, t in rows]
    label = groups_brute(fps)
    least = defaultdict(list)
    for (i, _), k in zip(rows, label):
        if i is not None:
            least[k].append(i)
    want = sorted(((i, f"{f:016x}", min(least[k], default=None)) for (i, _), f, k in zip(rows, fps, label)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.near_groups(docs_df(spark, [])).collect() == []


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(301)}
