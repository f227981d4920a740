"""The stages that drop copies, against plain loops."""

import random

import corpus_pipeline
import numpy as np
from albumen.llm import near_copies, simhash


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_copies_at_similarity_of_four_fifths(spark):
    random.seed(4)
    word = lambda: "w%d" % random.randrange(5000)
    docs = {}
    for k in range(60):
        words = [word() for _ in range(random.randint(80, 300))]
        docs[k] = " ".join(words)
        for j in (1, 2):
            edited = list(words)
            for _ in range(len(words) // 60 + j):
                edited[random.randrange(len(words))] = word()
            docs[100 * j + k] = " ".join(edited)
    root = {k: k for k in docs}
    sets = {k: shingle_set(t) for k, t in docs.items()}
    pairs = [(a, b) for a in docs for b in docs if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in docs:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id for r in corpus_pipeline.near(spark, frame(spark, list(docs.items())), "").collect()}
    assert pairs and got == {k for k in docs if root[k] == k}


def test_groups_searched_by_pivots(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "EACH", -1)
    monkeypatch.setattr(near_copies, "PIVOTS", (1, 2, 2))
    test_near_copies_at_similarity_of_four_fifths(spark)


def test_a_loose_group_is_told_apart(spark):
    """Texts that SimHash joins into one group, of which only some are near copies."""
    random.seed(6)
    base = [f"w{k}" for k in range(200)]
    docs = {}
    for k in range(30):
        words = list(base)
        for _ in range(1 + k // 5):
            words[random.randrange(200)] = f"z{random.random()}"
        docs[k] = " ".join(words)
    sets = {k: shingle_set(t) for k, t in docs.items()}
    root = {k: k for k in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id for r in corpus_pipeline.near(spark, frame(spark, list(docs.items())), "").collect()}
    assert 1 < len(got) < 30 and got == {k for k in docs if root[k] == k}


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    """Texts of one passage and an end of their own, similar by 0.75: as many comparisons as texts, not all pairs."""
    random.seed(9)
    passage, pairs, links = " ".join(f"w{k}" for k in range(138)), [], near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda p, *rest: (pairs.append(p.distinct().count()), links(p, *rest))[1])
    docs = {k: f"{passage} " + " ".join(f"e{k}x{j}" for j in range(22)) for k in range(120)}
    docs |= {1000 + k: f"{docs[k]} more" for k in range(0, 120, 8)}
    docs |= {2000 + k: docs[1000 + k].replace(f" e{k}x11 ", " other ") for k in range(0, 120, 16)}
    got = {r.doc_id for r in corpus_pipeline.near(spark, frame(spark, list(docs.items())), "").collect()}
    assert got == {k for k in docs if k < 1000}
    assert sum(pairs) < 12 * len(docs)


def test_rarest_shingles_of_similar_sets(spark):
    """Every pair at 0.8 or more shares one of its rarest shingles, where sizes and what follows allow the similarity."""
    random.seed(12)
    docs = {k: " ".join(f"w{j}" for j in range(random.randint(40, 60)) if random.random() > 0.02 * (k % 3)) for k in range(40)}
    sets = {k: near_copies.shingles(t) for k, t in docs.items()}
    members = spark.createDataFrame([(1, k, len(h)) for k, h in sets.items()], "bucket long, node long, size long")
    rows = near_copies.rarest(members, spark.createDataFrame(list(docs.items()), "node long, text string"))
    none = spark.createDataFrame([], "node long, root long")
    got = {tuple(sorted(r)) for r in near_copies._sharing(rows, none, False).collect()}
    want = {(a, b) for a in docs for b in docs if a < b and near_copies.similarity(sets[a], sets[b]) >= 0.8}
    assert want and want <= got
    stars = near_copies._sharing(rows, none, True)
    assert stars.count() <= rows.count()


def test_recall_of_anchors_at_the_bound():
    """Pairs of sets at a similarity of 0.8 that meet at an anchor and are near enough."""
    rng = np.random.default_rng(3)
    bits, blocks = near_copies.layout(200_000)
    deal, met = near_copies.draws(bits, blocks), 0
    for _ in range(300):
        h = rng.integers(0, 1 << 63, 220, dtype=np.uint64)
        a, b = (near_copies.fingerprint(x) for x in (h[:198], h[22:]))
        words = np.unpackbits(np.array([a, b]).view(np.uint8).reshape(2, -1), axis=1, bitorder="little") @ deal
        hit = False
        for k in range(blocks):
            rows, anchor, home = simhash.near_anchors(words[:, k].astype(np.uint64), (0, bits, 1), 0)
            of = [set(anchor[rows == i].tolist()) for i in (0, 1)]
            homes = set(anchor[home == 1].tolist())
            hit |= bool(of[0] & of[1] & homes)
        met += hit and int(np.bitwise_count(a[:2] ^ b[:2]).sum()) <= near_copies.MOST
    assert met >= 291


def test_only_the_copy_of_an_id_goes(spark):
    text = lambda k, n=40: " ".join(f"x{k}y{i}" for i in range(n))
    same, long = text(0), text(1, 400)
    unique = [(None, text(2)), (None, text(3)), (5, text(4)), (30, text(5)), (None, None)]
    rows = [(1, same), (None, same), (9, same), (5, same), (20, long), (None, long + " end"), (30, long + " fin"), (20, long), *unique]
    after = corpus_pipeline.exact(spark, frame(spark, rows), "")
    show = lambda rows: sorted(map(tuple, rows), key=str)
    want = [r for r in rows if r[1] != same or r[0] == 9]
    assert show(after.collect()) == show(want)
    assert show(corpus_pipeline.near(spark, after, "").collect()) == show([(9, same), (20, long), (20, long), *unique])
