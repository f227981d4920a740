"""Digests against the definition, window by window and bit by bit."""

import math
import random
from collections import Counter

import numpy as np

from albumen.llm import fingerprint as fp


def entropy_class(window):
    """0 where all bytes differ, the highest class where all are equal, by a sum of c log c in the operator's steps."""
    step = lambda c: round((c * math.log2(c) - ((c - 1) * math.log2(c - 1) if c > 1 else 0)) * 4096)
    total = sum(step(c) for n in Counter(window).values() for c in range(1, n + 1))
    return total * (fp.CLASSES - 1) // sum(step(c) for c in range(1, fp.B + 1))


def hashed(window):
    h, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for at in range(0, len(window), 8):
        h = (h ^ int.from_bytes(window[at : at + 8], "little")) * 0xBF58476D1CE4E5B9 & full
        h ^= h >> 29
        h = h * 0x94D049BB133111EB & full
        h ^= h >> 32
    return h


def features(data, rank):
    """Hashes of the selected windows, in the order of the text."""
    if not data:
        return []
    data = data.ljust(fp.SMALL, b"\0")
    n = len(data) - fp.B + 1
    found = []
    if len(data) >= fp.SHORT[0]:
        chosen = range(n)
        if n > fp.FEW:
            worth = [int(rank[entropy_class(data[i : i + fp.B])]) for i in range(n)]
            votes = Counter(min(range(r, r + fp.W), key=lambda i: (worth[i], i)) for r in range(n - fp.W + 1))
            sure = [i for i, v in votes.items() if v >= fp.T and worth[i] < fp.CLASSES]
            chosen = [i for i in votes if i in sure or all(abs(i - s) > fp.BARE for s in sure)]
        found += [(i, hashed(data[i : i + fp.B])) for i in chosen]
    if len(data) < fp.SHORT[1]:
        found += [(i, hashed(data[i : i + fp.SMALL])) for i in range(len(data) - fp.SMALL + 1)]
    first = {}
    for i, h in sorted(found):
        first.setdefault(h, i)
    return [h for h, _ in sorted(first.items(), key=lambda x: (x[1], x[0]))]


def chain(data, rank):
    """Sets of bits, one a filter."""
    hs = features(data, rank)
    return [{h >> 11 * k & fp.BITS - 1 for h in hs[at : at + fp.HELD] for k in range(fp.SET)} for at in range(0, len(hs), fp.HELD)]


def alike(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    spelled = lambda c: b"".join(np.packbits([k in f for k in range(fp.BITS)]).tobytes() for f in c)
    a, b = sorted((a, b), key=lambda c: (len(c), sum(map(len, c)), spelled(c)))
    total = 0.0
    for f in a:
        best = 0.0
        for g in b:
            chance = len(f) * len(g) / fp.BITS
            floor, most = chance + 3 * math.sqrt(chance), min(len(f), len(g))
            best = max(best, (len(f & g) - floor) / (most - floor) if most > floor else float(len(f & g) == most))
        total += min(max(best, 0.0), 1.0) * len(f)
    return total / sum(map(len, a))


def texts():
    random.seed(12)
    words = ["river", "über", "stone", "a", "of", "x9!", "Loser", "night,", "ciónraí", "tree."]
    prose = lambda n: " ".join(random.choice(words) + random.choice(["", "s", str(random.randrange(99))]) for _ in range(n))
    out = ["", "a", "short", prose(4), prose(18), prose(25), prose(33), prose(60), prose(400), "ha " * 150, "ab" * 300 + prose(80), prose(90) + "=" * 700, "é" * 64]
    return [t.encode() for t in out]


def test_entropies():
    for t in texts():
        got = fp.entropy_classes(np.frombuffer(t, np.uint8))
        assert got.tolist() == [entropy_class(t[i : i + fp.B]) for i in range(len(t) - fp.B + 1)]


def test_ranks_are_by_rarity_and_flat_windows_are_none():
    counts = np.arange(fp.CLASSES)[::-1] % 7
    rank = fp.ranks(counts)
    flat = [c for c in range(fp.CLASSES) if rank[c] == fp.CLASSES]
    # Those under a tenth of the highest entropy; the very tenth may round to either side.
    assert flat == list(range(flat[0], fp.CLASSES)) and flat[0] in (900, 901)
    rest = [c for c in range(fp.CLASSES) if c not in flat]
    assert sorted(rest, key=lambda c: rank[c]) == sorted(rest, key=lambda c: (counts[c], c))


def test_chains_and_likeness():
    data = texts()
    rank = fp.ranks(sum(fp.histogram([t]) for t in data))
    got, want = fp.chains(data, rank), [chain(t, rank) for t in data]
    for g, w in zip(got, want):
        assert [set(np.flatnonzero(row).tolist()) for row in np.unpackbits(g, axis=1)] == w
    for i in range(len(data)):
        for j in range(len(data)):
            assert abs(fp.likeness(got[i], got[j]) - alike(want[i], want[j])) < 1e-5
    one = [fp.chains([t], rank)[0] for t in data]
    assert all((a == b).all() for a, b in zip(one, got))
