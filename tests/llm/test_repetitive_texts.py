"""Texts that repeat a few bytes."""

import numpy as np

from albumen.llm import fingerprint


def test_repetitive_texts_have_fingerprints():
    texts = ["ha " * 400, "spam! " * 300, "buy now! " * 200, "click here " * 200, "=-" * 500, "a" * 1000, "b" * 1000, ""]
    rank = fingerprint.ranks(np.arange(fingerprint.CLASSES))
    chains = fingerprint.chains([t.encode() for t in texts], rank)
    assert len({c.tobytes() for c in chains}) == len(texts)
    assert all(len(c) for c in chains[:-1]) and not len(chains[-1])
    assert all(fingerprint.likeness(a, b) < 0.5 for i, a in enumerate(chains) for b in chains[:i])
    # Three quarters stay when the edit brings prose.
    prose = " ".join(f"word{k}" for k in range(300))
    own, new = fingerprint.chains([t.encode() for t in (texts[0], fingerprint.edited(texts[0], prose))], rank)
    assert fingerprint.likeness(own, new) > 0.5
