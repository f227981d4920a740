"""Hierarchical multi-length packing of tokenised documents.

Each task packs the documents it reads, block by block: texts are routed to tiers of context size, whole
windows of the longest tier are cut off, each remainder opens a window of the smallest tier that holds it,
and gaps are filled from shorter tiers, the last piece being cut to fit. What is left at the end of a block
is cut at powers of two, so no sequence is padded. Sequences of one length form step groups of equal tokens and cost.
Nothing is shuffled.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.llm.common import kept

#: Context sizes, the id that ends a document, tokens of a step group, and tokens packed together.
TIERS = (4096, 2048, 1024, 512)
END_ID = 2
STEP_TOKENS = 1 << 16
BLOCK_TOKENS = 1 << 21
#: Words whose ids a worker remembers, in each of two generations.
MEMORY_WORDS = 500_000
#: A mark alone at the end of a word.
MARK = re.compile(r"[,.](?<=[^\W_][,.])(?!\S)")
_ODD = tuple("\x1c\x1d\x1e\x1fİ")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a tokenizer that drops white space and never joins across it: words are encoded once and
    remembered. Texts where white space may be read in another way are encoded whole."""

    def __init__(self, path: str, memory_words: int = MEMORY_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.most = Tokenizer.from_file(path), {}, memory_words
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters, encoded many at a time and told apart by the pieces that end a word."""
        lines = [words[i : i + 64] for i in range(0, len(words), 64)]
        out: list[bytes] = []
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts)] if len(cuts) == len(line) else self._encode(line)
        return out

    def _learn(self, words: set[str]) -> None:
        """Words of the older generation move to the newer one; the others are encoded."""
        if len(self.memo) > self.most:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        memo.update((w, old[w]) for w in words if w in old)
        words = {w for w in words if w not in memo}
        letters = [w for w in words if w.isalpha()]
        memo.update(zip(letters, self._encode_letters(letters)))
        rest = [w for w in words if w not in memo]
        memo.update(zip(rest, self._encode(rest)))

    def __call__(self, text: str) -> np.ndarray:
        try:
            # Letters of one byte are lower-cased one by one here as in the tokenizer.
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "replace").decode("utf-8")
        if "<|" in text or any(c in text for c in _ODD):
            return np.frombuffer(self._encode([text])[0], self.kind)
        # A letter or digit and the mark after it are never one piece.
        words = MARK.sub(r" \g<0>", text).split()
        try:
            memo = self.memo
            found = b"".join(map(memo.__getitem__, words))
        except KeyError:
            self._learn({w for w in words if w not in memo})
            memo = self.memo
            if not all(w in memo for w in words):  # a new generation has begun
                self._learn({w for w in words if w not in memo})
            found = b"".join([memo[w] for w in words])
        return np.frombuffer(found, self.kind)


def powers(n: int) -> list[int]:
    """Powers of two that sum to n, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length). A sequence is as long as a tier or, at the end, a power of two.

    Whole windows of the longest tier are cut off; each remainder is routed to the smallest tier that holds it. Tiers
    are packed from the longest: a tier's largest piece opens a window, and its gap takes the largest piece that fits,
    from the tier itself and then from shorter ones; where none fits, the shortest piece there is is cut.
    """
    top, sequences = tiers[0], []
    pools: dict[int, list] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        whole = n - n % top
        sequences += [[(doc, at, top)] for at in range(0, whole, top)]
        if n > whole:
            pools[min(t for t in tiers if t >= n - whole)].append((n - whole, doc, whole))
    for pool in pools.values():
        pool.sort()
    for tier in tiers:
        while pools[tier]:
            n, doc, at = pools[tier].pop()
            window, gap = [(doc, at, n)], tier - n
            while gap and (found := _filler(pools, tiers, gap)):
                pool, k = found
                n, doc, at = pool.pop(k)
                window.append((doc, at, min(n, gap)))
                if n > gap:
                    insort(pools[min(t for t in tiers if t >= n - gap)], (n - gap, doc, at + gap))
                gap -= min(n, gap)
            sequences += [window] if not gap else _in_powers(window, tier - gap)
    return sequences


def _filler(pools: dict[int, list], tiers: tuple[int, ...], gap: int):
    """(pool, place) of the piece that a gap takes: the largest that fits, else the shortest; None if there is none."""
    for tier in tiers:
        if pools[tier] and pools[tier][0][0] <= gap:
            return pools[tier], bisect_right(pools[tier], gap, key=lambda piece: piece[0]) - 1
    return next(((pools[t], 0) for t in reversed(tiers) if pools[t]), None)


def _in_powers(window: list, size: int) -> list:
    """A window's pieces cut into sequences at powers of two."""
    parts, out, current = powers(size), [], []
    room = parts.pop(0)
    for doc, at, n in window:
        while n:
            take = min(n, room)
            current.append((doc, at, take))
            at, n, room = at + take, n - take, room - take
            if not room:
                out.append(current)
                room, current = parts.pop(0) if parts else 0, []
    return out


def step_groups(sequences: list) -> list[int]:
    """A group of each sequence, from 0. Sequences of one length are dealt to the fewest groups of at most STEP_TOKENS
    tokens, each of as many sequences as the others, or one less; the costliest (by the squares of their pieces, which
    attention pays) go first, forth and back, so that groups cost alike."""
    by_length: dict[int, list] = {}
    for k, pieces in enumerate(sequences):
        by_length.setdefault(sum(n for _, _, n in pieces), []).append((-sum(n * n for _, _, n in pieces), k))
    out, base = [0] * len(sequences), 0
    for length, rows in sorted(by_length.items(), reverse=True):
        groups = -(-len(rows) // max(1, STEP_TOKENS // length))
        for place, (_, k) in enumerate(sorted(rows)):
            turn, at = divmod(place, groups)
            out[k] = base + (groups - 1 - at if turn % 2 else at)
        base += groups
    return out


def _pack(path: str, end_id: int, tiers: tuple[int, ...], memory_words: int):
    def rows(block: list, sequence: int, base: int):
        out, sequences = [], pack_block([len(ids) for _, ids in block], tiers)
        steps = step_groups(sequences)
        for pieces, step in zip(sequences, steps):
            window, offset, step = sum(n for _, _, n in pieces), 0, base + step
            for doc, at, n in pieces:
                doc_id, ids = block[doc]
                out.append((doc_id, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), len(ids), sequence, offset, window, step))
                offset += n
            sequence += 1
        frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame, sequence, base + max(steps, default=-1) + 1

    def run(batches):
        encode, base = kept("packing", f"{path} {memory_words}", lambda: WordEncoder(path, memory_words)), TaskContext.get().partitionId() << 33
        sequence, step, block, tokens = base, base, [], 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(encode(text or ""), np.array([end_id], encode.kind))
                block.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    frame, sequence, step = rows(block, sequence, step)
                    yield frame
                    block, tokens = [], 0
        if block:
            yield rows(block, sequence, step)[0]

    return run


def pack(df: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", memory_words: int = MEMORY_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_id.

    `tokenizer` is a file at the same path on all machines; its default is word_bpe_49k.json. A worker remembers
    the ids of up to twice `memory_words` words. Null and empty
    texts are the end id alone. Repeated rows and null ids are packed as rows of their own. Lone surrogates
    read as '?'. An empty table gives no rows. Every id lies in one piece, sequences have no padding, and only
    id and text are read. Sequence and step ids are unique, and depend on how the input is split into tasks.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_id long"
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInPandas(_pack(tokenizer or default_tokenizer(), end_id, tuple(sorted(tiers, reverse=True)), memory_words), schema)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every text packed by the default tokenizer: see pack()."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
