"""SentencePiece encoding by suffix-array matching, and decoding.

The words of a batch are laid end to end, and a suffix array orders all their places. Binary search finds
the range of places where each piece of the vocabulary occurs. The edges (place, length, piece) are sorted
by place, and relaxed within each word: of the edges that join two neighbouring symbols, the one of the
highest score, the leftmost of equals, is taken, until none is left. That is the order in which a
byte-pair vocabulary joins symbols. Words are encoded once and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.llm.common import kept

#: White space's stand-in in pieces.
SPACE = "▁"
#: Kinds of pieces in a model file: fixed values of its format.
NORMAL, BYTE = 1, 6
#: Characters indexed together, words a worker remembers in each of two generations, the length from which a
#: word is relaxed by a heap, and the characters of texts whose words are learned together.
BATCH_CHARS, MEMORY_WORDS, LONG_WORD, TEXT_CHARS = 400_000, 500_000, 64, 4_000_000
_NONE = np.int32(1 << 30)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields; the value is bytes, an int, or 4 or 8 raw bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    def __init__(self, path: str):
        pieces, normal = [], {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    x = dict(_fields(value))
                    pieces.append((x[1].decode("utf-8"), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
                elif number == 3:
                    normal = dict(_fields(value))
        if normal.get(1) != b"identity" or normal.get(4, 1) or not normal.get(3, 1):
            raise ValueError("only models that leave text as it is but for a space before it are read here")
        if any(SPACE in p.lstrip(SPACE) for p, _, kind in pieces if kind == NORMAL):
            raise ValueError("pieces that span words are not read here")
        self.kind = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        used = [i for i, (_, _, kind) in enumerate(pieces) if kind == NORMAL]
        used.sort(key=lambda i: (-pieces[i][1], i))
        #: Ids in the order of their scores; what is joined is known by its place here.
        self.by_rank = np.array(used)
        self.ranked = [pieces[i][0] for i in used]
        self.width = max(map(len, self.ranked))
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.spelled = [p.replace(SPACE, " ").encode() if kind == NORMAL else bytes([int(p[3:5], 16)]) if kind == BYTE else b"" for p, _, kind in pieces]
        sizes = np.array([len(p) for p in self.ranked])
        self.sizes = sizes
        self.letters = np.zeros((len(sizes), self.width), np.int32)
        for k, p in enumerate(self.ranked):
            self.letters[k, : len(p)] = [ord(c) + 1 for c in p]
        #: Letters that stand side by side in some piece; symbols are never joined across others.
        self.side_by_side = {p[i : i + 2] for p in self.ranked for i in range(len(p) - 1)}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def suffixes(self, line: np.ndarray) -> np.ndarray:
        """The places of `line` in the order of what follows them, as far as the longest piece reaches."""
        rank, reach = line.astype(np.int64), 1
        while reach < self.width:
            after = np.zeros_like(rank)
            after[:-reach] = rank[reach:]
            _, rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
            rank, reach = rank + 1, reach * 2
        return np.argsort(rank, kind="stable")

    def edges(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, rank of the piece) of all occurrences of pieces, sorted by place."""
        order = self.suffixes(line)
        padded = np.concatenate([line, np.zeros(self.width, line.dtype)])
        low, high = np.zeros(len(self.sizes), np.int64), np.full(len(self.sizes), len(order), np.int64)
        for k in range(self.width):
            live = np.flatnonzero((self.sizes > k) & (low < high))
            want, bounds = self.letters[live, k], []
            for side in (0, 1):  # first place not under, and first place over the letter
                a, b = low[live].copy(), high[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    less = padded[order[np.minimum(mid, len(order) - 1)] + k] < want + side
                    a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
                bounds.append(a)
            low[live], high[live] = bounds
        found = np.maximum(high - low, 0)
        at = order[np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())]
        rank = np.repeat(np.arange(len(found)), found)
        by_place = np.argsort(at, kind="stable")
        return at[by_place], rank[by_place]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that hold their space sign; the words are indexed together."""
        sizes = np.array([len(w) + 1 for w in words])
        # A letter is its code point and one; 0 ends a word.
        line = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        ends = np.cumsum(sizes) - 1
        line[ends] = 0
        at, rank = self.edges(line)
        table = np.full((len(line), self.width + 1), _NONE, np.int32)
        table[at, self.sizes[rank]] = rank
        long = sizes - 1 > LONG_WORD
        limit = np.repeat(ends, sizes)
        after = np.arange(1, len(line) + 1)
        self._relax(table, after, limit, np.repeat(~long, sizes) & (line > 0))
        for k in np.flatnonzero(long):
            self._relax_long(table, after, ends[k] - sizes[k] + 1, ends[k])
        # What is left: symbols that start at a place not jumped over.
        starts = np.zeros(len(line), bool)
        starts[self._symbols(after, ends - sizes + 1, ends)] = True
        starts &= line > 0
        places = np.flatnonzero(starts)
        length = after[places] - places
        got = table[places, np.minimum(length, self.width)]
        ids = np.where(got < _NONE, self.by_rank[np.minimum(got, len(self.by_rank) - 1)], -1)
        out = []
        word = np.searchsorted(ends, places)
        for k, part in enumerate(np.split(ids, np.searchsorted(word, np.arange(1, len(words))))):
            if (part < 0).any():
                part = self._with_bytes(part, places[np.searchsorted(word, k) :], line)
            out.append(part.astype(self.kind).tobytes())
        return out

    def _with_bytes(self, ids: np.ndarray, places: np.ndarray, line: np.ndarray) -> np.ndarray:
        out = []
        for i, p in zip(ids, places):
            out += [i] if i >= 0 else [self.bytes[b] for b in chr(line[p] - 1).encode("utf-8", "replace")]
        return np.array(out)

    def _symbols(self, after: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        live, out = starts[starts < ends], []
        stop = ends[starts < ends]
        while len(live):
            out.append(live)
            live = after[live]
            keep = live < stop
            live, stop = live[keep], stop[keep]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _relax(self, table: np.ndarray, after: np.ndarray, limit: np.ndarray, live: np.ndarray) -> None:
        """Join symbols in all words at once, one edge a word and round. after[i]: where i's symbol ends."""
        at = np.flatnonzero(live)
        while len(at):
            nxt = after[at]
            ok = nxt < limit[at]
            end = np.where(ok, after[np.minimum(nxt, len(after) - 1)], 0)
            size = end - at
            ok &= size <= self.width
            rank = np.where(ok, table[at, np.where(ok, size, 0)], _NONE).astype(np.int64)
            word = limit[at]
            cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat((rank << 32) | at, cuts)
            good = (best >> 32) < _NONE
            first = best[good] & 0xFFFFFFFF
            gone = after[first]
            after[first] = after[gone]
            # Words with nothing to join are done; a symbol that was joined to the one before it is gone.
            keep = np.repeat(good, np.diff(np.r_[cuts, len(at)]))
            keep[np.searchsorted(at, gone)] = False
            at = at[keep]

    def _relax_long(self, table: np.ndarray, after: np.ndarray, start: int, end: int) -> None:
        before = {i + 1: i for i in range(start, end)}
        alive, heap = set(range(start, end)), []

        def offer(i: int) -> None:
            j = int(after[i])
            if j < end and (e := int(after[j])) - i <= self.width and table[i, e - i] < _NONE:
                heapq.heappush(heap, (int(table[i, e - i]), i, e))

        for i in range(start, end):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            if i not in alive or (j := int(after[i])) >= end or int(after[j]) != e:
                continue
            alive.discard(j)
            after[i] = e
            before[e] = i
            offer(i)
            if i > start:
                offer(before[i])

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        words = units_of(text)
        try:
            found = b"".join(map(self.memo.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            found = b"".join(map(self.memo.__getitem__, words))
        return np.frombuffer(found, self.kind)

    def learn(self, words: set[str]) -> None:
        """Afterwards all these words are remembered: those of the older generation move to the newer one, and the
        others are indexed together."""
        if len(self.memo) > MEMORY_WORDS:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        memo.update((w, old[w]) for w in words if w not in memo and w in old)
        # A last letter that no piece has beside the one before it is encoded apart.
        parts = {w: (w[:-1], w[-1]) if len(w) > 1 and w[-2:] not in self.side_by_side else (w, "") for w in words if w not in memo}
        cores = {core for core, _ in parts.values() if core not in memo}
        known: dict[str, bytes] = {}
        batch, size = [], 0
        for w in cores:
            batch.append(w)
            size += len(w) + 2
            if size > BATCH_CHARS:
                known.update(zip(batch, self.encode_words([_spaced(x) for x in batch])))
                batch, size = [], 0
        # Single letters without a space before them are known by a leading zero.
        marks = [m for m in {m for _, m in parts.values() if m} if "\0" + m not in memo]
        encoded = self.encode_words([_spaced(x) for x in batch] + marks) if batch or marks else []
        known.update(zip(batch, encoded))
        memo.update(zip(("\0" + m for m in marks), encoded[len(batch) :]))
        memo.update(known)
        memo.update((w, (known[core] if core in known else memo[core]) + memo["\0" + mark]) for w, (core, mark) in parts.items() if mark)

    def decode(self, ids: np.ndarray) -> str:
        """Spelled pieces laid end to end, without the space before the text; bytes that are no UTF-8 read as U+FFFD."""
        spelled = self.spelled
        data = b"".join([spelled[i] for i in ids.tolist()])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def units_of(text: str) -> list[str]:
    """What is encoded by itself: words without the space sign before them, where the text has none and single
    spaces only; else runs of space signs with what follows."""
    if SPACE in text or "  " in text or text[0] == " " or "\0" in text:
        return _words(SPACE + text.replace(" ", SPACE))
    return text.split(" ")


def _spaced(word: str) -> str:
    return word if word[:1] == SPACE else SPACE + word


def _words(line: str) -> list[str]:
    """Runs of space signs, each with what follows up to the next one."""
    out, at = [], 0
    while at < len(line):
        start = at
        while at < len(line) and line[at] == SPACE:
            at += 1
        nxt = line.find(SPACE, at)
        at = len(line) if nxt < 0 else nxt
        out.append(line[start:at])
    return out


def vocabulary(path: str) -> Vocabulary:
    return kept("pieces", path, lambda: Vocabulary(path))


def _encode(path: str):
    def run(batches):
        v = vocabulary(path)
        for pdf in batches:
            texts = [(t or "").encode("utf-8", "replace").decode() for t in pdf["text"]]
            # New words of many texts are indexed together.
            sizes = np.cumsum([len(t) for t in texts])
            for rows in np.split(np.arange(len(texts)), np.searchsorted(sizes, np.arange(TEXT_CHARS, sizes[-1] if len(sizes) else 0, TEXT_CHARS))):
                if not len(rows):
                    continue
                some, words = [texts[k] for k in rows], set()
                for t in some:
                    if t:
                        words.update(units_of(t))
                v.learn(words)
                ids = [v.encode(t).astype(np.int32) for t in some]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[rows].astype("Int64").to_numpy(), "text": some, "ids": ids}).astype({"doc_id": "Int64"})

    return run


def encode(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ids (array of int) for each row of df. Null and empty texts have no ids; lone surrogates
    read as '?'. Null ids and repeated rows are kept, texts may be of any length, and an empty table gives no rows. Only id and text are read; nothing is shuffled. `model` is
    a file at the same path on all machines."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(_encode(model or default_model()), "doc_id long, text string, ids array<int>")


def decode(df: DataFrame, model: str | None = None, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the texts of its ids in column `name`; null ids give null."""
    path = model or default_model()

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        v = vocabulary(path)
        return ids.map(lambda x: v.decode(np.asarray(x)), na_action="ignore")

    return df.withColumn(name, run(F.col(ids_col)))


def _round_trip(path: str):
    def run(batches):
        v = vocabulary(path)
        for pdf in _encode(path)(batches):
            out = []
            for text, ids in zip(pdf["text"], pdf["ids"]):
                back = v.decode(ids)
                out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text))
            frame = pd.DataFrame(out, columns=["n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])
            frame.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield frame.astype({"doc_id": "Int64"})

    return run


def op2_piece_encoding(spark, sf_dir: str) -> DataFrame:
    """Per document: its number of ids, their CRC-32 (unsigned, as little-endian unsigned 32-bit numbers), the
    digest of what they decode to, and whether that is the text."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rows.mapInPandas(_round_trip(default_model()), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
