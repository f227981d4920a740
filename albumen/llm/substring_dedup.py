"""Substring dedup by hashing paragraphs.

Each text is cut into lines, and lines at sentence ends. From the start of every piece, the fewest pieces that hold
MIN_CHARS characters are a paragraph; a text that holds fewer is one. Paragraphs are normalised and digested, digests
are grouped over all documents, the occurrence of the smallest rank (document, place) stays, and all others are
removed. Offsets refer to the original text.

Paragraphs overlap, so a repeated passage is found wherever it begins and whatever stands around it, as far as its
whole sentences go. Every piece that is removed stays at some earlier place: it is removed as part of a paragraph with
an earlier occurrence, whose own piece either stays or is removed for a still earlier one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.llm.common import materialise, release

#: Normalised characters that a paragraph has at least. At 1, every line or sentence is one.
MIN_CHARS = 100
#: A piece ends after a line end, after white space that follows the end of a sentence, or after a full-width mark.
PIECE = re.compile(r"[^\n.!?。！？]*+(?:[.!?]++(?![ \t\n])[^\n.!?。！？]*+)*+(?:[.!?。！？]++[ \t]*+\n?|\n|$)")


def pieces(text: str, piece=PIECE) -> list[tuple[int, int]]:
    """(start, end) of the lines and sentences; they cover the text."""
    return [m.span() for m in piece.finditer(text) if m.end() > m.start()]


def normalised(piece: str) -> str:
    """Words in folded case, with single spaces."""
    return " ".join(piece.casefold().split())


def paragraphs(text: str, min_chars: int = MIN_CHARS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) from each piece that has words; pieces without words belong to the ones before them."""
    spans, lengths, digests = [], [], []
    for s, e in pieces(text):
        words = normalised(text[s:e])
        if words:
            spans.append((s, e)), lengths.append(len(words))
            digests.append(hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=16).digest())
    out, j, held = [], 0, 0
    for i in range(len(spans)):
        while j < len(spans) and held < min_chars:
            held += lengths[j]
            j += 1
        if held < min_chars and i:
            break  # what is left is the end of paragraphs before
        digest = digests[i] if j == i + 1 else hashlib.blake2b(b"".join(digests[i:j]), digest_size=16).digest()
        out.append((spans[i][0], spans[j - 1][1], digest))
        held -= lengths[i]
    return out


def _cut(min_chars: int):
    def run(batches):
        for pdf in batches:
            rows: list = []
            for doc_id, h, text in zip(pdf["doc_id"], pdf["h"], pdf["text"]):
                rows += [(doc_id, h, s, e, d) for s, e, d in paragraphs(text or "", min_chars)]
                if len(rows) > 200_000:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    return run


def _frame(rows: list) -> pd.DataFrame:
    ids, hashes, starts, ends, digests = zip(*rows)
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    numbers = {"h": np.array(hashes, np.int64), "start": np.array(starts, np.int64), "end": np.array(ends, np.int64)}
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), **numbers, "d1": both[:, 0], "d2": both[:, 1]})


def repeated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h, spans): for each document with paragraphs to remove, their (start, end). docs: doc_id, h, text."""
    cut = materialise(docs.mapInPandas(_cut(min_chars), "doc_id long, h long, start long, end long, d1 long, d2 long"), "paragraphs")
    # Ids come before null; documents of one id are told apart by the hash of their text.
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h", "start")
    first = cut.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialise(first, "first")
    again = cut.join(first, ["d1", "d2"]).where(rank != F.col("first"))
    found = materialise(again.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "repeats")
    release(cut)
    release(first)
    return found


def united(spans) -> list[tuple[int, int]]:
    """Sorted spans, those that meet or overlap as one."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _remove(batches):
    for pdf in batches:
        out = []
        for text, spans in zip(pdf["text"], pdf["spans"]):
            gone = united((x["start"], x["end"]) for x in spans) if spans is not None else []
            kept, at = [], 0
            for s, e in gone:
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            out.append((sum(e - s for s, e in gone), ",".join(f"{s}:{e}" for s, e in gone), "".join(kept)))
        frame = pd.DataFrame(out, columns=["removed_chars", "removed", "kept_text"])
        frame.insert(0, "n_removed", [len(united((x["start"], x["end"]) for x in s)) if s is not None else 0 for s in pdf["spans"]])
        frame.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
        yield frame.astype({"doc_id": "Int64"})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row of df: doc_id, n_removed (spans), removed_chars, removed (start:end spans, comma-joined), kept_text.

    Of equal paragraphs the first by doc_id, then by place, stays. Null text counts as empty: no paragraphs. Null ids
    rank last. Rows that repeat another one's id and text are the same document and get the same result. Very long
    texts are read piece by piece. An empty table gives no rows. Only id and text are read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    found = repeated(docs, min_chars).select(F.col("doc_id").alias("id2"), F.col("h").alias("h2"), "spans")
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["id2"]) & (docs["h"] == found["h2"]), "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(_remove, "doc_id long, n_removed long, removed_chars long, removed string, kept_text string")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's removed spans, and the digest and length of what is kept."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_removed", "removed_chars", "removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.length("kept_text").cast("long").alias("kept_chars"))
