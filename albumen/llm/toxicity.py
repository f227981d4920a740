"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text. A text is cut into windows of one
word; a window's difference is how many bytes shorter it compresses with the toxic dictionary than with the
ordinary one. A logistic threshold over the largest differences, calibrated on labelled rows that the
dictionaries have not seen, gives the score.
"""

from __future__ import annotations

import math
import random
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.llm.common import forget, kept

#: Bounds of the labelled sample that the model is fitted on: rows of either class, and characters of a row.
TOXIC_ROWS, ORDINARY_ROWS, ROW_CHARS = 3000, 4000, 20_000
#: Bytes of the dictionaries, and ordinary words used to train one.
TOXIC_BYTES, ORDINARY_BYTES, ORDINARY_WORDS = 2048, 65_536, 400_000
#: Follows each window and ends both dictionaries: zstandard looks for no match in the last 8 bytes.
TAIL = b" that with from this und der des que les para"
GRAM, ROUNDS, HARD, TOP = 5, 2, 3, 8
#: Words whose difference a worker remembers.
MEMORY_WORDS = 300_000
THRESHOLD, LEAST_SPREAD = 0.7, 0.5


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _grams(word: str) -> set[str]:
    word = " " + word
    return {word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))}


class Distance:
    """Differences in compressed length of words under two dictionaries of raw content."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.sizes, self.memo = [self._compressor(d) for d in (toxic, ordinary)], {}

    @staticmethod
    def _compressor(content: bytes):
        data = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=13, chain_log=13, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        data.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress

    def __call__(self, words: list[str]) -> np.ndarray:
        memo, (toxic, ordinary) = self.memo, self.sizes
        if len(memo) > MEMORY_WORDS:
            memo.clear()
        for w in set(words):
            if w not in memo:
                x = b" " + w.encode("utf-8", "surrogatepass") + TAIL
                memo[w] = len(ordinary(x)) - len(toxic(x))
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def features(self, text: str | None) -> np.ndarray:
        words = _words(text)
        d = self(words)
        if len(d) > TOP:
            d = np.partition(d, len(d) - TOP)[-TOP:]
        top = np.zeros(TOP)
        top[: len(d)] = np.sort(d)[::-1]
        return np.array([top[0], top[1], top[2], top[:4].sum(), top.sum(), math.log1p(len(words))])


def _trained(samples: list[bytes], size: int, **how) -> bytes:
    """The content of a trained dictionary; what there is, where it is too little to train on."""
    grouped = [b"".join(samples[i : i + 8]) for i in range(0, len(samples), 8)]
    try:
        data = zstandard.train_dictionary(size, grouped, level=3, **how).as_bytes()
        # The header holds entropy tables; content comes after.
        return data[256:] if len(data) > 1024 else b"".join(samples)[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Train on windows of toxic text that hold letter sequences which ordinary text lacks, and on windows of
    ordinary text; then again with the ordinary windows that were taken for toxic."""
    counts = []
    for texts in (toxic, ordinary):
        count: Counter = Counter()
        for t in texts:
            count.update({g for w in set(_words(t)) for g in _grams(w)})
        counts.append(count)
    n1, n0 = len(toxic) + 1, len(ordinary) + 1
    marked = set()
    for g, a in counts[0].items():
        ratio = math.log((a + 0.5) / n1) - math.log((counts[1][g] + 0.5) / n0)
        if a >= 3 and ratio > 2 and a * ratio >= 9 + 3 * math.log(n1):
            marked.add(g)
    hot = [b" " + w.strip(".,;:!?").encode("utf-8", "surrogatepass") for t in toxic for w in _words(t) if not marked.isdisjoint(_grams(w))]
    plain = [b" " + w.encode("utf-8", "surrogatepass") for t in ordinary for w in _words(t)]
    random.Random(1).shuffle(plain)
    plain, hard = plain[:ORDINARY_WORDS], []
    first = _trained(hot, TOXIC_BYTES, k=40, d=6)
    for _ in range(ROUNDS):
        second = _trained(plain + hard * 3, ORDINARY_BYTES)
        distance, hard = Distance(first, second), []
        for t in ordinary:
            words = _words(t)
            hard += [b" " + words[i].encode("utf-8", "surrogatepass") for i in np.flatnonzero(distance(words) >= HARD)]
    return first, second


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple[str | None, int]]) -> dict:
    """A model from (text, label) rows. With fewer than 4 rows of a class, the score is a constant: the share
    of label 1 where both are there, else 0."""
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (1, 0))
    if min(len(toxic), len(ordinary)) < 4:
        return {"constant": len(toxic) / len(rows) if toxic and ordinary else 0.0}
    # Calibrate on halves that the dictionaries have not seen, then train them on all.
    x, y = [], []
    for k in (0, 1):
        distance = Distance(*_dictionaries(toxic[k::2], ordinary[k::2]))
        for texts, label in ((toxic[1 - k :: 2], 1.0), (ordinary[1 - k :: 2], 0.0)):
            x += [distance.features(t) for t in texts]
            y += [label] * len(texts)
    x, y = np.array(x), np.array(y)
    # A feature that hardly varies in the sample must not decide by itself.
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), LEAST_SPREAD)
    weights = _logistic(np.c_[(x - mean) / scale, np.ones(len(x))], y)
    return {"dictionaries": _dictionaries(toxic, ordinary), "mean": mean, "scale": scale, "weights": weights}


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(text, label) rows that may be learned from, at most TOXIC_ROWS and ORDINARY_ROWS of texts of up to
    ROW_CHARS characters: those of smallest hash. A document with both labels counts as toxic."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(~is_held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    size = F.length(F.col(text_col).cast("string"))
    short = docs.where(size <= ROW_CHARS).select(F.col(id_col).cast("long").alias("id"))
    ids = known.join(short.distinct(), "id", "left_semi")
    picked = [r.id for k, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)) for r in ids.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(n).collect()]
    if not picked:
        return []
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(i,) for i in picked], "id long").join(known, "id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(size <= ROW_CHARS).join(few, "id")
    # In the order of their hashes: what is fitted must not depend on which task ends first.
    rows = [(r.h, r.id, r.text, r.y) for r in texts.select(F.xxhash64("id").alias("h"), "id", "text", "y").toLocalIterator() if r.text is not None]
    return [(text, y) for _, _, text, y in sorted(rows)]


def with_score(df: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """df with each text's score, 0 to 1, in column `name`. Null counts as empty. Narrow: no shuffle."""
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            if "constant" in m:
                yield pd.Series(np.full(len(texts), m["constant"]))
                continue
            distance = kept("toxicity", key, lambda: Distance(*m["dictionaries"]))
            x = np.array([distance.features(t) for t in texts]).reshape(len(texts), len(m["mean"]))
            z = ((x - m["mean"]) / m["scale"]) @ m["weights"][:-1] + m["weights"][-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        forget()

    return df.withColumn(name, run(F.col(text_col).cast("string")))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null text counts as empty and gets the score of no words. Null ids are not held out. Repeated rows get
    equal scores. Labels that are null or not 0 or 1 are not used; ties of the sample's hash go by id. Texts of any
    length are scored word by word. An empty table gives no rows. Only doc_id and text are read.
    """
    model = fit(labelled_sample(docs, labels))
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every text scored by a model of the labelled rows that may be learned from: see toxic_scores()."""
    return toxic_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
