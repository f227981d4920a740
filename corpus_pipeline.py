"""A cleaning pipeline over documents: toxicity, exact dedup, near-dedup, PII, packing.

Every stage but the last returns the columns of documents (and any others that the table has). Rows with a
null text count as empty texts. Rows that repeat another one's id and text are one document: they are kept
or dropped together. Rows that share only an id (or have none) are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumen.llm import exact_dedup, near_copies, packing, pii, toxicity
from albumen.llm.common import materialise, release

#: Words that a worker remembers while packing: fewer than by default, as executors have run other stages before.
MEMORY_WORDS = 100_000
#: The names are chosen not to clash with columns of the table.
_SCORE, _TEXT, _ID, _DIGEST = "__albumen_score", "__albumen_text", "__albumen_id", "__albumen_digest"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold; no row moves between tasks."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    return toxicity.with_score(docs, model, name=_SCORE).where(F.col(_SCORE) < toxicity.THRESHOLD).drop(_SCORE)


def _without(docs: DataFrame, dropped: DataFrame, of_text: Column) -> DataFrame:
    """docs without the rows in `dropped`, a table of two columns: doc_id and a digest of the text, which is
    `of_text` in docs. Null ids match null; another text of the same id stays. A merge join at every size: what a
    large corpus drops is too much to broadcast."""
    dropped = dropped.toDF(_ID, _DIGEST).distinct()
    return docs.hint("merge").join(dropped, docs["doc_id"].eqNullSafe(dropped[_ID]) & (of_text == dropped[_DIGEST]), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    dropped = exact_dedup.exact_groups(docs).where("not kept").select("doc_id", "text_sha256")
    return _without(docs, dropped, F.sha2(F.coalesce(docs["text"], F.lit("")), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8), the one with the smallest id. Texts without
    words count as copies of each other: one of them stays."""
    return _without(docs, near_copies.copies(docs), F.md5(F.coalesce(docs["text"], F.lit(""))))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their personal data masked, and n_chars of the masked text."""
    out = pii.with_masked(docs, name=_TEXT).withColumn("text", F.col(_TEXT)).drop(_TEXT)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence."""
    return packing.pack(docs, memory_words=MEMORY_WORDS)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]

#: Compression lengths, covering codes and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's result is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
