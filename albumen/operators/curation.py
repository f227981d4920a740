"""Tag records: union of sources, scores, and the choice of what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from albumen import vocabulary as V
from albumen.functions import text
from albumen.operators.once import computed_once


def union_sources(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(key, pos, label, source) from array columns; columns maps a source to its column, in the order of ranks."""
    parts = []
    for n, (source, column) in enumerate(columns.items()):
        rows = df.select(key, F.posexplode(column).alias("i", "label"))
        parts.append(rows.select(key, (F.lit(n * 1_000_000) + F.col("i")).alias("pos"), "label", F.lit(source).alias("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_model_scores(records: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """confidence from the first score of each label; null where there is none. scores: key, pos, label, score."""
    first = scores.groupBy(key, F.lower(F.trim("label")).alias("low")).agg(F.min_by("score", "pos").alias("confidence"))
    rows = records.withColumn("low", F.lower(F.trim("label")))
    return rows.join(first, [key, "low"], "left").drop("low")


def scored(records: DataFrame) -> DataFrame:
    """tag, confidence, bucket, role, low_value and importance of records with label, source and confidence."""
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("ai_tag"))
    rows = records.withColumn("source", source).withColumn("tag", F.trim(F.left(text.normalize_token(F.coalesce("label", F.lit(""))), F.lit(V.TAG_LENGTH))))
    rows = computed_once(rows).where("tag <> ''")
    rows = rows.withColumn("confidence", text.coerce_confidence(F.col("confidence").cast("string"), F.col("source")))
    rows = rows.withColumn("bucket", text.tag_bucket(F.col("tag"), F.col("source"))).withColumn("low_value", F.col("tag").isin(*V.GENERIC))
    rows = rows.withColumn("role", F.when(F.col("bucket").isin(*V.SUBJECT_BUCKETS), "subject").otherwise("background"))
    return rows.withColumn("importance", text.tag_importance(F.col("confidence"), F.col("bucket"), F.col("source"), F.col("tag")))


def is_weak() -> Column:
    protected = F.col("source").isin("user", "stored")
    return ~protected & ((F.col("confidence") < V.MIN_CONFIDENCE) | (F.col("low_value") & (F.col("confidence") < V.MIN_GENERIC)))


def curate(records: DataFrame, key: str, most: int = V.TAGS_KEPT, most_weak: int = V.WEAK_KEPT) -> DataFrame:
    """The chosen tags of each key: tag, kind (selected or weak), rank, bucket, confidence, importance.

    Of a tag's records the most important one counts, the first of equals. Selected tags rank by importance,
    weak ones that are not selected by confidence; then by name.
    """
    rows = scored(records).withColumn("weak", is_weak())
    best = W.partitionBy(key, "weak", "tag").orderBy(F.desc("importance"), "pos")
    rows = rows.withColumn("k", F.row_number().over(best)).where("k = 1")
    strong = rows.where("not weak").withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("importance"), "tag"))).where(F.col("rank") <= most)
    weak = rows.where("weak").join(strong.select(key, "tag"), [key, "tag"], "left_anti")
    weak = weak.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("confidence"), "tag"))).where(F.col("rank") <= most_weak)
    cols = [key, "tag", "rank", "bucket", "role", "confidence", "importance"]
    return strong.select(*cols, F.lit("selected").alias("kind")).unionByName(weak.select(*cols, F.lit("weak").alias("kind")))


def buckets(curated: DataFrame, key: str) -> DataFrame:
    """A map from bucket to the selected tags, best first."""
    lists = curated.where("kind = 'selected'").groupBy(key, "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    return lists.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "tags"))).alias("buckets"))
