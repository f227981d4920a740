"""Sharding by bytes: contiguous shards cut at equal steps of a global prefix sum.

Rows are reduced to an id, a size and a checksum, sorted into ranges, and summed inside each range. The totals
of the ranges, a row each, give every range the bytes before it, so each row has its place in the whole order
without one task that sees all rows. A row goes to the shard in which its middle byte falls: cuts lie at the row
ends that are nearest to equal targets, and no shard differs from its target by more than its two end rows.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from albumen.llm.common import materialise, release

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def row_size(text: Column) -> Column:
    """UTF-8 bytes and ROW_BYTES; a null text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _keys(id_col: str, text_col: str) -> list[Column]:
    """What orders rows: rows that are equal in all three are the same to every shard."""
    text = F.col(text_col).cast("string")
    return [F.col(id_col).cast("long").alias("doc_id"), row_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32")]


def assign(df: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are in the order of id (nulls first), size and checksum; shards are contiguous in it and slots count from 0
    in each. Copies are rows of their own: shards do not keep equal texts together, and rows of one id, or of no id,
    are cut like any others. A null text counts as empty, a shard can be empty where a row is longer than its target,
    and an empty table gives no rows. Only id and text are read, once. law is 'bytes' and grown_shard null, as shards
    change with any row. Twice the bytes of all rows times n_shards must fit a long (at 40 shards 10^17 bytes).
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    narrow = materialise(df.select(*_keys(id_col, text_col)), "sizes")
    # The number of a row parts rows that are alike in all else, so that any number of them fill more than one range.
    ranged = narrow.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("row")).drop("row")
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    release(narrow)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    ranges = W.orderBy("part")  # a row a range
    earlier, every = ranges.rowsBetween(W.unboundedPreceding, -1), ranges.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = totals.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "n")), F.sum("bytes").over(every).alias("total"))
    within = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranged.select("*", F.sum("size").over(within).alias("bytes"), F.row_number().over(within).alias("n")).join(F.broadcast(starts), "part")
    twice_middle = 2 * (F.col("bytes_before") + F.col("bytes")) - F.col("size")
    shard = F.expr("div(twice_middle * %d, 2 * total)" % n_shards).cast("int")
    placed = placed.withColumn("twice_middle", twice_middle).select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("n_before") + F.col("n") - 1).alias("place"))
    placed = materialise(placed, "placed")
    release(ranged)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # a row a shard
    slot = (F.col("place") - F.col("first")).alias("slot")
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", file_rows: int = 100_000) -> None:
    """Writes the rows of df, all columns, as Parquet to folders shard=0, 1, ... of path.

    The first key of each shard, a row a shard, comes to the driver; every row then finds its shard by itself, and
    rows move once, to files of about file_rows rows that are in order inside and among each other. Rows that repeat
    one another (same id and text) share the shard of the first of them. Columns of df must not be named shard or
    start with __shard. An empty table writes no folder.
    """
    names = ["__shard_id", "__shard_size", "__shard_crc"]
    placed = assign(df, n_shards, id_col, text_col)
    key = F.struct("doc_id", "size", "text_crc32")
    starts = [r.first for r in placed.groupBy("shard").agg(F.min_by(key, "slot").alias("first"), F.count("*").alias("n")).orderBy("shard").collect()]
    counts = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    own = [c.alias(n) for c, n in zip(_keys(id_col, text_col), names)]
    shards = sorted(counts)
    least = F.lit(-(1 << 63)).cast("long")
    # Null ids come first: they rank below every id.
    mine = F.struct(F.col(names[0]).isNotNull(), F.coalesce(names[0], least), names[1], names[2])
    shard = F.lit(shards[0] if shards else 0)
    for number, start in list(zip(shards, starts))[1:]:
        bound = F.struct(F.lit(start.doc_id is not None), F.lit(start.doc_id).cast("long") if start.doc_id is not None else least, F.lit(start.size).cast("long"), F.lit(start.text_crc32).cast("long"))
        shard = F.when(mine >= bound, F.lit(number)).otherwise(shard)
    rows = df.select("*", *own).withColumn("shard", shard)
    files = max(1, sum(-(-n // file_rows) for n in counts.values()))
    rows = rows.repartitionByRange(files, "shard", F.col(names[0]).asc_nulls_first(), names[1], names[2])
    rows.sortWithinPartitions("shard", F.col(names[0]).asc_nulls_first(), names[1], names[2]).drop(*names).write.partitionBy("shard").parquet(path)


SQL = """
WITH bytes AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, hex(encode(coalesce(text, ''))) AS digits FROM documents
), step AS (
  SELECT list(value ORDER BY i) AS value FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS value FROM range(256) t(i)
  )
), sized AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(size - 16), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c // 256, value[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM bytes, step
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sized
), sharded AS (
  SELECT *, ((2 * upto - size) * 40 // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM sharded
"""


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near equal bytes. Nulls, repeated rows, long texts and an empty table: as assign() says."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
