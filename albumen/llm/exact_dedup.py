"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of characters. All distinct blocks are sorted and numbered, so
a block's integer name is free of collisions. Then adjacent names are paired, the distinct pairs are named
the same way, and so on until each text has one name. Two texts are equal exactly if they have the same
number of blocks and the same last name: no digest decides.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.llm.common import materialise, release

#: Characters in a block, and distinct blocks that a task remembers to avoid sending the same one again.
BLOCK_CHARS = 4096
MEMORY_BLOCKS = 8192


def _cut(block_chars: int, memory: int):
    """Rows of documents (kind 0) and of blocks (kind 1). A block already sent by this task is referred to,
    so that a block that many texts share is shuffled a few times a task, not once a text."""

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        rid, ref, seen = base, base, {}
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["id"], pdf["text"]):
                text = text or ""
                data = text.encode("utf-8", "surrogatepass")
                refs = []
                for at in range(0, max(1, len(text)), block_chars):
                    block = data if len(text) <= block_chars else text[at : at + block_chars].encode("utf-8", "surrogatepass")
                    known = seen.get(block)
                    if known is None:
                        if len(seen) >= memory:
                            seen.clear()
                        known = seen[block] = ref
                        ref += 1
                        out.append((1, known, None, None, None, None, block))
                    refs.append(known)
                out.append((0, rid, doc, hashlib.sha256(data).hexdigest(), len(refs), refs, None))
                rid += 1
            frame = pd.DataFrame(out, columns=["kind", "key", "id", "sha", "n", "refs", "block"])
            frame["id"] = frame["id"].astype("Int64")
            frame["n"] = frame["n"].astype("Int64")
            yield frame

    return run


def _number(columns: list[str], out: str):
    """Gives each distinct value of the columns, in a partition sorted by them, the next integer."""

    def run(batches):
        base, name, last = TaskContext.get().partitionId() << 33, -1, None
        for pdf in batches:
            names = []
            for value in zip(*(pdf[c] for c in columns)):
                if name < 0 or value != last:
                    name, last = name + 1, value
                names.append(base + name)
            yield pd.DataFrame({"key": pdf[out], "name": names}) if out else pd.DataFrame({c: pdf[c] for c in columns} | {"name": names})

    return run


def name_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, sha, n_blocks, name) for each row of df; (n_blocks, name) is equal exactly where the texts are.

    Null text counts as empty (one empty block); a null id stays null. Repeated rows give repeated rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = rows.mapInPandas(
        _cut(block_chars, MEMORY_BLOCKS), "kind int, key long, id long, sha string, n int, refs array<long>, block binary"
    )
    cut = materialise(cut, "cut")
    blocks = cut.where("kind = 1").select("key", "block")
    docs = cut.where("kind = 0").select(F.col("key").alias("rid"), "id", "sha", "n", "refs")
    named = blocks.repartition("block").sortWithinPartitions("block").mapInPandas(_number(["block"], "key"), "key long, name long")
    named = materialise(named, "names")
    one = docs.where("n = 1").select("id", "sha", "n", F.col("refs")[0].alias("key")).join(named, "key").select("id", "sha", "n", "name")
    many = docs.where("n > 1").select("rid", F.posexplode("refs").alias("pos", "key")).join(named, "key").select("rid", "pos", "name")
    many = materialise(many, "level")
    longest = docs.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        # (rid, pos, name) -> pairs of neighbours; the last of an odd number is paired with -1.
        slot = F.when(F.col("pos") % 2 == 0, F.col("name"))
        other = F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = many.groupBy("rid", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(slot).alias("a"), F.coalesce(F.max(other), F.lit(-1)).alias("b")
        )
        pairs = materialise(pairs, "pairs")
        distinct = pairs.select("a", "b").distinct().repartition("a", "b").sortWithinPartitions("a", "b")
        numbered = materialise(distinct.mapInPandas(_number(["a", "b"], ""), "a long, b long, name long"), "numbers")
        after = materialise(pairs.join(numbered, ["a", "b"]).select("rid", "pos", "name"), "level")
        for old in (many, pairs, numbered):
            release(old)
        many, longest = after, (longest + 1) // 2
    rest = docs.where("n > 1").select("rid", "id", "sha", "n").join(many.select("rid", "name"), "rid").select("id", "sha", "n", "name")
    found = materialise(one.unionByName(rest).withColumnRenamed("n", "n_blocks"), "identity")
    for old in (cut, named, many):
        release(old)
    return found


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; null text is the empty text. Null ids rank lowest: they
    stay only where no copy has an id, and keep_id is then null. Repeated rows (same id and text) are the
    same document: each is returned, counted in group_size, and kept or dropped together. An empty table
    gives no rows. Columns besides id and text are not read.
    """
    named = name_texts(df, id_col, text_col, block_chars)
    groups = named.groupBy("n_blocks", "name").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialise(groups, "groups")
    joined = named.join(groups, ["n_blocks", "name"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row with its group of equal texts. Null texts and ids, repeated rows and an empty table: as exact_groups() says."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
