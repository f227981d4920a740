"""Global ranks without a single task: sorted ranges, and the sizes of those before."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.operators.graph import materialise


def _number(batches):
    part, n = TaskContext.get().partitionId(), 0
    for pdf in batches:
        yield pdf.assign(part=part, row=range(n + 1, n + len(pdf) + 1))
        n += len(pdf)


def global_rank(df: DataFrame, key: str) -> DataFrame:
    """(key, rank): 1, 2, 3 ... by ascending key. The driver holds one number per range."""
    rows = df.select(key).repartitionByRange(F.col(key)).sortWithinPartitions(key)
    kind = df.schema[key].dataType.simpleString()
    rows = materialise(rows.mapInPandas(_number, f"{key} {kind}, part int, row long"), "ranks")
    before, total = [], 0
    for r in rows.groupBy("part").agg(F.max("row").alias("n")).orderBy("part").collect():
        before.append((r.part, total))
        total += r.n
    if not before:
        return rows.select(key, F.col("row").alias("rank"))
    starts = df.sparkSession.createDataFrame(before, "part int, before long")
    return rows.join(F.broadcast(starts), "part").select(key, (F.col("row") + F.col("before")).alias("rank"))


def like_next(df: DataFrame, key: str, digest: str, col: str, name: str) -> DataFrame:
    """df without `col` (vectors of one size, of length 1 or zeros), and with `name`: each row's cosine with the next
    row. Rows are dealt to ranges of `key` (nulls first), equal keys by the number `digest`; after the last comes the
    first, so a lone row is like itself. The driver holds two vectors per range. What costs much is best found after
    the rows are dealt, see `dealt`."""
    rest = [c for c in df.columns if c not in (col, digest)]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        part, held, first = TaskContext.get().partitionId(), None, True

        def rows(batch: pa.RecordBatch, near: np.ndarray, head: list, tail: list) -> pa.RecordBatch:
            more = [pa.array(near, pa.float64()), pa.array([part] * batch.num_rows, pa.int32()), *(pa.array(x, pa.list_(pa.float64())) for x in (head, tail))]
            return pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + more, [*rest, "near", "part", "head", "tail"])

        # A batch's last row waits for the next batch.
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(col).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            if held:
                yield rows(held[0], np.array([held[1] @ v[0]]), [held[1] if first else None], [None])
                first = False
            if n > 1:
                yield rows(batch.slice(0, n - 1), np.einsum("ij,ij->i", v[:-1], v[1:]), [v[0] if first else None, *[None] * (n - 2)], [None] * (n - 1))
                first = False
            held = batch.slice(n - 1), v[-1].copy()
        if held:
            yield rows(held[0], np.zeros(1), [held[1] if first else None], [held[1]])

    rows = df.mapInArrow(run, f"{kinds}, near double, part int, head array<double>, tail array<double>")
    rows = materialise(rows, "near_next")
    heads, tails = (rows.where(f"{end} is not null").select("part", end).orderBy("part").toPandas() for end in ("head", "tail"))
    over = [(int(p), float(np.dot(tail, heads["head"].iloc[(k + 1) % len(heads)]))) for k, (p, tail) in enumerate(zip(tails["part"], tails["tail"]))]
    over = df.sparkSession.createDataFrame(over, "part int, over double")
    rows = rows.join(F.broadcast(over), "part", "left")
    return rows.select(*rest, F.when(F.col("tail").isNull(), F.col("near")).otherwise(F.col("over")).alias(name))


def dealt(df: DataFrame, key: str, digest: str) -> DataFrame:
    """df in sorted ranges, as like_next reads it."""
    order = [F.asc_nulls_first(key), F.col(digest)]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def top_softmax(df: DataFrame, by: str, label: str, logit: str, k: int = 15) -> DataFrame:
    """The k likeliest labels of each row group by softmax over its logits."""
    from pyspark.sql import Window as W

    from albumen.functions.vectors import softmax

    p = softmax(F.col(logit), W.partitionBy(by))
    rows = df.withColumn("p", p).withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("p"), label)))
    return rows.where(F.col("rank") <= k)
