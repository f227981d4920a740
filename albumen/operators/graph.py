"""Written tables that cut lineage, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine, if Spark runs
    in one process on it (tests); on a cluster that is an error, as executors would write to their own disks."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(sc, "_albumen_dir", None)
    if own is None:
        own = sc._albumen_dir = "file://" + tempfile.mkdtemp(prefix="albumen-")
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, fixes values that depend on the
    partitioning, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a materialised table that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of their component, for the edges a-b."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches):
    """Each batch of edges a-b becomes edges to the smallest node of its component in the batch."""
    for pdf in batches:
        if len(pdf):
            nodes, root = local_components(pdf["a"].to_numpy(), pdf["b"].to_numpy())
            far = nodes != root
            yield pd.DataFrame({"a": nodes[far], "b": root[far]})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long); root is the smallest node of its component.

    Alternates large-star and small-star steps on written edge tables. A hub's neighbours are reduced by
    partial aggregation and joined back as rows, never gathered, so a hub of any degree is no hot spot.
    Null ends and self-links are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = materialise(edges.mapInPandas(_contract, "a long, b long").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        # Large star: each node's larger neighbours move to its smallest neighbour (or itself).
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "low")
        large = materialise(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large"
        )
        # Small star: each node and its smaller neighbours move to the smallest of them.
        low2 = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low2, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = materialise(moved, "small")
        for old in (edges, low, large, low2):
            release(old)
        edges = small
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
