"""Connected components over edges and over shared keys."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many edges (2 MB) one task joins them; beyond, all tasks do, with the same result.
ALONE = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master (tests) gets one of its own where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, ascending, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[one], root[two]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(root[root], root):
            root = root[root]


def _joined_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        nodes, roots = roots_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the edges (a, b).

    Large-star and small-star steps alternate until the edges are stars around the roots; each is a partial minimum per node
    and a join, so no node's neighbours are collected. The number of rounds grows with the logarithm of the nodes.
    """
    at = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if dict(at.dtypes)["a"] == "bigint" and at.count() <= ALONE:
        return at.coalesce(1).mapInArrow(_joined_alone, "node bigint, root bigint")
    while not _stars(at):
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour to the least one; rows then point from a larger node (a) to a smaller (b)
        down = checkpointed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lower = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(lower, "a").where("b <> m").select(F.col("m").alias("a"), "b")
        at = checkpointed(linked.unionByName(lower.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
    return at.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(at.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every b has one a and no a is a b: then each a is the root of its component."""
    children = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    parents = edges.select(F.col("a").alias("p")).distinct()
    most, chained = children.join(parents, F.col("b") == F.col("p"), "left").agg(F.max("n"), F.count("p")).first()
    return (most or 1) == 1 and not chained


def components_by_keys(items: DataFrame, item: str, keys: list[str]) -> DataFrame:
    """item and root of items (integers) that share any non-blank key; items without a shared key are their own root.

    Each key value links its items to the smallest of them, one edge per item and key.
    """
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys)))
    held = items.select(F.col(item).alias("b"), named.alias("key")).where("trim(key.v) <> ''")
    least = held.groupBy("key").agg(F.min("b").alias("a"))
    roots = connected(held.join(least, "key").select("a", "b"))
    return items.select(item).distinct().join(roots, F.col(item) == F.col("node"), "left").select(item, F.coalesce("root", item).alias("root"))


def components_by_pairs(held: DataFrame, item: str, key: str) -> DataFrame:
    """item and root over all rows (item, key); an item may hold any number of keys. Null and blank keys link nothing."""
    rows = held.select(F.col(item).alias("b"), F.col(key).alias("key"))
    named = rows.where("trim(key) <> ''")
    roots = connected(named.join(named.groupBy("key").agg(F.min("b").alias("a")), "key").select("a", "b"))
    return rows.select(F.col("b").alias(item)).distinct().join(roots, F.col(item) == F.col("node"), "left").select(item, F.coalesce("root", item).alias("root"))
