"""Connected components of an undirected graph, as rounds of joins.

Each task first reduces its edges to a spanning forest of stars.  Then two steps alternate:
every node sends its larger neighbours to the smallest node it knows (large star), and its
smaller neighbours likewise (small star), until nothing changes; that takes about log(n)
rounds.  Each step's edges are staged, which cuts the lineage.  A node with a third of all
edges is summed on the map side, and its join is one that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.session import stage


#: Forest edges (16 bytes each) that one task finishes alone; more take rounds of joins.
ONE_TASK = 500_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the given edges do."""
    if not len(a):
        return a, b
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(nodes), where[: len(a)], where[len(a) :])
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and 128 bits of them, as sums that cannot overflow."""
    hashes = F.xxhash64("a", "b"), F.xxhash64(F.lit(1), "a", "b")
    halves = [half for h in hashes for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return tuple(edges.agg(F.count(F.lit(1)), *[F.sum(half) for half in halves]).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it can reach, of every node that has an edge in ``a``, ``b``."""
    held = stage(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_local, "a long, b long"), "edges"
    )
    before = _mark(held)
    if before[0] <= ONE_TASK:
        # few enough for one task of bounded size, whatever the graph came from
        held = stage(held.coalesce(1).mapInArrow(_local, "a long, b long"), "edges")
        before = (0, None)
    while before[0]:
        # large star: a > b throughout
        ways = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            ways.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = stage(large, "edges")
        # small star
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        held = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _mark(held)
        if after == before:
            break
        before = after
    root = held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(root)
