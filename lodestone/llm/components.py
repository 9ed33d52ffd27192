"""Connected components of an edge table by alternating large and small stars, each round written to the shared folder, until
the edges left are few enough for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spaces import delete, written

#: Edges that one task takes, in some 50 MB; more go through rounds of stars.
FEW = 1 << 20


class Forest:
    """Union-find over 0 .. n - 1; a root is its tree's smallest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.up[a], self.up[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.up[self.up], self.up):
                self.up = up


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node and its component, from all edges."""
    got = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    edges = np.concatenate(got) if got else np.zeros((0, 2), np.int64)
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    forest = Forest(len(nodes))
    forest.join(at[:, 0], at[:, 1])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest.up])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """edges: a long, b long. Returns node, component (its component's smallest node) for every node with an edge to
    another node. The table it returns is read from the shared folder.

    A star's centre may have any degree: centres only meet their neighbours in a grouped minimum, which is summed up
    before the shuffle, and in an equi-join, whose hot keys adaptive execution splits.
    """
    now, path = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state[0] <= FEW:
            return written(now.coalesce(1).mapInArrow(_joined, "node long, component long"))[0]
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Every node now points down only: its own neighbours are all smaller.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.withColumnRenamed("m", "b"))
        old = path
        now, path = written(small.distinct())
        delete(edges.sparkSession, old)
    roots = now.select(F.col("b").alias("a"), "b").distinct()
    return now.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
