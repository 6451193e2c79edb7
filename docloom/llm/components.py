"""Connected components of a table of links, without bringing the links to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Up to so many links (16 bytes each) one task joins them; beyond that they are contracted in rounds.
ONE_TASK_LINKS = 1 << 20


class UnionFind:
    """Over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links beside the smallest node of its component (itself left out)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = UnionFind(len(names))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        sets.union(x, y)
    roots = np.array([sets.find(x) for x in range(len(names))], np.int64)
    moved = roots != np.arange(len(names))
    return names[moved], names[roots[moved]]


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        node, root = forest(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "component"])


def components(links: DataFrame, *, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """links: a, b (long) -> node, component: the smallest node that it reaches, for all nodes but those that are their own.

    Many links: alternating large-star and small-star rounds. In each, every node's neighbours are pointed at the
    smallest of them, by an aggregate and a join on the node (no list of neighbours is ever built, and a node with very
    many neighbours is a skewed join key that adaptive execution splits). Each round is written to the shared folder.
    """
    links = stored(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if links.count() <= one_task_links:
        return links.coalesce(1).mapInArrow(_join_all, "node bigint, component bigint")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        links = stored(small.filter("a != b").distinct(), "links")
        # Sums of hashes tell when a round has changed nothing.
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
