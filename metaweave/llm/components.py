"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


class Forest:
    """Union-find over numbers 0..n-1; the smallest is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def labels(self) -> np.ndarray:
        """The root of each number."""
        up = np.array(self.up)
        while True:
            two = up[up]
            if (two == up).all():
                return up
            up = two

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one batch as stars of their components: fewer, and the same components."""
    for b in batches:
        u, v = b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)
        if not len(u):
            continue
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = Forest(len(ids))
        for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
            forest.join(x, y)
        root = np.array([forest.find(x) for x in range(len(ids))], np.int64)
        own = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pa.array(ids[root[own]], pa.int64())], ["u", "v"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked with the smallest one it knows: the larger neighbours (large), or the smaller ones and itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: u and v (long, not null, in any order, repeats allowed). A row u, v for each node but the smallest of its component, which is v.

    Each round is written to the shared folder; the last is one that changes nothing. Hubs are counted by partial
    aggregation and joined back, so no task holds all neighbours of a node.
    """
    d = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    table = Table(d.mapInArrow(_thinned, "u long, v long").distinct())
    state = None
    while True:
        now = tuple(table.read().agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1_000_003).cast("long"))).first())
        if now == state or not now[0]:
            return table.read()
        state = now
        half = Table(_star(table.read(), True))
        table.drop()
        table = Table(_star(half.read(), False))
        half.drop()
