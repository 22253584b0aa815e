"""Exact nearest vectors behind an index: files by org and nearest pivot, of which the triangle inequality leaves few to be read."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import materialize

#: Pivots come from so many vectors, those with the smallest hashes of their ids.
SAMPLE = 4096
#: Distances are doubles of floats: cells are left out only if they are this much too far.
SLACK = 1e-6
#: Vectors of a cell that meet queries in a group, about.
MEET = 50_000


def pivots_of(vectors: DataFrame, count: int, id_col: str, vector_col: str) -> np.ndarray:
    """count pivots, each the one of a bounded sample that is farthest from those before it."""
    rows = vectors.select(F.col(vector_col).alias("v"), F.xxhash64(id_col).alias("h")).orderBy("h").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.v for r in rows], np.float64)
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


@dataclass
class PivotIndex:
    """An index under a folder: vectors (org, cell, id, v, r: the distance to the cell's pivot) by org and cell; a row for each cell with its least and greatest r.

    Its size on the driver is that of pivots and cells: orgs times pivots.
    """

    spark: SparkSession
    path: str
    pivots: np.ndarray
    cells: pd.DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, path: str, count: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", org_col: str | None = None) -> PivotIndex:
        """vectors: id (long), vector and org; rows without a vector, or with one of another length than most, are left out. One pass assigns, one shuffle writes."""
        spark = vectors.sparkSession
        size = vectors.groupBy(F.size(vector_col).alias("size")).count().filter("size > 0").orderBy(F.desc("count"), "size").first()
        own = vectors.filter(F.size(vector_col) == (size.size if size else -1))
        pivots = pivots_of(own, count, id_col, vector_col)
        org = F.col(org_col) if org_col else F.lit("-")
        d = own.select(org.cast("string").alias("org"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                far = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)
                cell = far.argmin(axis=1)
                yield b.assign(cell=cell, r=far[np.arange(len(x)), cell])

        placed = d.mapInPandas(assign, "org string, id long, v array<float>, cell int, r double")
        # sorted by distance, so that files and row groups are rings of their cell
        placed.hint("rebalance", F.col("org"), F.col("cell")).sortWithinPartitions("org", "cell", "r").write.partitionBy("org", "cell").parquet(f"{path}/vectors")
        stored = spark.read.schema("id long, v array<float>, r double, org string, cell int").parquet(f"{path}/vectors")
        stored.groupBy("org", "cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(json.dumps(pivots.tolist()),)], "pivots string").coalesce(1).write.parquet(f"{path}/pivots")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PivotIndex:
        pivots = json.loads(spark.read.parquet(f"{path}/pivots").first().pivots)
        return cls(spark, path, np.array(pivots, np.float64) if pivots else np.zeros((0, 0)), spark.read.parquet(f"{path}/cells").toPandas())

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<float>, r double, org string, cell int").parquet(f"{self.path}/vectors")

    def _plan(self, query: np.ndarray, k: int, org: str) -> tuple[pd.DataFrame, np.ndarray]:
        """An org's cells with the least distance that any of their vectors can have (near), by it; and the query's distances to the pivots."""
        far = np.linalg.norm(self.pivots - query, axis=1) if len(self.pivots) else np.zeros(0)
        c = self.cells[self.cells["org"] == org].copy()
        q = far[c["cell"].to_numpy(dtype=int)] if len(c) else np.zeros(0)
        c["near"], c["most"] = np.maximum(np.maximum(q - c["high"], c["low"] - q), 0), q + c["high"]
        return c.sort_values(["near", "cell"]), far

    def reach(self, query: list[float], k: int, org: str = "-") -> float:
        """No vector beyond this distance can be among the k nearest: so many lie in cells that are wholly within it."""
        c, _ = self._plan(np.asarray(query, np.float64), k, org)
        c = c.sort_values("most")
        within = c[c["n"].cumsum() >= k]
        return float(within["most"].iloc[0]) if len(within) else math.inf

    def search(self, query: list[float], k: int, org: str = "-") -> DataFrame:
        """id and distance of the k nearest vectors of an org, nearest first, ties by id; the same as by looking at all.

        First the nearest cells that hold k are read; the k-th distance there bounds the rest: of the cells that can come as near, the ring between that
        distance less and more than the query's own from the pivot.
        """
        q = np.asarray(query, np.float64)
        c, far = self._plan(q, k, org)
        if k <= 0 or not len(c):
            return self.vectors().limit(0).select("id", F.lit(0.0).alias("distance"))
        held = c["n"].cumsum().to_numpy()
        first = c["cell"].iloc[: int(np.searchsorted(held, k)) + 1].tolist()
        top = materialize(self._nearest(q, k, org, {x: (0.0, math.inf) for x in first}))
        kth = top.agg(F.max("distance"), F.count("*")).first()
        bound = kth[0] * (1 + SLACK) + SLACK if kth[1] >= k else math.inf
        rest = {int(x): (float(far[x] - bound), float(far[x] + bound)) for x, near in zip(c["cell"], c["near"]) if near <= bound and x not in first}
        if not rest:
            return top.orderBy("distance", "id")
        return top.union(self._nearest(q, k, org, rest)).orderBy("distance", "id").limit(k)

    def _nearest(self, q: np.ndarray, k: int, org: str, rings: dict[int, tuple[float, float]]) -> DataFrame:
        inside = F.lit(False)
        for cell, (low, high) in rings.items():
            ring = (F.col("cell") == cell) & (F.col("r") >= low)
            inside = inside | (ring & (F.col("r") <= high) if high < math.inf else ring)
        d = self.vectors().filter((F.col("org") == org) & F.col("cell").isin(list(rings)) & inside)
        point = F.array(*[F.lit(float(x)) for x in q])
        far = F.sqrt(F.aggregate(F.zip_with("v", point, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
        return d.select("id", far.alias("distance")).orderBy("distance", "id").limit(k)

    def search_many(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", org: str = "-") -> DataFrame:
        """query, id, distance and rank (from 1) of the k nearest of each query, without itself: exact. queries: id and vector.

        A query goes to the cells that its reach() can't rule out. What meets in a group is at most about MEET vectors of a cell and MEET // 10 queries: larger cells, and
        those with many queries, are cut by hash into so many parts, each two of which meet. Each group keeps k for a query.
        """
        pivots, cells = self.pivots, self.cells[self.cells["org"] == org]

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = PivotIndex(None, "", pivots, cells)
            for b in batches:
                out = []
                for i, v in zip(b["query"], b["q"]):
                    bound = own.reach(v, k + 1, org) * (1 + SLACK) + SLACK
                    c, _ = own._plan(np.asarray(v, np.float64), k, org)
                    out += [(i, v, int(x)) for x in c.loc[c["near"] <= bound, "cell"]]
                yield pd.DataFrame(out, columns=["query", "q", "cell"])

        asked = queries.filter(F.size(vector_col) == (pivots.shape[1] if pivots.size else -1)).select(F.col(id_col).cast("long").alias("query"), F.col(vector_col).cast("array<float>").alias("q"))
        routed = materialize(asked.mapInPandas(route, "query long, q array<float>, cell int"))
        size = {r.cell: r["count"] for r in routed.groupBy("cell").count().collect()}  # a row for each cell
        cut = [(int(c), max(1, -(-int(n) // MEET)), max(1, -(-size.get(int(c), 0) // (MEET // 10)))) for c, n in zip(cells["cell"], cells["n"])]
        parts = F.broadcast(self.spark.createDataFrame(cut, "cell int, x int, y int"))
        piece = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.vectors().filter(F.col("org") == org).join(parts, "cell").withColumns({"a": piece("id", "x"), "b": every("y")}).select("cell", "a", "b", "id", "v")
        right = routed.join(parts, "cell").withColumns({"a": every("x"), "b": piece("query", "y")}).select("cell", "a", "b", "query", "q")
        met = left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b"))

        def meet(vectors: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(vectors) and len(some):
                x, ids = np.stack(vectors["v"].to_numpy()).astype(np.float64), vectors["id"].to_numpy()
                for i, v in zip(some["query"], some["q"]):
                    far = np.sqrt(np.square(x - np.asarray(v, np.float64)).sum(axis=1))
                    at = np.lexsort((ids, far))
                    at = at[ids[at] != i][:k]
                    out += [(i, int(ids[a]), float(far[a])) for a in at]
            return pd.DataFrame(out, columns=["query", "id", "distance"])

        each = met.applyInPandas(meet, "query long, id long, distance double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
        return each.withColumn("rank", rank).filter(F.col("rank") <= k)
