"""Nearest neighbours by brute force in column expressions, and embedding of text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A search returns so many hits at most.
MAX_K = 50


def l2_distance(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    return F.lit(1.0) - dot / (own * F.lit(size))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2", where: Column | None = None, prefilter: bool = True) -> DataFrame:
    """id and distance of the k nearest. The condition holds before the k are taken, or (prefilter=False) after.

    Each task keeps its k best, and those meet in one: the plan's TakeOrderedAndProject.
    """
    if k <= 0:
        return vectors.select(id_col, F.lit(0.0).alias("distance")).limit(0)
    d = vectors.filter(where) if where is not None and prefilter else vectors
    distance = (l2_distance if metric == "l2" else cosine_distance)(F.col(vector_col), query)
    d = d.select(*[c for c in vectors.columns if c != vector_col], distance.alias("distance")).orderBy("distance", id_col).limit(min(k, MAX_K))
    if where is not None and not prefilter:
        d = d.filter(where)
    return d.select(id_col, "distance")


def similar(vectors: DataFrame, focal: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest to a row, which is left out, with similarity 1 - distance / 2."""
    row = vectors.filter(F.col(id_col) == focal).select(vector_col).first()
    if row is None:
        raise ValueError(f"no vector for {focal!r}")
    d = knn(vectors.filter(F.col(id_col) != focal), row[0], k, id_col, vector_col)
    return d.withColumn("similarity", F.lit(1.0) - F.col("distance") / 2)


def search_bundles(vectors: DataFrame, query: list[float], k: int, bundle_col: str = "bundle", vector_col: str = "embedding", org: str | None = None) -> DataFrame:
    """bundle and distance (L2) of the k nearest bundles, nearest first, ties by name. A bundle has several vectors, and is as near as the nearest of them.

    A bundle's vectors may lie in many tasks. Each task keeps the k nearest bundles of those it has seen: one that is among the k nearest of all is so in the task with its
    nearest vector. Those meet by bundle. Null vectors and those of another length are left out.
    """
    k = max(0, min(k, MAX_K))
    d = vectors.filter(F.col("org_id") == org) if org is not None else vectors
    d = d.filter(F.size(vector_col) == len(query)).select(F.col(bundle_col).cast("string").alias("bundle"), F.col(vector_col).alias("v"))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = np.asarray(query, np.float64)
        kept = pd.Series(dtype=float)
        for b in batches:
            if len(b):
                far = np.sqrt(np.square(np.stack(b["v"].to_numpy()).astype(np.float64) - q).sum(axis=1))
                both = pd.concat([kept, pd.Series(far, index=b["bundle"].to_numpy())]) if len(kept) else pd.Series(far, index=b["bundle"].to_numpy())
                both = both.groupby(level=0).min()
                kept = both.sort_index().sort_values(kind="stable").head(k)
        yield pd.DataFrame({"bundle": kept.index.to_numpy(dtype=object), "distance": kept.to_numpy(dtype=float)})

    return d.mapInPandas(nearest, "bundle string, distance double").groupBy("bundle").agg(F.min("distance").alias("distance")).orderBy("distance", "bundle").limit(k)


def vector_counts(vectors: DataFrame) -> DataFrame:
    """How many vectors each org has, and of how many different contents."""
    return vectors.groupBy("org_id").agg(F.count("*").alias("vectors"), F.count_distinct("content_hash").alias("contents"))


#: Words whose signs are summed at once.
EMBED_WORDS = 5_000


def hashing_embedder(dim: int = 384) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in that needs no model: each word is a vector of dim signs, which its hashes give, and a text is the sum of its words' vectors, with length 1
    (zeros for no words). Two words share all signs in one of 2 ** dim cases, so other words make another vector. It is not a language model.

    Texts are taken in blocks of EMBED_WORDS words (a text at least), whose signs are summed together; a sum of whole numbers doesn't depend on that.
    """
    import re
    from functools import lru_cache

    import xxhash

    @lru_cache(maxsize=20_000)
    def digest(word: str) -> bytes:
        return b"".join(xxhash.xxh64_digest(word, seed) for seed in range(-(-dim // 64)))

    def sums(block: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(block), dim))
        at = {w: k for k, w in enumerate(dict.fromkeys(w for words in block for w in words))}
        if at:
            bits = np.frombuffer(b"".join(map(digest, at)), np.uint8).reshape(len(at), -1)
            signs = 1 - 2 * np.unpackbits(bits, axis=1, count=dim).astype(np.int8)
            some = [k for k, words in enumerate(block) if words]
            starts = np.cumsum([0, *(len(block[k]) for k in some[:-1])])
            out[some] = np.add.reduceat(signs[[at[w] for words in block for w in words]], starts, axis=0, dtype=np.int32)
        return out

    def unit(v: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    def embed(texts: list[str]) -> list[list[float]]:
        out, block, held = [], [], 0
        for t in texts:
            words = re.findall(r"\w+", (t or "").lower())
            if block and held + len(words) > EMBED_WORDS:
                out += list(unit(sums(block)))
                block, held = [], 0
            block.append(words)
            held += len(words)
        return out + (list(unit(sums(block))) if block else [])

    return embed


def embed(rows: DataFrame, text: Column, make: Callable[[], Callable[[list[str]], list[list[float]]]], id_col: str = "qname") -> DataFrame:
    """id, content_hash (of the embedded text) and embedding. The embedder is made once in each task; batches are Arrow's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "content_hash": b["content_hash"], "embedding": [np.asarray(v, np.float32) for v in f(b["t"].tolist())]})

    d = rows.select(id_col, text.alias("t"), F.sha2(text, 256).alias("content_hash"))
    return d.mapInPandas(run, f"{id_col} string, content_hash string, embedding array<float>")


def stale_vectors(rows: DataFrame, stored: DataFrame, text: Column, id_col: str = "qname") -> DataFrame:
    """Rows whose text is not the one embedded."""
    d = rows.withColumn("content_hash", F.sha2(text, 256))
    return d.join(stored.select(id_col, "content_hash"), [id_col, "content_hash"], "left_anti")
