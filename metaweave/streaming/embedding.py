"""Embedding beside the sync: a second stream over changed texts, with what fails kept by row and tried again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..sources.retry import halved
from ..store import GraphStore
from ..tables import materialize

VECTORS, FAILURES = "node_vectors", "embedding_failures"
#: A text that fails so often is left until it changes.
ATTEMPTS = 3
KEY = ["org_id", "qname"]


def try_embed(texts: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """texts: org_id, qname, text, and others that stay. With content_hash, and embedding or error. A failing batch is halved until single texts fail."""
    d = texts.withColumn("content_hash", F.sha2("text", 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for b in batches:
            own = b["text"].tolist()
            good, bad = halved(lambda at: f([own[k] for k in at]), list(range(len(own))))
            vectors, errors = {k: v if v is None else np.asarray(v, np.float32) for k, v in good}, dict(bad)
            yield b.assign(embedding=[vectors.get(k) for k in range(len(own))], error=[errors.get(k) for k in range(len(own))])

    return d.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", embedding array<float>, error string")


def due(store: GraphStore, number: int | None = None) -> DataFrame:
    """Texts that failed, but not too often, and not in this batch already."""
    d = store.read(FAILURES).filter(F.col("attempts") < ATTEMPTS)
    return d if number is None else d.filter(F.col("batch") != number)


def apply_texts(store: GraphStore, batch: DataFrame | None, number: int, make: Callable) -> dict[str, int]:
    """Embeds a batch's texts (org_id, qname, text, ordinal; the last of each counts) and those that are due; how many worked and failed.

    Vectors are written first, then the list of failures: a batch that runs twice leaves the same vectors, and counts no attempt twice.
    """
    known = bool(store._current(FAILURES))
    if not known and batch is None:
        return {"embedded": 0, "failed": 0}
    new = None if batch is None else materialize(merge.last_of_each(batch.select(*KEY, "text", "ordinal"), KEY, "ordinal").select(*KEY, "text").withColumn("attempts", F.lit(0).cast("long")))
    todo = new
    if known:
        again = due(store, number).select(*KEY, "text", "attempts")
        todo = again if new is None else new.unionByName(again.join(new.select(*KEY), KEY, "left_anti"))
    done = materialize(try_embed(todo, make))
    store.upsert_vectors(done.filter("error IS NULL").select(*KEY, "content_hash", "embedding"), VECTORS)
    failed = done.filter("error IS NOT NULL").select(*KEY, "text", "error", (F.col("attempts") + 1).alias("attempts"), F.lit(number).cast("long").alias("batch"))
    if known:
        # what else this batch wrote, if it is run again, stays as it is
        kept = store.read(FAILURES).join(done.select(*KEY), KEY, "left_anti")
        failed = kept.unionByName(failed.select(kept.columns))
    store.write(FAILURES, materialize(failed))
    n = done.agg(F.count_if(F.col("error").isNull()).alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
    return n.asDict()


def embed_stream(store: GraphStore, texts: DataFrame, checkpoint: str, make: Callable) -> StreamingQuery:
    """Embeds a stream of texts until what there is has been read."""
    return texts.writeStream.foreachBatch(lambda batch, n: apply_texts(store, batch, n, make)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(store: GraphStore, make: Callable, number: int) -> int:
    """Tries what is due until nothing is; how many texts are left as failed. number: larger than those of the batches before."""
    while store._current(FAILURES) and not due(store, number).isEmpty():
        apply_texts(store, None, number, make)
        number += 1
    return store.read(FAILURES).count() if store._current(FAILURES) else 0
