"""Change feeds as Structured Streaming: each micro-batch is an upsert, so a batch that runs twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..store import GraphStore
from ..tables import materialize


def apply_batch(store: GraphStore, batch: DataFrame, now: int) -> None:
    """batch: node facts with `ordinal` and `obsolete`. The last fact of a key counts: it is merged, or its node deleted with all its edges."""
    last = materialize(merge.last_of_each(batch, ["org_id", "qname"], "ordinal"))
    store.merge_nodes(last.filter(~F.coalesce("obsolete", F.lit(False))).drop("obsolete", "ordinal"), now)
    store.delete_nodes(last.filter("obsolete"))


def sync(spark: SparkSession, store: GraphStore, changes: DataFrame, checkpoint: str, now: int = 0) -> StreamingQuery:
    """Merges a stream of node facts into the store until what there is has been read. The checkpoint is the high-water mark."""
    def write(batch: DataFrame, number: int) -> None:
        apply_batch(store, batch, now + number)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_since(changes: DataFrame, since: int, categories: DataFrame | None = None) -> DataFrame:
    """A batch of a change feed: what changed after a time, oldest first, with its category (types without one are left out)."""
    d = changes.filter(F.col("last_modified_at") > since)
    if categories is not None:
        d = d.join(F.broadcast(categories), "member_type")  # a row for each kind of member
    return d.orderBy("last_modified_at", "member_name")
