"""First and last seen of nodes as streaming state: a small table for each node instead of a join with the store in each batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..store import GraphStore

FACT = StructType([StructField(n, t) for n, t in (("label", StringType()), ("attributes", StringType()), ("source_hash", StringType()), ("at", LongType()), ("gone", BooleanType()))])
ORDINAL = StructType([StructField("ordinal", LongType())])
#: What is known of a node: its content, its times, whether it is gone, and the ordinal of the last fact that went into it.
NODE = StructType([StructField(n, t) for n, t in (("label", StringType()), ("attributes", StringType()), ("source_hash", StringType()), ("first_seen_at", LongType()), ("last_seen_at", LongType()), ("last_modified_at", LongType()), ("gone", BooleanType()), ("ordinal", LongType()))])
OUTPUT = StructType([StructField("org_id", StringType()), StructField("qname", StringType()), *NODE.fields])


def after(node: tuple | None, ordinal: int, fact: tuple) -> tuple:
    """A node after one more fact: as a merge of that fact into the store. A tombstone keeps what was there, as gone; what comes after it is new."""
    label, attributes, hash_, at, gone = fact
    if gone:
        return (*(node[:6] if node else (label, attributes, hash_, at, at, at)), True, ordinal)
    if node is None or node[6]:
        return (label, attributes, hash_, at, at, at, False, ordinal)
    if hash_ == node[2]:
        return (*node[:4], at, node[5], False, ordinal)
    return (label, attributes, hash_, node[3], at, at, False, ordinal)


class Seen(StatefulProcessor):
    """State of a node: all facts up to the watermark as one row, and the later ones by their ordinal, since earlier ones may still come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("node", NODE)
        self.pending = handle.getMapState("pending", ORDINAL, FACT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        node = self.base.get() if self.base.exists() else None
        node = tuple(node) if node is not None else None
        for d in rows:
            d = d.drop_duplicates("ordinal", keep="last")
            for r in d.itertuples(index=False):
                if node is None or r.ordinal > node[7]:  # what is in the row already is a repetition, or too late
                    self.pending.updateValue((int(r.ordinal),), (r.label, r.attributes, r.source_hash, int(r.at), bool(r.obsolete)))
        facts = sorted((int(k[0]), tuple(v)) for k, v in self.pending.iterator()) if self.pending.exists() else []
        settled = timerValues.getCurrentWatermarkInMs()
        while facts and facts[0][1][3] <= settled:
            ordinal, fact = facts.pop(0)
            node = after(node, ordinal, fact)
            self.pending.removeKey((ordinal,))
            self.base.update(node)
        for ordinal, fact in facts:
            node = after(node, ordinal, fact)
        if node is not None:
            yield pd.DataFrame([(*key, *node)], columns=OUTPUT.names)

    def close(self) -> None:
        pass


def seen(facts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of nodes (OUTPUT) as they are after each batch, from one of facts: org_id, qname, label, attributes, source_hash, event_time (timestamp), at (the same in ms), ordinal (grows with
    at), obsolete. Facts may come in any order within the delay, and more than once; later than that, only those with a larger ordinal than what is settled count.

    The session must use the RocksDB state store. A node's state is a row and the facts of the last delay.
    """
    d = facts.withWatermark("event_time", delay)
    return d.groupBy("org_id", "qname").transformWithStateInPandas(statefulProcessor=Seen(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep(store: GraphStore, facts: DataFrame, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Keeps the store's nodes as the stream says until what there is has been read; a batch that is written twice changes nothing."""
    conf, name = facts.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKSDB)
    try:
        return seen(facts, delay).writeStream.outputMode("update").foreachBatch(lambda batch, n: store.put_nodes(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
