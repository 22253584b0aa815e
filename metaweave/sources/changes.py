"""A feed of changes that executors read: offsets are times, and each type and slice of time between two of them is a partition of its own."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "member_type string, member_name string, last_modified_at long, ordinal long, source_uri string, obsolete boolean, namespace string, content string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def named(name: str) -> Callable:
    """The function that `module:function` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Feed(DataSourceStreamReader):
    """Only two numbers pass the driver: the offset up to which changes were read, and the latest one there is."""

    def __init__(self, options: dict):
        self.fetch, self.latest = options["fetch"], options["latest"]
        self.types = [t for t in options.get("types", "").split(",") if t]
        self.since, self.lag = int(options.get("since", "0")), int(options.get("lag_ms", "0"))
        self.seen = self.since  # Spark may ask for the latest offset before it asks for the first
        self.until = int(options["until"]) if "until" in options else None
        self.slice, self.most = int(options.get("slice_ms", "3600000")), int(options.get("slices", "1000"))
        self.args = {k[4:]: v for k, v in options.items() if k.startswith("arg.")}

    def initialOffset(self) -> dict:
        return {"at": self.since}

    def latestOffset(self) -> dict:
        """lag_ms behind what the source says: changes may show late. It never goes back."""
        at = named(self.latest)(self.args) - self.lag
        self.seen = max(self.seen, at if self.until is None else min(at, self.until))
        return {"at": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The same for the same offsets, so a batch that is read again is the same batch."""
        width = max(self.slice, -(-(end["at"] - start["at"]) // self.most))
        return [InputPartition((t, a, min(a + width, end["at"]))) for t in self.types for a in range(start["at"], end["at"], width)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        kind, after, upto = partition.value
        return (r for r in named(self.fetch)(kind, after, upto, self.args) if after < r[2] <= upto)

    def commit(self, end: dict) -> None:
        pass


class Changes(DataSource):
    """format("metaweave_changes"), to be registered with spark.dataSource.register.

    Options: types (with commas between), fetch and latest (each `module:function`, to be found by executors), since, until, lag_ms, slice_ms, slices (so
    many of a type at most in a batch, else they get wider) and any `arg.x`. fetch(type, after, upto, args) yields the rows that changed after a time (ms) and
    up to another; latest(args) gives the time of the latest change. Times and what they hold must not change once they are lag_ms old: then a
    restart, in the middle of a batch too, loses and repeats nothing for a sink that can take a batch twice.
    """

    @classmethod
    def name(cls) -> str:
        return "metaweave_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Feed(self.options)


def _folder(path: str):
    from pyarrow import dataset, fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return dataset.dataset(parts.path, partitioning="hive")
    system, inner = fs.FileSystem.from_uri(path)
    return dataset.dataset(inner, filesystem=system, partitioning="hive")


def folder_changes(kind: str, after: int, upto: int, args: dict) -> Iterator[tuple]:
    """fetch over a folder (arg.path) of Parquet files by member_type: a slice's rows are picked by the files' statistics, a batch at a time."""
    from pyarrow import dataset as ds

    at = ds.field("last_modified_at")
    for batch in _folder(args["path"]).to_batches(columns=COLUMNS, filter=(ds.field("member_type") == kind) & (at > after) & (at <= upto)):
        yield from zip(*[batch.column(c).to_pylist() for c in COLUMNS])


def folder_latest(args: dict) -> int:
    """latest over such a folder, from the files' statistics."""
    found = 0
    for fragment in _folder(args["path"]).get_fragments():
        for group in fragment.row_groups:
            found = max(found, (group.statistics or {}).get("last_modified_at", {}).get("max", 0))
    return found
