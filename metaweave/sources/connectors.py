"""Sources that fetch: a Python data source with a fetch function of the caller's, and a small feed of changes as a stream."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "member_type string, member_name string, last_modified_at long, source_uri string, obsolete boolean, namespace string, content string"


def _load(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.types = options["fetch"], [t for t in options.get("types", "").split(",") if t]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(t) for t in self.types]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _load(self.fetch)(partition.value)


class _Feed(SimpleDataSourceStreamReader):
    """The offset is the time up to which changes were read."""

    def __init__(self, options: dict):
        self.fetch, self.since = options["fetch"], int(options.get("since", "0"))

    def initialOffset(self) -> dict:
        return {"at": self.since}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = sorted((r for r in _load(self.fetch)(start["at"]) if r[2] > start["at"]), key=lambda r: (r[2], r[1]))
        return iter(rows), {"at": max([start["at"], *(r[2] for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(r for r in _load(self.fetch)(start["at"]) if start["at"] < r[2] <= end["at"])

    def commit(self, end: dict) -> None:
        pass


class MemberSource(DataSource):
    """format("metaweave_members"): option fetch names `module:function`.

    For a batch, fetch(type) yields the rows of one member type and `types` lists them: a task for each. For a
    stream, fetch(since) yields the rows that changed after a time in milliseconds.
    """

    @classmethod
    def name(cls) -> str:
        return "metaweave_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Feed(self.options)


def listed_types(members: DataFrame, types: DataFrame) -> DataFrame:
    """Members of the types that a list (member_type) allows."""
    return members.join(types.select("member_type").distinct(), "member_type", "left_semi")
