"""Sources that fail in part: what was read stays, the failure is a row, and what may pass is read once more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import skip_category
from ..tables import materialize
from .changes import COLUMNS, SCHEMA, named
from .retry import TRANSIENT, category, halved


class Parts(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.types = options["fetch"], [t for t in options["types"].split(",") if t]
        self.args = {k[4:]: v for k, v in options.items() if k.startswith("arg.")} | {"attempt": options.get("attempt", "0")}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(t) for t in self.types]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The type's rows, and a row with the error in place of those after it."""
        n = 0
        try:
            for n, row in enumerate(named(self.fetch)(partition.value, self.args), 1):
                yield (*row, None)
        except Exception as error:
            yield (partition.value, *[None] * (len(COLUMNS) - 1), f"{type(error).__name__} after {n} rows: {error}")


class SoftParts(DataSource):
    """format("metaweave_parts"). Options: types (with commas between), fetch (`module:function`, to be found by executors), attempt, and any `arg.x`.

    fetch(type, args) yields rows (changes.COLUMNS) of one type, in a task of its own. Where it raises, the rows before stay, and a row with only the type and `error` follows.
    """

    @classmethod
    def name(cls) -> str:
        return "metaweave_parts"

    def schema(self) -> str:
        return f"{SCHEMA}, error string"

    def reader(self, schema) -> DataSourceReader:
        return Parts(self.options)


def read_parts(spark: SparkSession, fetch: str, types: list[str], args: dict[str, str] | None = None, retries: int = 1) -> tuple[DataFrame, DataFrame]:
    """The rows of all types, and a report of what failed for good: source, message, category, attempts.

    Types whose failure may pass are read again, so often at most; of what both reads gave, the later row of a name stays. Each read is written, so no type is read more often than
    that. Only types and messages pass the driver.
    """
    spark.dataSource.register(SoftParts)
    options = {f"arg.{k}": v for k, v in (args or {}).items()} | {"fetch": fetch}
    reads, failed, left = [], {}, list(types)
    for attempt in range(retries + 1):
        if not left:
            break
        d = materialize(spark.read.format("metaweave_parts").options(**options, types=",".join(left), attempt=attempt).load())
        errors = {r.member_type: r.error for r in d.filter("error IS NOT NULL").select("member_type", "error").collect()}
        reads.append(d.filter("error IS NULL").drop("error").withColumn("__read", F.lit(attempt)))
        failed = {k: v for k, v in failed.items() if k not in left} | {k: (v, attempt + 1) for k, v in errors.items()}
        left = [k for k, v in errors.items() if category(v) in TRANSIENT]
    report = spark.createDataFrame([(k, m, n) for k, (m, n) in failed.items()], "source string, message string, attempts int").withColumn("category", skip_category(F.col("message")))
    if not reads:
        return spark.createDataFrame([], SCHEMA), report
    rows = reads[0]
    for more in reads[1:]:
        # only types that were read again can have a name twice
        again = more.select("member_type").distinct()
        both = rows.join(F.broadcast(again), "member_type", "left_semi").unionByName(more)  # a row for each type
        last = both.groupBy("member_type", "member_name").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("member_type", "member_name")]), "__read").alias("r")).select("member_type", "member_name", "r.*")
        rows = rows.join(F.broadcast(again), "member_type", "left_anti").unionByName(last.select(rows.columns))
    return rows.select(COLUMNS), report


def read_names(names: DataFrame, call: Callable[[str, list[str]], list[str]], batch: int = 64) -> DataFrame:
    """names: member_type and member_name. With content, or error and its category, of each.

    call(type, names) gives the contents of a batch, or raises for all of it: then the batch is halved until single names fail. A task asks for its names of a type in batches.
    """
    schema = "member_type string, member_name string, content string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, some in b.groupby("member_type", sort=False):
                own = some["member_name"].tolist()
                for a in range(0, len(own), batch):
                    good, bad = halved(lambda x: call(kind, x), own[a : a + batch])  # noqa: B023
                    rows = [(kind, n, text, None) for n, text in good] + [(kind, n, None, error) for n, error in bad]
                    yield pd.DataFrame(rows, columns=["member_type", "member_name", "content", "error"])

    d = names.select("member_type", "member_name").sortWithinPartitions("member_type").mapInPandas(run, schema)
    return d.withColumn("category", F.when(F.col("error").isNotNull(), skip_category(F.col("error"))))
