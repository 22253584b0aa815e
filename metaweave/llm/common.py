"""Helpers that the operators of this subpackage share: shared-folder tables, keys, Arrow batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id wherever ids are ordered: after all others.
NULL_ID = 2**63 - 1
#: Text of one block of documents that Python works on at once.
BLOCK_CHARS = 4_000_000

_local: dict[str, str] = {}
_left: dict[str, object] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a folder of our own only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        done = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = done.get() if done.isDefined() else None
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not folder:
        folder = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="ckpt-"))
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended
        pass


@atexit.register
def _clean() -> None:
    for path, (jvm, conf) in list(_left.items()):
        _delete(jvm, conf, path)


class Table:
    """A DataFrame written as Parquet to the shared folder and read again: lineage ends there, and lost executors don't matter."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/t-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        _left[self.path] = (self.spark._jvm, self.spark._jsc.hadoopConfiguration())
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Once nothing reads it any more."""
        _delete(*_left.pop(self.path), self.path)


def written(df: DataFrame) -> DataFrame:
    return Table(df).read()


def release(spark: SparkSession) -> None:
    """Between phases: shuffle files go when the JVM collects the handles of the plans that wrote them; what a first round frees may hold others."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def key_columns(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The order of documents and, with it, the key of a row: equal for repeated rows only, whatever ids repeat or are null.

    A null id is ordered with the largest number; the lowest bit of the second column tells them apart.
    """
    null = F.col(id_col).cast("long").isNull().cast("long")
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), text.bitwiseAND(F.lit(-2)).bitwiseOR(null)


def null_flag(h: Column) -> Column:
    return h.bitwiseAND(F.lit(1))


def real_id(i: Column, null: Column) -> Column:
    return F.when((i != NULL_ID) | (null == 0), i)


def real_ids(batch: pa.RecordBatch) -> pa.Array:
    """The ids of a batch with key columns i and h."""
    null = pc.and_(pc.equal(batch.column("i"), NULL_ID), pc.equal(pc.bit_wise_and(batch.column("h"), 1), 1))
    return pc.if_else(null, pa.scalar(None, pa.int64()), batch.column("i"))


def blocks(batches: Iterator[pa.RecordBatch], text: str, chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about so much text each, at least a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions an int that repartition(n, column) sends there: so n parts go to n tasks, not several to one."""
    found: dict[int, int] = {}
    d = spark.range(24 * n).select(F.col("id").cast("int").alias("k"))
    for r in d.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect():
        found[r.p] = r.k
    return [found.get(p, p) for p in range(n)]
