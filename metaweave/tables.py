"""Tables written to the session's shared folder: they end lineage, and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_left: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; one of our own only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="metaweave-"))
    return folder


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@atexit.register
def _clean() -> None:
    for path, spark in list(_left.items()):
        try:
            delete_path(spark, path)
        except Exception:  # the session has ended
            pass


def materialize(df: DataFrame) -> DataFrame:
    """Writes df and reads it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/m-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left[path] = spark
    return spark.read.schema(df.schema).parquet(path)
