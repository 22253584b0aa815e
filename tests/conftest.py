import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return c


def rows_of(df) -> list[str]:
    """Rows of a pandas frame as sorted text, columns in order of name."""
    return sorted(df[sorted(df.columns)].astype(str).agg("|".join, axis=1).tolist())


@pytest.fixture(scope="session")
def same():
    from pyspark.sql.types import IntegralType

    def check(spark_df, duck_df):
        a, b = spark_df.toPandas(), duck_df.df()
        for f in spark_df.schema:  # pandas has made integers with nulls floats
            if isinstance(f.dataType, IntegralType) and a[f.name].dtype == float:
                a[f.name] = a[f.name].astype("Int64")
        assert sorted(a.columns) == sorted(b.columns)
        assert rows_of(a) == rows_of(b) if len(a) and len(b) else len(a) == len(b)

    return check
