"""Each query of the catalogue gives the rows of its SQL."""

import pytest

from metaweave import app_queries, catalog, source_queries, stream_queries

SMALL = "/root/testdata/sf0.001"


MODULES = [catalog, app_queries, stream_queries, source_queries]
QUERIES, ORACLE_SQL = ({k: v for m in MODULES for k, v in getattr(m, part).items()} for part in ("QUERIES", "ORACLE_SQL"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SMALL), duck.sql(ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qname", "label", "depth"]
    assert set(e.oracle_sql()) <= set(e.queries())
