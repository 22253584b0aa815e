"""Plans: native operators stay in the JVM, scans read two columns, parts go to tasks of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaweave.llm import common, queries, repeats, simhash

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op9_url_filter"])
def test_native(name, spark):
    plan = plan_of(queries.QUERIES[name](spark, SMALL))
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas")) and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_exact_dedup_shuffles_text_once(spark):
    plan = plan_of(queries.QUERIES["op4_exact_dedup"](spark, SMALL))
    assert plan.count("rangepartitioning") == 1 and "SinglePartition, ENSURE" not in plan.split("Window")[0]


@pytest.mark.parametrize("name", ["op6_byte_bpe", "op8_language_id"])
def test_scans_read_two_columns(name, spark):
    plan = plan_of(queries.QUERIES[name](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_partition_keys(spark):
    for n in (1, 7, 40):
        keys = common.partition_keys(spark, n)
        d = spark.createDataFrame([(k,) for k in keys], "k int").repartition(n, "k").select(F.spark_partition_id().alias("p"))
        assert sorted(r.p for r in d.collect()) == list(range(n))


def test_ids_differ(spark):
    assert repeats.ids_differ(spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], "i long, t string"), "i")
    assert not repeats.ids_differ(spark.createDataFrame([(None, "a"), (None, "b")], "i long, t string"), "i")
    assert not repeats.ids_differ(spark.createDataFrame([(1, "a"), (1, "b")], "i long, t string"), "i")


def test_pairs_of_a_dense_group():
    """Pairs grow with a group's size, not with its square."""
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, (1, 2), dtype=np.uint64)
    f = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 63, (1, 2), dtype=np.uint64)) for _ in range(300)]), axis=0)
    assert len(simhash.links_within(f, simhash.WIDE_RADIUS)) == len(f) - 1
