"""Plans: scans of one label read its files, reports keep few rows a task, merges shuffle on the key."""

import re

import pytest
from pyspark.sql import functions as F

from metaweave.operators import audit, merge, vector
from metaweave.sources import testdata as td
from metaweave.store import GraphStore

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_scan_prunes(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}")
    store.merge_nodes(td.nodes(spark, SMALL, ["Nation", "Region"]).select("org_id", "label", "qname", F.lit("{}").alias("attributes"), "source_hash"), 1)
    d = store.read("nodes").filter("label = 'Region' and org_id = 'org1'")
    assert re.search(r"PartitionFilters: \[[^\]]*label", plan_of(d))
    assert d.count() == 5


def test_writes_touch_their_partitions_only(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}")
    rows = lambda *x: spark.createDataFrame([(o, la, q, "{}", h) for o, la, q, h in x], "org_id string, label string, qname string, attributes string, source_hash string")
    edge = lambda *x: spark.createDataFrame([(o, "R", a, b, "{}") for o, a, b in x], "org_id string, rel_type string, src string, dst string, attributes string")
    paths = lambda t: set(store._state(t)["paths"])
    assert store.merge_nodes(rows(("o1", "A", "a", "1"), ("o1", "B", "b", "1"), ("o2", "A", "a", "1")), 1) == {"inserted": 3, "updated": 0, "unchanged": 0}
    store.merge_edges(edge(("o1", "a", "b"), ("o2", "a", "b")), 1)
    snap, before = store.create_snapshot("o1", "s", now=1), paths("nodes")
    assert store.merge_nodes(rows(("o1", "B", "b", "2"), ("o1", "B", "c", "1")), 2) == {"inserted": 1, "updated": 1, "unchanged": 0}
    assert len(before & paths("nodes")) == 2  # A of both orgs
    assert store.merge_nodes(rows(("o1", "C", "a", "2")), 3) == {"inserted": 0, "updated": 1, "unchanged": 0}  # moves to another label
    assert sorted((r.org_id, r.label, r.qname) for r in store.read("nodes").collect()) == [("o1", "B", "b"), ("o1", "B", "c"), ("o1", "C", "a"), ("o2", "A", "a")]
    assert store.merge_nodes(rows(), 4) == {"inserted": 0, "updated": 0, "unchanged": 0}
    store.delete_nodes(rows(("o1", "B", "b", "")))  # the other org's edge of the same names stays
    assert [tuple(r) for r in store.read("edges").select("org_id", "src", "dst").collect()] == [("o2", "a", "b")]
    for k in range(6):
        store.merge_nodes(rows(("o1", "B", "c", f"x{k}")), 5 + k)
    assert sorted((r.label, r.qname, r.source_hash) for r in store.snapshot(snap).collect()) == [("A", "a", "1"), ("B", "b", "1")]
    assert store.snapshot(snap, "edges").count() == 1 and store.read("nodes").count() == 3
    folders = lambda: {str(x.parent.relative_to(tmp_path / "nodes")) for x in (tmp_path / "nodes").glob("gen=*/*/*/*.parquet")}
    assert snap and before & folders() == before
    store.delete_snapshot(snap)
    assert before - folders() == before - paths("nodes")
    with pytest.raises(ValueError):
        store.snapshot(snap)


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, f"file://{tmp_path}")
    store.upsert_org("o1", "one", "", "", 1)
    old = store.read("orgs")
    monkeypatch.setattr(store, "_current", lambda table: 0)  # as it was when the other began
    with pytest.raises(Exception, match="exists"):
        store.write("orgs", old)


def test_analysis_of_one_org_leaves_others(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}")
    store.merge_nodes(spark.createDataFrame([(o, "ApexClass", "ApexClass:A", "{}", "1") for o in ("o1", "o2")], "org_id string, label string, qname string, attributes string, source_hash string"), 1)
    for org in ("o1", "o2", "o1"):
        store.populate_analysis(org, 2)
    assert sorted(r.org_id for r in store.read("dead_code_scores").collect()) == ["o1", "o2"]


def test_top_rows(spark):
    d = td.read(spark, SMALL, "embeddings")
    assert "TakeOrderedAndProject" in plan_of(vector.knn(d, [0.0] * 64, 5))
    assert "WindowGroupLimit" in plan_of(audit.freshness_report(td.nodes(spark, SMALL), 0))


def test_merge_joins_once(spark):
    before, after = td.snapshot_pair(spark, SMALL)
    stored = before.withColumns({"first_seen_at": F.lit(1), "last_seen_at": F.lit(1)})
    plan = plan_of(merge.merge(stored, after, ["org_id", "qname"], 2))
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 1 and "Window" not in plan


def test_scan_reads_needed_columns(spark):
    plan = plan_of(td.edges(spark, SMALL, ["CONTAINS"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
