"""Queries give the rows of their SQL on odd texts, and on tables with larger groups than the test tables have."""

import io
import os
import shutil
import warnings
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from metaweave import app_queries, ingest
from metaweave.functions import governor
from metaweave.operators import resolve, vector
from metaweave.parse import base, registry
from metaweave.sources import archives
from metaweave.store import GraphStore

SMALL = "/root/testdata/sf0.001"


def tables(tmp_path, **replaced):
    """A folder of the small tables, with these in place of those of their names; and DuckDB's views of them."""
    import duckdb

    for name in os.listdir(SMALL):
        if name.removesuffix(".parquet") not in replaced:
            shutil.copy(f"{SMALL}/{name}", tmp_path / name)
    for name, d in replaced.items():
        d.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    c = duckdb.connect()
    for name in os.listdir(tmp_path):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{name}'")
    return str(tmp_path), c


def test_evidence_of_blank_texts(spark, same, tmp_path):
    texts = [None, "", " ", "   ", "\t", " a", "a  ", "x" * 199, " " * 300 + "x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder, duck = tables(tmp_path, documents=d)
    same(app_queries.QUERIES["fn_evidence"](spark, folder), duck.sql(app_queries.ORACLE_SQL["fn_evidence"]))


def test_tools_with_over_500_nodes(spark, same, tmp_path):
    """Over 500 components call the class that has changed."""
    k = F.col("id")
    d = spark.range(47_000).select(k.alias("c_custkey"), F.lit("n").alias("c_name"), (k % 25).cast("int").alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    folder, duck = tables(tmp_path, customer=d)
    for name in ("tool_trace_upstream", "tool_impact_from_git_diff", "tool_impact_from_git_diff_whole", "tool_test_gap_intelligence_from_git_diff"):
        out = app_queries.QUERIES[name](spark, folder)
        assert out.count() > 500
        same(out, duck.sql(app_queries.ORACLE_SQL[name]))


def test_cap_of_a_diff(spark, tmp_path):
    folder, _ = tables(tmp_path)
    impact = lambda **more: app_queries.tools.dispatch("impact_from_git_diff", app_queries.app_store(spark, folder), org="org1", diff_text=app_queries.GIT_FAR, depth=2, **more).data
    whole, cut = impact(), impact(cap=5)
    assert not whole["truncated"] and cut["truncated"] and cut["impacted"].count() < whole["impacted"].count()
    wide = impact(cap=100_000)  # each seed by itself, and the nearest seeds together, give the same
    assert sorted(map(tuple, whole["impacted"].collect())) == sorted(map(tuple, wide["impacted"].collect()))
    assert sorted(map(tuple, whole["edges"].collect())) == sorted(map(tuple, wide["edges"].collect()))


def test_resolvers_walk_attributes_once(spark, tmp_path, monkeypatch):
    """What a resolver finds is read by the merge and by the counters, and worked out once."""
    seen, walk = spark.sparkContext.accumulator(0), resolve.json_leaves

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def leaves(rows):
        d = walk(rows)
        return d.mapInArrow(counted, d.schema)

    monkeypatch.setattr(resolve, "json_leaves", leaves)
    store = GraphStore(spark, f"file://{tmp_path}")
    rows = [("org1", "A", f"A:Name{i}", '{"uses": "Name%d", "more": ["x", "Name%d"]}' % (i + 1, i + 2), "h") for i in range(20)]
    store.merge_nodes(spark.createDataFrame(rows, "org_id string, label string, qname string, attributes string, source_hash string"), 1)
    assert ingest.run_resolvers(store, "org1", 2)["references"] == {"edges": 37, "truncated_sources": 0}
    assert seen.value == 60


def test_blanks_and_vectors_as_they_were():
    text = "a('it\\'s // x'); // c 'd'\n/* 'e' \n */ f('g\nh' /* i"
    assert governor.blank(text) == "a('          ');         \n       \n    f(' \nh'    i"
    long, short = ["w%d" % i for i in range(2 * vector.EMBED_WORDS)], ["a b", "", "b", "..."]
    one = vector.hashing_embedder(70)
    each = [one([t])[0].tolist() for t in [*short, " ".join(long)]]
    assert [v.tolist() for v in one([*short, " ".join(long)])] == each and each[1] == [0.0] * 70


def test_a_working_tree_is_parsed_by_all_tasks(spark):
    """Small members in one partition, as of one file, are dealt before they are parsed."""
    rows = [("org1", "ApexClass", f"A{i}", "", None, "class A%d { public void f() { } }" % i) for i in range(200)]
    d = spark.createDataFrame(rows, "org_id string, member_type string, member_name string, source_uri string, namespace string, content string").coalesce(1)
    facts = registry.parse_stored(d)
    tasks = {r.f for r in facts.select(F.input_file_name().alias("f")).distinct().collect()}
    assert facts.filter("kind = 'node'").count() == 400 and len(tasks) >= spark.sparkContext.defaultParallelism


def test_similar_reads_the_vectors_once(spark, tmp_path, monkeypatch):
    """The hits are counted, shown and returned, and searched for once."""
    seen, search = spark.sparkContext.accumulator(0), vector.knn

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(vector, "knn", lambda d, *more: search(d.mapInArrow(counted, d.schema), *more))
    store = GraphStore(spark, f"file://{tmp_path}")
    names = [f"A:Name{i}" for i in range(30)]
    store.merge_nodes(spark.createDataFrame([("org1", "A", q, "{}", "h") for q in names], "org_id string, label string, qname string, attributes string, source_hash string"), 1)
    store.upsert_vectors(vector.embed(store.read("nodes"), F.col("qname"), lambda: vector.hashing_embedder(16)).withColumn("org_id", F.lit("org1")))
    hits = app_queries.tools.dispatch("find_similar", store, org="org1", text="A:Name7", k=3, embedder=vector.hashing_embedder(16)).data["hits"]
    assert [r.qname for r in hits.collect()][0] == "A:Name7" and hits.count() == 3
    assert seen.value == 30


def test_chunks_of_an_archive_read_no_directory(spark, tmp_path):
    """The listing says where entries are: the directory may be gone by the time that they are read."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(300):
            z.writestr(f"d/{k}.txt", f"text {k}")
        start = z.start_dir
    d = archives.read_archives(spark, f"file://{tmp_path}", chunk=100)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[start:] = bytes(len(data) - start)
    (tmp_path / "a.zip").write_bytes(data)
    assert {r.path: r.content for r in d.collect()} == {f"d/{k}.txt": f"text {k}" for k in range(300)}


def test_directory_is_as_zipfile_reads_it(tmp_path):
    path, data = tmp_path / "a.zip", io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"a comment"
        for name, text in (("one.txt", "1"), ("d/", ""), ("ü.txt", "ü" * 50), ("one.txt", "2")):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                z.writestr(name, text)
    path.write_bytes(b"#!/bin/sh\n" + data.getvalue())  # bytes before the archive
    overlapping = bytearray(path.read_bytes())
    at = overlapping.rindex(b"PK\x01\x02") + 42
    overlapping[at : at + 4] = bytes(4)  # the last entry says that it lies where the first does
    for content in (path.read_bytes(), overlapping):
        path.write_bytes(content)
        with zipfile.ZipFile(path) as z:
            want = [(x.filename, x.header_offset, x._end_offset, x.CRC, x.file_size, x.compress_size) for x in z.infolist() if not x.is_dir()]
        got = [(r.path, r.at, r.end, r.crc, r.size, r.packed) for d in archives._listed(str(path), 10) for r in d.itertuples()]
        assert got == want


def test_facts_of_large_members_go_in_small_batches(spark):
    """A batch of members may have any number of facts; a source that many nodes have is hashed once."""
    kept = []
    members = type("Members", (), {"mapInArrow": lambda self, run, schema: kept.append(run)})()
    registry._parsed(members, 0)
    fields = "".join(f"<fields><fullName>F{i}__c</fullName><type>Text</type></fields>" for i in range(400))
    rows = [{"org_id": "org1", "member_type": "CustomObject", "member_name": f"O{k}__c", "source_uri": "", "namespace": None, "content": f"<CustomObject><label>{k}</label>{fields}</CustomObject>"} for k in range(60)]
    sizes = [b.num_rows for b in kept[0](iter([pa.RecordBatch.from_pylist(rows)]))]
    assert sum(sizes) == 60 * 801 and len(sizes) > 1 and max(sizes) < registry.ROWS + 801
    facts, calls = base.Facts(base.Context()), []
    real, base.sha256 = base.sha256, lambda text: calls.append(text) or real(text)
    try:
        source, other = "a" * 50, "b"
        for text in (source, source, other, "", source):
            facts.node("L", "L:x", {}, text)
    finally:
        base.sha256 = real
    assert [n[3] for n in facts.nodes] == [real(source), real(source), real(other), "", real(source)] and len(calls) == 3
