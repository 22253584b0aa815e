"""Feeds, state and side stages under restarts, repetitions and changes of order."""

import random

import pytest
from pyspark.sql import functions as F

from metaweave import stream_queries
from metaweave.sources import changes, failsoft
from metaweave.sources.retry import category, halved
from metaweave.store import GraphStore
from metaweave.streaming import embedding, state

FEED = [("A", f"a{k}", k, k, "", False, None, str(k)) for k in range(1, 101)] + [("B", f"b{k}", 3 * k, 1000 + k, "", False, None, "x") for k in range(1, 30)]


def fetch(kind, after, upto, args):
    yield from (r for r in FEED if r[0] == kind and after < r[2] <= upto)


def latest(args):
    return 100


def test_a_feed_restarted_in_mid_batch_loses_and_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(changes.Changes)
    taken, fail = {}, [True]

    def write(batch, number):
        rows = [(r.member_type, r.ordinal) for r in batch.collect()]
        if number == 1 and fail[0]:
            fail[0] = False
            raise RuntimeError("stopped")
        taken[number] = rows

    def run(until):
        options = {"types": "A,B", "fetch": "tests.test_streams:fetch", "latest": "tests.test_streams:latest", "until": until, "slice_ms": 7, "slices": 5, "lag_ms": 2}
        d = spark.readStream.format("metaweave_changes").options(**options).load()
        d.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    run(40)
    with pytest.raises(Exception):
        run(1000)
    run(1000)
    run(1000)
    rows = [r for n in taken for r in taken[n]]
    assert sorted(rows) == sorted((r[0], r[3]) for r in FEED if r[2] <= 98) and len(taken) == 2


def test_partitions_are_types_times_slices():
    feed = changes.Feed({"fetch": "", "latest": "", "types": "A,B", "slice_ms": "10", "slices": "4"})
    cut = [p.value for p in feed.partitions({"at": 5}, {"at": 28})]
    assert cut == [(t, a, b) for t in "AB" for a, b in ((5, 15), (15, 25), (25, 28))]
    assert len(feed.partitions({"at": 0}, {"at": 1000})) == 8 and feed.partitions({"at": 9}, {"at": 9}) == []


def plain(facts):
    node = {}
    for q, ordinal, at, hash_, gone in sorted(set(facts), key=lambda x: x[1]):
        if gone:
            node.pop(q, None)
        elif q not in node:
            node[q] = [hash_, at, at, at]
        else:
            old = node[q]
            node[q] = [hash_, old[1], at, old[3] if old[0] == hash_ else at]
    return {(q, *v) for q, v in node.items()}


def test_state_equals_merges_in_order(spark, tmp_path):
    """Facts in random order within the delay, over several batches, repeated, with tombstones: as if each had been merged when it happened."""
    r = random.Random(1)
    facts = [(f"N:{r.randrange(12)}", k, 1000 * (k + 1), r.choice("xyz"), r.random() < 0.15) for k in range(400)]
    order = sorted(facts, key=lambda f: f[1] + r.uniform(-30, 30))
    store = GraphStore(spark, f"file://{tmp_path}/s")
    schema = "qname string, ordinal long, at long, source_hash string, obsolete boolean"
    for part in range(4):
        rows = order[part * 100 : part * 100 + 100] + order[max(0, part * 100 - 20) : part * 100]
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{tmp_path}/in/{part}")
        d = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/*")
        d = d.select(F.lit("o").alias("org_id"), "qname", F.lit("N").alias("label"), F.lit("{}").alias("attributes"), "source_hash", F.timestamp_millis("at").alias("event_time"), "at", "ordinal", "obsolete")
        state.keep(store, d, f"file://{tmp_path}/c", "120 seconds").awaitTermination()
        assert {(x.qname, x.source_hash, x.first_seen_at, x.last_seen_at, x.last_modified_at) for x in store.read("nodes").collect()} == plain(order[: part * 100 + 100])
    before = store.read("nodes").collect()
    again = spark.createDataFrame([(*x, False) for x in before], store.read("nodes").schema.add("gone", "boolean"))
    store.put_nodes(again)
    assert sorted(store.read("nodes").collect()) == sorted(before)


def test_one_failing_text_fails_alone(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def f(texts):
            calls.add(1)
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [[float(len(t))] for t in texts]

        return f

    store = GraphStore(spark, f"file://{tmp_path}/s")
    texts = [("o", f"q{k}", "bad" if k in (5, 40) else "t" * k, 1) for k in range(1, 65)]
    d = spark.createDataFrame(texts, "org_id string, qname string, text string, ordinal long").coalesce(1)
    assert embedding.apply_texts(store, d, 0, make) == {"embedded": 62, "failed": 2}
    assert calls.value <= 1 + 2 * 2 * 6 * 2  # a plan may run the embedder once, and writing what it gave doesn't run it again
    assert embedding.apply_texts(store, d, 0, make) == {"embedded": 62, "failed": 2}  # the same batch again
    assert {(r.qname, r.attempts) for r in store.read(embedding.FAILURES).collect()} == {("q5", 1), ("q40", 1)}
    fixed = spark.createDataFrame([("o", "q5", "good", 1), ("o", "q5", "better", 2)], d.schema)
    assert embedding.apply_texts(store, fixed, 1, make) == {"embedded": 1, "failed": 1}
    assert embedding.drain(store, make, 2) == 1
    assert {(r.qname, r.attempts) for r in store.read(embedding.FAILURES).collect()} == {("q40", 3)}
    got = {r.qname: r.embedding[0] for r in store.read(embedding.VECTORS).collect()}
    assert len(got) == 63 and got["q5"] == 6.0 and got["q7"] == 7.0
    assert embedding.apply_texts(GraphStore(spark, f"file://{tmp_path}/t"), None, 0, make) == {"embedded": 0, "failed": 0}


def test_halving():
    calls = []

    def f(items):
        calls.append(len(items))
        if any(x in (3, 17, 60) for x in items):
            raise KeyError("bad")
        return [x * 2 for x in items]

    good, bad = halved(f, list(range(64)))
    assert [x for x, _ in bad] == [3, 17, 60] and good == [(x, 2 * x) for x in range(64) if x not in (3, 17, 60)] and len(calls) <= 2 * 3 * 6 + 1
    assert halved(f, []) == ([], []) and halved(lambda x: [], [1])[1][0][0] == 1
    assert [category(m) for m in ("INSUFFICIENT rights", "forbidden", "sObject INVALID_TYPE", "REQUEST_LIMIT_EXCEEDED", "connect ETIMEDOUT", "read timed out")] == ["insufficient_access", "insufficient_access", "not_found", "rate_limit", "network", "unknown"]


def test_feed_plan_has_no_driver_rows(spark, tmp_path):
    assert set(stream_queries.QUERIES) == set(stream_queries.ORACLE_SQL)
    d = spark.range(10).select(F.lit("A").alias("member_type"), F.col("id").cast("string").alias("member_name"), F.col("id").alias("last_modified_at"), F.col("id").alias("ordinal"), F.lit("").alias("source_uri"), F.lit(False).alias("obsolete"), F.lit(None).cast("string").alias("namespace"), F.lit("c").alias("content"))
    d.write.partitionBy("member_type").parquet(f"file://{tmp_path}/x")
    args = {"path": f"file://{tmp_path}/x"}
    assert changes.folder_latest(args) == 9 and [r[2] for r in changes.folder_changes("A", 3, 6, args)] == [4, 5, 6] and not list(changes.folder_changes("B", 0, 9, args))


def parts(kind, args):
    """Type A is whole; B ends in an error that passes; C in one that stays."""
    for k in range(5):
        if kind == "B" and k == 3 and args["attempt"] == "0":
            raise ConnectionError("connect ETIMEDOUT")
        if kind == "C" and k == 2:
            raise ValueError("INVALID_TYPE: no such thing")
        yield (kind, f"n{k}", 1, k, args["from"], False, None, f"{kind}{k} of {args['attempt']}")


def test_a_source_that_fails_keeps_its_rows_and_is_read_once_more(spark):
    rows, report = failsoft.read_parts(spark, "tests.test_streams:parts", ["A", "B", "C"], {"from": "here"})
    got = {(r.member_type, r.member_name): r.content for r in rows.collect()}
    assert got == {("A", f"n{k}"): f"A{k} of 0" for k in range(5)} | {("B", f"n{k}"): f"B{k} of 1" for k in range(5)} | {("C", f"n{k}"): f"C{k} of 0" for k in range(2)}
    assert [(r.source, r.category, r.attempts) for r in report.collect()] == [("C", "not_found", 1)]
    rows, report = failsoft.read_parts(spark, "tests.test_streams:parts", ["B"], {"from": "here"}, retries=0)
    assert rows.count() == 3 and [(r.source, r.category) for r in report.collect()] == [("B", "network")]
    rows, report = failsoft.read_parts(spark, "tests.test_streams:parts", [])
    assert rows.count() == 0 and report.count() == 0


def test_names_that_fail_a_batch_are_found_by_halving(spark):
    calls = spark.sparkContext.accumulator(0)

    def call(kind, names):
        calls.add(1)
        if any(n in ("n3", "n20", "n63") for n in names):
            raise ValueError("NOT_FOUND")
        return [f"{kind}:{n}" for n in names]

    d = spark.createDataFrame([("T", f"n{k}") for k in range(64)], "member_type string, member_name string").coalesce(1)
    got = failsoft.read_names(d, call).collect()
    assert {r.member_name for r in got if r.error} == {"n3", "n20", "n63"} and {r.category for r in got if r.error} == {"not_found"}
    assert sum(r.content == f"T:{r.member_name}" for r in got) == 61 and calls.value <= 2 * 3 * 6 + 1
