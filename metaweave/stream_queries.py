"""Queries by Structured Streaming over the test tables, each with SQL that gives what the batch would."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import archives, failsoft
from .sources import testdata as td
from .sources.changes import Changes, folder_changes
from .store import GraphStore
from .streaming import embedding, state
from .tables import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def changes(spark: SparkSession, sf_dir: str, root: str) -> tuple[DataFrame, int, int]:
    """All events as changes of members, a type for each kind of event, written by type; their first and last time. An error removes its user."""
    at = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    e = td.read(spark, sf_dir, "events").select(F.col("event_type").alias("member_type"), F.col("user_id").cast("string").alias("member_name"), at.alias("last_modified_at"), F.col("event_id").alias("ordinal"), F.lit("").alias("source_uri"), (F.col("event_type") == "error").alias("obsolete"), F.lit(None).cast("string").alias("namespace"), F.col("event_type").alias("content"))
    e.repartition("member_type").sortWithinPartitions("last_modified_at").write.partitionBy("member_type").parquet(root)
    lo, hi = e.agg(F.min("last_modified_at"), F.max("last_modified_at")).first()
    return e, lo, hi


def feed(spark: SparkSession, root: str, types: list[str], since: int, until: int, day: int = 86_400_000) -> DataFrame:
    spark.dataSource.register(Changes)
    options = {"types": ",".join(types), "fetch": "metaweave.sources.changes:folder_changes", "latest": "metaweave.sources.changes:folder_latest", "arg.path": root, "since": since, "until": until, "slice_ms": day}
    return spark.readStream.format("metaweave_changes").options(**options).load()


def kinds(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r.event_type for r in td.read(spark, sf_dir, "events").select("event_type").distinct().collect()]  # the kinds there are


@query("SELECT event_id AS ordinal, event_type AS member_type, CAST(user_id AS VARCHAR) AS member_name, epoch_us(ts) // 1000 AS at FROM events")
def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by the partitioned feed, in three runs on one checkpoint: each starts where the last ended."""
    root = folder(spark)
    _, lo, hi = changes(spark, sf_dir, f"{root}/in")
    types = kinds(spark, sf_dir)
    for until in (lo + (hi - lo) // 3, lo + (hi - lo) // 2, hi):
        stream = feed(spark, f"{root}/in", types, lo - 1, until)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("ordinal", "member_type", "member_name", F.col("last_modified_at").alias("at"))


def as_facts(d: DataFrame, name: Column) -> DataFrame:
    return d.select(F.lit("org1").alias("org_id"), name.alias("qname"), F.lit("User").alias("label"), F.lit("{}").alias("attributes"), F.sha2("content", 256).alias("source_hash"), F.timestamp_millis("last_modified_at").alias("event_time"), F.col("last_modified_at").alias("at"), "ordinal", "obsolete")


@query("""WITH e AS (SELECT user_id, event_id AS o, epoch_us(ts) // 1000 AS t, event_type AS h, event_type = 'error' AS gone FROM events),
    d AS (SELECT *, max(CASE WHEN gone THEN o END) OVER (PARTITION BY user_id) AS dead FROM e),
    f AS (SELECT * FROM d WHERE NOT gone AND (dead IS NULL OR o > dead)),
    g AS (SELECT user_id, arg_max(h, o) AS h FROM f GROUP BY user_id),
    x AS (SELECT f.*, g.h AS final FROM f JOIN g USING (user_id)),
    y AS (SELECT *, max(CASE WHEN h <> final THEN o END) OVER (PARTITION BY user_id) AS other FROM x)
    SELECT 'User:' || user_id AS qname, sha256(any_value(final)) AS source_hash, arg_min(t, o) AS first_seen_at, arg_max(t, o) AS last_seen_at, arg_min(t, o) FILTER (WHERE other IS NULL OR o > other) AS last_modified_at FROM y GROUP BY user_id""")
def stream_state_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last seen of all users by state over the feed, whose types come in no order, with every change twice: as merges one by one would leave it."""
    root = folder(spark)
    _, lo, hi = changes(spark, sf_dir, f"{root}/in")
    store, types = GraphStore(spark, f"{root}/store"), kinds(spark, sf_dir)
    for until in (lo + (hi - lo) // 2, hi):
        stream = feed(spark, f"{root}/in", types, lo - 1, until)
        state.keep(store, as_facts(stream.union(stream), F.concat(F.lit("User:"), "member_name")), f"{root}/checkpoint").awaitTermination()
    return store.read("nodes").select("qname", "source_hash", "first_seen_at", "last_seen_at", "last_modified_at")


def _embedder() -> Callable[[list[str]], list[list[float]]]:
    """A vector of a text's length; raises for a whole batch if it holds a text that ends in 97."""

    def run(texts: list[str]) -> list[list[float]]:
        if any(t.endswith("97") for t in texts):
            raise ValueError("a text can't be embedded")
        return [[float(len(t)), 1.0] for t in texts]

    return run


@query("""WITH t AS (SELECT o_orderkey AS k, 'Order: ' || o_orderkey AS text FROM orders),
    l AS (SELECT k, CASE WHEN text LIKE '%97' AND k % 2 = 1 AND k % 3 = 0 THEN text || ' mended' ELSE text END AS text FROM t)
    SELECT k, CAST(CASE WHEN text LIKE '%97' THEN NULL ELSE length(text) END AS INTEGER) AS length, CAST(CASE WHEN text LIKE '%97' THEN 3 END AS INTEGER) AS attempts FROM l""")
def embedding_side_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all orders as a stream, some of which fail their batch: these fail alone, are tried three times, and some are mended by a later change."""
    root = folder(spark)
    d = td.read(spark, sf_dir, "orders").select(F.lit("org1").alias("org_id"), F.col("o_orderkey").cast("string").alias("qname"), F.concat(F.lit("Order: "), F.col("o_orderkey").cast("string")).alias("text"), F.lit(1).cast("long").alias("ordinal"))
    d.write.parquet(f"{root}/in/first")
    store = GraphStore(spark, f"{root}/store")
    read = lambda part: spark.readStream.schema(d.schema).parquet(f"{root}/in/{part}")
    embedding.embed_stream(store, read("first"), f"{root}/checkpoint", _embedder).awaitTermination()
    mended = d.filter(F.col("text").endswith("97") & (F.col("qname").cast("long") % 3 == 0)).withColumns({"text": F.concat("text", F.lit(" mended")), "ordinal": F.lit(2).cast("long")})
    mended.write.parquet(f"{root}/in/second")
    embedding.embed_stream(store, read("second"), f"{root}/checkpoint-2", _embedder).awaitTermination()
    embedding.drain(store, _embedder, 10)
    vectors = store.read(embedding.VECTORS).select("qname", F.get("embedding", F.lit(0)).cast("int").alias("length"))
    failed = store.read(embedding.FAILURES).select("qname", F.col("attempts").cast("int").alias("attempts"))
    return vectors.join(failed, "qname", "full_outer").select(F.col("qname").cast("long").alias("k"), "length", "attempts")


def flaky(kind: str, args: dict) -> Iterator[tuple]:
    """Members of a folder in order; at the first large one some kinds fail for good, and some on the first attempt only."""
    for row in sorted(folder_changes(kind, -1, 2**62, args), key=lambda r: r[3]):
        if row[7] == "50" and kind.endswith("1") and args["attempt"] == "0":
            raise ConnectionError("connect ETIMEDOUT")
        if row[7] == "50" and kind.endswith("2"):
            raise ValueError("INVALID_TYPE")
        yield row


@query("""WITH p AS (SELECT p_brand AS b, p_partkey AS k, p_size AS s FROM part), l AS (SELECT b, min(k) FILTER (WHERE s = 50 AND b LIKE '%2') AS stop FROM p GROUP BY b)
    SELECT b AS source, count(*) FILTER (WHERE stop IS NULL OR k < stop) AS rows, CASE WHEN any_value(stop) IS NOT NULL THEN 'not_found' END AS category, CAST(CASE WHEN any_value(stop) IS NOT NULL THEN 1 END AS INTEGER) AS attempts FROM p JOIN l USING (b) GROUP BY b""")
def soft_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of all brands by a source that fails for some of them: what was read before stays, what may pass is read once more."""
    root = f"{folder(spark)}/in"
    d = td.read(spark, sf_dir, "part").select(F.col("p_brand").alias("member_type"), F.col("p_partkey").cast("string").alias("member_name"), F.lit(1).cast("long").alias("last_modified_at"), F.col("p_partkey").cast("long").alias("ordinal"), F.lit("").alias("source_uri"), F.lit(False).alias("obsolete"), F.lit(None).cast("string").alias("namespace"), F.col("p_size").cast("string").alias("content"))
    d.repartition("member_type").write.partitionBy("member_type").parquet(root)
    brands = [r.member_type for r in d.select("member_type").distinct().collect()]  # the brands there are
    rows, report = failsoft.read_parts(spark, "metaweave.stream_queries:flaky", brands, {"path": root})
    n = rows.groupBy(F.col("member_type").alias("source")).agg(F.count("*").alias("rows"))
    every = d.select(F.col("member_type").alias("source")).distinct()
    return every.join(n, "source", "left").join(report.select("source", "category", "attempts"), "source", "left").select("source", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "category", "attempts")


def _lookup(kind: str, names: list[str]) -> list[str]:
    if any(int(n) % 97 == 0 for n in names):
        raise ValueError("REQUEST_LIMIT_EXCEEDED")
    return [f"{kind}:{n}" for n in names]


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 97 <> 0 THEN p_brand || ':' || p_partkey END AS content, CASE WHEN p_partkey % 97 = 0 THEN 'rate_limit' END AS category FROM part")
def names_by_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of all parts' names, asked for in batches, of which bad names fail alone."""
    names = td.read(spark, sf_dir, "part").select(F.col("p_brand").alias("member_type"), F.col("p_partkey").cast("string").alias("member_name"))
    return failsoft.read_names(names, _lookup).select(F.col("member_name").cast("long").alias("k"), "content", "category")


@query("SELECT 'orders/' || o_orderkey || '.txt' AS path, o_orderpriority AS content FROM orders")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as entries of zip archives, read by entry."""
    root = folder(spark)
    made = td.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("v")).repartition(4)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
        system.create_dir(inner, recursive=True)
        name = f"{inner}/{uuid.uuid4().hex}.zip"
        with system.open_output_stream(name) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for k, v in zip(b["k"], b["v"]):
                    z.writestr(f"orders/{k}.txt", v)
        yield pd.DataFrame({"name": [name]})

    made.mapInPandas(write, "name string").count()
    return archives.read_archives(spark, root, chunk=1 << 16).filter("error IS NULL").select("path", "content")
