"""The driver's tables as a graph: nodes, edges and derived situations, each with its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORG = "org1"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _qname(label: str, key: str):
    return F.concat(F.lit(label + ":"), F.col(key).cast("string")).alias("qname")


#: label -> (table, key, the column that stands for its name, time)
NODE_TABLES = {
    "Region": ("region", "r_regionkey", "r_name", None),
    "Nation": ("nation", "n_nationkey", "n_name", None),
    "Customer": ("customer", "c_custkey", "c_mktsegment", None),
    "Supplier": ("supplier", "s_suppkey", "s_name", None),
    "Part": ("part", "p_partkey", "p_brand", None),
    "Order": ("orders", "o_orderkey", "o_orderstatus", "o_orderdate"),
}

#: relation -> (table, from label, from key, to label, to key, distinct)
EDGE_TABLES = {
    "PART_OF": ("nation", "Nation", "n_nationkey", "Region", "n_regionkey", False),
    "LOCATED_IN": ("customer", "Customer", "c_custkey", "Nation", "c_nationkey", False),
    "PLACED_BY": ("orders", "Order", "o_orderkey", "Customer", "o_custkey", False),
    "CONTAINS": ("lineitem", "Order", "l_orderkey", "Part", "l_partkey", True),
    "SUPPLIES": ("lineitem", "Supplier", "l_suppkey", "Part", "l_partkey", True),
}

#: The relations of the graph that traversals run on.
CORE = ["PART_OF", "LOCATED_IN", "PLACED_BY", "CONTAINS"]


def nodes(spark: SparkSession, sf_dir: str, labels: list[str] | None = None) -> DataFrame:
    """org_id, label, qname, name, source_hash, last_modified_at."""
    parts = []
    for label in labels or NODE_TABLES:
        table, key, name, time = NODE_TABLES[label]
        at = F.unix_millis(F.col(time).cast("timestamp")) if time else F.lit(0)
        d = read(spark, sf_dir, table).select(F.lit(ORG).alias("org_id"), F.lit(label).alias("label"), _qname(label, key), F.col(name).alias("name"), at.cast("long").alias("last_modified_at"))
        parts.append(d.withColumn("source_hash", F.sha2(F.concat_ws("|", "label", "qname", "name"), 256)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str, rels: list[str] | None = None) -> DataFrame:
    """org_id, rel_type, src, dst."""
    out = None
    for rel in rels or EDGE_TABLES:
        table, one, key1, two, key2, distinct = EDGE_TABLES[rel]
        d = read(spark, sf_dir, table).select(F.col(key1), F.col(key2))
        d = d.distinct() if distinct else d
        d = d.select(F.lit(ORG).alias("org_id"), F.lit(rel).alias("rel_type"), _qname(one, key1).alias("src"), _qname(two, key2).alias("dst"))
        out = d if out is None else out.unionByName(d)
    return out


def nodes_sql(labels: list[str] | None = None) -> str:
    each = []
    for label in labels or NODE_TABLES:
        table, key, name, time = NODE_TABLES[label]
        at = f"epoch_ms({time})" if time else "0"
        each.append(f"SELECT '{ORG}' AS org_id, '{label}' AS label, '{label}:' || {key} AS qname, {name} AS name, CAST({at} AS BIGINT) AS last_modified_at FROM {table}")
    return f"SELECT *, sha256(label || '|' || qname || '|' || name) AS source_hash FROM ({' UNION ALL '.join(each)})"


def edges_sql(rels: list[str] | None = None) -> str:
    each = []
    for rel in rels or EDGE_TABLES:
        table, one, key1, two, key2, distinct = EDGE_TABLES[rel]
        each.append(f"SELECT {'DISTINCT ' * distinct}'{ORG}' AS org_id, '{rel}' AS rel_type, '{one}:' || {key1} AS src, '{two}:' || {key2} AS dst FROM {table}")
    return " UNION ALL ".join(each)


def snapshot_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order nodes before and after: a tenth is added, a tenth removed, a seventh changed."""
    orders = nodes(spark, sf_dir, ["Order"]).withColumn("k", F.split_part("qname", F.lit(":"), F.lit(2)).cast("long"))
    after = orders.filter("k % 10 <> 1").withColumn("source_hash", F.when(F.col("k") % 7 == 0, F.concat("source_hash", F.lit("x"))).otherwise(F.col("source_hash")))
    return orders.filter("k % 10 <> 0").drop("k"), after.drop("k")


SNAPSHOT_SQL = f"""o AS (SELECT *, CAST(split_part(qname, ':', 2) AS BIGINT) AS k FROM ({nodes_sql(["Order"])})),
    before AS (SELECT * FROM o WHERE k % 10 <> 0),
    after AS (SELECT * REPLACE (CASE WHEN k % 7 = 0 THEN source_hash || 'x' ELSE source_hash END AS source_hash) FROM o WHERE k % 10 <> 1)"""


def edge_snapshot_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    placed = edges(spark, sf_dir, ["PLACED_BY"]).withColumn("k", F.split_part("src", F.lit(":"), F.lit(2)).cast("long"))
    return placed.filter("k % 10 <> 0").drop("k"), placed.filter("k % 10 <> 1").drop("k")


EDGE_SNAPSHOT_SQL = f"""p AS (SELECT *, CAST(split_part(src, ':', 2) AS BIGINT) AS k FROM ({edges_sql(["PLACED_BY"])})),
    before AS (SELECT * FROM p WHERE k % 10 <> 0), after AS (SELECT * FROM p WHERE k % 10 <> 1)"""


def two_orgs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers of nations 0-12 and 13-24 as two orgs, with keys that meet; a key's smallest customer stands for it."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("Customer:"), (F.col("c_custkey") % 700).cast("string")).alias("qname"), F.sha2("c_mktsegment", 256).alias("source_hash"), "c_custkey", "c_nationkey")
    sides = [c.filter(w).groupBy("qname").agg(F.min_by("source_hash", "c_custkey").alias("source_hash")).withColumn("label", F.lit("Customer")) for w in ("c_nationkey <= 12", "c_nationkey > 12")]
    return sides[0], sides[1]


TWO_ORGS_SQL = """c AS (SELECT 'Customer:' || (c_custkey % 700) AS qname, sha256(c_mktsegment) AS source_hash, c_custkey, c_nationkey FROM customer),
    a AS (SELECT qname, arg_min(source_hash, c_custkey) AS source_hash FROM c WHERE c_nationkey <= 12 GROUP BY qname),
    b AS (SELECT qname, arg_min(source_hash, c_custkey) AS source_hash FROM c WHERE c_nationkey > 12 GROUP BY qname)"""
