"""Queries on the test tables about members that are put together out of rows: each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parse import registry
from .sources import assemble, members
from .sources import testdata as td

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@query("""WITH r AS (SELECT c_custkey, string_agg('cmp/f' || o_orderkey || '.js=' || coalesce(o_orderpriority, ''), ';' ORDER BY 'cmp/f' || o_orderkey || '.js') AS files, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT 'b' || c.c_custkey AS name, CASE WHEN c_nationkey = 3 THEN '' ELSE coalesce(files, '') END AS files, c_nationkey = 3 AS managed FROM customer c LEFT JOIN r USING (c_custkey) WHERE c_custkey <> 7""")
def component_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as components, their orders as the components' files; those of one nation belong to a package."""
    bundles = td.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _key("b", "c_custkey").alias("name"), F.when(F.col("c_nationkey") == 3, "pack").alias("namespace"), F.lit(1).alias("last_modified_at"))
    resources = td.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle_id"), F.concat(_key("cmp/f", "o_orderkey"), F.lit(".js")).alias("path"), F.col("o_orderpriority").alias("source"))
    d = assemble.component_members(bundles, resources, skip=["b7"])
    read = F.from_json("content", "bundleName string, files map<string,string>, managed boolean")
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("x.files")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return d.withColumn("x", read).select(F.col("x.bundleName").alias("name"), lines.alias("files"), F.coalesce("x.managed", F.lit(False)).alias("managed"))


@query("""WITH o AS (SELECT s_suppkey, 'S' || s_suppkey || '__c' AS name FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0),
    f AS (SELECT DISTINCT name, 'F' || l_partkey || '__c' AS field, l_partkey FROM lineitem JOIN o ON l_suppkey = s_suppkey)
    SELECT 'DEFINES_FIELD' AS rel_type, 'CustomObject:' || name AS src, 'CustomField:' || name || '.' || field AS dst FROM f
    UNION ALL SELECT 'REFERENCES_OBJECT', 'CustomField:' || name || '.' || field, 'CustomObject:P' || (l_partkey % 10) || '__c' FROM f WHERE l_partkey % 3 = 0""")
def object_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as objects (each fifth a companion, each seventh without a description), the parts they ship as their fields, parsed into edges."""
    s, k = td.read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = F.when(k % 5 == 0, F.concat(_key("S", "s_suppkey"), F.lit("__Share"))).otherwise(F.concat(_key("S", "s_suppkey"), F.lit("__c")))
    objects = members.include_objects(s.select(name.alias("name"), F.lit(True).alias("custom"), F.lit(True).alias("queryable")))
    described = s.filter(k % 7 != 0).select(F.concat(_key("S", "s_suppkey"), F.lit("__c")).alias("object"), F.col("s_name").alias("label"))
    fields = td.read(spark, sf_dir, "lineitem").select(F.concat(_key("S", "l_suppkey"), F.lit("__c")).alias("object"), F.col("l_partkey").alias("ordinal"), F.concat(_key("F", "l_partkey"), F.lit("__c")).alias("name"), (F.col("l_partkey") % 2 == 0).alias("nullable"), F.when(F.col("l_partkey") % 3 == 0, F.array(F.concat(F.lit("P"), (F.col("l_partkey") % 10).cast("string"), F.lit("__c")))).alias("reference_to"))
    made = assemble.object_members(objects, described, fields.distinct()).withColumn("org_id", F.lit("org1"))
    return registry.edges_of(registry.parse_members(made, kinds=["CustomObject"])).select("rel_type", "src", "dst")


@query("""SELECT DISTINCT 'OMNI_CALLS_DATA_TRANSFORM' AS rel_type, 'OmniProcess:P' || o_orderkey AS src, 'OmniDataTransform:D' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_linenumber % 3 <> 0
    UNION ALL SELECT DISTINCT 'OMNI_INVOKES_REMOTE', 'OmniProcess:P' || o_orderkey, 'Remote:unknown' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_linenumber % 3 = 0""")
def process_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as processes (pending ones as a type without elements), their lines as elements, each third with properties that aren't JSON; parsed into edges."""
    o, li = td.read(spark, sf_dir, "orders"), td.read(spark, sf_dir, "lineitem")
    rows = o.select(F.when(F.col("o_orderstatus") == "P", "OmniUiCard").otherwise(F.lit("OmniProcess")).alias("member_type"), F.col("o_orderkey").alias("id"), _key("P", "o_orderkey").alias("name"), F.lit(1).alias("last_modified_at"))
    broken = F.col("l_linenumber") % 3 == 0
    elements = li.select(F.col("l_orderkey").alias("process_id"), F.col("l_linenumber").alias("id"), F.when(broken, "Remote Action").otherwise(F.lit("DataRaptor Extract Action")).alias("type"), F.lit("e").alias("name"), F.concat(F.lit('{"bundle": "D'), F.col("l_partkey").cast("string"), F.when(broken, "").otherwise(F.lit('"}'))).alias("property_set"))
    made = assemble.process_members(rows, elements).withColumn("org_id", F.lit("org1"))
    return registry.edges_of(registry.parse_members(made, kinds=["OmniProcess", "OmniUiCard"])).select("rel_type", "src", "dst").distinct()


@query("""SELECT DISTINCT name, CASE WHEN name IN ('DataRaptor', 'OmniScript', 'IntegrationProcedure', 'VlocityCard') THEN 'registry' WHEN name = 'ApexClass' THEN 'query' ELSE 'list_read' END AS strategy
    FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'ApexClass' WHEN 1 THEN 'DataRaptor' WHEN 2 THEN '' ELSE p_brand END AS name FROM part
    UNION ALL SELECT unnest(['DataRaptor', 'IntegrationProcedure', 'OmniScript', 'VlocityCard'])) WHERE name <> ''""")
def type_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way the types that parts stand for are read, in an org with packs."""
    size = F.col("p_size") % 4
    return assemble.routes(td.read(spark, sf_dir, "part").select(F.when(size == 0, "ApexClass").when(size == 1, "DataRaptor").when(size == 2, "").otherwise(F.col("p_brand")).alias("name")), True)
