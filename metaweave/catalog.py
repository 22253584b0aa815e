"""The queries: operators on the graph of the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import audit, diff, filters, merge, resolve, traverse, vector
from .sources import testdata as td
from .tables import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Fixed "now" of the freshness queries: 2001-08-01.
NOW = 996_624_000_000
CORE_EDGES_SQL = td.edges_sql(td.CORE)
ALL_NODES_SQL = td.nodes_sql()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def bfs_sql(seeds: list[str], reverse: bool, depth: int, rels: str = CORE_EDGES_SQL) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    rows = " UNION ALL ".join(f"SELECT '{s}' AS seed, '{s}' AS qname, 0 AS depth" for s in seeds)
    return f"""WITH RECURSIVE e AS MATERIALIZED ({rels}),
        b(seed, qname, depth) AS ({rows} UNION SELECT b.seed, e.{b}, b.depth + 1 FROM b JOIN e ON e.{a} = b.qname WHERE b.depth < {depth}),
        reached AS (SELECT seed, qname, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY seed, qname)"""


# Traversal


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core edges, derived from the tables once for all levels of a traversal (a store has them as they are)."""
    return materialize(td.edges(spark, sf_dir, td.CORE))


@query(f"{bfs_sql(['Region:1'], True, 3)} SELECT r.qname, n.label, r.depth FROM reached r JOIN ({ALL_NODES_SQL}) n USING (qname) WHERE r.depth > 0")
def trace_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that depends on a region, three levels up."""
    r = traverse.trace(_graph(spark, sf_dir), "Region:1", reverse=True, depth=3)
    return traverse.hydrate(r.nodes, td.nodes(spark, sf_dir)).select("qname", "label", "depth")


@query(f"{bfs_sql(['Order:1'], False, 3)} SELECT r.qname, n.label, r.depth FROM reached r JOIN ({ALL_NODES_SQL}) n USING (qname) WHERE r.depth > 0")
def trace_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = traverse.trace(_graph(spark, sf_dir), "Order:1", reverse=False, depth=3)
    return traverse.hydrate(r.nodes, td.nodes(spark, sf_dir)).select("qname", "label", "depth")


@query(f"{bfs_sql(['Nation:3'], True, 2)} SELECT DISTINCT e.src, e.dst, e.rel_type FROM e JOIN reached r ON e.dst = r.qname WHERE r.depth < 2")
def trace_upstream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.trace(_graph(spark, sf_dir), "Nation:3", reverse=True, depth=2).edges


@query(f"{bfs_sql(['Region:0', 'Nation:3', 'Customer:5'], True, 2)} SELECT seed, qname, depth FROM reached WHERE depth > 0")
def trace_multi_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("Region:0",), ("Nation:3",), ("Customer:5",)], "qname string")
    return traverse.walk(_graph(spark, sf_dir), seeds, True, 2).nodes.filter("depth > 0").select("seed", "qname", "depth")


FLOW_RELS = ["PLACED_BY", "LOCATED_IN", "PART_OF"]


@query(f"{bfs_sql(['Order:7'], False, 9, td.edges_sql(FLOW_RELS))} SELECT DISTINCT e.src, e.dst, e.rel_type FROM e JOIN reached r ON e.src = r.qname")
def typed_flow_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.typed_flow(_graph(spark, sf_dir), "Order:7", FLOW_RELS).edges


BOTH_WAYS = f"SELECT rel_type, src, dst FROM ({CORE_EDGES_SQL}) UNION ALL SELECT rel_type, dst, src FROM ({CORE_EDGES_SQL})"


@query(f"{bfs_sql(['Customer:7'], False, 2, BOTH_WAYS)} SELECT qname, depth FROM reached")
def neighborhood_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.neighborhood(_graph(spark, sf_dir), "Customer:7", 2).nodes.select("qname", "depth")


@query(f"{bfs_sql(['Customer:7'], False, 2, BOTH_WAYS)} SELECT DISTINCT c.src, c.dst, c.rel_type FROM ({CORE_EDGES_SQL}) c WHERE c.src IN (SELECT qname FROM reached WHERE depth < 2) OR c.dst IN (SELECT qname FROM reached WHERE depth < 2)")
def neighborhood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.neighborhood(_graph(spark, sf_dir), "Customer:7", 2).edges


@query(f"SELECT rel_type, src, dst FROM ({CORE_EDGES_SQL}) WHERE split_part(src, ':', 1) IN ('Region', 'Nation') AND split_part(dst, ':', 1) IN ('Region', 'Nation')")
def overview_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.overview(td.nodes(spark, sf_dir), _graph(spark, sf_dir), ["Region", "Nation"])[1].select("rel_type", "src", "dst")


@query(f"SELECT DISTINCT rel_type, src, dst FROM ({CORE_EDGES_SQL}) WHERE rel_type IN ('PART_OF', 'LOCATED_IN') AND (src LIKE 'Nation:%' OR dst LIKE 'Nation:%')")
def schema_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.schema_view(td.nodes(spark, sf_dir), _graph(spark, sf_dir), ["Nation"], ["PART_OF", "LOCATED_IN"])


@query(f"SELECT DISTINCT rel_type, src FROM ({td.edges_sql(['CONTAINS', 'SUPPLIES'])}) WHERE dst = 'Part:1'")
def field_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.fan_in(td.edges(spark, sf_dir), "Part:1", ["CONTAINS", "SUPPLIES"])


# Merge, diff


@query(f"""WITH {td.SNAPSHOT_SQL} SELECT CASE WHEN b.qname IS NULL THEN 'inserted' WHEN b.source_hash = a.source_hash THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS n
    FROM after a LEFT JOIN before b USING (qname) GROUP BY 1""")
def merge_nodes_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = td.snapshot_pair(spark, sf_dir)
    return merge.counts(merge.merge_actions(before, after, ["org_id", "qname"], "source_hash"))


@query(f"""WITH {td.EDGE_SNAPSHOT_SQL} SELECT CASE WHEN b.src IS NULL THEN 'inserted' ELSE 'unchanged' END AS action, count(*) AS n
    FROM after a LEFT JOIN before b USING (rel_type, src, dst) GROUP BY 1""")
def merge_edges_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (d.withColumn("attributes", F.lit("{}")) for d in td.edge_snapshot_pair(spark, sf_dir))
    return merge.counts(merge.merge_actions(before, after, ["org_id", "rel_type", "src", "dst"], "attributes"))


@query(f"""WITH {td.SNAPSHOT_SQL} SELECT coalesce(a.qname, b.qname) AS qname, coalesce(a.source_hash, b.source_hash) AS source_hash,
    CAST(CASE WHEN b.qname IS NULL THEN 200 ELSE 100 END AS BIGINT) AS first_seen_at, CAST(CASE WHEN a.qname IS NULL THEN 100 ELSE 200 END AS BIGINT) AS last_seen_at
    FROM before b FULL JOIN after a USING (qname)""")
def merge_nodes_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = td.snapshot_pair(spark, sf_dir)
    stored = before.withColumns({"first_seen_at": F.lit(100).cast("long"), "last_seen_at": F.lit(100).cast("long")})
    return merge.merge(stored, after, ["org_id", "qname"], 200).select("qname", "source_hash", "first_seen_at", "last_seen_at")


DIFF_CASE = "CASE WHEN b.qname IS NULL THEN 'added' WHEN a.qname IS NULL THEN 'removed' WHEN a.source_hash <> b.source_hash THEN 'changed' END"


@query(f"WITH {td.SNAPSHOT_SQL} SELECT * FROM (SELECT coalesce(a.qname, b.qname) AS qname, 'Order' AS label, {DIFF_CASE} AS change FROM before b FULL JOIN after a USING (qname)) WHERE change IS NOT NULL")
def snapshot_diff_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_nodes(*td.snapshot_pair(spark, sf_dir))


@query(f"""WITH {td.EDGE_SNAPSHOT_SQL} SELECT rel_type, src, dst, 'added' AS change FROM (SELECT rel_type, src, dst FROM after EXCEPT SELECT rel_type, src, dst FROM before)
    UNION ALL SELECT rel_type, src, dst, 'removed' FROM (SELECT rel_type, src, dst FROM before EXCEPT SELECT rel_type, src, dst FROM after)""")
def snapshot_diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_edges(*td.edge_snapshot_pair(spark, sf_dir))


ORGS_CASE = "CASE WHEN b.qname IS NULL THEN 'only_in_a' WHEN a.qname IS NULL THEN 'only_in_b' WHEN a.source_hash <> b.source_hash THEN 'changed' END"


@query(f"WITH {td.TWO_ORGS_SQL} SELECT * FROM (SELECT coalesce(a.qname, b.qname) AS qname, {ORGS_CASE} AS side FROM a FULL JOIN b USING (qname)) WHERE side IS NOT NULL")
def cross_org_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_orgs(*td.two_orgs(spark, sf_dir)).select("qname", "side")


#: Labels that the customers of two orgs stand for in a manifest, and the types they have there (the last has none).
MANIFEST_LABELS = ["ApexClass", "SharingRule", "CustomLabel", "CustomMetadataType", "CustomMetadataRecord", "MatchingRule", "LightningComponentBundle", "ApexMethod"]


@query(f"""WITH {td.TWO_ORGS_SQL}, d AS (SELECT CAST(split_part(coalesce(a.qname, b.qname), ':', 2) AS BIGINT) AS k, {ORGS_CASE} AS side FROM a FULL JOIN b USING (qname)),
    m AS (SELECT side = 'only_in_b' AS destructive, CASE k % 8 WHEN 0 THEN 'ApexClass' WHEN 1 THEN 'SharingRules' WHEN 2 THEN 'CustomLabels' WHEN 3 THEN 'CustomObject' WHEN 4 THEN 'CustomMetadata' WHEN 5 THEN 'MatchingRules' WHEN 6 THEN 'LightningComponentBundle' END AS type,
        CASE WHEN k % 8 = 1 THEN 'Obj' || (k % 5) ELSE 'Obj' || (k % 5) || '.R' || k END AS member FROM d WHERE side IS NOT NULL)
    SELECT destructive, type, string_agg(DISTINCT member, ',' ORDER BY member) AS members, count(*) AS n FROM m WHERE type IS NOT NULL GROUP BY 1, 2""")
def manifest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharing rules go by their object, labels without a type in manifests go."""
    k = F.split_part("qname", F.lit(":"), F.lit(2)).cast("long")
    d = diff.diff_orgs(*td.two_orgs(spark, sf_dir)).withColumn("k", k)
    d = d.withColumn("label", F.element_at(F.array(*map(F.lit, MANIFEST_LABELS)), (F.col("k") % 8 + 1).cast("int"))).withColumn("qname", F.concat("label", F.lit(":Obj"), (F.col("k") % 5).cast("string"), F.lit(".R"), F.col("k").cast("string")))
    return diff.manifest_members(d).select("destructive", "type", F.array_join("members", ",").alias("members"), "n")


@query(f"WITH {td.SNAPSHOT_SQL} SELECT qname FROM before WHERE qname NOT IN (SELECT qname FROM after)")
def detect_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.detect_deletions(*td.snapshot_pair(spark, sf_dir), finished_labels=["Order"]).select("qname")


@query(f"""WITH e AS (SELECT rel_type, src, split_part(dst, ':', 2)::BIGINT AS k FROM ({td.edges_sql(['CONTAINS'])}))
    SELECT DISTINCT rel_type, src, 'Part:' || (CASE WHEN k % 50 = 0 THEN k + 100000 ELSE k END) AS dst FROM e""")
def rename_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = td.read(spark, sf_dir, "part").filter("p_partkey % 50 = 0")
    name = lambda c: F.concat(F.lit("Part:"), c.cast("string"))
    renames = parts.select(name(F.col("p_partkey")).alias("old"), name(F.col("p_partkey") + 100000).alias("new"))
    return merge.rename_edges(td.edges(spark, sf_dir, ["CONTAINS"]), renames).select("rel_type", "src", "dst")


# Audits

LOOSE_SQL = f"""e AS ({CORE_EDGES_SQL}), i AS (SELECT qname FROM ({td.nodes_sql([x for x in td.NODE_TABLES if x != 'Part'])}) UNION ALL SELECT 'Part:' || p_partkey FROM part WHERE p_size <= 25),
    loose AS (SELECT * FROM e WHERE dst NOT IN (SELECT qname FROM i))"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = td.read(spark, sf_dir, "part").filter("p_size <= 25").select(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("qname"))
    return td.nodes(spark, sf_dir, [x for x in td.NODE_TABLES if x != "Part"]).select("qname").unionByName(small)


@query(f"WITH {LOOSE_SQL} SELECT rel_type, src, dst FROM loose")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dangling(td.edges(spark, sf_dir, td.CORE), _index(spark, sf_dir)).select("rel_type", "src", "dst")


@query(f"WITH {LOOSE_SQL} SELECT rel_type, count(*) AS n FROM loose GROUP BY 1")
def dangling_by_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dangling_by(td.edges(spark, sf_dir, td.CORE), _index(spark, sf_dir), "rel_type")


@query(f"WITH {LOOSE_SQL} SELECT split_part(dst, ':', 1) AS prefix, count(*) AS n FROM loose GROUP BY 1")
def dangling_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dangling_by(td.edges(spark, sf_dir, td.CORE), _index(spark, sf_dir), "prefix")


FRESH_SQL = f"""age AS (SELECT qname, label, last_modified_at AS m, ({NOW}::DOUBLE - last_modified_at) / 86400000 AS d FROM ({ALL_NODES_SQL})),
    fresh AS (SELECT qname, label, CAST(CASE WHEN m <= 0 THEN 0.5 WHEN d <= 7 THEN 1.0 WHEN d <= 30 THEN 0.8 WHEN d <= 90 THEN 0.6 WHEN d <= 180 THEN 0.4 WHEN d <= 365 THEN 0.2 ELSE 0.05 END AS DOUBLE) AS score FROM age),
    b AS (SELECT *, CASE WHEN score >= 0.8 THEN 'hot' WHEN score >= 0.5 THEN 'current' WHEN score >= 0.2 THEN 'stale' ELSE 'dead' END AS bucket FROM fresh)"""


@query(f"WITH {FRESH_SQL} SELECT bucket, count(*) AS n FROM b GROUP BY 1")
def freshness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = audit.freshness(F.col("last_modified_at"), NOW)
    return td.nodes(spark, sf_dir).groupBy(audit.bucket(score).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {FRESH_SQL} SELECT bucket, qname, score FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score, qname) AS p FROM b) WHERE p <= 20")
def freshness_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.freshness_report(td.nodes(spark, sf_dir), NOW).select("bucket", "qname", "score")


IN_SQL = f"i AS (SELECT dst AS qname, count(*) AS n FROM ({CORE_EDGES_SQL}) GROUP BY 1)"


@query(f"""WITH {FRESH_SQL}, {IN_SQL}, s AS (SELECT qname, coalesce(n, 0) AS in_degree, score AS f, 0.6::DOUBLE * score + 0.4::DOUBLE * least(1.0::DOUBLE, coalesce(n, 0) / 5.0::DOUBLE) AS score FROM fresh LEFT JOIN i USING (qname))
    SELECT qname, in_degree, round(score, 6) AS score, CASE WHEN score < 0.2 THEN 'high' WHEN score < 0.45 THEN 'medium' ELSE 'low' END AS confidence,
    concat_ws(',', CASE WHEN in_degree = 0 THEN 'no_incoming_edges' END, CASE WHEN f < 0.4 THEN 'stale_freshness' END) AS reasons FROM s WHERE NOT (in_degree > 0 AND f >= 0.5)""")
def dead_code_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = audit.dead_code_scores(td.nodes(spark, sf_dir), td.edges(spark, sf_dir, td.CORE), NOW)
    return d.select("qname", "in_degree", F.round("score", 6).alias("score"), "confidence", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {FRESH_SQL}, {IN_SQL} SELECT qname, score FROM fresh WHERE score < 0.4 AND qname NOT IN (SELECT qname FROM i)")
def dead_code_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dead_code(td.nodes(spark, sf_dir), td.edges(spark, sf_dir, td.CORE), NOW).select("qname", "score")


#: Orders of status F test the parts that they contain.
TESTS_SQL = "t AS (SELECT DISTINCT 'Order:' || l_orderkey AS src, 'Part:' || l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = td.read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    d = td.read(spark, sf_dir, "lineitem").join(done, "l_orderkey", "left_semi").select("l_orderkey", "l_partkey").distinct()
    return d.select(F.lit("IS_TEST_FOR").alias("rel_type"), F.concat(F.lit("Order:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("Part:"), F.col("l_partkey").cast("string")).alias("dst"))


@query(f"WITH {TESTS_SQL} SELECT 'Part:' || p_partkey AS qname, coalesce(n, 0) AS test_count FROM part LEFT JOIN (SELECT dst, count(*) AS n FROM t GROUP BY 1) ON dst = 'Part:' || p_partkey")
def test_coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.test_counts(td.nodes(spark, sf_dir, ["Part"]), _tests(spark, sf_dir))


@query(f"{bfs_sql(['Supplier:3'], False, 1, td.edges_sql(['SUPPLIES']))}, {TESTS_SQL} SELECT qname FROM reached WHERE depth > 0 AND qname NOT IN (SELECT dst FROM t)")
def test_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a changed supplier touches and no test covers."""
    near = traverse.trace(td.edges(spark, sf_dir, ["SUPPLIES"]), "Supplier:3", False, 1).nodes
    return audit.covered(near.select("qname"), _tests(spark, sf_dir)).filter("not covered").select("qname")


#: Which suppliers are permission sets, by an attribute; the others are profiles.
GRANTERS_SQL = "g AS (SELECT DISTINCT l_partkey, 'Supplier:' || l_suppkey AS who FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 5000)"


def _grants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = td.edges(spark, sf_dir, ["SUPPLIES"]).withColumn("rel_type", F.lit("GRANTS_FIELD_ACCESS"))
    who = td.read(spark, sf_dir, "supplier").select(F.concat(F.lit("Supplier:"), F.col("s_suppkey").cast("string")).alias("qname"), F.when(F.col("s_acctbal") < 5000, "PermissionSet").otherwise("Profile").alias("label"))
    return e, who


@query(f"WITH {GRANTERS_SQL} SELECT 'Part:' || l_partkey AS qname, string_agg(who, ',' ORDER BY who) AS granted_by FROM g GROUP BY 1")
def security_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.granted_by(*_grants(spark, sf_dir)).select("qname", F.array_join("granted_by", ",").alias("granted_by"))


@query(f"WITH {GRANTERS_SQL} SELECT 'Part:' || p_partkey AS qname FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM g)")
def fls_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.access_gaps(td.nodes(spark, sf_dir, ["Part"]), *_grants(spark, sf_dir))


#: Customers whose orders changed between the snapshots are what depends on the change; finished orders test their customers' nations.
@query(f"""WITH {td.SNAPSHOT_SQL}, c AS (SELECT coalesce(b.qname, a.qname) AS qname FROM before b FULL JOIN after a USING (qname) WHERE b.qname IS NOT NULL AND (a.qname IS NULL OR a.source_hash <> b.source_hash)),
    p AS (SELECT * FROM ({td.edges_sql(["PLACED_BY"])})), t AS (SELECT DISTINCT 'Order:' || o_orderkey AS src, 'Customer:' || o_custkey AS dst FROM orders WHERE o_orderstatus = 'F')
    SELECT DISTINCT p.dst AS qname, CASE WHEN p.dst IN (SELECT dst FROM t) THEN 'covered' ELSE 'at_risk' END AS risk FROM p JOIN c ON p.src = c.qname""")
def what_broke_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = diff.diff_nodes(*td.snapshot_pair(spark, sf_dir)).filter("change <> 'added'").select("qname")
    reached = traverse.reach(td.edges(spark, sf_dir, ["PLACED_BY"]), changed, False, 1).nodes
    o = td.read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    tests = o.select(F.lit("IS_TEST_FOR").alias("rel_type"), F.concat(F.lit("Order:"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("Customer:"), F.col("o_custkey").cast("string")).alias("dst"))
    return audit.risk_buckets(changed, reached, tests)


_PLACE = "CAST(%d AS INTEGER) AS place, %s AS type, CAST(%d AS INTEGER) AS part, %s AS member, %s AS line"


@query(f"""WITH {td.TWO_ORGS_SQL}, m AS (SELECT DISTINCT replace(coalesce(a.qname, b.qname), 'Customer:', '') AS member, CASE WHEN CAST(replace(coalesce(a.qname, b.qname), 'Customer:', '') AS INTEGER) % 2 = 0 THEN 'ApexClass' ELSE 'Flow' END AS type
        FROM a FULL JOIN b USING (qname) WHERE a.qname IS NOT NULL AND (b.qname IS NULL OR a.source_hash <> b.source_hash))
    SELECT {_PLACE % (1, "type", 1, "member || '&'", "'    <members>' || member || '&amp;</members>'")} FROM m
    UNION ALL SELECT DISTINCT {_PLACE % (1, "type", 0, "''", "'  <types>'")} FROM m
    UNION ALL SELECT DISTINCT {_PLACE % (1, "type", 2, "''", "'    <name>' || type || '</name>'")} FROM m
    UNION ALL SELECT DISTINCT {_PLACE % (1, "type", 3, "''", "'  </types>'")} FROM m
    UNION ALL SELECT {_PLACE % (0, "''", 0, "''", """'<?xml version="1.0" encoding="UTF-8"?>'""")}
    UNION ALL SELECT {_PLACE % (0, "''", 1, "''", """'<Package xmlns="http://soap.sforce.com/2006/04/metadata">'""")}
    UNION ALL SELECT {_PLACE % (2, "''", 0, "''", "'  <version>59.0</version>'")} UNION ALL SELECT {_PLACE % (2, "''", 1, "''", "'</Package>'")}""")
def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of what one org has and the other hasn't or has otherwise, as lines in order; a sign in the names that XML escapes."""
    k = F.split_part("qname", F.lit(":"), F.lit(2))
    d = diff.diff_orgs(*td.two_orgs(spark, sf_dir)).withColumn("k", k).withColumn("label", F.when(F.col("k").cast("int") % 2 == 0, "ApexClass").otherwise("Flow"))
    return diff.manifest_lines(d.withColumn("qname", F.concat("label", F.lit(":"), "k", F.lit("&"))), False)


@query("""WITH s AS (SELECT c_custkey, 'Customer:' || c_custkey AS c, 'Nation:' || c_nationkey AS n, c_mktsegment = 'BUILDING' AS b FROM customer)
    SELECT c AS qname, n AS seed, 1 AS depth, 'LOCATED_IN' AS rel_type FROM s
    UNION ALL SELECT 'Order:' || o_orderkey, CASE WHEN b THEN c ELSE n END, CASE WHEN b THEN 1 ELSE 2 END, 'PLACED_BY' FROM orders JOIN s ON o_custkey = c_custkey""")
def nearest_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on the nations and on the customers of one segment, each with the nearest of them; such customers depend on their nations, too."""
    c = td.read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("Customer:"), F.col("c_custkey").cast("string")).alias("qname"))
    seeds = td.nodes(spark, sf_dir, ["Nation"]).select("qname").unionByName(c)
    return traverse.reach(td.edges(spark, sf_dir, ["PART_OF", "LOCATED_IN", "PLACED_BY"]), seeds, True, 2).nodes.select("qname", "seed", "depth", "rel_type")


@query(f"SELECT qname, count(*) AS degree FROM (SELECT src AS qname FROM ({CORE_EDGES_SQL}) UNION ALL SELECT dst FROM ({CORE_EDGES_SQL})) GROUP BY 1 ORDER BY degree DESC, qname LIMIT 40")
def degree_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.degrees(td.edges(spark, sf_dir, td.CORE), 40)


@query(f"""WITH {FRESH_SQL}, {IN_SQL}, {LOOSE_SQL.replace('i AS (SELECT qname', 'known AS (SELECT qname').replace('FROM i)', 'FROM known)')}, {GRANTERS_SQL}
    SELECT 'dead-code.unreferenced' AS rule_id, 'note' AS level, qname, qname || ': no incoming references' AS message FROM fresh WHERE score < 0.4 AND qname NOT IN (SELECT qname FROM i)
    UNION ALL SELECT 'graph.dangling-edge', 'note', src, src || ' --' || rel_type || '--> ' || dst || ': dst node missing' FROM loose
    UNION ALL SELECT 'security.fls-gap', 'warning', 'Part:' || p_partkey, 'Part:' || p_partkey || ': no FLS grant on any profile/permission set' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM g)
    UNION ALL SELECT 'security.sharing-full-access', 'warning', 'SharingRule:' || n_nationkey, 'SharingRule:' || n_nationkey || ': granted full access via sharing rule or OWD' FROM nation WHERE n_regionkey IN (0, 1, 2)""")
def findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = td.edges(spark, sf_dir, td.CORE)
    found = audit.collect_findings(dead=audit.dead_code(td.nodes(spark, sf_dir), e, NOW), gaps=fls_gaps(spark, sf_dir), sharing=audit.open_sharing(_sharing(spark, sf_dir)), loose=audit.dangling(e, _index(spark, sf_dir)))
    return found.select("rule_id", "level", "qname", "message")


def _sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sharing rule for each nation, whose access its region says: in three of five ways it is full."""
    access = F.element_at(F.array(*[F.lit(x) for x in ('{"accessLevel":"Edit"}', '{"accessLevel":"All"}', '{"access":"Edit","accessLevel":"Read"}', '{"accessLevel":"Read","access":"All"}', '{"accessLevel":"edit"}')]), F.col("n_regionkey") + 1)
    return td.read(spark, sf_dir, "nation").select(F.lit("org1").alias("org_id"), F.concat(F.lit("SharingRule:"), F.col("n_nationkey").cast("string")).alias("qname"), F.lit("SharingRule").alias("label"), access.alias("attributes"))


@query("""SELECT 'SharingRule:' || n_nationkey AS qname, 'sharing.full_access' AS rule_id, 'high' AS severity, CASE n_regionkey WHEN 0 THEN '{"accessLevel":"Edit"}' WHEN 1 THEN '{"accessLevel":"All"}' ELSE '{"accessLevel":"Read"}' END AS evidence FROM nation WHERE n_regionkey < 3""")
def sharing_full_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.open_sharing(_sharing(spark, sf_dir)).select("qname", "rule_id", "severity", "evidence")


# Vectors

DISTANCE_SQL = "SELECT vec_id, label, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS d FROM embeddings"


def _vector(spark: SparkSession, sf_dir: str, i: int) -> tuple[DataFrame, list[float]]:
    d = td.read(spark, sf_dir, "embeddings")
    return d, list(d.filter(F.col("vec_id") == i).first()["embedding"])


@query(f"SELECT vec_id, round(d, 6) AS distance FROM ({DISTANCE_SQL}) ORDER BY d, vec_id LIMIT 10")
def knn_l2_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn(*_vector(spark, sf_dir, 7), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS distance FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), vec_id LIMIT 10")
def knn_cosine_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn(*_vector(spark, sf_dir, 7), 10, metric="cosine").select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"SELECT vec_id, round(d, 6) AS distance FROM ({DISTANCE_SQL}) WHERE label = 1 ORDER BY d, vec_id LIMIT 10")
def knn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn(*_vector(spark, sf_dir, 7), 10, where=F.col("label") == 1).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT * FROM ({DISTANCE_SQL}) ORDER BY d, vec_id LIMIT 10) WHERE label = 1")
def knn_label_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn(*_vector(spark, sf_dir, 7), 10, where=F.col("label") == 1, prefilter=False).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(d, 6) AS distance, round(1 - d / 2, 6) AS similarity FROM ({DISTANCE_SQL}) WHERE vec_id <> 7 ORDER BY d, vec_id LIMIT 5")
def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.similar(td.read(spark, sf_dir, "embeddings"), 7, 5).select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


# Names


@query(f"SELECT qname FROM ({ALL_NODES_SQL}) WHERE regexp_full_match(qname, '(Order|Part):1[0-4].*') ORDER BY qname LIMIT 500")
def glob_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.find_by_glob(td.nodes(spark, sf_dir), "{Order,Part}:1[0-4]*")[0].select("qname")


@query(f"SELECT rel_type, src, dst FROM ({CORE_EDGES_SQL}) WHERE dst ILIKE 'part:12%'")
def like_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.edges_like(td.edges(spark, sf_dir, td.CORE), "part:12%").select("rel_type", "src", "dst")


@query(f"SELECT qname FROM ({ALL_NODES_SQL}) WHERE contains(lower(qname), 'er:11') ORDER BY qname LIMIT 100")
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search(td.nodes(spark, sf_dir), "eR:11").select("qname")


@query(f"SELECT label, count(*) AS n FROM ({ALL_NODES_SQL}) GROUP BY 1")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.nodes(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


# Resolvers, on names made of parts and sizes

METHODS_SQL = "m AS (SELECT DISTINCT 'ApexMethod:C' || (p_partkey % 40) || '.m' || (p_size % 7) || '(' || (p_partkey % 3) || ')' AS qname FROM part)"
CALLS_SQL = """c AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'IMPORTS_APEX' ELSE 'USES_WIRE' END AS rel_type, CASE WHEN p_partkey % 3 = 0 THEN 'ApexMethod:K' || (p_partkey % 90) || '.run(0)' ELSE 'LWC:tile' || (p_partkey % 90) END AS src,
    CASE WHEN p_partkey % 11 = 0 THEN 'ApexMethod:C' || (p_partkey % 45) || '(?)' WHEN p_partkey % 13 = 0 THEN 'ApexClass:C' || (p_partkey % 45) ELSE 'ApexMethod:C' || (p_partkey % 45) || '.m' || (p_size % 8) || '(?)' END AS dst, p_partkey % 5 AS line FROM part),
    k AS (SELECT rel_type, src, dst, min(line) AS line FROM c GROUP BY ALL)"""


def _methods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Methods with overloads, and edges of three relations: to methods of unknown arity, to a name that isn't a method's, to classes."""
    p = td.read(spark, sf_dir, "part")
    t = lambda e: F.expr(f"cast({e} as string)")
    methods = p.select(F.concat(F.lit("ApexMethod:C"), t("p_partkey % 40"), F.lit(".m"), t("p_size % 7"), F.lit("("), t("p_partkey % 3"), F.lit(")")).alias("qname")).distinct()
    k, n = F.col("p_partkey") % 3, t("p_partkey % 45")
    rel = F.when(k == 0, "CALLS").when(k == 1, "IMPORTS_APEX").otherwise("USES_WIRE")
    src = F.when(k == 0, F.concat(F.lit("ApexMethod:K"), t("p_partkey % 90"), F.lit(".run(0)"))).otherwise(F.concat(F.lit("LWC:tile"), t("p_partkey % 90")))
    dst = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("ApexMethod:C"), n, F.lit("(?)"))).when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("ApexClass:C"), n)).otherwise(F.concat(F.lit("ApexMethod:C"), n, F.lit(".m"), t("p_size % 8"), F.lit("(?)")))
    calls = p.groupBy(rel.alias("rel_type"), src.alias("src"), dst.alias("dst")).agg(F.min(F.col("p_partkey") % 5).alias("line"))
    return methods, calls.select("rel_type", "src", "dst", F.to_json(F.struct(F.col("line"), F.lit(True).alias("unresolvedArity"))).alias("attributes"))


ARITY_SQL = f"""{METHODS_SQL}, {CALLS_SQL}, o AS (SELECT regexp_replace(qname, '\\([0-9]+\\)$', '(?)') AS loose, qname FROM m), n AS (SELECT loose, count(*) AS n FROM o GROUP BY 1)"""


@query(f"""WITH {ARITY_SQL}
    SELECT k.rel_type, k.src, coalesce(o.qname, k.dst) AS dst, CAST(k.line AS VARCHAR) AS line, CASE WHEN n.n IS NULL THEN 'true' END AS unresolved, CASE WHEN n.n IS NOT NULL THEN 'arity-resolver' END AS resolved_by, CASE WHEN n.n > 1 THEN 'true' WHEN n.n = 1 THEN 'false' END AS ambiguous, CAST(n.n AS VARCHAR) AS overloads
    FROM k LEFT JOIN o ON o.loose = k.dst LEFT JOIN n ON n.loose = k.dst""")
def arity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods, calls = _methods(spark, sf_dir)
    j = lambda key, name: F.get_json_object("attributes", f"$.{key}").alias(name)
    return resolve.resolve_arity(calls, methods).edges.select("rel_type", "src", "dst", j("line", "line"), j("unresolvedArity", "unresolved"), j("resolvedBy", "resolved_by"), j("ambiguous", "ambiguous"), j("overloadCount", "overloads"))


@query(f"""WITH {ARITY_SQL}, j AS (SELECT coalesce(n, 0) AS n FROM k LEFT JOIN n ON loose = dst WHERE dst LIKE 'ApexMethod:%(?)')
    SELECT count(*) AS scanned, count(*) FILTER (WHERE n > 0) AS resolved, count(*) FILTER (WHERE n > 1) AS ambiguous, count(*) FILTER (WHERE n = 0) AS missing, CAST(sum(n) AS BIGINT) AS emitted FROM j""")
def arity_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods, calls = _methods(spark, sf_dir)
    return resolve.resolve_arity(calls, methods).counters


INVOCABLE_SQL = """m AS (SELECT 'C' || (p_partkey % 400) AS c, 'ApexMethod:C' || (p_partkey % 400) || '.m' || p_partkey || '(1)' AS q FROM part WHERE p_size % 10 = 0),
    f AS (SELECT DISTINCT 'Flow:F' || p_partkey AS src, 'C' || (p_partkey % 450) AS c FROM part WHERE p_size < 10)"""


@query(f"WITH {INVOCABLE_SQL}, n AS (SELECT c, count(*) AS n FROM m GROUP BY 1) SELECT src, q AS dst, 'FLOW_INVOKES_APEX_METHOD' AS rel_type, n > 1 AS ambiguous FROM f JOIN m USING (c) JOIN n USING (c)")
def flow_invocable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invocable method of the class a flow names, marked where there are several."""
    return _invocable(spark, sf_dir).edges.select("src", "dst", "rel_type", F.get_json_object("attributes", "$.ambiguous").cast("boolean").alias("ambiguous"))


@query(f"WITH {INVOCABLE_SQL}, n AS (SELECT c, count(*) AS n FROM m GROUP BY 1) SELECT count(*) AS scanned, count(n) AS resolved, count(*) FILTER (WHERE n > 1) AS ambiguous, count(*) FILTER (WHERE n IS NULL) AS missing FROM f LEFT JOIN n USING (c)")
def flow_invocable_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _invocable(spark, sf_dir).counters


def _invocable(spark: SparkSession, sf_dir: str) -> resolve.Resolved:
    p = td.read(spark, sf_dir, "part")
    methods = p.selectExpr("concat('ApexMethod:C', p_partkey % 400, '.m', p_partkey, '(1)') AS qname", "if(p_size % 10 = 0, '{\"isInvocable\":true}', '{}') AS attributes")
    flows = p.filter("p_size < 10").selectExpr("'FLOW_INVOKES_APEX' AS rel_type", "concat('Flow:F', p_partkey) AS src", "concat('ApexClass:C', p_partkey % 450) AS dst", "'{\"actionName\":\"x\"}' AS attributes").distinct()
    return resolve.resolve_invocable(flows, methods)


#: Names of one org: prefixes of a flavour go, and the org's own namespace, no other one; so a third of the older ones, another package's, have no partner.
FLAVOR_SQL = """a AS (SELECT 'DataRaptor:' || CASE c_custkey % 3 WHEN 0 THEN 'own__' WHEN 1 THEN '' ELSE 'other__' END || 'DR_N' || c_custkey AS x, CASE WHEN c_custkey % 3 = 2 THEN 'other__dr_n' ELSE 'n' END || c_custkey AS k FROM customer),
    b AS (SELECT 'OmniDataTransform:OMNI_n' || s_suppkey AS y, 'n' || s_suppkey AS k FROM supplier)"""


def _flavors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = td.read(spark, sf_dir, "customer").selectExpr("'DataRaptor' AS label", "concat('DataRaptor:', element_at(array('own__', '', 'other__'), cast(c_custkey % 3 + 1 as int)), 'DR_N', c_custkey) AS qname")
    b = td.read(spark, sf_dir, "supplier").selectExpr("'OmniDataTransform' AS label", "concat('OmniDataTransform:OMNI_n', s_suppkey) AS qname")
    return a.unionByName(b)


@query(f"WITH {FLAVOR_SQL} SELECT x AS src, y AS dst, 'CANONICAL_OF' AS rel_type, 'DataRaptor<>OmniDataTransform' AS pair FROM a JOIN b USING (k) UNION ALL SELECT y, x, 'CANONICAL_OF', 'OmniDataTransform<>DataRaptor' FROM a JOIN b USING (k)")
def cross_flavor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.link_flavors(_flavors(spark, sf_dir), namespace="own")


@query(f"""WITH {FLAVOR_SQL}, q AS (SELECT x AS qname FROM a JOIN b USING (k) UNION ALL SELECT y FROM a JOIN b USING (k))
    SELECT qname, CASE WHEN qname LIKE '%7' THEN 'DataRaptor,Old,OmniDataTransform' ELSE 'DataRaptor,OmniDataTransform' END AS flavors, 'h+canonical:' || flavors AS source_hash, 'v' AS other FROM q""")
def flavors_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both labels are added to the flavours a node has, and its hash tells."""
    d = _flavors(spark, sf_dir)
    attributes = F.when(F.col("qname").endswith("7"), '{"flavors":["Old"],"o":"v"}').otherwise('{"o":"v"}')
    n = resolve.unite_flavors(d.withColumns({"attributes": attributes, "source_hash": F.lit("h")}), resolve.link_flavors(d, namespace="own"))
    return n.select("qname", F.array_join(F.from_json(F.get_json_object("attributes", "$.flavors"), "array<string>"), ",").alias("flavors"), "source_hash", F.get_json_object("attributes", "$.o").alias("other"))


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, and what their nodes call: the same, another number of the same, the same under another relation, or nothing."""
    pairs = resolve.link_flavors(_flavors(spark, sf_dir), namespace="own").select("src", "dst", "rel_type")
    i = F.regexp_extract(F.col("y"), "([0-9]+)$", 1).cast("long")
    own = pairs.filter("src like 'DataRaptor%'").select(F.col("src").alias("x"), F.col("dst").alias("y")).withColumn("i", i % 4).filter("i < 3")
    one = own.selectExpr("x AS src", "'DataRaptor:t' AS dst", "'CALLS_DR' AS rel_type").unionByName(own.selectExpr("x AS src", "'ApexClass:A' AS dst", "'CALLS' AS rel_type"))
    two = own.selectExpr("y AS src", "explode(if(i = 1, array('OmniDataTransform:t', 'omnidatatransform:u'), array('OmniDataTransform:t'))) AS dst", "if(i = 2, 'CALLS_DATA_TRANSFORM', 'CALLS_DR') AS rel_type").unionByName(own.selectExpr("y AS src", "'ApexClass:B' AS dst", "'CALLS' AS rel_type"))
    return pairs.unionByName(one).unionByName(two)


@query(f"""WITH {FLAVOR_SQL}, p AS (SELECT x, y, CAST(regexp_extract(y, '([0-9]+)$', 1) AS BIGINT) % 4 AS i FROM a JOIN b USING (k))
    SELECT x, y, CASE i WHEN 0 THEN 'matched' WHEN 3 THEN 'empty' ELSE 'diverged' END AS status,
        CASE i WHEN 1 THEN 'CALLS_DR|dr_or_odt: 1 vs 2' WHEN 2 THEN 'CALLS_DATA_TRANSFORM|dr_or_odt: 0 vs 1,CALLS_DR|dr_or_odt: 1 vs 0' ELSE '' END AS points FROM p""")
def overlap_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations count by their own names, targets by their flavours' common token or their label."""
    return resolve.compare_flavors(_overlap(spark, sf_dir)).select("x", "y", "status", F.array_join("points", ",").alias("points"))


@query(f"""WITH {FLAVOR_SQL}, p AS (SELECT x, y, CAST(regexp_extract(y, '([0-9]+)$', 1) AS BIGINT) % 4 AS i FROM a JOIN b USING (k))
    SELECT x AS src, y AS dst, i IN (0, 3) AS matches FROM p UNION ALL SELECT y, x, i IN (0, 3) FROM p""")
def overlap_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the comparison writes into the edges of both directions."""
    e = _overlap(spark, sf_dir).withColumn("attributes", F.lit('{"pair":"p"}'))
    d = resolve.annotate_flavors(e, resolve.compare_flavors(e), 5)
    return d.filter(F.get_json_object("attributes", "$.pair") == "p").select("src", "dst", F.get_json_object("attributes", "$.signaturesMatch").cast("boolean").alias("matches"))


#: Reserved words are no references, even where a node is named so (Part:undefined, Part:value); names that only look general are (Part:active).
@query("""WITH n AS (SELECT 'Customer:Cust' || c_custkey AS qname, 'Supp' || (c_custkey % 300) AS r, 'ref' AS via FROM customer UNION ALL SELECT 'Supplier:Supp' || s_suppkey, 'SUPP' || (s_suppkey + 1), 'next' FROM supplier
        UNION ALL SELECT 'Supplier:Supp' || s_suppkey, 'active', 'w' FROM supplier),
    names AS (SELECT qname, split_part(qname, ':', 2) AS name FROM n UNION SELECT * FROM (VALUES ('Part:undefined', 'undefined'), ('Part:value', 'value'), ('Part:active', 'active'), ('Order:active', 'active')))
    , f AS (SELECT n.qname AS src, m.qname AS dst, via, r FROM n JOIN names m ON m.name = n.r UNION SELECT n.qname, m.qname, via, r FROM n JOIN names m ON lower(m.name) = lower(n.r) WHERE n.r NOT IN (SELECT name FROM names))
    SELECT DISTINCT src, dst, via AS via_key, r = 'active' AS ambiguous FROM f WHERE src <> dst""")
def reflection_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = td.read(spark, sf_dir, "customer").selectExpr("'Customer' AS label", "concat('Customer:Cust', c_custkey) AS qname", "to_json(named_struct('deep', array(named_struct('ref', array(concat('Supp', c_custkey % 300)), 'word', 'a b c', 'v', 'undefined', 'x', ' active')))) AS attributes")
    s = td.read(spark, sf_dir, "supplier").selectExpr("'Supplier' AS label", "concat('Supplier:Supp', s_suppkey) AS qname", "to_json(named_struct('next', concat('SUPP', s_suppkey + 1), 'n', '12345', 't', 'VALUE', 'w', 'active')) AS attributes")
    p = spark.createDataFrame([(q.split(":")[0], q, "{}") for q in ("Part:undefined", "Part:value", "Part:active", "Order:active")], "label string, qname string, attributes string")
    return resolve.infer_references(c.unionByName(s).unionByName(p)).edges.select("src", "dst", "via_key", "ambiguous")


# Texts


@query("SELECT page_id, url AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS url FROM pages)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.read(spark, sf_dir, "pages").select("page_id", F.explode(scalar.all_matches(F.col("html"), 'href="([^"]*)"')).alias("href"))


#: What a DuckDB pattern makes of each kind of secret, from the rules as published, in their order.
SCRUB_SQL = [
    ("(?i)Authorization:\\s*Bearer\\s+[A-Za-z0-9._\\-+/=]+", "<bearer-token>"), ("\\bBearer\\s+[A-Za-z0-9._\\-+/=]+", "<bearer-token>"), ("\\b00D[0-9A-Za-z]{12,15}![A-Za-z0-9._\\-+/=]+", "<sf-session>"),
    ("[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}", "<email>"), ("\\b[a-zA-Z0-9-]+(?:\\.[a-zA-Z0-9-]+)*\\.(?:my\\.salesforce\\.com|lightning\\.force\\.com|visualforce\\.com|cloudforce\\.com|salesforce\\.com|force\\.com)\\b", "<sf-host>"),
    ("\\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\b", "<uuid>"), ("\\b[A-Za-z]:\\\\[^\\s\"'']*", "<path>"), ("(?:/Users|/home|/var|/tmp|/private|/opt|/etc)/[^\\s\"'':,]*", "<path>"),
    ("\\b(?:001|003|005|006|00D|00e|00G|00Q|00T|00U|01p|a00|a01|a02|a03|a04|a05|a06|a07|a08|a09|0WO|0WP)[A-Za-z0-9]{12}(?:[A-Za-z0-9]{3})?\\b", "<sf-id>"),
]


def _scrub_sql(text: str) -> str:
    for pattern, name in SCRUB_SQL:
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return text


@query(f"SELECT doc_id, sha256({_scrub_sql('text')}) AS scrubbed FROM documents")
def scrub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.read(spark, sf_dir, "documents").select("doc_id", F.sha2(scalar.scrub(F.col("text")), 256).alias("scrubbed"))


#: A text that holds a secret of each kind, by the event's number, and what is left of it.
SECRET_KINDS = [
    ("authorization: bearer abc.d-{k}=", "<bearer-token>"), ("Bearer t{k}/x bearer t{k}", "<bearer-token> bearer t{k}"), ("at 00D000000000{p}!AQ.{k}", "at <sf-session>"), ("mail u{k}@ex.co.uk now", "mail <email> now"),
    ("see a{k}.b.my.salesforce.com, x{k}.example.com", "see <sf-host>, x{k}.example.com"), ("id 0123abcd-00AA-11bb-22cc-0000{q}.", "id <uuid>."), ("C:\\Users\\u{k} and D:", "<path> and D:"), ("in /var/log/{k}.log, /srv/{k}", "in <path>, /srv/{k}"),
    ("rec 001000000000{p} 002000000000{p}", "rec <sf-id> 002000000000{p}"), ("1.2.3.4 +1 555 123 {k}", "1.2.3.4 +1 555 123 {k}"),
]


def _secret_sql(which: int) -> str:
    text = lambda t: "'" + t.replace("{k}", "' || event_id || '").replace("{p}", "' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '").replace("{q}", "' || lpad(CAST(event_id AS VARCHAR), 8, '0') || '") + "'"
    return "CASE event_id % 10 " + " ".join(f"WHEN {n} THEN {text(kind[which])}" for n, kind in enumerate(SECRET_KINDS)) + " END"


@query(f"SELECT event_id, {_secret_sql(1)} AS scrubbed FROM events")
def scrub_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a secret each, and what must be left of them."""
    text = F.expr(_secret_sql(0).replace("VARCHAR", "STRING").replace("\\", "\\\\"))
    return td.read(spark, sf_dir, "events").select("event_id", scalar.scrub(text).alias("scrubbed"))


#: Paths of a project by kind, and the qname each stands for (none for the last three).
PATHS = [
    ("force-app/main/default/classes/C{k}.cls", "ApexClass:C{k}"), ("classes/C{k}.cls-meta.xml", "ApexClass:C{k}"), ("src/triggers/T{k}.trigger", "ApexTrigger:T{k}"), ("a/lwc/tile{k}/tile.js", "LWC:tile{k}"), ("flows/F{k}.flow", "Flow:F{k}"),
    ("x/flows/F{k}.flow-meta.xml", "Flow:F{k}"), ("objects/O{k}.object", "CustomObject:O{k}"), ("objects/O{k}/O{k}.object-meta.xml", "CustomObject:O{k}"), ("objects/O{k}/fields/N.field-meta.xml", "CustomField:O{k}.N"),
    ("main\\classes\\W{k}.cls", "ApexClass:W{k}"), ("objects/O{k}/P{k}.object-meta.xml", None), ("permissionsets/P{k}.permissionset-meta.xml", None), ("README{k}.md", None),
]


def _path_sql(which: int) -> str:
    text = lambda t: "NULL" if t is None else "'" + t.replace("{k}", "' || p_partkey || '") + "'"
    return f"CASE p_partkey % {len(PATHS)} " + " ".join(f"WHEN {n} THEN {text(kind[which])}" for n, kind in enumerate(PATHS)) + " END"


@query(f"SELECT {_path_sql(1)} AS qname, CASE WHEN p_size % 3 = 0 THEN 'added' WHEN p_size % 3 = 1 THEN 'deleted' ELSE 'modified' END AS status FROM part WHERE {_path_sql(1)} IS NOT NULL")
def git_diff_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unified diff with a file for each part: added, deleted or modified."""
    p = td.read(spark, sf_dir, "part").withColumn("path", F.expr(_path_sql(0).replace("\\", "\\\\")))
    old, new = F.when(F.col("p_size") % 3 == 0, F.lit("/dev/null")).otherwise(F.concat(F.lit("a/"), "path")), F.when(F.col("p_size") % 3 == 1, F.lit("/dev/null")).otherwise(F.concat(F.lit("b/"), "path"))
    lines = F.array(F.concat(F.lit("--- "), old), F.concat(F.lit("+++ "), new), F.lit("@@ -1 +1 @@"), F.lit("-x"))
    text = p.select("p_partkey", F.posexplode(lines).alias("at", "line")).select((F.col("p_partkey") * 10 + F.col("at")).alias("n"), "line")
    return diff.parse_diff(text).select(diff.path_to_qname(F.col("path")).alias("qname"), "status").filter("qname is not null")


#: Sources by kind and the risks (kind, line) in each.
SOURCES = [
    ("void f{k}() {\n  for (A a : as) {\n    insert a{k};\n    X x = [SELECT Id FROM X];\n  }\n}", [("dml_in_loop", 3), ("soql_in_loop", 4), ("unbounded_query", 4)]),
    ("trigger T{k} on Account (before insert) {\n  doIt();\n}", [("no_bulk", -1)]),
    ("// for (;;) { insert x; }\nX x = [SELECT Id FROM X WHERE Id = :i{k}];\nwhile (true) update y;", [("dml_in_loop", 3)]),
    ("trigger U{k} on X (before insert) { for (X x : Trigger.new) { x.f = 'insert y; [select'; } }", []),
    ("trigger V{k} on X (after update) { for (X x : Trigger.old) { } }", [("no_bulk", -1)]),
    ("X x{k} = [SELECT Id\n FROM X\n LIMIT 5];\nfor (;;) { for (;;) { } }\ndelete z;", []),
]


def _source_sql(which: str) -> str:
    text = lambda t: "'" + t.replace("'", "''").replace("{k}", "' || p_partkey || '").replace("\n", "' || chr(10) || '") + "'"
    return f"CASE p_partkey % {len(SOURCES)} " + " ".join(f"WHEN {n} THEN {text(t)}" for n, (t, _) in enumerate(SOURCES)) + " END"


@query("SELECT 'S' || p_partkey AS qname, r.risk_type, r.line FROM part JOIN (VALUES " + ", ".join(f"({n}, '{kind}', {line})" for n, (_, found) in enumerate(SOURCES) for kind, line in found) + f") AS r(n, risk_type, line) ON p_partkey % {len(SOURCES)} = r.n")
def governor_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each part; its kind says what runs into limits."""
    d = td.read(spark, sf_dir, "part").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("qname"), F.expr(_source_sql("spark").replace("''", "\\'")).alias("text"))
    return audit.governor_risks(d).select("qname", "risk_type", F.col("line").cast("int").alias("line"))


@query("""SELECT o_orderkey AS k, split_part(o_orderpriority, '-', 1) AS first_part, lower(o_orderpriority) AS low, regexp_extract(o_orderpriority, '([A-Z]+)$', 1) AS last_word,
    CASE WHEN starts_with(o_orderpriority, '1-') THEN substring(o_orderpriority, 3) ELSE o_orderpriority END AS bare, o_orderpriority <> '' AS truth, sha256(o_orderpriority) AS hash FROM orders""")
def rule_function_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return td.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), scalar.split_at(p, "-", 0).alias("first_part"), F.lower(p).alias("low"), scalar.first_match(p, "([A-Z]+)$").alias("last_word"), scalar.strip_prefix(p, "1-").alias("bare"), scalar.truthy(p).alias("truth"), F.sha2(p, 256).alias("hash"))


# Store and stream


@query("""SELECT 'User:' || user_id AS qname, sha256(arg_max(event_type, event_id)) AS source_hash FROM events GROUP BY user_id""")
def stream_merge_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two micro-batches of events by a file stream and foreachBatch leave the last state of each user."""
    import uuid

    from .store import GraphStore
    from .streaming.merge import sync
    from .tables import shared_folder

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = td.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    facts = e.select(F.lit("org1").alias("org_id"), F.lit("User").alias("label"), F.concat(F.lit("User:"), F.col("user_id").cast("string")).alias("qname"), F.lit("{}").alias("attributes"), F.sha2("event_type", 256).alias("source_hash"), F.col("event_id").alias("ordinal"), F.lit(False).alias("obsolete"))
    middle = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    facts.filter(F.col("ordinal") <= middle).coalesce(1).write.parquet(f"{root}/in/a")
    facts.filter(F.col("ordinal") > middle).coalesce(1).write.parquet(f"{root}/in/b")
    store = GraphStore(spark, f"{root}/store")
    for part in ("a", "b"):
        stream = spark.readStream.schema(facts.schema).parquet(f"{root}/in/{part}")
        sync(spark, store, stream, f"{root}/checkpoint-{part}").awaitTermination()
    return store.read("nodes").select("qname", "source_hash")


@query("SELECT 'inserted' AS action, count(*) AS n, count(*) AS again FROM orders")
def store_merge_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging the same facts twice inserts them once, and leaves them unchanged then."""
    import uuid

    from .store import GraphStore
    from .tables import shared_folder

    store = GraphStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    facts = td.nodes(spark, sf_dir, ["Order"]).select("org_id", "label", "qname", F.lit("{}").alias("attributes"), "source_hash")
    one, two = store.merge_nodes(facts, 1), store.merge_nodes(facts, 2)
    return spark.createDataFrame([("inserted", one["inserted"], two["unchanged"])], "action string, n long, again long")


# Parsing


MEMBERS = [
    ("ApexClass", "Orders", "public with sharing class Orders extends Base implements Queueable {\n  public void run(Integer n) {\n    List<Item__c> i = [SELECT Id, Name__c FROM Item__c WHERE Id = :n];\n    Audit.log(n, 'x, y');\n    update i;\n  }\n}"),
    ("ApexTrigger", "OnItem", "trigger OnItem on Item__c (before insert, after update) { Orders.go(Trigger.new); }"),
    ("LightningComponentBundle", "tile", '{"files": {"tile.js": "import run from \'@salesforce/apex/Orders.run\';\\nimport NAME from \'@salesforce/schema/Item__c.Name__c\';\\nexport default class Tile { @wire(run) rows; fire() { this.dispatchEvent(new CustomEvent(\'picked\')); } }", "tile.html": "<template><c-small-card onpicked={fire} name={NAME}></c-small-card><p>{title}</p></template>"}}'),
    ("Flow", "Ship", "<Flow><apiVersion>60.0</apiVersion><start><object>Item__c</object></start><actionCalls><actionType>apex</actionType><actionName>Orders</actionName></actionCalls><recordUpdates><object>Item__c</object></recordUpdates></Flow>"),
    ("CustomObject", "Item__c", '{"apiName": "Item__c", "objectXml": "<CustomObject><fields><fullName>Name__c</fullName></fields><fields><fullName>Twice__c</fullName><formula>Item__c.Count__c * 2</formula></fields></CustomObject>"}'),
    ("PermissionSet", "Sales", "<PermissionSet><fieldPermissions><field>Item__c.Name__c</field></fieldPermissions><classAccesses><apexClass>Orders</apexClass></classAccesses></PermissionSet>"),
    ("Layout", "Item__c-Main", "<Layout><layoutSections><layoutColumns><layoutItems><field>Name__c</field></layoutItems></layoutColumns></layoutSections></Layout>"),
    ("VlocityIntegrationProcedure", "Sync", '{"elements": [{"Type": "DataRaptor Extract Action", "propertySet": {"bundle": "Load"}}, {"Type": "Remote Action", "propertySet": {"remoteClass": "Orders"}}]}'),
    ("Workflow", "Item__c", "<Workflow><rules><fullName>R</fullName></rules><fieldUpdates><field>Name__c</field></fieldUpdates></Workflow>"),
]
PARSED_EDGES = """CONTAINS_METHOD ApexClass:Orders ApexMethod:Orders.run(1)
EXTENDS ApexClass:Orders ApexClass:Base
IMPLEMENTS ApexClass:Orders ApexInterface:Queueable
EXECUTES_SOQL ApexMethod:Orders.run(1) CustomObject:Item__c
READS_FIELD ApexMethod:Orders.run(1) CustomField:Item__c.Id
READS_FIELD ApexMethod:Orders.run(1) CustomField:Item__c.Name__c
CALLS ApexMethod:Orders.run(1) ApexMethod:Audit.log(2)
EXECUTES_DML ApexMethod:Orders.run(1) DML:update
TRIGGERS_ON ApexTrigger:OnItem CustomObject:Item__c
CONTAINS_COMPONENT LWCBundle:tile LWC:tile
IMPORTS_APEX LWC:tile ApexMethod:Orders.run(?)
USES_WIRE LWC:tile ApexMethod:Orders.run(?)
READS_FIELD LWC:tile CustomField:Item__c.Name__c
DISPATCHES_EVENT LWC:tile LWCEvent:picked
EMBEDS_LWC LWC:tile LWC:smallCard
LISTENS_TO_EVENT LWC:tile LWCEvent:picked
LWC_BINDS_FIELD LWC:tile CustomField:Item__c.Name__c
LWC_BINDS_PROPERTY LWC:tile LWCProperty:title
CONTAINS Flow:Ship FlowVersion:Ship.v60
TRIGGER_FIRES_ON FlowVersion:Ship.v60 CustomObject:Item__c
FLOW_INVOKES_APEX FlowVersion:Ship.v60 ApexClass:Orders
REFERENCES_OBJECT FlowVersion:Ship.v60 CustomObject:Item__c
DEFINES_FIELD CustomObject:Item__c CustomField:Item__c.Name__c
DEFINES_FIELD CustomObject:Item__c CustomField:Item__c.Twice__c
READS_FIELD CustomField:Item__c.Twice__c CustomField:Item__c.Count__c
GRANTS_FIELD_ACCESS PermissionSet:Sales CustomField:Item__c.Name__c
GRANTS_APEX_ACCESS PermissionSet:Sales ApexClass:Orders
RENDERS_FIELD Layout:Item__c-Main CustomField:Item__c.Name__c
IP_CALLS_DR IntegrationProcedure:Sync DataRaptor:Load
IP_INVOKES_REMOTE IntegrationProcedure:Sync Remote:Orders
WORKFLOW_TRIGGERS Workflow:Item__c WorkflowRule:Item__c.R
TRIGGER_FIRES_ON WorkflowRule:Item__c.R CustomObject:Item__c
WORKFLOW_UPDATES_FIELD Workflow:Item__c CustomField:Item__c.Name__c"""


#: What each supplier's members have in place of the names above.
NAMES = ["Orders", "OnItem", "Item__c", "Ship", "Sales", "Sync", "tile"]


def _named(text, k):
    """text with the names numbered by k, so that each row has members of its own."""
    for name in NAMES:
        new = "Item{}__c" if name == "Item__c" else name + "{}"
        a, z = new.split("{}")
        text = F.regexp_replace(text, rf"(?<![A-Za-z.'-]){name}(?![A-Za-z])|(?<=['/:]){name}(?![A-Za-z_])", F.concat(F.lit(a), k, F.lit(z)))
    return text


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parse import registry

    each = spark.createDataFrame(MEMBERS, "member_type string, member_name string, content string")
    k = td.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    d = k.join(F.broadcast(each)).select("member_type", _named(F.col("member_name"), F.col("k")).alias("member_name"), _named(F.col("content"), F.col("k")).alias("content"))
    return registry.parse_members(d.select(F.lit("org1").alias("org_id"), "member_type", "member_name", F.lit("").alias("source_uri"), F.lit(None).cast("string").alias("namespace"), "content"))


def _numbered(column: str) -> str:
    for name in NAMES:
        a, z = ("Item", "__c") if name == "Item__c" else (name, "")
        column = f"regexp_replace({column}, '(^|[:.])({name})($|[.(-])', '\\1{a}' || s_suppkey || '{z}\\3')"
    return column


@query(f"SELECT DISTINCT rel_type, {_numbered('src')} AS src, {_numbered('dst')} AS dst FROM supplier, (VALUES " + ", ".join("('" + "', '".join(line.split(" ")) + "')" for line in PARSED_EDGES.split("\n")) + ") AS t(rel_type, src, dst)")
def parse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that parsers and rules make of members of nine types, for each supplier."""
    from .parse import registry

    return registry.edges_of(_parsed(spark, sf_dir)).select("rel_type", "src", "dst").distinct()


@query("SELECT label, CAST(n * c AS INTEGER) AS n FROM (VALUES ('ApexClass', 1), ('ApexMethod', 1), ('ApexTrigger', 1), ('CustomField', 2), ('CustomObject', 1), ('Flow', 1), ('FlowVersion', 1), ('IntegrationProcedure', 1), ('LWC', 1), ('LWCBundle', 1), ('Layout', 1), ('PermissionSet', 1), ('Workflow', 1), ('WorkflowRule', 1)) AS t(label, n), (SELECT count(*) AS c FROM supplier)")
def parse_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parse import registry

    return registry.nodes_of(_parsed(spark, sf_dir)).groupBy("label").agg(F.count("*").cast("int").alias("n"))


@query(f"""WITH {LOOSE_SQL} SELECT 'graph.dangling-edge' AS rule_id, 'note' AS level, count(*) AS n FROM loose HAVING count(*) > 0 UNION ALL SELECT 'security.sharing-full-access', 'warning', count(*) FROM nation WHERE n_regionkey < 3""")
def sarif_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by rule, as a SARIF document has them (but for its cap)."""
    found = audit.collect_findings(sharing=audit.open_sharing(_sharing(spark, sf_dir)), loose=audit.dangling(td.edges(spark, sf_dir, td.CORE), _index(spark, sf_dir)))
    return audit.per_rule(found).join(found.select("rule_id", "level").distinct(), "rule_id").select("rule_id", "level", "n")
