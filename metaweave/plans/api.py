"""What a browser asks for, as plain values: bounds are clamped, and hold before anything is collected."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ..operators import filters, traverse
from ..store import GraphStore

SEARCH, DEPTH, OVERVIEW, FULL, SCHEMA = 100, 4, 5000, 15_000, 5000
#: Labels of the full graph, and of the schema with the relations around it. Fixed values.
GRAPH_LABELS = ["ApexClass", "ApexInterface", "ApexMethod", "TestMethod", "ApexTrigger", "ApexPage", "ApexComponent", "LWC", "LWCBundle", "Flow", "FlowVersion", "CustomObject", "CustomField", "PlatformEvent", "RecordType", "ValidationRule", "PermissionSet", "Profile", "DataRaptor", "IntegrationProcedure", "OmniScript", "OmniProcess"]
SCHEMA_LABELS = ["CustomObject", "CustomField"]
SCHEMA_RELS = ["DEFINES_FIELD", "REFERENCES_OBJECT", "DEPENDS_ON_FIELD", "READS_FIELD", "USES_GLOBAL_VALUE_SET", "HAS_RECORD_TYPE", "HAS_VALIDATION_RULE", "GRANTS_FIELD_ACCESS", "GRANTS_OBJECT_ACCESS", "TRIGGERS_ON"]


def _clamp(value: int | None, most: int) -> int:
    return max(1, min(most, value if value is not None else most))


def _org(store: GraphStore, org: str):
    return store.read("nodes").filter(F.col("org_id") == org), store.read("edges").filter(F.col("org_id") == org)


def _graph(nodes, edges) -> dict[str, Any]:
    return {"nodes": [r.asDict() for r in nodes.select("qname", "label").collect()], "edges": [r.asDict() for r in edges.select("src", "dst", "rel_type").distinct().collect()]}


def orgs(store: GraphStore) -> list[dict[str, Any]]:
    edges = store.read("edges").groupBy(F.col("org_id").alias("id")).agg(F.count("*").alias("edges"))
    return [r.asDict() for r in store.list_orgs().join(edges, "id", "left").na.fill(0, ["edges"]).orderBy("alias").collect()]


def relations(store: GraphStore, org: str) -> list[dict[str, Any]]:
    return [r.asDict() for r in _org(store, org)[1].groupBy("rel_type").agg(F.count("*").alias("n")).orderBy("rel_type").collect()]


def search(store: GraphStore, org: str, text: str, limit: int | None = None) -> list[dict[str, Any]]:
    return [r.asDict() for r in filters.search(_org(store, org)[0], text, _clamp(limit, SEARCH)).select("qname", "label").collect()]


def neighborhood(store: GraphStore, org: str, qname: str, depth: int = 1, rels: list[str] | None = None, cap: int = 250) -> dict[str, Any]:
    n, e = _org(store, org)
    r = traverse.neighborhood(e, qname, _clamp(depth, DEPTH), rels, cap)
    return _graph(traverse.hydrate(r.nodes, n, "Unknown"), r.edges) | {"truncated": r.truncated}


def overview(store: GraphStore, org: str, labels: list[str], limit: int | None = None) -> dict[str, Any]:
    return _graph(*traverse.overview(*_org(store, org), labels, _clamp(limit, OVERVIEW)))


def full(store: GraphStore, org: str, limit: int | None = None) -> dict[str, Any]:
    return _graph(*traverse.overview(*_org(store, org), GRAPH_LABELS, _clamp(limit, FULL)))


def schema_graph(store: GraphStore, org: str, limit: int | None = None) -> dict[str, Any]:
    n, e = _org(store, org)
    edges = traverse.schema_view(n, e, SCHEMA_LABELS, SCHEMA_RELS).orderBy("rel_type", "src", "dst").limit(_clamp(limit, SCHEMA))
    ends = edges.select(F.col("src").alias("qname")).union(edges.select(F.col("dst").alias("qname"))).distinct()
    return _graph(traverse.hydrate(ends, n, "Unknown"), edges)
