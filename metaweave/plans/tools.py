"""The query tools: each checks its input, composes operators and answers with a summary, text and data."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import render, schema
from ..operators import audit, diff, filters, traverse, vector
from ..parse import registry
from ..sources import filesystem
from ..store import GraphStore
from ..tables import materialize

#: Labels whose nodes are code that can be dead. Fixed values.
CODE = ["ApexClass", "ApexMethod", "ApexTrigger", "LWC", "Flow"]
FLOW_RELS = ["CALLS_APEX_FROM_LWC", "CALLS", "EXECUTES_SOQL", "READS_FIELD"]
READS, WRITES, GRANTS = ["READS_FIELD", "DR_READS_FIELD", "LWC_BINDS_FIELD"], ["WRITES_FIELD", "DR_WRITES_FIELD", "WORKFLOW_UPDATES_FIELD"], ["GRANTS_FIELD_ACCESS"]
#: Characters of an annotation.
ANNOTATION = 16 * 1024


class ToolError(ValueError):
    """code: INVALID_INPUT, NOT_FOUND or UNKNOWN_TOOL."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Response:
    summary: str
    markdown: str = ""
    data: dict[str, Any] = field(default_factory=dict)
    follow_up_tools: list[str] = field(default_factory=list)


TOOLS: dict[str, Callable[..., Response]] = {}


def tool(f: Callable[..., Response]) -> Callable[..., Response]:
    TOOLS[f.__name__] = f
    return f


def dispatch(name: str, store: GraphStore, /, **inputs: Any) -> Response:
    """Runs a tool by name. ToolError tells unknown tools and bad input."""
    if name not in TOOLS:
        raise ToolError("UNKNOWN_TOOL", f"no tool {name!r}")
    try:
        return TOOLS[name](store, **inputs)
    except TypeError as error:
        raise ToolError("INVALID_INPUT", str(error)) from error
    except ToolError:
        raise
    except ValueError as error:
        raise ToolError("INVALID_INPUT", str(error)) from error


def _tables(store: GraphStore, org: str) -> tuple[DataFrame, DataFrame]:
    schema.check_org(org)
    return store.read("nodes").filter(F.col("org_id") == org), store.read("edges").filter(F.col("org_id") == org)


def _has(store: GraphStore, table: str) -> bool:
    return store._current(table) > 0


def _now(now: int | None) -> int:
    return int(time.time() * 1000) if now is None else now


@tool
def ping(store: GraphStore, now: int | None = None) -> Response:
    return Response("ok", data={"ok": True, "ts": _now(now)})


@tool
def start_ingest_job(store: GraphStore, source: str, mode: str = "auto") -> Response:
    """The call that ingests a source; nothing is started."""
    if mode not in ("auto", "full", "incremental") or any(ord(c) < 32 for c in source):
        raise ToolError("INVALID_INPUT", "mode is auto, full or incremental; source has no control characters")
    quoted = "'" + source.replace("'", "'\\''") + "'"
    return Response("Run this to ingest", data={"command": f"python -m metaweave --store {store.root} ingest --source {quoted} --mode {mode}"}, follow_up_tools=["get_ingest_job"])


_JOBS: dict[str, dict[str, Any]] = {}


@tool
def get_ingest_job(store: GraphStore, job_id: str) -> Response:
    if job_id not in _JOBS:
        raise ToolError("NOT_FOUND", f"no job {job_id!r}")
    return Response(_JOBS[job_id].get("status", "?"), data=_JOBS[job_id])


@tool
def snapshot_create(store: GraphStore, org: str, name: str | None = None, kind: str = "manual", now: int | None = None) -> Response:
    schema.check_org(org)
    at = _now(now)
    i = store.create_snapshot(org, name or f"snapshot-{at}", kind == "auto", at)
    return Response(f"Snapshot {i}", data={"id": i}, follow_up_tools=["snapshot_list", "point_in_time_diff"])


@tool
def snapshot_list(store: GraphStore, org: str) -> Response:
    d = store.snapshots(org).limit(20)
    return Response(f"{d.count()} snapshots", render.markdown_table(d), {"snapshots": d})


@tool
def freshness_report(store: GraphStore, org: str, bucket: str | None = None, now: int | None = None, labels: list[str] | None = None, cap: int | None = None) -> Response:
    """The stalest nodes of each bucket. cap: how many nodes of a label are looked at (all without one); truncated tells whether a label has so many."""
    n, truncated = filters.first_of_labels(_tables(store, org)[0].filter(F.col("label").isin(labels or CODE)), cap)
    d = audit.freshness_report(n, _now(now))
    d = d.filter(F.col("bucket") == bucket) if bucket else d
    return Response("Stalest first" + ", truncated" * truncated, render.markdown_table(d.select("bucket", "qname", "score")), {"rows": d, "truncated": truncated})


@tool
def point_in_time_diff(store: GraphStore, org: str, before: str, after: str = "current") -> Response:
    nodes = diff.diff_nodes(store.snapshot(before, "nodes", org), store.snapshot(after, "nodes", org))
    edges = diff.diff_edges(store.snapshot(before, "edges", org), store.snapshot(after, "edges", org))
    return Response(f"{nodes.count()} nodes and {edges.count()} edges differ", render.diff_graph(nodes), {"nodes": nodes, "edges": edges})


@tool
def what_broke(store: GraphStore, org: str, since: str | None = None, depth: int = 3) -> Response:
    """What depends on what changed since a snapshot (by default the newest automatic one), and whether tests cover it."""
    if since is None:
        row = store.snapshots(org).filter("is_auto").first()
        if row is None:
            return Response("no baseline snapshot", data={"changed": None})
        since = row.id
    _, e = _tables(store, org)
    changed = diff.diff_nodes(store.snapshot(since, "nodes", org), store.snapshot("current", "nodes", org)).filter(F.col("change") != diff.ADDED)
    if changed.isEmpty():
        return Response("no changes", data={"changed": changed})
    reached = traverse.reach(e, changed, True, depth).nodes
    risks = audit.risk_buckets(changed, reached, e)
    return Response(f"{risks.filter(F.col('risk') == 'at_risk').count()} at risk", render.markdown_table(risks), {"changed": changed, "risks": risks}, ["test_gap_intelligence_from_git_diff"])


@tool
def analyze_field(store: GraphStore, org: str, object_name: str, field_name: str) -> Response:
    _, e = _tables(store, org)
    q = f"CustomField:{object_name}.{field_name}"
    data = {k: traverse.fan_in(e, q, rels) for k, rels in (("readers", READS), ("writers", WRITES), ("grants", GRANTS))}
    return Response(f"{q}: " + ", ".join(f"{d.count()} {k}" for k, d in data.items()), data=data)


def _trace(store: GraphStore, org: str, qname: str, depth: int, reverse: bool, cap: int | None) -> Response:
    """cap: how many nodes there may be, the start among them (all without one); truncated tells whether there are so many."""
    n, e = _tables(store, org)
    r = traverse.trace(e, qname, reverse, depth, cap=cap)
    nodes = traverse.hydrate(r.nodes, n)
    return Response(f"{nodes.count()} nodes" + ", truncated" * r.truncated, render.dependency_graph(n, r.edges, qname), {"nodes": nodes, "edges": r.edges, "truncated": r.truncated})


@tool
def trace_upstream(store: GraphStore, org: str, qname: str, depth: int = 3, cap: int | None = None) -> Response:
    return _trace(store, org, qname, depth, True, cap)


@tool
def trace_downstream(store: GraphStore, org: str, qname: str, depth: int = 3, cap: int | None = None) -> Response:
    return _trace(store, org, qname, depth, False, cap)


@tool
def cross_layer_flow_map(store: GraphStore, org: str, entry: str, cap: int = 100) -> Response:
    _, e = _tables(store, org)
    r = traverse.typed_flow(e, entry, FLOW_RELS, cap)
    people = [x.qname for x in r.nodes.orderBy("depth", "qname").collect()]  # at most cap
    messages = [(x.src, x.rel_type, x.dst) for x in r.edges.orderBy("src", "rel_type", "dst").limit(10 * cap).collect()]
    return Response(f"{len(people)} participants" + ", truncated" * r.truncated, render.sequence(people, messages), {"participants": people, "messages": messages, "truncated": r.truncated})


@tool
def cross_org_diff(store: GraphStore, org_a: str, org_b: str, category: str | None = None, cap: int | None = None) -> Response:
    """What two orgs have differently. cap: as in freshness_report, of each org."""
    a, b = _tables(store, org_a)[0], _tables(store, org_b)[0]
    if category:
        a, b = a.filter(F.col("label") == category), b.filter(F.col("label") == category)
    (a, more_a), (b, more_b) = filters.first_of_labels(a, cap), filters.first_of_labels(b, cap)
    d, truncated = diff.diff_orgs(a, b), more_a or more_b
    return Response(f"{d.count()} differ" + ", truncated" * truncated, render.markdown_table(d), {"diff": d, "truncated": truncated}, ["deployment_manifest_gen"])


@tool
def deployment_manifest_gen(store: GraphStore, org_from: str, org_to: str, category: str | None = None, version: str = diff.API_VERSION, out: str | None = None) -> Response:
    """What brings one org to the other, as two manifests. With out they are written there, and nothing of them passes the driver."""
    d = cross_org_diff(store, org_from, org_to, category).data["diff"]
    m = diff.manifest_members(d)
    if out is not None:
        for name, destructive in (("package", False), ("destructive", True)):
            diff.write_manifest(d, f"{out}/{name}", destructive, version)
        return Response("Manifests", data={"package": f"{out}/package", "destructive": f"{out}/destructive", "by_type": diff.manifest_counts(d)})
    return Response("Manifests", data={"package": diff.manifest_xml(m, False, version), "destructive": diff.manifest_xml(m, True, version), "by_type": m.select("destructive", "type", "n")})


def _seeds(store: GraphStore, text: str) -> DataFrame:
    lines = store.spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")
    return diff.parse_diff(lines).select(diff.path_to_qname(F.col("path")).alias("qname"), "status").filter("qname is not null").distinct()


def _from_seeds(e: DataFrame, seeds: DataFrame, reverse: bool, depth: int, cap: int | None) -> traverse.Reached:
    """The seeds (at depth 0) and what they reach. Without a cap (of the nodes of each seed) a node has its nearest seed only, with one a row for each seed."""
    if cap is not None:
        return traverse.walk(e, seeds, reverse, depth, cap=cap)
    r = traverse.reach(e, seeds, reverse, depth)
    own = seeds.select(F.col("qname").alias("seed"), "qname", F.lit(0).alias("depth")).distinct()
    return traverse.Reached(own.unionByName(r.nodes.select("seed", "qname", "depth")), r.edges, False)


@tool
def impact_from_git_diff(store: GraphStore, org: str, diff_text: str, depth: int = 3, cap: int | None = None) -> Response:
    """What a diff's nodes depend on and what depends on them: impacted has each node once, at its smallest depth in either direction (0: changed itself);
    edges those that were followed, in either. cap: how many nodes a seed may have in a direction (all without one); truncated, whether one came to it."""
    n, e = _tables(store, org)
    seeds = _seeds(store, diff_text)
    up, down = (_from_seeds(e, seeds, reverse, depth, cap) for reverse in (True, False))
    found = up.nodes.select("seed", "qname", "depth").unionByName(down.nodes.select("seed", "qname", "depth")).groupBy("qname").agg(F.min(F.struct("depth", "seed")).alias("x")).select("qname", "x.seed", "x.depth")
    found = traverse.hydrate(found, n, "Changed").filter("depth = 0 or label <> 'Changed'")
    edges, truncated = up.edges.unionByName(down.edges).distinct(), up.truncated or down.truncated
    return Response(f"{seeds.count()} changed, {found.count()} impacted" + ", truncated" * truncated, render.markdown_table(found.select("qname", "seed", "depth")), {"seeds": seeds, "impacted": found, "edges": edges, "truncated": truncated})


@tool
def test_gap_intelligence_from_git_diff(store: GraphStore, org: str, diff_text: str, depth: int = 3, cap: int | None = None) -> Response:
    """What a diff changes and what depends on it, and whether tests cover it. cap: as in impact_from_git_diff."""
    _, e = _tables(store, org)
    found = _from_seeds(e, _seeds(store, diff_text), True, depth, cap).nodes.select("qname").distinct()
    testers = e.filter("rel_type = 'IS_TEST_FOR'").select(F.col("src").alias("qname")).distinct()
    d = audit.covered(found.join(testers, "qname", "left_anti"), e)
    return Response(f"{d.filter('not covered').count()} without tests", render.markdown_table(d), {"gaps": d.filter("not covered"), "covered": d.filter("covered")})


@tool
def governor_risk_check(store: GraphStore, org: str) -> Response:
    n, _ = _tables(store, org)
    cached = _has(store, "governor_risks")
    d = store.read("governor_risks").filter(F.col("org_id") == org) if cached else audit.governor_flags(n)
    return Response(f"{d.count()} risks", render.markdown_table(d), {"risks": d, "cached": cached})


@tool
def dead_code_audit(store: GraphStore, org: str, now: int | None = None) -> Response:
    n, e = _tables(store, org)
    cached = _has(store, "dead_code_scores")
    d = store.read("dead_code_scores").filter(F.col("org_id") == org) if cached else audit.dead_code(n.filter(F.col("label").isin(audit.DEAD_LABELS)), e, _now(now))
    d = d.orderBy("score", "qname")
    return Response(f"{d.count()} candidates", render.markdown_table(d), {"dead": d, "cached": cached})


@tool
def security_audit(store: GraphStore, org: str, object_name: str | None = None, field_name: str | None = None, cap: int | None = None) -> Response:
    """Open sharing, who is granted which field, and fields nobody is granted. cap: as in freshness_report, of sharing rules, permission sets and fields."""
    n, e = _tables(store, org)
    truncated = False
    if cap is not None:
        n, truncated = filters.first_of_labels(n.filter(F.col("label").isin("SharingRule", "PermissionSet", "CustomField")), cap)
    fields = n.filter(F.col("label") == "CustomField").filter(filters.in_scope(F.col("qname"), object_name, field_name))
    matrix = audit.granted_by(e, n).filter(filters.in_scope(F.col("qname"), object_name, field_name))
    data = {"sharing": audit.open_sharing(n), "matrix": matrix, "gaps": audit.access_gaps(fields, e, n)}
    return Response(", ".join(f"{d.count()} {k}" for k, d in data.items()) + ", truncated" * truncated, data=data | {"truncated": truncated})


def _working_tree(store: GraphStore, org: str, root: str | None, members: DataFrame | None, now: int) -> tuple[DataFrame, DataFrame]:
    if (root is None) == (members is None):
        raise ToolError("INVALID_INPUT", "give project_root or members")
    facts = registry.parse_stored(filesystem.read_project(store.spark, root, org) if members is None else members, now)
    nodes = registry.nodes_of(facts).filter("label <> 'ParseError'").dropDuplicates(["org_id", "qname", "source_hash"])
    return nodes.groupBy("qname").agg(F.min("label").alias("label"), F.min("source_hash").alias("source_hash")), registry.edges_of(facts)


def _wip(store: GraphStore, org: str, root: str | None, members: DataFrame | None, full: bool, now: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, e = _tables(store, org)
    local, own = _working_tree(store, org, root, members, _now(now))
    labels = [r.label for r in local.select("label").distinct().collect()] if full else []  # some dozens
    return materialize(diff.diff_working_tree(local, n, labels)), e, own


@tool
def wip_impact(store: GraphStore, org: str, project_root: str | None = None, depth: int = 3, mode: str = "changed", overlay_edges: bool = False, now: int | None = None, members: DataFrame | None = None) -> Response:
    """What depends on what a working tree (a folder, or its members as a table) changes or adds, each node once with its nearest change, and whether a
    test covers it. With overlay_edges the tree's own edges count, too. Mode full also lists what is gone, within the labels the tree has."""
    changes, e, own = _wip(store, org, project_root, members, mode == "full", now)
    if overlay_edges:
        e = e.select("rel_type", "src", "dst").unionByName(own.select("rel_type", "src", "dst")).distinct()
    r = traverse.reach(e, changes.filter(F.col("change") != diff.REMOVED), True, depth)
    found = materialize(audit.covered(r.nodes, e))
    return Response(f"{changes.count()} changes, {found.count()} dependents", render.wip_graph(changes, found), {"changes": changes, "dependents": found, "truncated": r.truncated}, ["wip_test_gap"])


@tool
def wip_diff(store: GraphStore, org: str, project_root: str | None = None, mode: str = "changed", now: int | None = None, members: DataFrame | None = None) -> Response:
    changes, _, _ = _wip(store, org, project_root, members, mode == "full", now)
    return Response(f"{changes.count()} changes", render.markdown_table(changes), {"changes": changes})


@tool
def wip_test_gap(store: GraphStore, org: str, project_root: str | None = None, depth: int = 3, now: int | None = None, members: DataFrame | None = None) -> Response:
    d = wip_impact(store, org, project_root, depth, now=now, members=members).data["dependents"].filter("not covered")
    return Response(f"{d.count()} without tests", render.markdown_table(d), {"uncovered": d})


@tool
def list_orgs(store: GraphStore, known: list[str] | None = None, default: str | None = None, now: int | None = None) -> Response:
    """Orgs that are stored, and those known elsewhere; how old their sync is, and which is the default."""
    spark = store.spark
    extra = spark.createDataFrame([(k, True) for k in known or []], "id string, known boolean")
    days, stale = audit.staleness(F.col("last_synced_at"), _now(now))
    d = store.list_orgs().join(extra, "id", "full_outer").withColumns({"age_days": days, "stale": stale, "is_default": F.col("id") == F.lit(default), "known": F.coalesce("known", F.lit(False))}).orderBy("alias", "id")
    return Response(f"{d.count()} orgs", render.markdown_table(d), {"orgs": d})


@tool
def staleness_check(store: GraphStore, org: str, now: int | None = None) -> Response:
    days, stale = audit.staleness(F.col("last_synced_at"), _now(now))
    row = store.read("orgs").filter(F.col("id") == org).select(days.alias("days"), stale.alias("stale")).first()
    if row is None:
        raise ToolError("NOT_FOUND", f"no org {org!r}")
    return Response("stale" if row.stale else "current", data={"days": row.days, "stale": row.stale})


@tool
def explain_code(store: GraphStore, org: str, qname: str, annotation: str | None = None, refresh: bool = False, now: int | None = None) -> Response:
    """A snippet with its kept explanation; an annotation (up to 16 KiB) becomes its explanation."""
    d = store.read("snippets", store.parts("snippets", org))
    mine = F.col("qname") == qname
    row = d.filter(mine).first()
    if row is None:
        raise ToolError("NOT_FOUND", f"no source of {qname!r}")
    if annotation is not None:
        if len(annotation.encode()) > ANNOTATION:
            raise ToolError("INVALID_INPUT", "an annotation has 16 KiB at most")
        store.replace_org("snippets", org, d.withColumns({"explanation": F.when(mine, F.lit(annotation)).otherwise(F.col("explanation")), "explained_at": F.when(mine, F.lit(_now(now))).otherwise(F.col("explained_at"))}))
        return Response("kept", data={"text": row.text, "explanation": annotation})
    return Response(qname, data={"text": row.text, "format": row.format, "explanation": None if refresh else row.explanation})


@tool
def find_similar(store: GraphStore, org: str, qname: str | None = None, text: str | None = None, k: int = 10, label: str | None = None, embedder: Callable | None = None) -> Response:
    """Nearest nodes to a node or to a text (one of both)."""
    if (qname is None) == (text is None) or not 1 <= k <= vector.MAX_K:
        raise ToolError("INVALID_INPUT", f"give qname or text, and k from 1 to {vector.MAX_K}")
    d = store.read("node_vectors").filter(F.col("org_id") == org)
    d = d.join(store.read("nodes").filter(F.col("org_id") == org).select("qname", "label"), "qname")
    d = d.filter(F.col("label") == label) if label else d
    if qname is not None:
        found = vector.similar(d, qname, k, "qname")
    else:
        q = (embedder or vector.hashing_embedder())([text])[0]
        found = vector.knn(d, q, k, "qname").withColumn("similarity", F.lit(1.0) - F.col("distance") / 2)
    found = materialize(found)  # k rows, for which every vector is read
    return Response(f"{found.count()} hits", render.markdown_table(found), {"hits": found})


@tool
def export_sarif(store: GraphStore, org: str, audits: list[str] | None = None, now: int | None = None) -> Response:
    n, e = _tables(store, org)
    want = set(audits or ["dead_code", "governor", "security", "dangling"])
    fields = n.filter(F.col("label") == "CustomField")
    found = audit.collect_findings(
        dead=audit.dead_code(n.filter(F.col("label").isin(audit.DEAD_LABELS)), e, _now(now)) if "dead_code" in want else None,
        governor=audit.governor_flags(n.filter(F.col("label") == "ApexClass")) if "governor" in want else None,
        sharing=audit.open_sharing(n) if "security" in want else None,
        gaps=audit.access_gaps(fields, e, n) if "security" in want else None,
        loose=audit.dangling(e, n).orderBy("src", "dst").limit(1000) if "dangling" in want else None,
    )
    doc = render.sarif(found)
    run = doc["runs"][0]
    truncated = run["properties"]["truncated"]
    return Response(f"{len(run['results'])} results" + ", truncated" * truncated, data={"sarif": doc, "lint": render.lint_sarif(doc), "findings": found, "truncated": truncated})


@tool
def find_nodes(store: GraphStore, org: str, pattern: str, label: str | None = None, limit: int = 500) -> Response:
    n, _ = _tables(store, org)
    d, total = filters.find_by_glob(n, pattern, label, min(limit, 500))
    return Response(f"{total} matches", render.markdown_table(d.select("qname", "label")), {"matches": d, "total": total, "truncated": total > limit})
