"""A sync of an org: parse, merge, resolve, delete, analyse."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import audit, merge, resolve, vector
from .parse import registry
from .sources import filesystem
from .sources.members import baseline_edges
from .store import GraphStore
from .streaming import embedding
from .tables import materialize


@dataclass
class Report:
    nodes: dict[str, int] = field(default_factory=dict)
    edges: dict[str, int] = field(default_factory=dict)
    parse_errors: int = 0
    deleted: int = 0
    resolved: dict[str, dict[str, int]] = field(default_factory=dict)
    dangling: int = 0
    embedded: dict[str, int] = field(default_factory=dict)
    renamed: int = 0
    baseline: dict[str, int] = field(default_factory=dict)
    snapshot: str | None = None


def choose_mode(mode: str, last_synced: int | None, tracks_changes: bool) -> str:
    """auto: incremental if there was a sync and changes are tracked, else full."""
    if mode not in ("auto", "full", "incremental"):
        raise ValueError(f"mode is auto, full or incremental, not {mode!r}")
    return mode if mode != "auto" else "incremental" if last_synced and tracks_changes else "full"


def _add_edges(store: GraphStore, org: str, made: DataFrame, now: int) -> dict[str, int]:
    if "attributes" in made.columns:
        return store.merge_edges(materialize(made.select(F.lit(org).alias("org_id"), "rel_type", "src", "dst", "attributes").dropDuplicates(["rel_type", "src", "dst"])), now)
    d = made.select(F.lit(org).alias("org_id"), "rel_type", "src", "dst", F.to_json(F.struct(*[c for c in made.columns if c not in ("org_id", "rel_type", "src", "dst")] or [F.lit("resolver").alias("source")])).alias("attributes"))
    return store.merge_edges(materialize(d.dropDuplicates(["rel_type", "src", "dst"])), now)


def run_resolvers(store: GraphStore, org: str, now: int, namespace: str | None = None) -> dict[str, dict[str, int]]:
    """Flavours, invocable methods, overloads, inferred references, comparison of flavours: in this order, each on what the others left. One that fails ends no other."""
    out: dict[str, dict[str, int]] = {}

    def own() -> tuple[DataFrame, DataFrame]:
        return store.read("nodes").filter(F.col("org_id") == org), store.read("edges").filter(F.col("org_id") == org)

    def flavors() -> dict[str, int]:
        n = own()[0]
        links = materialize(resolve.link_flavors(n, namespace=namespace))
        if links.isEmpty():
            return {}
        made = materialize(resolve.unite_flavors(n, links))
        store.merge_nodes(made.select("org_id", "label", "qname", "attributes", "source_hash", "last_modified_at"), now)
        return _add_edges(store, org, links, now)

    def overlap() -> dict[str, int]:
        _, e = own()
        compared = materialize(resolve.compare_flavors(e))
        if compared.isEmpty():
            return {}
        _add_edges(store, org, resolve.annotate_flavors(e, compared, now), now)
        return {r["status"]: r["count"] for r in compared.groupBy("status").count().collect()}

    def invocable() -> dict[str, int]:
        n, e = own()
        r = resolve.resolve_invocable(e, n.filter(F.col("label").isin("ApexMethod", "TestMethod")))
        _add_edges(store, org, r.edges, now)
        return r.counters.first().asDict()

    def arity() -> dict[str, int]:
        n, e = own()
        r = resolve.resolve_arity(e, n.filter(F.col("label").isin("ApexMethod", "TestMethod")))
        counters = r.counters.first().asDict()
        if counters["resolved"]:
            store.swap_edges(r.gone, r.made.select(schema.EDGES.names))
        return counters

    def references() -> dict[str, int]:
        r = resolve.infer_references(own()[0])
        _add_edges(store, org, r.edges, now)
        return r.counters.first().asDict()

    for step in (flavors, invocable, arity, references, overlap):
        try:
            out[step.__name__] = step()
        except Exception as error:
            out[step.__name__] = {"failed": 1, str(error)[:80]: 1}
    return out


def embed_nodes(store: GraphStore, org: str, embedder: Callable, at: int) -> dict[str, int]:
    """Embeds nodes (label, name and description) whose text has no vector yet, and texts that failed before. One that fails fails alone, and ends no sync."""
    n = store.read("nodes", store.parts("nodes", org)).filter(F.col("label") != "ParseError")
    text = F.concat("label", F.lit(": "), "qname", F.lit("\n"), F.coalesce(F.get_json_object("attributes", "$.description"), F.lit("")))
    try:
        if store._current(embedding.VECTORS):
            n = vector.stale_vectors(n, store.read(embedding.VECTORS).filter(F.col("org_id") == org), text)
        return embedding.apply_texts(store, n.select("org_id", "qname", text.alias("text"), F.lit(0).alias("ordinal")), at, embedder)
    except Exception as error:
        return {"failed": 1, str(error)[:80]: 1}


def follow_renames(store: GraphStore, org: str, members: DataFrame, at: int) -> int:
    """Records the members' service ids, and renames what has another name now; how many did."""
    name = F.concat_ws(":", "member_type", "member_name")
    seen = members.filter(F.coalesce("service_id", F.lit("")) != "").groupBy(F.lit(org).alias("org_id"), "service_id").agg(F.max(name).alias("qname"), F.max("member_type").alias("label"))
    renames = store.record_service_ids(materialize(seen), at)
    n = renames.count()
    if n:
        store.rename(org, renames, nodes=True)
    return n


def add_baseline(store: GraphStore, org: str, dependencies: DataFrame, parsed: DataFrame, at: int, namespace: str | None = None) -> dict[str, int]:
    """Merges the platform's edges, but for those that were parsed: these count more."""
    made = baseline_edges(dependencies, namespace=namespace).join(parsed.select("rel_type", "src", "dst"), ["rel_type", "src", "dst"], "left_anti")
    return store.merge_edges(materialize(made.select(F.lit(org).alias("org_id"), "rel_type", "src", "dst", "attributes")), at)


def sync(store: GraphStore, members: DataFrame, org: str, mode: str = "full", now: int | None = None, detect_deletions: bool = True, snapshot: bool = True, keep_days: int = 30, analyse: bool = True, namespace: str | None = None, embedder: Callable | None = vector.hashing_embedder, dependencies: DataFrame | None = None) -> Report:
    """Merges members (schema.MEMBERS, with org_id) into the store.

    A full sync deletes nodes that it did not touch, but only if nothing failed to parse, and only of labels that it
    read. An incremental one deletes what the feed says is gone. A snapshot is taken before, old automatic ones go after.
    Members with a service_id that had another name before are renamed first, all at once, nodes and edges. dependencies: a
    table of the platform's own (members.baseline_edges), whose edges are added; parsed ones of the same relation and names count more.
    """
    at = int(time.time() * 1000) if now is None else now
    out = Report()
    if snapshot and store._current("nodes"):
        out.snapshot = store.create_snapshot(org, f"pre-sync-{at}", True, at)
    gone = members.filter(F.coalesce("obsolete", F.lit(False)))
    if "service_id" in members.columns:
        out.renamed = follow_renames(store, org, members.filter(~F.coalesce("obsolete", F.lit(False))), at)
    facts = registry.parse_stored(members.filter(~F.coalesce("obsolete", F.lit(False))), at)
    nodes = registry.nodes_of(facts)
    out.parse_errors = nodes.filter("label = 'ParseError'").count()
    nodes = materialize(merge.last_of_each(nodes.withColumn("__n", F.monotonically_increasing_id()), ["org_id", "qname"], "__n").drop("__n"))
    edges = materialize(merge.last_of_each(registry.edges_of(facts).withColumn("__n", F.monotonically_increasing_id()), ["org_id", "rel_type", "src", "dst"], "__n").drop("__n"))
    if dependencies is not None:
        out.baseline = add_baseline(store, org, dependencies, edges, at, namespace)
    out.nodes, out.edges = store.merge_nodes(nodes, at), store.merge_edges(edges, at)
    store.merge_snippets(registry.snippets_of(facts).dropDuplicates(["org_id", "qname"]))
    stored = store.read("nodes").filter(F.col("org_id") == org)
    if mode == "full" and detect_deletions:
        labels = [r.label for r in nodes.select("label").distinct().collect()]  # some dozens
        dead = materialize(merge.detect_deletions(stored, nodes, labels, out.parse_errors).select("org_id", "qname"))
    else:
        dead = materialize(stored.join(gone.select(F.concat_ws(":", "member_type", "member_name").alias("qname")), "qname", "left_semi").select("org_id", "qname"))
    out.deleted = dead.count()
    if out.deleted:
        store.delete_nodes(dead)
    out.resolved = run_resolvers(store, org, at, namespace)
    if embedder is not None:
        out.embedded = embed_nodes(store, org, embedder, at)
    n, e = store.read("nodes").filter(F.col("org_id") == org), store.read("edges").filter(F.col("org_id") == org)
    out.dangling = audit.dangling(e, n).count()
    store.write("orgs", store.read("orgs").withColumn("last_synced_at", F.when(F.col("id") == org, F.lit(at)).otherwise(F.col("last_synced_at"))))
    if analyse:
        store.populate_analysis(org, at)
    store.prune(org, keep_days, at)
    return out


def sync_orgs(store: GraphStore, members: dict[str, DataFrame], **options) -> dict[str, Report | str]:
    """Several orgs, one after another; one that fails is reported, and ends no other."""
    out: dict[str, Report | str] = {}
    for org, d in members.items():
        try:
            out[org] = sync(store, d, org, **options)
        except Exception as error:
            out[org] = str(error)
    return out


def add_options(p: argparse.ArgumentParser) -> None:
    """What can be said about a sync."""
    p.add_argument("--source", required=True, help="a project folder, or with --members a table of members (Parquet)")
    p.add_argument("--members", action="store_true")
    p.add_argument("--mode", default="auto", choices=["auto", "full", "incremental"])
    p.add_argument("--orgs", default="", help="orgs of one run, with commas between them, instead of --org; one that fails ends no other")
    p.add_argument("--only", default="", help="types of members to read, with commas between them; nothing of others is deleted")
    p.add_argument("--namespace", help="the org's own namespace, which names are compared without")
    p.add_argument("--dependencies", help="the platform's table of dependencies (Parquet)")
    p.add_argument("--no-deletions", action="store_true")
    p.add_argument("--no-snapshot", action="store_true")
    p.add_argument("--no-vectors", action="store_true")
    p.add_argument("--no-analysis", action="store_true")


def run(store: GraphStore, org: str, o: argparse.Namespace) -> dict[str, Report | str]:
    """The syncs that options ask for, by org."""
    spark, now = store.spark, int(time.time() * 1000)
    out: dict[str, Report | str] = {}
    for name in [x.strip() for x in o.orgs.split(",") if x.strip()] or [schema.check_org(org)]:
        try:
            known = store.read("orgs").filter(F.col("id") == schema.check_org(name)).first()
            if known is None:
                store.upsert_org(name, name, "", "", now)
            if o.members:
                members = spark.read.parquet(o.source)
                members = members.filter(F.col("org_id") == name) if "org_id" in members.columns else members.withColumn("org_id", F.lit(name))
            else:
                members = filesystem.read_project(spark, o.source, name)
            if o.only:
                members = members.filter(F.col("member_type").isin([t.strip() for t in o.only.split(",")]))
            mode = choose_mode(o.mode, known and known.last_synced_at, False)
            given = {"embedder": None} if o.no_vectors else {}
            out[name] = sync(store, members, name, mode, detect_deletions=not o.no_deletions, snapshot=not o.no_snapshot, analyse=not o.no_analysis, namespace=o.namespace, dependencies=spark.read.parquet(o.dependencies) if o.dependencies else None, **given)
        except Exception as error:
            if not o.orgs:
                raise
            out[name] = str(error)
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Ingest a project folder or a table of members into a store.")
    p.add_argument("--store", required=True)
    p.add_argument("--org", default="org1")
    add_options(p)
    o = p.parse_args(args)
    for org, report in run(GraphStore(SparkSession.builder.appName("metaweave").getOrCreate(), o.store), o.org, o).items():
        print(org, report)


if __name__ == "__main__":
    main()
