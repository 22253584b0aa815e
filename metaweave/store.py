"""A store of tables in versions: a write makes folders of the partitions it touches, and a file then names what belongs to the version."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schema
from .operators import audit, merge
from .tables import delete_path, materialize, path_exists

#: Versions that stay.
KEEP = 5
_SCHEMAS = {"nodes": schema.NODES, "edges": schema.EDGES, "snippets": schema.SNIPPETS, "orgs": schema.ORGS, "snapshots": schema.SNAPSHOTS, "service_ids": schema.SERVICE_IDS, "findings": schema.FINDINGS, "embedding_failures": schema.FAILURES}
_PARTITIONS = {"nodes": ["org_id", "label"], "edges": ["org_id", "rel_type"], "orgs": [], "snapshots": []}


def partition_columns(table: str, columns: list[str]) -> list[str]:
    return _PARTITIONS.get(table, [c for c in columns if c == "org_id"])


def partition_of(path: str) -> tuple[str, ...]:
    """The values that a partition's folder names."""
    return tuple(unquote(x.split("=", 1)[1]) for x in path.split("/")[1:])


class GraphStore:
    """Tables under a root folder (of any Hadoop file system), in versions that are lists of folders.

    Nodes and edges are partitioned by org and by label or relation, the others by org: a scan of one reads only its
    files, and a write makes only the partitions it touches anew. A version is whole before the file that names it is
    made; making it fails if another writer has made it (where the file system creates files exclusively). Readers of
    an older version keep it, as the last KEEP stay. A snapshot is such a list, too: taking it copies nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._known: dict[str, tuple[int, dict]] = {}  # the last version read of each table; what a version says never changes

    # Versions

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _load(self, path: str) -> dict:
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, path: str, content: dict) -> None:
        p, fs = self._fs(path)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _current(self, table: str) -> int:
        return max(map(int, self._names(f"{self.root}/{table}/_versions")), default=0)

    def _state(self, table: str, n: int | None = None) -> dict:
        """Schema and folders of a version, by default the current one."""
        n = self._current(table) if n is None else n
        if n:
            if self._known.get(table, (0, {}))[0] != n:
                self._known[table] = n, self._load(f"{self.root}/{table}/_versions/{n}")
            return dict(self._known[table][1])
        if table not in _SCHEMAS:
            raise ValueError(f"no table {table!r}")
        return {"schema": _SCHEMAS[table].jsonValue(), "paths": []}

    def _open(self, table: str, state: dict) -> DataFrame:
        kind, base = StructType.fromJson(state["schema"]), f"{self.root}/{table}"
        if not state["paths"]:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", base).parquet(*[f"{base}/{x}" for x in state["paths"]]).select(kind.names)

    def read(self, table: str, parts: set[tuple[str, ...]] | None = None) -> DataFrame:
        """A table, or these partitions of it."""
        state = self._state(table)
        if parts is not None:
            state["paths"] = [x for x in state["paths"] if partition_of(x) in parts]
        return self._open(table, state)

    def parts(self, table: str, org: str | None = None) -> set[tuple[str, ...]]:
        """The partitions a table has, of one org if given."""
        return {x for x in map(partition_of, self._state(table)["paths"]) if org is None or x[:1] == (org,)}

    def _parts_of(self, table: str, rows: DataFrame) -> set[tuple[str, ...]]:
        return {tuple(r) for r in rows.select(*partition_columns(table, rows.columns)).distinct().collect()}  # orgs times labels

    def write(self, table: str, df: DataFrame, parts: set[tuple[str, ...]] | None = None) -> None:
        """A new version, with df in place of these partitions (of all, if None)."""
        n = self._current(table)
        old = self._state(table, n)["paths"] if n else []
        by, base = partition_columns(table, df.columns), f"{self.root}/{table}"
        new = [f"gen={n + 1}-{uuid.uuid4().hex[:8]}"]
        # rebalanced: a large label is split by its size, small ones share tasks
        (df.hint("rebalance", *map(F.col, by)).write.partitionBy(*by) if by else df.write).parquet(f"{base}/{new[0]}")
        for _ in by:
            new = [f"{x}/{y}" for x in new for y in self._names(f"{base}/{x}") if "=" in y]
        kept = [x for x in old if parts is not None and partition_of(x) not in parts]
        if by and set(map(partition_of, kept)) & set(map(partition_of, new)):
            raise ValueError("rows of partitions that aren't replaced")
        self._save(f"{base}/_versions/{n + 1}", {"schema": _SCHEMAS.get(table, df.schema).jsonValue(), "paths": kept + new})
        for v in [v for v in map(int, self._names(f"{base}/_versions")) if v <= n + 1 - KEEP]:
            past = self._state(table, v)["paths"]
            delete_path(self.spark, f"{base}/_versions/{v}")
            self._discard(table, past)

    def replace_org(self, table: str, org: str, df: DataFrame) -> None:
        """df in place of an org's rows."""
        self.write(table, df, self.parts(table, org) if self._current(table) else None)

    def _discard(self, table: str, paths: list[str]) -> None:
        """Deletes folders that neither a version nor a snapshot names."""
        states = [self._state(table, int(v)) for v in self._names(f"{self.root}/{table}/_versions")]
        states += [self._load(f"{self.root}/_snapshots/{x}").get(table, {"paths": []}) for x in self._names(f"{self.root}/_snapshots")]
        held = {x for state in states for x in state["paths"]}
        for x in paths:
            if x not in held:
                delete_path(self.spark, f"{self.root}/{table}/{x}")

    # Nodes, edges, snippets

    def _merge(self, table: str, facts: DataFrame, changed_by: str, now: int, order: str | None) -> dict[str, int]:
        key, modified, kinds = schema.KEYS[table], table == "nodes", (merge.INSERTED, merge.UPDATED, merge.UNCHANGED)
        touched = self._parts_of(table, facts)
        if table == "nodes":  # whose label may have changed: only keys of the other labels are read
            orgs = {o for o, _ in touched}
            others = self.read(table, {x for x in self.parts(table) - touched if x[0] in orgs})
            touched |= self._parts_of(table, others.join(facts.select(*key), key, "left_semi"))
        if not touched:
            if not self._current(table):
                self.write(table, self.read(table))
            return dict.fromkeys(kinds, 0)
        stored = self.read(table, touched)
        if order is None:  # counted while it is written
            seen = Observation()
            self.write(table, merge.merge(stored, facts, key, now, changed_by, modified, seen), touched)
            return {a: seen.get[a] for a in kinds}
        counts = {r["action"]: r["n"] for r in merge.counts(merge.batch_actions(stored, facts, key, order, changed_by)).collect()}
        self.write(table, merge.merge(stored, merge.last_of_each(facts, key, order).drop(order), key, now, changed_by, modified), touched)
        return {a: counts.get(a, 0) for a in kinds}

    def merge_nodes(self, facts: DataFrame, now: int, order: str | None = None) -> dict[str, int]:
        """Upserts facts (order: a column that tells their order, if keys may repeat); how many were inserted, updated, unchanged."""
        return self._merge("nodes", facts, "source_hash", now, order)

    def put_nodes(self, rows: DataFrame) -> None:
        """rows: nodes with all their columns, and `gone`. They take the place of those with their keys, or leave it empty; nothing is compared, so doing it twice changes nothing."""
        rows = materialize(rows.select(*schema.NODES.names, "gone"))
        new, key = rows.filter("NOT gone").drop("gone"), schema.KEYS["nodes"]
        orgs = {r.org_id for r in rows.select("org_id").distinct().collect()}
        held = self.read("nodes", {x for x in self.parts("nodes") if x[0] in orgs}).select(*key, "label")
        touched = self._parts_of("nodes", new) | self._parts_of("nodes", held.join(rows.select(*key), key, "left_semi"))
        if touched:
            self.write("nodes", self.read("nodes", touched).join(rows.select(*key), key, "left_anti").unionByName(new), touched)

    def merge_edges(self, facts: DataFrame, now: int, order: str | None = None) -> dict[str, int]:
        return self._merge("edges", facts, "attributes", now, order)

    def swap_edges(self, gone: DataFrame, made: DataFrame) -> None:
        """made in place of the edges gone (keys); of what is there already, the stored edge stays. Only the partitions of these are written anew."""
        gone, made = materialize(gone), materialize(made)
        key = schema.KEYS["edges"]
        touched = self._parts_of("edges", gone) | self._parts_of("edges", made)
        kept = self.read("edges", touched).join(gone.select(*key), key, "left_anti")
        self.write("edges", kept.unionByName(made.join(kept.select(*key), key, "left_anti").select(kept.columns)), touched)

    def merge_snippets(self, facts: DataFrame) -> None:
        touched = self._parts_of("snippets", facts)
        if touched or not self._current("snippets"):
            self.write("snippets", merge.merge_snippets(self.read("snippets", touched), facts), touched)

    def _edges_at(self, names: DataFrame) -> set[tuple[str, ...]]:
        """The partitions with edges that have one of these ends (org_id, qname)."""
        orgs = {r.org_id for r in names.select("org_id").distinct().collect()}
        e = self.read("edges", {x for x in self.parts("edges") if x[0] in orgs})
        return set().union(*(self._parts_of("edges", e.join(names.withColumnRenamed("qname", end), ["org_id", end], "left_semi")) for end in ("src", "dst")))

    def delete_nodes(self, gone: DataFrame, with_edges: bool = True) -> None:
        """gone: org_id and qname. Nodes of other orgs stay, whatever their names."""
        gone = gone.select("org_id", "qname").distinct()
        if with_edges and (touched := self._edges_at(gone)):
            self.write("edges", merge.delete_edges_for(self.read("edges", touched), gone), touched)
        orgs = {r.org_id for r in gone.select("org_id").distinct().collect()}
        held = self.read("nodes", {x for x in self.parts("nodes") if x[0] in orgs})
        if touched := self._parts_of("nodes", held.join(gone, ["org_id", "qname"], "left_semi")):
            self.write("nodes", merge.delete_nodes(self.read("nodes", touched), gone), touched)

    def delete_dangling(self, org: str) -> int:
        e, n = self.read("edges", self.parts("edges", org)), self.read("nodes", self.parts("nodes", org))
        found = {r.rel_type: r["count"] for r in audit.dangling(e, n).groupBy("rel_type").count().collect()}
        if found:
            touched = {(org, x) for x in found}
            self.write("edges", audit.delete_dangling(self.read("edges", touched), n).select(e.columns), touched)
        return sum(found.values())

    def rename(self, org: str, renames: DataFrame, nodes: bool = False) -> None:
        """renames: old and new names. Only relations whose edges have an old one are written anew; with nodes, labels that have an old or new one, too."""
        old = renames.select(F.lit(org).alias("org_id"), F.col("old").alias("qname"))
        if touched := self._edges_at(old):
            self.write("edges", merge.rename_edges(self.read("edges", touched), renames), touched)
        if nodes:
            names = old.union(renames.select(F.lit(org), "new")).distinct()
            held = self.read("nodes", self.parts("nodes", org))
            if touched := self._parts_of("nodes", held.join(names, ["org_id", "qname"], "left_semi")):
                self.write("nodes", merge.rename_nodes(self.read("nodes", touched), renames), touched)

    def record_service_ids(self, seen: DataFrame, now: int) -> DataFrame:
        touched = self._parts_of("service_ids", seen)
        after, renames = merge.record_service_ids(self.read("service_ids", touched), seen, now)
        found = materialize(renames)
        self.write("service_ids", after, touched)
        return found

    def reset_service_ids(self, org: str) -> None:
        self.replace_org("service_ids", org, self.read("service_ids", set()))

    def upsert_vectors(self, vectors: DataFrame, table: str = "node_vectors", key: tuple[str, ...] = ("org_id", "qname")) -> dict[str, int]:
        """vectors: the key, content_hash and embedding. A vector of the same content stays; others take its place."""
        if not self._current(table):
            self.write(table, vectors)
            return {merge.INSERTED: self.read(table).count(), merge.UPDATED: 0, merge.UNCHANGED: 0}
        touched = self._parts_of(table, vectors) if "org_id" in vectors.columns else None
        stored = self.read(table, touched)
        counts = {r["action"]: r["n"] for r in merge.counts(merge.merge_actions(stored, vectors, list(key), "content_hash")).collect()}
        new = vectors.join(stored.select(*key, "content_hash"), [*key, "content_hash"], "left_anti")
        self.write(table, stored.join(new.select(*key), list(key), "left_anti").unionByName(new.select(stored.columns)), touched)
        return {a: counts.get(a, 0) for a in (merge.INSERTED, merge.UPDATED, merge.UNCHANGED)}

    def missing_explanations(self, org: str, limit: int = 100) -> DataFrame:
        return self.read("snippets").filter((F.col("org_id") == org) & F.col("explanation").isNull()).orderBy("qname").limit(limit)

    def rebuild(self) -> None:
        """Empties nodes, edges and snippets for a full sync; their older versions stay."""
        for table in ("nodes", "edges", "snippets"):
            self.write(table, self.read(table).limit(0))

    # Orgs

    def upsert_org(self, org: str, alias: str, url: str, version: str, now: int) -> None:
        """Alias, URL and version; when it was made and last synced stays."""
        schema.check_org(org)
        new = self.spark.createDataFrame([(org, alias, url, version, now, None)], schema.ORGS)
        old = self.read("orgs")
        kept = old.select("id", F.col("created_at").alias("c"), F.col("last_synced_at").alias("s"))
        new = new.join(kept, "id", "left").withColumns({"created_at": F.coalesce("c", "created_at"), "last_synced_at": F.col("s")}).select(old.columns)
        self.write("orgs", old.filter(F.col("id") != org).unionByName(new))

    def touch_sync(self, org: str, at: str) -> None:
        """at: an ISO time; raises ValueError for others."""
        t = datetime.fromisoformat(at.replace("Z", "+00:00"))
        ms = int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1000)
        self.write("orgs", self.read("orgs").withColumn("last_synced_at", F.when(F.col("id") == org, F.lit(ms)).otherwise(F.col("last_synced_at"))))

    def list_orgs(self) -> DataFrame:
        n = self.read("nodes").groupBy(F.col("org_id").alias("id")).agg(F.count("*").alias("nodes"))
        return self.read("orgs").join(n, "id", "left").na.fill(0, ["nodes"]).orderBy("alias")

    # Snapshots

    def create_snapshot(self, org: str, label: str, is_auto: bool = False, now: int | None = None) -> str:
        """Names the folders that hold an org's nodes and edges now; they stay while the snapshot does."""
        name = f"snap_{uuid.uuid4().hex}"
        at = int(time.time() * 1000) if now is None else now
        states = {table: self._state(table) for table in ("nodes", "edges")}
        self._save(f"{self.root}/_snapshots/{name}", {t: {**state, "paths": [x for x in state["paths"] if partition_of(x)[0] == org]} for t, state in states.items()})
        self.write("snapshots", self.read("snapshots").unionByName(self.spark.createDataFrame([(name, org, label, at, is_auto)], schema.SNAPSHOTS)))
        return name

    def snapshots(self, org: str) -> DataFrame:
        return self.read("snapshots").filter(F.col("org_id") == org).orderBy(F.desc("created_at"), "id")

    def snapshot(self, name: str, table: str = "nodes", org: str | None = None) -> DataFrame:
        """An org's table as it is (`current`) or was in a snapshot; ValueError for one that doesn't exist."""
        if name == "current":
            return self.read(table, self.parts(table, org) if org else None)
        path = f"{self.root}/_snapshots/{name}"
        if not path_exists(self.spark, path):
            raise ValueError(f"no snapshot {name!r}")
        return self._open(table, self._load(path)[table])

    def delete_snapshot(self, name: str) -> None:
        path = f"{self.root}/_snapshots/{name}"
        if path_exists(self.spark, path):
            states = self._load(path)
            delete_path(self.spark, path)
            for table, state in states.items():
                self._discard(table, state["paths"])
        self.write("snapshots", self.read("snapshots").filter(F.col("id") != name))

    def prune(self, org: str, days: int, now: int) -> int:
        """Deletes automatic snapshots that are older than so many days."""
        old = [r.id for r in self.snapshots(org).filter(F.col("is_auto") & (F.col("created_at") < now - days * audit.DAY)).collect()]
        for name in old:
            self.delete_snapshot(name)
        return len(old)

    # Analysis tables

    def populate_analysis(self, org: str, now: int, labels: list[str] | None = None) -> None:
        """Writes dead-code scores, governor risks, test counts and sharing findings, which reports then read."""
        n = self.read("nodes").filter(F.col("org_id") == org)
        e = self.read("edges").filter(F.col("org_id") == org)
        code = n.filter(F.col("label").isin(labels or audit.SCORED_LABELS))
        self.replace_org("dead_code_scores", org, audit.dead_code_scores(code, e, now).withColumn("org_id", F.lit(org)))
        source = self.read("snippets").filter(F.col("org_id") == org).filter("format = 'apex'").select("qname", "text")
        self.replace_org("governor_risks", org, audit.risks_with_hints(audit.governor_risks(source), n).withColumn("org_id", F.lit(org)))
        self.replace_org("test_coverage", org, audit.test_counts(n.filter(F.col("label") == "ApexClass"), e).withColumn("org_id", F.lit(org)))
        self.replace_org("findings", org, audit.open_sharing(n).withColumn("computed_at", F.lit(now)).select(schema.FINDINGS.names))
