"""Scores, audits and findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.governor import scan_source

DAY = 86_400_000
#: Age in days up to which a freshness holds. Fixed values.
FRESHNESS = [(7, 1.0), (30, 0.8), (90, 0.6), (180, 0.4), (365, 0.2)]
BUCKETS = [(0.8, "hot"), (0.5, "current"), (0.2, "stale")]


def freshness(modified: Column, now: int) -> Column:
    """1.0 down to 0.05 by the age of a time in milliseconds; 0.5 if there is none."""
    age = (F.lit(now).cast("double") - modified) / DAY
    out = F.lit(0.05)
    for days, score in reversed(FRESHNESS):
        out = F.when(age <= days, score).otherwise(out)
    return F.when(modified.isNull() | (modified <= 0), 0.5).otherwise(out)


def bucket(score: Column) -> Column:
    out = F.lit("dead")
    for least, name in reversed(BUCKETS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def freshness_report(nodes: DataFrame, now: int, top: int = 20) -> DataFrame:
    """The stalest nodes of each bucket. Spark keeps `top` rows of a bucket in each task before they move (a window group limit)."""
    d = nodes.select("qname", "label", freshness(F.col("last_modified_at"), now).alias("score")).withColumn("bucket", bucket(F.col("score")))
    w = Window.partitionBy("bucket").orderBy("score", "qname")
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("qname")).agg(F.count("*").alias("in_degree"))


#: Labels that are looked at for dead code: at once, and for the table of scores. Fixed values (components under both names they have here).
DEAD_LABELS = ["ApexClass", "LWC", "LightningComponentBundle", "Flow"]
SCORED_LABELS = [*DEAD_LABELS, "ApexPage", "ApexComponent"]


def dead_code_scores(nodes: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    """qname, in_degree, score, confidence (how surely it is dead) and reasons; nodes both referenced and current are left out."""
    d = nodes.select("qname", "label", freshness(F.col("last_modified_at"), now).alias("fresh")).join(in_degrees(edges), "qname", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)).cast("long"))
    score = 0.6 * F.col("fresh") + 0.4 * F.least(F.lit(1.0), F.col("in_degree") / 5.0)
    reasons = F.array_compact(F.array(F.when(F.col("in_degree") == 0, "no_incoming_edges"), F.when(F.col("fresh") < 0.4, "stale_freshness")))
    d = d.withColumn("score", score).withColumn("reasons", reasons).filter(~((F.col("in_degree") > 0) & (F.col("fresh") >= 0.5)))
    return d.select("qname", "label", "in_degree", "score", F.when(F.col("score") < 0.2, "high").when(F.col("score") < 0.45, "medium").otherwise("low").alias("confidence"), "reasons")


def dead_code(nodes: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    """Nodes that nothing points at and that are stale."""
    d = nodes.withColumn("score", freshness(F.col("last_modified_at"), now)).filter(F.col("score") < 0.4)
    return d.join(edges.select(F.col("dst").alias("qname")).distinct(), "qname", "left_anti").select("qname", "label", "score")


def test_counts(nodes: DataFrame, edges: DataFrame, rel: str = "IS_TEST_FOR") -> DataFrame:
    """How many sources test each node, 0 included."""
    n = edges.filter(F.col("rel_type") == rel).select("src", F.col("dst").alias("qname")).distinct().groupBy("qname").agg(F.count("*").alias("test_count"))
    return nodes.select("qname").join(n, "qname", "left").select("qname", F.coalesce("test_count", F.lit(0)).cast("long").alias("test_count"))


def covered(nodes: DataFrame, edges: DataFrame, rel: str = "IS_TEST_FOR") -> DataFrame:
    """nodes with `covered`: whether any edge of the relation points at them."""
    t = edges.filter(F.col("rel_type") == rel).select(F.col("dst").alias("qname"), F.lit(True).alias("covered")).distinct()
    return nodes.join(t, "qname", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def risk_buckets(changed: DataFrame, dependents: DataFrame, edges: DataFrame, rel: str = "IS_TEST_FOR") -> DataFrame:
    """qname and risk of what depends on a change: covered or at_risk, each once; tests themselves and the changed are left out."""
    testers = edges.filter(F.col("rel_type") == rel).select(F.col("src").alias("qname")).distinct()
    d = dependents.select("qname").distinct().join(testers, "qname", "left_anti").join(changed.select("qname").distinct(), "qname", "left_anti")
    return covered(d, edges, rel).select("qname", F.when(F.col("covered"), "covered").otherwise("at_risk").alias("risk"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target has no node."""
    return edges.join(nodes.select(F.col("qname").alias("dst")).distinct(), "dst", "left_anti")


def prefix(qname: Column) -> Column:
    return F.when(F.instr(qname, ":") > 1, F.substring_index(qname, ":", 1)).otherwise(F.lit("(unlabeled)"))


def dangling_by(edges: DataFrame, nodes: DataFrame, what: str) -> DataFrame:
    """Counts of dangling edges by rel_type, or by the prefix of their target."""
    key = F.col("rel_type") if what == "rel_type" else prefix(F.col("dst"))
    return dangling(edges, nodes).groupBy(key.alias(what)).agg(F.count("*").alias("n"))


def delete_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("qname").alias("dst")).distinct(), "dst", "left_semi")


def granted_by(edges: DataFrame, nodes: DataFrame, rel: str = "GRANTS_FIELD_ACCESS", granters: tuple[str, ...] = ("PermissionSet",)) -> DataFrame:
    """For each granted field the sorted names of who grants it."""
    who = nodes.filter(F.col("label").isin(*granters)).select(F.col("qname").alias("src"))
    return edges.filter(F.col("rel_type") == rel).join(who, "src", "left_semi").groupBy(F.col("dst").alias("qname")).agg(F.array_sort(F.collect_set("src")).alias("granted_by"))


def access_gaps(fields: DataFrame, edges: DataFrame, nodes: DataFrame, rel: str = "GRANTS_FIELD_ACCESS", granters: tuple[str, ...] = ("PermissionSet",)) -> DataFrame:
    """Fields that nobody grants."""
    return fields.select("qname").join(granted_by(edges, nodes, rel, granters), "qname", "left_anti")


#: Values of a sharing rule's access and accessLevel that count as full access. Fixed values.
FULL_ACCESS = {"access": ("Edit",), "accessLevel": ("Edit", "All")}


def open_sharing(nodes: DataFrame) -> DataFrame:
    """Sharing rules that give full access, as rows of the findings table."""
    read = {k: F.get_json_object("attributes", f"$.{k}") for k in FULL_ACCESS}
    full = F.lit(False)
    for key, values in FULL_ACCESS.items():
        full = full | F.coalesce(read[key].isin(*values), F.lit(False))
    shown = F.to_json(F.struct(F.coalesce(read["accessLevel"], read["access"]).alias("accessLevel")))
    return nodes.filter((F.col("label") == "SharingRule") & full).select("org_id", "qname", F.lit("sharing.full_access").alias("rule_id"), F.lit(-1).cast("long").alias("line"), F.lit("high").alias("severity"), F.lit("sharing rule grants full access (All/Edit)").alias("message"), shown.alias("evidence"))


def governor_risks(snippets: DataFrame) -> DataFrame:
    """snippets: qname, text (Apex). qname, risk_type, line, evidence of what runs into limits; each (risk_type, line) once.

    Loops need a scan that counts braces, so source goes through Python in Arrow batches, a snippet at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, kind, line, text) for q, source in zip(b["qname"], b["text"]) for kind, line, text in scan_source(source or "")]
            yield pd.DataFrame(rows, columns=["qname", "risk_type", "line", "evidence"])

    return snippets.select("qname", "text").mapInPandas(run, "qname string, risk_type string, line long, evidence string")


#: Attributes by which a parser hints at a risk, and the risk. Fixed values.
RISK_FLAGS = {"hasSoqlInLoop": "soql_in_loop", "hasDmlInLoop": "dml_in_loop"}


def governor_flags(nodes: DataFrame) -> DataFrame:
    """Risks that a parser has left as flags in the attributes."""
    each = F.array_compact(F.array(*[F.when(F.get_json_object("attributes", f"$.{f}") == "true", F.struct(F.lit(kind).alias("risk_type"), F.lit(f"attribute {f}=true").alias("evidence"))) for f, kind in RISK_FLAGS.items()]))
    return nodes.select("qname", F.explode(each).alias("x")).select("qname", "x.risk_type", F.lit(-1).cast("long").alias("line"), "x.evidence")


def risks_with_hints(risks: DataFrame, nodes: DataFrame) -> DataFrame:
    """risks and, at line -1, what the attributes of classes and triggers hint at."""
    hints = governor_flags(nodes.filter(F.col("label").isin("ApexClass", "ApexTrigger"))).withColumn("evidence", F.lit("attribute hint"))
    return risks.unionByName(hints)


def staleness(last_synced: Column, now: int) -> tuple[Column, Column]:
    """Whole days since the last sync (null if never), and whether that is stale: never, or seven days and more."""
    days = F.floor((F.lit(now) - last_synced) / DAY)
    return days, days.isNull() | (days >= 7)


#: Rules that findings refer to: level and short description. Fixed values.
RULES = {
    "governor.soql-in-loop": ("error", "Apex method executes SOQL inside a loop."),
    "governor.dml-in-loop": ("error", "Apex method executes DML inside a loop."),
    "governor.unbounded-query": ("warning", "Apex method runs SOQL with no LIMIT or WHERE."),
    "governor.no-bulk": ("error", "Trigger touches a single record per fire — fails on bulk DML."),
    "security.fls-gap": ("warning", "CustomField has no FLS grant on any profile/permission set."),
    "security.sharing-full-access": ("warning", "OWD or sharing rule grants Modify All / View All to a broad audience."),
    "dead-code.unreferenced": ("note", "Node has no incoming edges and is not an obvious entry point."),
    "graph.dangling-edge": ("note", "Edge points to a destination node that doesn't exist in the graph."),
}


def as_findings(rule: Column | str, found: DataFrame, message: Column, line: str | None = None, evidence: str | None = None) -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return found.select(rule.alias("rule_id"), "qname", message.alias("message"), (F.col(line).cast("long") if line else F.lit(None).cast("long")).alias("line"), (F.col(evidence).cast("string") if evidence else F.lit(None).cast("string")).alias("evidence"))


def collect_findings(dead: DataFrame | None = None, governor: DataFrame | None = None, sharing: DataFrame | None = None, gaps: DataFrame | None = None, loose: DataFrame | None = None) -> DataFrame:
    """Findings of the audits given: rule_id, level (that of the rule), qname, message, line, evidence. A dangling edge is found at its source."""
    parts = []
    if governor is not None:
        parts.append(as_findings(F.concat(F.lit("governor."), F.replace("risk_type", F.lit("_"), F.lit("-"))), governor, F.concat("qname", F.lit(": "), "evidence"), "line", "evidence"))
    if gaps is not None:
        parts.append(as_findings("security.fls-gap", gaps, F.concat("qname", F.lit(": no FLS grant on any profile/permission set"))))
    if sharing is not None:
        parts.append(as_findings("security.sharing-full-access", sharing, F.concat("qname", F.lit(": granted full access via sharing rule or OWD"))))
    if dead is not None:
        parts.append(as_findings("dead-code.unreferenced", dead, F.concat("qname", F.lit(": no incoming references"))))
    if loose is not None:
        text = F.concat("qname", F.lit(" --"), "rel_type", F.lit("--> "), "dst", F.lit(": dst node missing"))
        parts.append(as_findings("graph.dangling-edge", loose.withColumnRenamed("src", "qname"), text, evidence="dst"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    level = F.lit("warning")
    for rule, (own, _) in RULES.items():
        level = F.when(F.col("rule_id") == rule, own).otherwise(level)
    return out.withColumn("level", level)


def per_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id")


def degrees(edges: DataFrame, top: int | None = None) -> DataFrame:
    """In- and out-degree together; with top, the largest ones."""
    d = edges.select(F.col("src").alias("qname")).unionAll(edges.select(F.col("dst").alias("qname"))).groupBy("qname").agg(F.count("*").alias("degree"))
    return d.orderBy(F.desc("degree"), "qname").limit(top) if top is not None else d
