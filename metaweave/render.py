"""Results as text: diagrams, tables and SARIF. What is drawn is small: caps hold before anything reaches the driver."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.audit import RULES, degrees
from .operators.traverse import induced

#: Nodes of a diagram.
CAP = 40
#: Order of the layers of a sequence.
LAYERS = ["LWC", "Apex", "SOQL", "Field"]


def diagram_id(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def diagram_label(name: str) -> str:
    short = name if len(name) <= 30 else name[:27] + "\u2026"
    return re.sub(r"[\[\]()]", "_", short.replace('"', "'"))


def dependency_graph(nodes: DataFrame, edges: DataFrame, focus: str | None = None, cap: int = CAP) -> str:
    """A flowchart of the most connected nodes (and the focus), with a class for each label."""
    top = degrees(edges, cap).select("qname")
    if focus:
        top = top.unionByName(top.sparkSession.createDataFrame([(focus,)], "qname string")).distinct()
    drawn = top.join(nodes.select("qname", "label"), "qname", "left").withColumn("label", F.coalesce("label", F.lit("Unknown"))).orderBy("qname").collect()
    lines = ["flowchart LR"] + [f'  {diagram_id(r.qname)}["{diagram_label(r.qname)}"]:::{r.label}' for r in drawn]
    links = induced(edges.select("src", "dst", "rel_type"), top).distinct().orderBy("src", "dst", "rel_type").collect()
    lines += [f"  {diagram_id(r.src)} -->|{r.rel_type}| {diagram_id(r.dst)}" for r in links]
    return "\n".join(lines + [f"  classDef {label} stroke-width:1px" for label in sorted({r.label for r in drawn})])


def diff_graph(diff: DataFrame, cap: int = CAP) -> str:
    rows = diff.orderBy("change", "qname").limit(cap).collect()
    lines = ["flowchart TB"] + [f'  {diagram_id(r.qname)}["{diagram_label(r.qname)}"]:::{r.change}' for r in rows]
    return "\n".join([*lines, "  classDef added stroke:#0a0", "  classDef removed stroke:#a00", "  classDef changed stroke:#aa0"])


def wip_graph(changes: DataFrame, dependents: DataFrame, cap: int = CAP) -> str:
    """changes: qname, change; dependents: qname, seed, covered."""
    text = diff_graph(changes, cap)
    rows = dependents.orderBy("seed", "qname").limit(cap).collect()
    lines = [f'  {diagram_id(r.qname)}["{diagram_label(r.qname)}"]:::{"covered" if r.covered else "uncovered"}\n  {diagram_id(r.seed)} --> {diagram_id(r.qname)}' for r in rows]
    return "\n".join([text, *lines, "  classDef covered stroke:#0a0", "  classDef uncovered stroke:#a0a"])


def layer(qname: str) -> str:
    """The layer that a name's label belongs to; others are layers of their own, after these."""
    label = qname.partition(":")[0]
    known = {"LightningComponentBundle": "LWC", "CustomField": "Field", "CustomObject": "SOQL"}
    return "Apex" if label.startswith("Apex") else known.get(label, label)


def sequence(participants: list[str], messages: list[tuple[str, str, str]]) -> str:
    place = {n: k for k, n in enumerate(LAYERS)}
    ordered = sorted(dict.fromkeys(participants), key=lambda q: place.get(layer(q), len(LAYERS)))
    lines = ["sequenceDiagram"] + [f"  participant {diagram_id(q)} as {diagram_label(q)}" for q in ordered]
    return "\n".join(lines + [f"  {diagram_id(a)} ->> {diagram_id(b)}: {diagram_label(rel)}" for a, rel, b in messages])


def markdown_table(df: DataFrame, limit: int = 20) -> str:
    rows = df.limit(limit).collect()
    text = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(text(v) for v in r) + " |" for r in rows]])


def sarif(findings: DataFrame, version: str = "1.0.0", cap: int = 5000) -> dict[str, Any]:
    """SARIF 2.1.0 of the first findings in order of rule and name: only rules that are referred to, with a stub for ones unknown. The run's properties say whether there were more than cap."""
    rows = findings.orderBy("rule_id", "qname").limit(cap + 1).collect()
    truncated, rows = len(rows) > cap, rows[:cap]
    used = sorted({r.rule_id for r in rows})
    rules = [{"id": r, "shortDescription": {"text": RULES[r][1] if r in RULES else r}, "defaultConfiguration": {"level": RULES[r][0] if r in RULES else "warning"}} for r in used]
    results = []
    for r in rows:
        d = r.asDict()
        place: dict[str, Any] = {"logicalLocations": [{"fullyQualifiedName": r.qname}]}
        if d.get("uri"):
            place["physicalLocation"] = {"artifactLocation": {"uri": d["uri"]}} | ({"region": {"startLine": d["line"]}} if (d.get("line") or 0) > 0 else {})
        results.append({"ruleId": r.rule_id, "ruleIndex": used.index(r.rule_id), "level": d.get("level") or "warning", "message": {"text": d.get("message") or r.rule_id}, "locations": [place]})
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "metaweave", "version": version, "rules": rules}}, "results": results, "properties": {"truncated": truncated}}]}


def lint_sarif(doc: dict[str, Any]) -> list[str]:
    """What is wrong with a SARIF document: version, runs, results of rules that aren't defined, levels, messages."""
    wrong = [] if doc.get("version") == "2.1.0" else ["version must be 2.1.0"]
    runs = doc.get("runs")
    if not isinstance(runs, list) or not runs:
        return [*wrong, "runs are missing"]
    for run in runs:
        known = {r["id"] for r in run.get("tool", {}).get("driver", {}).get("rules", [])}
        for k, result in enumerate(run.get("results", [])):
            if result.get("ruleId") not in known:
                wrong.append(f"result {k}: rule {result.get('ruleId')} is not defined")
            if result.get("level") not in ("none", "note", "warning", "error"):
                wrong.append(f"result {k}: level {result.get('level')}")
            if not result.get("message", {}).get("text"):
                wrong.append(f"result {k}: no message")
    return wrong


def to_json(doc: Any) -> str:
    return json.dumps(doc, indent=2, sort_keys=True)
