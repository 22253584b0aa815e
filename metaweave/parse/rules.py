"""Declarative rules: what nodes and edges a record gives, in the expression language."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Member, Nodes, Reader
from .selectors import Scope, Template, Value, predicate


@dataclass
class Emit:
    """A node (label, qname) or an edge (rel, src, dst): once, or for each item of `each`, if `when` holds."""

    kind: str
    src: str
    dst: str = ""
    each: str = ""
    when: str = ""
    props: dict[str, Any] = field(default_factory=dict)


@dataclass
class Rule:
    type: str
    root: str
    nodes: list[Emit]
    edges: list[Emit]
    input: str = "xml"
    applies_when: Any = None


def applies(condition: Any, caps: dict) -> bool:
    """always, capability, not, any_of, all_of; what there is no condition for always applies."""
    if condition is None:
        return True
    checks = {
        "always": lambda v: bool(v),
        "capability": lambda v: bool(caps.get(v)),
        "not": lambda v: not applies(v, caps),
        "any_of": lambda v: any(applies(x, caps) for x in v),
        "all_of": lambda v: all(applies(x, caps) for x in v),
    }
    return isinstance(condition, dict) and bool(condition) and all(k in checks and checks[k](v) for k, v in condition.items())


def reader(rule: Rule) -> Reader:
    """The rule as a reader of columns. A rule with an empty name at either end of an edge, or for a node, makes nothing there."""

    def facts(m: Member) -> list[Column]:
        def fact(e: Emit, edge: bool, scope: Scope) -> Column:
            src = Template(e.src).text(scope)
            props = {k: Template(v)(scope).json() if isinstance(v, str) else F.lit(json.dumps(v)) for k, v in e.props.items()}
            good = src != ""
            if e.when:
                good &= predicate(e.when, scope)
            if not edge:
                return m.node(e.kind, src, props, good)
            dst = Template(e.dst).text(scope)
            return m.edge(e.kind, src, dst, props, good & (dst != ""))

        def all_of(e: Emit, edge: bool) -> Column:
            scope = Scope(m, None, {})
            if not e.each:
                return F.array(fact(e, edge, scope))
            many = Template(e.each).alone(scope)
            if many.kind == "nodes":
                # an item is a list of one: whether it is a record or a text shows only when the rest has been read
                nodes = many.value
                return F.transform(nodes.column, lambda x: fact(e, edge, Scope(m, Value("nodes", Nodes(F.array(x), nodes.shape)), {})))
            return F.transform(many.texts(), lambda x: fact(e, edge, Scope(m, Value("text", x), {})))

        return [all_of(e, edge) for emits, edge in ((rule.nodes, False), (rule.edges, True)) for e in emits]

    return facts


def load_yaml(text: str) -> Rule:
    """A rule in YAML with the keys type, root, input, applies_when, nodes and edges; strict about keys."""
    import yaml

    d = yaml.safe_load(text)
    unknown = set(d) - {"type", "category", "root", "input", "applies_when", "nodes", "edges"}
    if unknown or "type" not in d:
        raise ValueError(f"rule has {sorted(unknown)}, or no type")
    emits = {}
    for part, name, first in (("nodes", "label", "qname"), ("edges", "relType", "src")):
        emits[part] = []
        for x in d.get(part) or []:
            odd = set(x) - {name, first, "dst", "iterate", "when", "props"}
            if odd:
                raise ValueError(f"{d['type']}: unknown {sorted(odd)}")
            emits[part].append(Emit(x[name], x[first], x.get("dst", ""), x.get("iterate", ""), x.get("when", ""), x.get("props") or {}))
    return Rule(d["type"], d.get("root", ""), emits["nodes"], emits["edges"], {"xml-string": "xml"}.get(d.get("input"), d.get("input", "xml")), d.get("applies_when"))
