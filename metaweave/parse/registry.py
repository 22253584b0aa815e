"""Member types and their parsers, and parsing as a DataFrame operator."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize
from . import apex, columns, lwc, markup, metadata, omni
from .base import Context, Facts, parse_json
from .columns import SCHEMA, Reader
from .rules import Rule, applies, reader

#: (name, content, context) -> Facts. The content of bundles, objects and rules with several fields is JSON.
Parser = Callable[[str, str, Context], Facts]
#: Facts that go to Spark at once, about: a member may have many.
ROWS = 10_000
_to_json = json.JSONEncoder(sort_keys=True).encode
_PARSERS: dict[str, Parser] = {}
#: Types that columns read: their root element and reader.
PLANS: dict[str, tuple[str, Reader]] = dict(metadata.READERS)


def register(kind: str, parser: Parser) -> None:
    """ValueError if the type has a parser."""
    if kind in _PARSERS or kind in PLANS:
        raise ValueError(f"{kind} has a parser already")
    _PARSERS[kind] = parser


def register_rule(rule: Rule) -> None:
    """A type that a rule describes; it is read by columns, as those of metadata are. A rule for other inputs than XML or JSON is refused."""
    if rule.input not in ("xml", "json", "object"):
        raise ValueError(f"{rule.type}: no input {rule.input!r}")
    if rule.type in _PARSERS or rule.type in PLANS:
        raise ValueError(f"{rule.type} has a parser already")
    PLANS[rule.type] = (rule.root or rule.type, reader(rule) if applies(rule.applies_when, {}) else lambda m: [])


def types() -> list[str]:
    return sorted([*_PARSERS, *PLANS])


def parse_member(kind: str, name: str, content: str, context: Context) -> Facts:
    """Facts of a member; types without a parser give an opaque node, and empty content an error."""
    if not content:
        return Facts(context).error(kind, name, "no content")
    parser = _PARSERS.get(kind)
    return parser(name, content, context) if parser else markup.parse_opaque(kind, name, content, context)


def _object(name: str, content: str, context: Context) -> Facts:
    d = parse_json(content) if content.lstrip().startswith("{") else {"objectXml": content}
    return markup.parse_object(d.get("apiName", name), d.get("objectXml", ""), context, d.get("fields"), d.get("recordTypes"), d.get("validationRules"))


def _bundle(name: str, content: str, context: Context) -> Facts:
    d = parse_json(content)
    return lwc.parse_bundle(d.get("bundleName", name), d.get("files", d), context)


register("ApexClass", apex.parse_class)
register("ApexTrigger", apex.parse_trigger)
register("LightningComponentBundle", _bundle)
register("Flow", markup.parse_flow)
register("CustomObject", _object)
register("MatchingRule", markup.parse_matching_rule)
register("VlocityDataRaptor", omni.parse_data_raptor)
register("OmniDataTransform", omni.parse_data_transform)
for _kind, _label in {"VlocityIntegrationProcedure": "IntegrationProcedure", "VlocityOmniScript": "OmniScript", "VlocityCard": "VlocityCard", "OmniProcess": "OmniProcess", "OmniIntegrationProcedure": "OmniIntegrationProcedure", "OmniUiCard": "OmniUiCard"}.items():
    register(_kind, lambda name, content, context, label=_label: omni.parse_elements(label, name, content, context))

def parse_members(members: DataFrame, now: int = 0, kinds: list[str] | None = None) -> DataFrame:
    """members: org_id, member_type, member_name, source_uri, namespace, content. Node, edge and snippet facts in one table, told by `kind`.

    Each declarative type is a plan of its own over its members, without Python; kinds, if known, names the types there are, and the others get
    no plan. Members are read once for each plan: give a table that is stored in order of member_type, so that a plan reads its part of the files. The rest
    is source code and trees, which need Python; it runs in Arrow batches, and a member that can't be parsed gives a ParseError node.
    """
    d = members.select("org_id", "member_type", "member_name", "source_uri", "namespace", "content")
    planned = [k for k in PLANS if kinds is None or k in kinds]
    out = [columns.plan(d, k, *PLANS[k]) for k in planned]
    if kinds is None or not planned or set(kinds) - set(planned):
        out.append(_parsed(d.filter(F.col("member_type").isNull() | ~F.col("member_type").isin(list(PLANS))), now))
    return reduce(DataFrame.unionByName, out)


def parse_stored(members: DataFrame, now: int = 0) -> DataFrame:
    """The facts of members that are written first, in order of member_type, so that sources are read once and each type's plan reads its part; then written themselves.

    Members are dealt by their names into some files for each core, so that every task parses some of each type, however few files they come from and however
    small they are when compressed.
    """
    parts = max(16, 2 * members.sparkSession.sparkContext.defaultParallelism)
    kept = materialize(members.repartition(parts, "member_type", "member_name").sortWithinPartitions("member_type"))
    kinds = [r.member_type for r in kept.select("member_type").distinct().collect()]  # some dozens
    return materialize(parse_members(kept, now, kinds))


def _parsed(members: DataFrame, now: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [c.split() for c in SCHEMA.split(", ")]
        kinds = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in fields])
        rows: list[tuple] = []
        cut = lambda: pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
        for b in batches:
            for m in b.to_pylist():
                org, kind, name = m["org_id"], m["member_type"], m["member_name"]
                context = Context(org, m["source_uri"] or "", now, m["namespace"])
                try:
                    f = parse_member(kind, name, m["content"] or "", context)
                except Exception as error:  # one member must not end the sync
                    f = Facts(context).error(kind, name, f"{type(error).__name__}: {error}")
                rows += [("node", org, t, q, None, _to_json(a), h, None, None, None) for t, q, a, h in f.nodes]
                rows += [("edge", org, t, s, d, _to_json(a), None, None, None, None) for t, s, d, a in f.edges]
                rows += [("snippet", org, t, q, None, None, None, text, x, y) for q, t, text, x, y in f.snippets]
                if len(rows) >= ROWS:
                    yield cut()
                    rows.clear()
        if rows:
            yield cut()

    return members.mapInArrow(run, SCHEMA)


def nodes_of(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'node'").select("org_id", F.col("type").alias("label"), "qname", "attributes", "source_hash")


def edges_of(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'edge'").select("org_id", F.col("type").alias("rel_type"), F.col("qname").alias("src"), "dst", "attributes")


def snippets_of(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'snippet'").select("org_id", "qname", F.col("type").alias("format"), "text", "start_line", "end_line", F.sha2("text", 256).alias("hash"))
