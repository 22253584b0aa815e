"""Declarative members as column plans: XML or JSON is read by Spark's own functions into just the elements that a type asks for.

A type's reader runs once, when the plan is made. It gets a View, which notes each element asked for and gives it as a column, and
returns arrays of facts. What was asked for becomes the schema that from_xml reads by, so one plan a type, without Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a table of facts.
SCHEMA = "kind string, org_id string, type string, qname string, dst string, attributes string, source_hash string, text string, start_line long, end_line long"
#: Fields that stand for the member's name unless its JSON has them.
NAMES = ("name", "object", "apiName")
XML_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "attributePrefix": "@_", "valueTag": "#text", "ignoreNamespace": "true"}
#: A number as it would be written back.
NUMBER = r"^-?(0|[1-9][0-9]{0,14})(\.[0-9]+)?$"


class Shape:
    """What is asked of an element: elements in it, or its text."""

    def __init__(self):
        self.children: dict[str, Shape] = {}
        self.as_text = False

    def child(self, name: str) -> Shape:
        return self.children.setdefault(name, Shape())

    def element(self) -> str:
        if self.children and self.as_text:
            raise ValueError(f"an element with {', '.join(self.children)} in it is asked for as text, too")
        return f"struct<{self.fields()}>" if self.children else "string"

    def fields(self) -> str:
        return ", ".join(f"`{k}` " + ("string" if k.startswith("@_") else f"array<{c.element()}>") for k, c in self.children.items())


class Nodes:
    """Elements of one name: one, many or none of them, as an array."""

    def __init__(self, column: Column, shape: Shape):
        self.column, self.shape = column, shape

    def step(self, name: str) -> Nodes:
        """The elements of that name in each of these."""
        child = self.shape.child(name)
        inner = F.filter(F.transform(self.column, lambda x: x[name]), lambda x: x.isNotNull())
        return Nodes(inner if name.startswith("@_") else F.flatten(inner), child)

    def texts(self) -> Column:
        self.shape.as_text = True
        return self.column


class View:
    """A record: the member itself, or an element while it is iterated over."""

    def __init__(self, field: Callable[[str], Column], shape: Shape, namespace: Column):
        self.field, self.shape, self.namespace = field, shape, namespace

    def nodes(self, name: str, *path: str) -> Nodes:
        column, child = self.field(name), self.shape.child(name)
        at = Nodes(F.when(column.isNotNull(), F.array(column)).otherwise(F.array()) if name.startswith("@_") else F.coalesce(column, F.array()), child)
        for step in path:
            at = at.step(step)
        return at

    def text(self, *path: str) -> Column:
        """The text at a path, the first of many; null without one."""
        return F.get(self.nodes(*path).texts(), F.lit(0))

    def local(self, name: Column) -> Column:
        """A name without the org's own namespace; empty for null."""
        own = F.concat(self.namespace, F.lit("__"))
        return F.coalesce(F.when((self.namespace != "") & name.startswith(own), F.substring(name, F.length(own) + 1, F.length(name))).otherwise(name), F.lit(""))

    def name(self, *path: str) -> Column:
        return self.local(self.text(*path))

    def first(self, *keys: str) -> Column:
        """The first of these fields that says anything, as a name."""
        return F.coalesce(*[F.nullif(self.name(k), F.lit("")) for k in keys], F.lit(""))

    def values(self, *keys: str) -> dict[str, Column]:
        return {k: json_value(self.text(k)) for k in keys}

    def flags(self, *keys: str) -> dict[str, Column]:
        return {k: json_flag(self.text(k)) for k in keys}


class Member(View):
    """The member, and what makes facts of it. A fact is a struct; whether it counts is its last field."""

    def __init__(self, shape: Shape):
        super().__init__(lambda name: F.col("__f")[name], shape, F.col("namespace"))

    def fact(self, kind: str, type_: str, qname: Column, dst: Column | None, attributes: dict[str, Column], hash_: Column | None, when: Column | None) -> Column:
        none = F.lit(None).cast("string")
        all_ = {"sourceUri": json_text(F.coalesce(F.col("source_uri"), F.lit("")))} | attributes
        text = F.concat(F.lit("{"), *[x for n, k in enumerate(sorted(all_)) for x in (F.lit(f'{", " if n else ""}"{k}": '), all_[k])], F.lit("}"))
        ok = F.coalesce(when, F.lit(False)) if when is not None else F.lit(True)
        columns = {"kind": F.lit(kind), "type": F.lit(type_), "qname": qname, "dst": none if dst is None else dst, "attributes": text, "source_hash": none if hash_ is None else hash_, "ok": ok}
        return F.struct(*[c.alias(k) for k, c in columns.items()])

    def node(self, label: str, qname: Column, attributes: dict[str, Column] | None = None, when: Column | None = None) -> Column:
        source = F.coalesce(F.nullif(F.col("__xml"), F.lit("")), F.nullif(F.col("__body"), F.lit("")))
        return self.fact("node", label, qname, None, attributes or {}, F.coalesce(F.sha2(source, 256), F.lit("")), when)

    def edge(self, rel: str, src: Column, dst: Column, attributes: dict[str, Column] | None = None, when: Column | None = None) -> Column:
        return self.fact("edge", rel, src, dst, attributes or {}, None, when)

    def to(self, rel: str, src: Column, target: str, name: Column, attributes: dict[str, Column] | None = None) -> Column:
        """An edge to what has that name; none without a name."""
        return self.edge(rel, src, F.concat(F.lit(f"{target}:"), name), attributes, name != "")

    def each(self, nodes: Nodes, facts: Callable[[View], list[Column]]) -> Column:
        """The facts of each element."""
        return F.flatten(F.transform(nodes.column, lambda x: F.array(*facts(View(lambda name: x[name], nodes.shape, self.namespace)))))

    def each_name(self, names: Column, fact: Callable[[Column], Column]) -> Column:
        """A fact of each text of an array."""
        return F.transform(names, lambda x: fact(self.local(x)))


Reader = Callable[[Member], list[Column]]


def json_text(value: Column) -> Column:
    """A text as JSON; `null` for null."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_value(value: Column) -> Column:
    """An element's text as JSON: booleans and numbers as such."""
    plain = F.when(value.contains("."), F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.$", "")).otherwise(value)
    return F.when(value.isin("true", "false"), value).when(value.rlike(NUMBER), plain).otherwise(json_text(value))


def json_flag(value: Column) -> Column:
    """Whether there is a value other than false, zero and nothing."""
    return F.coalesce(~value.rlike(r"^(false|-?0(\.0+)?)?$"), F.lit(False)).cast("string")


def root_name(xml: Column) -> Column:
    """The root element's name without a prefix."""
    return F.regexp_extract(xml, r"^(?s:\s|\x{FEFF}|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<(?:[^\s:<>/]+:)?([^\s:<>/]+)", 1)


def texts_under(raw: Column, name: str) -> Column:
    """The texts of all elements of a name in XML, however deep, in their order; those without text are left out."""
    found = F.regexp_extract_all(raw, F.lit(rf"<(?:[\w.-]+:)?{name}(?:\s[^<>]*)?>([^<]*)<"), F.lit(1))

    def plain(x: Column) -> Column:
        for sign, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
            x = F.replace(x, F.lit(code), F.lit(sign))
        return F.trim(x)

    return F.filter(F.transform(found, plain), lambda x: x != "")


def of_json(value: Column, key: str, shape: Shape) -> Column:
    """What is under a key of a variant, one or many, in the form of XML's elements; null without the key."""
    path = f"$['{key}']"
    one = F.try_variant_get(value, path, "variant")
    items = F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)))
    if not shape.children:
        return F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), lambda x: x.isNotNull())
    return F.transform(items, lambda x: F.struct(*[(F.try_variant_get(x, f"$['{k}']", "string") if k.startswith("@_") else of_json(x, k, c)).alias(k) for k, c in shape.children.items()]))


def plan(members: DataFrame, type_: str, root: str, read: Reader) -> DataFrame:
    """The facts (SCHEMA) of the members of one type. Their content is XML, or a JSON object of the fields (xml, body, object and others), whose values count
    before the XML's. No content, or XML that can't be read, gives a ParseError node."""
    shape = Shape()
    parts = read(Member(shape))
    kept = F.filter(F.concat(*parts), lambda f: f["ok"])
    content = F.coalesce("content", F.lit(""))
    is_json = F.ltrim(content).startswith("{")
    d = members.filter(F.col("member_type") == type_).withColumn("__j", F.when(is_json, F.try_parse_json(content)))
    plain = lambda key: F.try_variant_get("__j", f"$['{key}']", "string")
    d = d.withColumns({"__xml": F.when(is_json, plain("xml")).otherwise(content), "__body": plain("body")})
    d = d.withColumn("__x", F.from_xml("__xml", (shape.fields() + ", " if shape.children else "") + "__bad string", XML_OPTIONS))
    named = (F.length("__xml") > 0) & (root_name(F.col("__xml")) == root)
    fields = []
    for key, child in shape.children.items():
        given = plain(key) if key.startswith("@_") else F.when(F.col("__j").isNotNull(), of_json(F.col("__j"), key, child))
        own = F.array("member_name") if key in NAMES else F.when(named, F.col("__x")[key])
        fields.append(F.coalesce(given, own).alias(key))
    d = d.withColumn("__f", F.struct(*fields) if fields else F.struct(F.lit(None).alias("none")))
    broken = (F.length("__xml") > 0) & F.col("__x.__bad").isNotNull()
    error = lambda message: F.array(Member(Shape()).node("ParseError", F.concat(F.lit(f"ParseError:{type_}:"), "member_name"), {"message": json_text(F.lit(message))}).withField("source_hash", F.lit("")))
    facts = F.when(content == "", error("no content")).when(broken, error("the XML can't be read")).otherwise(kept)
    d = d.select("org_id", F.inline(facts))
    return d.select("kind", "org_id", "type", "qname", "dst", "attributes", "source_hash", F.lit(None).cast("string").alias("text"), *[F.lit(None).cast("long").alias(c) for c in ("start_line", "end_line")])
