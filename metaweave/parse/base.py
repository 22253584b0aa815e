"""What parsers share: facts, names, XML and JSON as plain values."""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Context:
    org: str = "org1"
    uri: str = ""
    at: int = 0
    namespace: str | None = None
    caps: dict[str, Any] = field(default_factory=dict)


@dataclass
class Facts:
    """nodes: (label, qname, attributes, hash); edges: (rel_type, src, dst, attributes); snippets: (qname, format, text, first line, last line)."""

    context: Context
    nodes: list[tuple] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)
    snippets: list[tuple] = field(default_factory=list)
    hashed: tuple[str, str] = ("", "")  # the last source, as many nodes may have one, and its hash

    def node(self, label: str, qname: str, attributes: dict | None = None, source: str = "") -> str:
        if source and source is not self.hashed[0]:
            self.hashed = source, sha256(source)
        self.nodes.append((label, qname, {"sourceUri": self.context.uri, **(attributes or {})}, self.hashed[1] if source else ""))
        return qname

    def edge(self, rel: str, src: str, dst: str, attributes: dict | None = None, line: int | None = None) -> None:
        where = {"sourceUri": self.context.uri} | ({"line": line} if line is not None else {})
        self.edges.append((rel, src, dst, where | (attributes or {})))

    def snippet(self, qname: str, kind: str, text: str, first: int | None = None, last: int | None = None) -> None:
        self.snippets.append((qname, kind, text, first, last))

    def error(self, kind: str, name: str, message: str) -> Facts:
        self.node("ParseError", f"ParseError:{kind}:{name}", {"message": message})
        return self


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def local(name: Any, namespace: str | None) -> str:
    """A name without `namespace__` at its start."""
    text = "" if name is None else str(name)
    return text[len(namespace) + 2 :] if namespace and text.startswith(namespace + "__") else text


def many(value: Any) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def scalar(text: str) -> Any:
    """Text of an element: booleans and numbers (as they'd be written back) as such."""
    t = text.strip()
    if t in ("true", "false"):
        return t == "true"
    if re.fullmatch(r"-?(?:0|[1-9]\d{0,14})", t):
        return int(t)
    if re.fullmatch(r"-?(?:0|[1-9]\d{0,14})\.\d+", t):
        number = float(t)
        return int(number) if number.is_integer() else number
    return t


def _element(e: ET.Element) -> Any:
    out: dict[str, Any] = {f"@_{k.rpartition('}')[2]}": v for k, v in e.attrib.items()}
    for child in e:
        key, value = child.tag.rpartition("}")[2], _element(child)
        out[key] = [*many(out[key]), value] if key in out else value
    text = (e.text or "").strip()
    if not out:
        return scalar(text)
    if text:
        out["#text"] = scalar(text)
    return out


def parse_xml(text: str) -> tuple[str, Any]:
    """The root's name and its value: elements as dicts, repeated ones as lists. Raises ValueError for what isn't XML."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as error:
        raise ValueError(str(error)) from None
    return root.tag.rpartition("}")[2], _element(root)


def as_dict(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def parse_json(value: Any) -> Any:
    if not isinstance(value, str):
        return value if value is not None else {}
    try:
        return json.loads(value)
    except ValueError:
        return {}


def each_object(value: Any):
    """Every dict in a tree, from the outside."""
    if isinstance(value, dict):
        yield value
        value = list(value.values())
    if isinstance(value, list):
        for v in value:
            yield from each_object(v)


_FIELD = re.compile(r"\b([A-Z]\w*?(?:__r)?)\.([A-Z]\w*)\b")


def field_refs(text: str) -> list[str]:
    """The distinct `Object.Field` in a text, in order; relations lose their suffix."""
    return list(dict.fromkeys(f"{a.removesuffix('__r')}.{b}" for a, b in _FIELD.findall(text)))
