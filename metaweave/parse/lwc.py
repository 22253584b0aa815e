"""Lightning web component bundles: script, markup and settings."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .base import Context, Facts, as_dict, local, many, parse_xml

_IMPORT = re.compile(r"^\s*import\s+(?:(\w+)|\{([^}]*)\}|\*\s+as\s+(\w+))?(?:\s*,\s*\{([^}]*)\})?\s*(?:from\s*)?['\"]([^'\"]+)['\"]", re.M)
_WIRE = re.compile(r"@wire\s*\(\s*(\w+)")
_EVENT = re.compile(r"\bnew\s+CustomEvent\s*\(\s*['\"]([^'\"]+)['\"]")


def _without_comments(code: str) -> str:
    return re.sub(r"/\*.*?\*/|(?<![:'\"])//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.S)


def parse_script(out: Facts, q: str, code: str) -> dict[str, str]:
    """What a script imports, wires, calls and dispatches; local names of imported fields."""
    ns = out.context.namespace
    code = _without_comments(code)
    if code.count("{") != code.count("}") or code.count("(") != code.count(")"):
        out.error("LWC", q, "brackets don't match")
        return {}
    apex: dict[str, str] = {}
    fields: dict[str, str] = {}
    for m in _IMPORT.finditer(code):
        name, module = m[1] or "", m[5]
        line = code.count("\n", 0, m.start(5)) + 1
        parts = module.split("/")
        if parts[0] == "@salesforce" and len(parts) >= 3:
            kind, rest = parts[1], "/".join(parts[2:])
            if kind == "apex":
                owner, _, method = rest.rpartition(".")
                target = f"ApexMethod:{local(owner.rpartition('.')[2] or owner, ns)}.{method}(?)"
                apex[name] = target
                out.edge("IMPORTS_APEX", q, target, {"local": name}, line)
            elif kind == "resourceUrl":
                out.edge("IMPORTS_STATIC_RESOURCE", q, f"StaticResource:{local(rest, ns)}", line=line)
            elif kind == "label":
                out.edge("IMPORTS_CUSTOM_LABEL", q, f"CustomLabel:{local(rest.removeprefix('c.'), ns)}", line=line)
            elif kind == "schema":
                obj, _, field = rest.partition(".")
                if field:
                    fields[name] = f"CustomField:{local(obj, ns)}.{local(field, ns)}"
                    out.edge("READS_FIELD", q, fields[name], line=line)
                else:
                    out.edge("REFERENCES_OBJECT", q, f"CustomObject:{local(obj, ns)}", line=line)
    for m in _WIRE.finditer(code):
        if m[1] in apex:
            out.edge("USES_WIRE", q, apex[m[1]], line=code.count("\n", 0, m.start()) + 1)
    for name, target in apex.items():
        for m in re.finditer(rf"(?<![\w.@(]){re.escape(name)}\s*\(", code):
            out.edge("CALLS_APEX_FROM_LWC", q, target, line=code.count("\n", 0, m.start()) + 1)
    for event in dict.fromkeys(_EVENT.findall(code)):
        out.edge("DISPATCHES_EVENT", q, f"LWCEvent:{event}")
    return fields


class Markup(HTMLParser):
    """Tags with a dash embed components; on… attributes listen; {expression} binds; directives bind too."""

    def __init__(self, out: Facts, q: str, fields: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.out, self.q, self.fields, self.seen = out, q, fields, set()
        self.loops: list[str] = []

    def _once(self, rel: str, dst: str, attributes: dict) -> None:
        if (rel, dst) not in self.seen:
            self.seen.add((rel, dst))
            self.out.edge(rel, self.q, dst, attributes, self.getpos()[0])

    def _bind(self, expression: str, directive: str | None = None) -> None:
        expression = expression.strip()
        root, _, rest = expression.partition(".")
        if root in self.loops or not re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)*", expression):
            return
        how = {"binding": expression} | ({"directive": directive} if directive else {})
        if root in self.fields:
            self._once("LWC_BINDS_FIELD", self.fields[root], how)
        elif directive is None and (m := re.fullmatch(r"(?:\w+\.)*fields\.(\w+)\.value", expression)):
            self._once("LWC_BINDS_FIELD", f"CustomField:{m[1]}", how)
        else:
            self._once("LWC_BINDS_PROPERTY", f"LWCProperty:{expression}", how)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if "-" in tag:
            prefix, _, rest = tag.partition("-")
            if prefix == "c":
                words = rest.split("-")
                self._once("EMBEDS_LWC", f"LWC:{words[0]}{''.join(w[:1].upper() + w[1:] for w in words[1:])}", {"tag": tag})
            elif prefix != "lightning":
                self._once("EMBEDS_AURA", f"AuraComponent:{prefix}:{rest}", {"tag": tag})
        for name, value in attrs:
            value = value or ""
            inner = value[1:-1] if value.startswith("{") and value.endswith("}") else None
            if name in ("for:item", "for:index"):
                self.loops.append(value)
            elif name.startswith("on") and len(name) > 2 and inner is not None:
                self._once("LISTENS_TO_EVENT", f"LWCEvent:{name[2:]}", {"handler": inner})
            elif inner is not None:
                directive = name if name in ("if:true", "if:false", "lwc:if", "lwc:elseif", "for:each") or name.startswith("iterator:") else None
                if name.startswith("iterator:"):
                    self.loops.append(name.partition(":")[2])
                self._bind(inner, directive)

    handle_startendtag = handle_starttag

    def handle_data(self, data: str) -> None:
        for expression in re.findall(r"\{([^{}]+)\}", data):
            self._bind(expression)


def parse_bundle(name: str, files: dict[str, str], context: Context) -> Facts:
    """A component and its bundle: scripts first, so that markup knows imported fields. The hash doesn't depend on the files' order."""
    out = Facts(context)
    own = local(name, context.namespace)
    source = "\x00".join(f"{k}\x00{files[k]}" for k in sorted(files))
    meta: dict = {}
    for file, text in files.items():
        if file.endswith("-meta.xml"):
            try:
                x = as_dict(parse_xml(text)[1])
            except ValueError:
                continue
            meta = {"apiVersion": x.get("apiVersion"), "isExposed": x.get("isExposed") is True, "masterLabel": x.get("masterLabel"), "targets": [str(t) for t in many(as_dict(x.get("targets")).get("target"))]}
    q = out.node("LWC", f"LWC:{own}", {"name": own, **meta}, source)
    bundle = out.node("LWCBundle", f"LWCBundle:{own}", {"name": own, "files": sorted(files)}, source)
    out.edge("CONTAINS_COMPONENT", bundle, q)
    fields: dict[str, str] = {}
    for file in sorted(files):
        if file.endswith(".js"):
            fields |= parse_script(out, q, files[file])
            out.snippet(q, "js", files[file], 1, files[file].count("\n") + 1)
    for file in sorted(files):
        if file.endswith(".html"):
            Markup(out, q, fields).feed(files[file])
    return out
