"""A scan of Apex source for what runs into limits."""

from __future__ import annotations

import re

_LOOP = re.compile(r"\b(for|while|do)\b")
_QUERY = re.compile(r"\[\s*select\b", re.I)
_CHANGE = re.compile(r"\b(?:insert|update|upsert|delete|undelete|merge)\s+[A-Za-z_(]|\bDatabase\.(?:insert|update|upsert|delete|undelete|merge)\b", re.I)
_BOUND = re.compile(r"\b(?:where|limit)\b", re.I)
EVIDENCE = 200


#: A comment, or a string up to the sign that ends it (a quote, the end of a line, the end of it all).
_HIDDEN = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:\\[\s\S]|[^'\\\n])*[\s\S]?")
_SIGN = re.compile(r"[^\n]")


def _spaces(m: re.Match) -> str:
    text = m[0]
    if text[0] == "/":
        return _SIGN.sub(" ", text)
    return "'" + _SIGN.sub(" ", text[1:-1]) + text[-1] if len(text) > 1 else text


def blank(source: str) -> str:
    """The source with comments and the insides of strings as spaces: places and lines stay."""
    return _HIDDEN.sub(_spaces, source)


def loop_spans(code: str) -> list[tuple[int, int]]:
    """Where the bodies of loops lie: in braces after the head, or up to the next semicolon."""
    spans = []
    for m in _LOOP.finditer(code):
        at = m.end()
        if m[1] != "do":
            at = code.find("(", at)
            if at < 0:
                continue
            depth = 0
            while at < len(code):
                depth += (code[at] == "(") - (code[at] == ")")
                at += 1
                if not depth:
                    break
        while at < len(code) and code[at].isspace():
            at += 1
        if at < len(code) and code[at] == "{":
            depth, end = 0, at
            while end < len(code):
                depth += (code[end] == "{") - (code[end] == "}")
                end += 1
                if not depth:
                    break
        else:
            end = code.find(";", at)
            end = len(code) if end < 0 else end + 1
        spans.append((at, end))
    return spans


def scan_source(source: str) -> list[tuple[str, int, str]]:
    """(kind, line, evidence): queries and data changes in loops, queries without a condition or limit, triggers that never look at Trigger.new (line -1)."""
    code = blank(source)
    loops = loop_spans(code)
    inside = lambda at: any(a <= at < z for a, z in loops)
    found: dict[tuple[str, int], str] = {}

    def add(kind: str, at: int) -> None:
        line = code.count("\n", 0, at) + 1
        found.setdefault((kind, line), source.split("\n")[line - 1].strip()[:EVIDENCE])

    for m in _QUERY.finditer(code):
        end = code.find("]", m.end())
        if inside(m.start()):
            add("soql_in_loop", m.start())
        if not _BOUND.search(code, m.end(), end if end >= 0 else len(code)):
            add("unbounded_query", m.start())
    for m in _CHANGE.finditer(code):
        if inside(m.start()):
            add("dml_in_loop", m.start())
    if re.search(r"\btrigger\s+\w+\s+on\s+\w+", code, re.I) and not re.search(r"\bTrigger\s*\.\s*new", code, re.I):
        found["no_bulk", -1] = "trigger without Trigger.new iteration"
    return [(kind, line, text) for (kind, line), text in found.items()]
