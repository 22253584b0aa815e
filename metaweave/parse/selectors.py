"""The expression language of rules: paths, ten functions, and/or/not/equality, templates. An expression is parsed once and made into columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar
from .columns import Nodes, View, json_flag, json_text, json_value, texts_under

_TOKEN = re.compile(r"\s*(?:(?P<number>-?\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_@#][\w@#]*)|(?P<sign>\|\||&&|==|!=|[!().,\[\]*|]))")


class Value:
    """What an expression gives, as columns: text (string), bool, list (array of strings), nodes (Nodes), view (View) or const (a Python value)."""

    def __init__(self, kind: str, value: Any):
        self.kind, self.value = kind, value

    def text(self) -> Column:
        """As text; many texts with commas between them, nothing as empty text."""
        if self.kind in ("list", "nodes"):
            return F.array_join(self.value.texts() if self.kind == "nodes" else self.value, ",")
        if self.kind == "const":
            v = self.value
            return F.lit("" if v is None or isinstance(v, (dict, list)) else str(v).lower() if isinstance(v, bool) else str(v))
        if self.kind == "view":
            raise ValueError("a record isn't text")
        return F.coalesce(self.value.cast("string"), F.lit(""))

    def truth(self) -> Column:
        """JavaScript's truth: of texts any but the empty one; of elements false and zero are none, and many of them are true."""
        if self.kind == "bool":
            return F.coalesce(self.value, F.lit(False))
        if self.kind == "text":
            return F.coalesce(self.value != "", F.lit(False))
        if self.kind == "list":
            return self.value.isNotNull()
        if self.kind == "nodes":
            c = self.value.column
            return (F.size(c) > 1) | ((F.size(c) == 1) & (json_flag(F.get(c, F.lit(0)).cast("string")) == "true"))
        v = self.value
        return F.lit(self.kind == "view" or v is not None and v is not False and v != "" and v != 0)

    def texts(self) -> Column:
        """As an array of texts: one of what is no list."""
        if self.kind == "nodes":
            return self.value.texts()
        return self.value if self.kind == "list" else F.when(self.truth(), F.array(self.text())).otherwise(F.array().cast("array<string>"))

    def json(self) -> Column:
        if self.kind == "text":
            return json_text(self.value)
        if self.kind == "bool":
            return self.value.cast("string")
        if self.kind == "list":
            return F.coalesce(F.to_json(self.value), F.lit("null"))
        if self.kind == "nodes":
            c = self.value.texts()
            return F.when(F.size(c) > 1, F.concat(F.lit("["), F.array_join(F.transform(c, json_value), ","), F.lit("]"))).otherwise(json_value(F.get(c, F.lit(0))))
        return F.lit(json.dumps(self.value))


@dataclass
class Scope:
    """What `record`, `item`, `ns` and `caps` stand for."""

    record: View
    item: Value | None = None
    caps: Any = None


def step(value: Value, key: str) -> Value:
    """An element of a record, or of each of many; `*` is all items of a list."""
    if key == "*":
        return value if value.kind in ("nodes", "list") else Value("list", value.texts())
    if value.kind == "view":
        return Value("nodes", value.value.nodes(key))
    if value.kind == "nodes":
        return Value("nodes", value.value.step(key))
    return Value("const", value.value.get(key) if value.kind == "const" and isinstance(value.value, dict) else None)


def at_index(value: Value, k: Value) -> Value:
    """An item from 0, or nothing. An element that isn't repeated is its own first."""
    number = k.value if k.kind == "const" and isinstance(k.value, int) else -1
    if value.kind == "nodes":
        return Value("nodes", Nodes(F.slice(value.value.column, number + 1, 1) if number >= 0 else F.slice(value.value.column, 1, 0), value.value.shape))
    return Value("text", F.get(value.value, F.lit(number))) if value.kind == "list" else Value("const", None)


def constant(value: Value) -> str:
    if value.kind != "const":
        raise ValueError("a pattern, key or separator must be a constant")
    return str(value.value)


def under(value: Value, key: str) -> Column:
    """All texts under a key of elements that aren't asked for anything else, however deep."""
    return F.flatten(F.transform(value.texts(), lambda x: texts_under(x, key)))


def flagged(pattern: Value, flags: Value | None) -> str:
    return ("(?i)" if flags and "i" in constant(flags) else "") + constant(pattern)


FUNCTIONS = {
    "toString": lambda s, v: Value("text", v.text()),
    "lower": lambda s, v: Value("text", F.lower(v.text())),
    "bool": lambda s, v: Value("bool", v.truth()),
    "stripNs": lambda s, v: Value("text", s.record.local(v.text())),
    "split": lambda s, v, by: Value("list", F.split(v.text(), "\\Q" + constant(by) + "\\E")),
    "match": lambda s, v, pattern, flags=None: Value("text", scalar.first_match(v.text(), flagged(pattern, flags))),
    "matchAll": lambda s, v, pattern, flags=None: Value("list", scalar.all_matches(v.text(), flagged(pattern, flags))),
    "splitCsv": lambda s, v: Value("list", scalar.split_csv(v.text())),
    "walkAll": lambda s, v, key: Value("list", under(v, constant(key))),
    "stripPrefix": lambda s, v, prefix: Value("text", scalar.strip_prefix(v.text(), constant(prefix))),
}


class Expression:
    """Parsed once: `or` binds less than `and`, that less than equality, that less than `!`."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        end = len(source.rstrip())
        while at < end:
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"can't read {source!r} at {at}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.tree = self._or()
        self.raw = False
        if self._take("|"):
            if self._name() != "raw":
                raise ValueError(f"only `| raw` can follow in {source!r}")
            self.raw = True
        if self.at != len(self.tokens):
            raise ValueError(f"can't read all of {source!r}")

    def _take(self, sign: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] == ("sign", sign):
            self.at += 1
            return True
        return False

    def _need(self, sign: str) -> None:
        if not self._take(sign):
            raise ValueError(f"{sign!r} is missing in {self.source!r}")

    def _name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind not in ("name", "number") and (kind, value) != ("sign", "*"):
            raise ValueError(f"a name is missing in {self.source!r}")
        self.at += 1
        return value

    def _or(self):
        out = self._and()
        while self._take("||"):
            out = ("or", out, self._and())
        return out

    def _and(self):
        out = self._equal()
        while self._take("&&"):
            out = ("and", out, self._equal())
        return out

    def _equal(self):
        out = self._not()
        while True:
            if self._take("=="):
                out = ("eq", out, self._not())
            elif self._take("!="):
                out = ("ne", out, self._not())
            else:
                return out

    def _not(self):
        return ("not", self._not()) if self._take("!") else self._path()

    def _path(self):
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if self._take("("):
            out = self._or()
            self._need(")")
        elif kind == "number":
            self.at += 1
            out = ("value", float(value) if "." in value else int(value))
        elif kind == "string":
            self.at += 1
            out = ("value", re.sub(r"\\(['\"\\])", r"\1", value[1:-1]))
        else:
            name = self._name()
            if self._take("("):
                if name not in FUNCTIONS:
                    raise ValueError(f"no function {name!r}")
                args = []
                while not self._take(")"):
                    args.append(self._or())
                    if not self._take(","):
                        self._need(")")
                        break
                out = ("call", name, args)
            else:
                out = ("value", {"true": True, "false": False, "null": None}[name]) if name in ("true", "false", "null") else ("root", name)
        while True:
            if self._take("."):
                out = ("step", out, self._name())
            elif self._take("["):
                out = ("index", out, self._or())
                self._need("]")
            else:
                return out

    def __call__(self, scope: Scope) -> Value:
        return self._value(self.tree, scope)

    def _value(self, t, scope: Scope) -> Value:
        kind = t[0]
        if kind == "value":
            return Value("const", t[1])
        if kind == "root":
            roots = {"record": Value("view", scope.record), "item": scope.item, "ns": Value("text", scope.record.namespace), "caps": Value("const", scope.caps or {})}
            return roots.get(t[1]) or Value("const", None)
        if kind == "step":
            return step(self._value(t[1], scope), t[2])
        if kind == "index":
            return at_index(self._value(t[1], scope), self._value(t[2], scope))
        if kind == "call":
            return FUNCTIONS[t[1]](scope, *[self._value(a, scope) for a in t[2]])
        if kind == "not":
            return Value("bool", ~self._value(t[1], scope).truth())
        left, right = self._value(t[1], scope), self._value(t[2], scope)
        if kind in ("eq", "ne"):
            return Value("bool", self._same(left, right) if kind == "eq" else ~self._same(left, right))
        if left.kind == right.kind == "bool":
            return Value("bool", left.truth() | right.truth() if kind == "or" else left.truth() & right.truth())
        if left.kind == "const" and left.value is None:
            return right if kind == "or" else left
        return Value("text", F.when(left.truth(), left.text() if kind == "or" else right.text()).otherwise(right.text() if kind == "or" else left.text()))

    @staticmethod
    def _same(left: Value, right: Value) -> Column:
        """Texts are equal as they stand, truths with truths; nothing equals null only, a number what is written as it."""
        for a, b in ((left, right), (right, left)):
            if a.kind == "const" and a.value is None:
                return F.size(b.value.column) == 0 if b.kind == "nodes" else F.lit(b.value is None) if b.kind == "const" else F.lit(False) if b.kind == "view" else b.value.isNull()
        there = [v.value.isNotNull() if v.kind in ("text", "list") else F.size(v.value.column) > 0 if v.kind == "nodes" else F.lit(True) for v in (left, right)]
        return there[0] & there[1] & (left.text() == right.text())


class Template:
    """Text with `${expression}`; one expression alone keeps its kind. Texts lose the namespace, but for `| raw`."""

    def __init__(self, source: str):
        parts = re.split(r"\$\{((?:[^}'\"]|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")*)\}", source)
        self.parts = [Expression(p) if k % 2 else p for k, p in enumerate(parts)]
        self.alone = self.parts[1] if len(parts) == 3 and not parts[0] and not parts[2] else None

    def _text(self, e: Expression, scope: Scope) -> Column:
        return e(scope).text() if e.raw else scope.record.local(e(scope).text())

    def __call__(self, scope: Scope) -> Value:
        if self.alone:
            v = self.alone(scope)
            return Value("text", F.when(v.value.isNotNull(), scope.record.local(v.value))) if v.kind == "text" and not self.alone.raw else v
        return Value("text", self.text(scope))

    def text(self, scope: Scope) -> Column:
        return F.concat(*[self._text(p, scope) if isinstance(p, Expression) else F.lit(p) for p in self.parts])


def predicate(source: str, scope: Scope) -> Column:
    return (Template(source).alone if source.startswith("${") else Expression(source))(scope).truth()
