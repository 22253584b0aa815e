"""Scalar functions on names, texts and JSON, as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How deep strings are looked for in JSON.
MAX_DEPTH = 32


def strip_namespace(name: Column, namespace: str | None) -> Column:
    """Without `namespace__` at its start."""
    return F.when(name.startswith(f"{namespace}__"), F.substring(name, F.lit(len(namespace) + 3), F.length(name))).otherwise(name) if namespace else name


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def split_at(text: Column, separator: str, index: int) -> Column:
    """The part at an index from 0; null beyond the last."""
    return F.get(F.split(text, "\\Q" + separator + "\\E"), F.lit(index))


def to_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def truthy(value: Column) -> Column:
    """JavaScript's truth of a string: any but null and the empty one, `false` too."""
    return value.isNotNull() & (value != "")


def first_match(text: Column, pattern: str) -> Column:
    """The first group of the first match, or all of it without groups; empty without a match."""
    import re

    return F.coalesce(F.regexp_extract(text, pattern, 1 if re.compile(pattern).groups else 0), F.lit(""))


def all_matches(text: Column, pattern: str) -> Column:
    import re

    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if re.compile(pattern).groups else 0))


def split_csv(text: Column) -> Column:
    """The parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def bare_name(qname: Column) -> Column:
    return F.regexp_replace(qname, "^[^:]*:", "")


def normalize_key(qname: Column, namespace: str | None = None) -> Column:
    """The bare name in lower case, without the org's own namespace and a flavour prefix. Other namespaces stay: they are other packages."""
    return F.lower(F.regexp_replace(strip_namespace(bare_name(qname), namespace), "(?i)^(DR_|IP_|OS_|VC_|OMNI_)", ""))


def formula_fields(formula: Column) -> Column:
    """The distinct `Object.Field` of a formula in their order, relations without their suffix. Both names start with a capital."""
    found = F.regexp_extract_all(formula, F.lit(r"\b[A-Z]\w*\.[A-Z]\w*\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"__r\.", ".")))


def kebab_to_camel(name: Column) -> Column:
    parts = F.split(name, "-")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def bundle_hash(files: Column) -> Column:
    """sha256 over the names and contents of a map of files, each with a zero byte after it, whatever their order."""
    entries = F.array_sort(F.map_entries(files))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\x00"), F.coalesce(e["value"], F.lit("")), F.lit("\x00"))), ""), 256)


def diagram_id(qname: Column) -> Column:
    return F.regexp_replace(qname, "[^A-Za-z0-9_]", "_")


def diagram_label(text: Column) -> Column:
    """At most 30 signs, without quotes and brackets."""
    short = F.when(F.length(text) > 30, F.concat(F.substring(text, 1, 27), F.lit("\u2026"))).otherwise(text)
    return F.regexp_replace(F.replace(short, F.lit('"'), F.lit("'")), r"[\[\]()]", "_")


def layer(label: Column) -> Column:
    """The layer of a sequence that a label belongs to; others are layers of their own."""
    return F.when(label.isin("LWC", "LightningComponentBundle"), "LWC").when(label.startswith("Apex"), "Apex").when(label == "CustomField", "Field").when(label == "CustomObject", "SOQL").otherwise(label)


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) of an offset (from 0)."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def evidence(text: Column) -> Column:
    return F.substring(F.trim(text), 1, 200)


#: Secrets and personal data and what stands for them, in the order they are looked for. Fixed values.
SCRUBS = [
    (r"(?i)Authorization:\s*Bearer\s+[A-Za-z0-9._\-+/=]+", "<bearer-token>"),
    (r"\bBearer\s+[A-Za-z0-9._\-+/=]+", "<bearer-token>"),
    (r"\b00D[0-9A-Za-z]{12,15}![A-Za-z0-9._\-+/=]+", "<sf-session>"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "<email>"),
    (r"\b[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*\.(?:my\.salesforce\.com|lightning\.force\.com|visualforce\.com|cloudforce\.com|salesforce\.com|force\.com)\b", "<sf-host>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b[A-Za-z]:\\[^\s\"']*", "<path>"),
    (r"(?:/Users|/home|/var|/tmp|/private|/opt|/etc)/[^\s\"':,]*", "<path>"),
    (r"\b(?:001|003|005|006|00D|00e|00G|00Q|00T|00U|01p|a00|a01|a02|a03|a04|a05|a06|a07|a08|a09|0WO|0WP)[A-Za-z0-9]{12}(?:[A-Za-z0-9]{3})?\b", "<sf-id>"),
]


def scrub(text: Column) -> Column:
    for pattern, name in SCRUBS:
        text = F.regexp_replace(text, pattern, name)
    return text


def scrub_value(value, depth: int = 0):
    """scrub() for all strings of a nested value; what lies deeper than ten levels is left out."""
    import re

    if depth > 10:
        return "<max-depth>"
    if isinstance(value, str):
        for pattern, name in SCRUBS:
            value = re.sub(pattern, name, value, flags=re.ASCII)
        return value
    if isinstance(value, list):
        return [scrub_value(v, depth + 1) for v in value]
    return {k: scrub_value(v, depth + 1) for k, v in value.items()} if isinstance(value, dict) else value


def json_with(attributes: Column, fields: dict[str, Column]) -> Column:
    """A JSON object with further fields (those that aren't null), which it doesn't have."""
    body, extra = F.trim(F.coalesce(attributes, F.lit("{}"))), F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    return F.when(extra == "{}", body).when(body.isin("{}", ""), extra).otherwise(F.concat(F.regexp_replace(body, r"\s*\}$", ""), F.lit(","), F.substring(extra, F.lit(2), F.length(extra))))


#: Words of an error (in capitals) and why a source was skipped, then, in the order they are looked for. Fixed values.
SKIPS = [
    ("insufficient_access", ("INSUFFICIENT", "FORBIDDEN")),
    ("not_found", ("NOT_FOUND", "INVALID_TYPE")),
    ("rate_limit", ("REQUEST_LIMIT_EXCEEDED", "RATE_LIMIT")),
    ("network", ("ECONNREFUSED", "ENOTFOUND", "ETIMEDOUT")),
]
UNKNOWN = "unknown"


def skip_category(message: Column) -> Column:
    """Why a source was skipped, by words of its error."""
    m, out = F.upper(message), F.lit(UNKNOWN)
    for name, words in reversed(SKIPS):
        out = F.when(F.greatest(*[m.contains(w) for w in words], F.lit(False)), name).otherwise(out)
    return out


def _leaves(value, path: str = "", key: str | None = None, depth: int = 0) -> Iterator[tuple[str, str | None, str]]:
    """Path, nearest key and value of every string."""
    if depth > MAX_DEPTH:
        return
    if isinstance(value, str):
        yield path, key, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}" if path else k, k, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, path, key, depth + 1)


def json_leaves(rows: DataFrame, json_col: str = "attributes") -> DataFrame:
    """The other columns (strings) with path, nearest key and value of every string in the JSON. How deep it goes isn't known, so it is walked in Python, in Arrow batches."""
    others = [c for c in rows.columns if c != json_col]
    columns = [*others, "path", "key", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, *own in zip(*(b.column(c).to_pylist() for c in (json_col, *others))):
                try:
                    value = json.loads(text) if text else None
                except ValueError:
                    continue
                out += [(*own, p, k, v) for p, k, v in _leaves(value)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=columns)

    return rows.mapInArrow(run, ", ".join(f"{c} string" for c in columns))
