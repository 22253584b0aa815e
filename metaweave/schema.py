"""The data model: a typed property graph in tables, and the names it allows."""

from __future__ import annotations

import re

from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


S, L, D, B = StringType(), LongType(), DoubleType(), BooleanType()

NODES = _struct(org_id=S, label=S, qname=S, attributes=S, source_hash=S, first_seen_at=L, last_seen_at=L, last_modified_at=L)
EDGES = _struct(org_id=S, rel_type=S, src=S, dst=S, attributes=S, first_seen_at=L, last_seen_at=L)
SNIPPETS = _struct(org_id=S, qname=S, format=S, text=S, start_line=L, end_line=L, hash=S, explanation=S, explained_at=L)
ORGS = _struct(id=S, alias=S, instance_url=S, api_version=S, created_at=L, last_synced_at=L)
SNAPSHOTS = _struct(id=S, org_id=S, label=S, created_at=L, is_auto=B)
SERVICE_IDS = _struct(org_id=S, service_id=S, qname=S, label=S, first_seen_at=L, last_seen_at=L)
FINDINGS = _struct(org_id=S, qname=S, rule_id=S, line=L, severity=S, message=S, evidence=S)
FAILURES = _struct(org_id=S, qname=S, text=S, error=S, attempts=L, batch=L)
MEMBERS = _struct(category=S, member_type=S, member_name=S, last_modified_at=L, source_uri=S, obsolete=B, namespace=S, content=S)

#: Key columns of each table.
KEYS = {"nodes": ["org_id", "qname"], "edges": ["org_id", "rel_type", "src", "dst"], "snippets": ["org_id", "qname"]}

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,63}")
_ALIAS = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,63}")
_ID = re.compile(r"[A-Za-z0-9]{15}(?:[A-Za-z0-9]{3})?")
#: Names that some file systems keep for themselves. Fixed values.
RESERVED = {"con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10))}


def check_name(name: str) -> str:
    """A label or relation: a letter, then up to 63 letters, digits and underscores."""
    if not _NAME.fullmatch(name or ""):
        raise ValueError(f"not a label or relation name: {name!r}")
    return name


def check_org(name: str) -> str:
    """An org identifier: an id of 15 or 18 letters and digits, or an alias: a letter, then up to 63 letters, digits, `_` and `-`; no reserved name."""
    if not isinstance(name, str) or name.lower() in RESERVED or not (_ID.fullmatch(name) or _ALIAS.fullmatch(name)):
        raise ValueError(f"not an org identifier: {name!r}")
    return name
