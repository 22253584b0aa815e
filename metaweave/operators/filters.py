"""Filters on names, and ordered, capped reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize


def glob_to_regex(pattern: str, separator: str = "/") -> str:
    """`*` and `?` stop at the separator, `**` doesn't; [..] and [!..] are classes, {a,b} alternatives."""
    out, i, depth = "", 0, 0
    stop = re.escape(separator)
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += f"[^{stop}]*"
        elif c == "?":
            out += f"[^{stop}]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", r"\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def find_by_glob(nodes: DataFrame, pattern: str, label: str | None = None, limit: int = 500, separator: str = "/") -> tuple[DataFrame, int]:
    """The first matches by qname, and how many there are in all. The fixed start of the pattern reaches the scan."""
    d = nodes.filter(F.col("label") == label) if label else nodes
    fixed = re.match(r"[^*?\[{\\]*", pattern)[0]
    if fixed:
        d = d.filter(F.col("qname").startswith(fixed))
    d = d.filter(F.col("qname").rlike(glob_to_regex(pattern, separator)))
    return d.orderBy("qname").limit(limit), d.count()


def edges_like(edges: DataFrame, pattern: str, rel: str | None = None, limit: int | None = None) -> DataFrame:
    """Edges whose target is LIKE the pattern, whatever its case; the limit is on all relations together."""
    d = edges.filter(F.col("rel_type") == rel) if rel else edges
    d = d.filter(F.col("dst").ilike(pattern))
    return d.orderBy("rel_type", "src", "dst").limit(limit) if limit is not None else d


def search(nodes: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """Nodes whose qname contains the text (of two characters at least), whatever its case."""
    if len(text) < 2:
        return nodes.limit(0)
    return nodes.filter(F.lower("qname").contains(text.lower())).orderBy("qname").limit(limit)


def in_scope(qname: Column, object_name: str | None = None, field: str | None = None) -> Column:
    """Whether a qname is the field of the object, or the object or any field of it if no field is given; all are without an object.

    The object may have a label before it, and the field may be a whole qname.
    """
    bare = F.substring_index(qname, ":", -1)
    if field and ":" in field:
        return qname == field
    if not object_name:
        return F.lit(True)
    name = object_name.split(":")[-1]
    return bare == f"{name}.{field}" if field else bare.startswith(name + ".") | (bare == name)


def adjacent(edges: DataFrame, qname: str, reverse: bool = False, rel: str | None = None) -> DataFrame:
    d = edges.filter(F.col("dst" if reverse else "src") == qname)
    return d.filter(F.col("rel_type") == rel) if rel else d


def nodes_by_label(nodes: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    d = nodes.filter(F.col("label") == label)
    return d.orderBy("qname").limit(limit) if limit is not None else d


def first_of_labels(nodes: DataFrame, cap: int | None) -> tuple[DataFrame, bool]:
    """The first nodes of each label by qname, as many as cap says, and whether a label has so many; all without a cap. A task keeps cap rows a label before they meet."""
    if cap is None:
        return nodes, False
    kept = materialize(nodes.withColumn("__place", F.row_number().over(Window.partitionBy("label").orderBy("qname"))).filter(F.col("__place") <= cap))
    return kept.drop("__place"), not kept.filter(F.col("__place") == cap).isEmpty()


def get_node(nodes: DataFrame, org: str, qname: str) -> DataFrame:
    return nodes.filter((F.col("org_id") == org) & (F.col("qname") == qname))
