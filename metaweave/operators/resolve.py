"""Resolvers: edges rewritten or added once all parts of a graph are merged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import json_leaves, json_with, normalize_key
from ..tables import materialize


@dataclass
class Resolved:
    edges: DataFrame
    counters: DataFrame
    made: DataFrame | None = None
    gone: DataFrame | None = None


def method_parts(qname: Column) -> tuple[Column, Column, Column]:
    """Class, method and arity (null if `?`) of ApexMethod:Class.method(arity)."""
    body = F.regexp_replace(qname, "^[^:]*:", "")
    return F.regexp_extract(body, r"^(.*)\.[^.(]+\(", 1), F.regexp_extract(body, r"([^.(]+)\([^)]*\)$", 1), F.try_to_number(F.regexp_extract(body, r"\((\d+)\)$", 1), F.lit("999999999")).cast("int")


#: Names of methods of unknown and of known arity: class, method, arity. Fixed values.
STRANDED, KNOWN = r"^ApexMethod:(.+)\.([A-Za-z_]\w*)\(\?\)$", r"^ApexMethod:(.+)\.([A-Za-z_]\w*)\((\d+)\)$"


def resolve_arity(edges: DataFrame, methods: DataFrame, limit: int | None = None) -> Resolved:
    """Edges of any relation to a method of unknown arity, `(?)`, become edges to each of its overloads; those without any stay as they are.

    New edges keep the old one's attributes (JSON) but unresolvedArity, and its times; resolvedBy, ambiguous and overloadCount say how they came about. made and gone
    are the edges that differ, edges all after that. Overloads are gathered by class and method before the join, so an edge only fans out to them.
    Counters: scanned, resolved (with any overload), ambiguous (with several), missing (with none), emitted (new edges).
    """
    loose = edges.filter(F.col("dst").startswith("ApexMethod:") & F.col("dst").endswith("(?)"))
    loose = loose.orderBy("rel_type", "src", "dst").limit(limit) if limit is not None else loose
    loose = loose.withColumns({"c": F.regexp_extract("dst", STRANDED, 1), "m": F.regexp_extract("dst", STRANDED, 2)})
    overloads = methods.filter(F.col("qname").rlike(KNOWN)).select(F.regexp_extract("qname", KNOWN, 1).alias("c"), F.regexp_extract("qname", KNOWN, 2).alias("m"), "qname")
    overloads = overloads.groupBy("c", "m").agg(F.collect_set("qname").alias("targets"))
    d = loose.join(overloads, ["c", "m"], "left").withColumn("n", F.when(F.col("targets").isNull(), 0).otherwise(F.size("targets")))
    found = d.filter("n > 0")
    how = {"resolvedBy": F.lit("arity-resolver"), "ambiguous": F.col("n") > 1, "overloadCount": F.col("n")}
    own = F.lit("{}")
    if "attributes" in edges.columns:
        fields = F.map_filter(F.from_json(F.coalesce("attributes", F.lit("{}")), "map<string, variant>"), lambda k, v: ~k.isin("unresolvedArity", *how))
        own = F.coalesce(F.to_json(fields), F.lit("{}"))
    key = [c for c in ("org_id", "rel_type", "src", "dst") if c in edges.columns]
    made = found.withColumn("attributes", json_with(own, how)).withColumn("dst", F.explode("targets")).drop("c", "m", "targets", "n").dropDuplicates(key)
    gone = found.select(*key)
    kept = edges.join(gone, key, "left_anti").withColumn("attributes", F.col("attributes") if "attributes" in edges.columns else F.lit(None).cast("string"))
    counters = d.agg(F.count("*").alias("scanned"), F.count_if(F.col("n") > 0).alias("resolved"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.count_if(F.col("n") == 0).alias("missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("emitted"))
    return Resolved(kept.unionByName(made).dropDuplicates(key), counters, made, gone)


#: A method's qname, as far as flows can call it: class, name, arity. Fixed value.
METHOD = r"^ApexMethod:(.+)\.([A-Za-z_]\w*)\(\d+\)$"


def resolve_invocable(edges: DataFrame, methods: DataFrame) -> Resolved:
    """FLOW_INVOKES_APEX_METHOD edges from flows to every invocable method of the class they name, marked ambiguous if there are several.

    methods: qname, attributes. The edges keep the attributes of those to the class, which stay. Counters: scanned, resolved (with any method),
    ambiguous (with several), missing (with none).
    """
    flag = (F.get_json_object("attributes", "$.isInvocable") == "true") & F.col("qname").rlike(METHOD)
    byclass = methods.filter(flag).select(F.regexp_extract("qname", METHOD, 1).alias("c"), "qname").groupBy("c").agg(F.collect_set("qname").alias("found"))
    d = edges.filter((F.col("rel_type") == "FLOW_INVOKES_APEX") & F.col("dst").startswith("ApexClass:"))
    d = d.withColumn("c", F.substring("dst", F.lit(len("ApexClass:") + 1), F.length("dst"))).join(byclass, "c", "left").withColumn("n", F.when(F.col("found").isNull(), 0).otherwise(F.size("found")))
    d = materialize(d)  # read for the edges and for the counters
    own = F.col("attributes") if "attributes" in edges.columns else F.lit(None).cast("string")
    attributes = json_with(own, {"resolvedBy": F.lit("flow-invocable-resolver"), "ambiguous": F.col("n") > 1})
    made = d.filter("n > 0").select("src", F.explode("found").alias("dst"), F.lit("FLOW_INVOKES_APEX_METHOD").alias("rel_type"), attributes.alias("attributes"), (F.col("n") > 1).alias("ambiguous"))
    counters = d.agg(F.count("*").alias("scanned"), F.count_if(F.col("n") > 0).alias("resolved"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.count_if(F.col("n") == 0).alias("missing"))
    return Resolved(made, counters)


#: Labels of the two flavours of the same thing, and what stands for both in a signature. Fixed values.
FLAVOR_PAIRS = [("DataRaptor", "OmniDataTransform"), ("IntegrationProcedure", "OmniIntegrationProcedure"), ("OmniScript", "OmniProcess"), ("VlocityCard", "OmniUiCard")]
FLAVOR_TOKENS = ["dr_or_odt", "ip_or_oip", "os_or_op", "vc_or_ouc"]


def link_flavors(nodes: DataFrame, pairs: list[tuple[str, str]] = FLAVOR_PAIRS, namespace: str | None = None) -> DataFrame:
    """CANONICAL_OF edges, both ways, between nodes of paired labels with one normalised name, with `pair` (the labels, the source's first); of equal names the last qname stands."""
    made = None
    keyed = nodes.select("qname", "label", normalize_key(F.col("qname"), namespace).alias("k"))
    for a, b in pairs:
        one = keyed.filter(F.col("label") == a).groupBy("k").agg(F.max("qname").alias("x"))
        d = one.join(keyed.filter(F.col("label") == b).select("k", F.col("qname").alias("y")), "k")
        both = d.select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit(f"{a}<>{b}").alias("pair")).unionByName(d.select(F.col("y").alias("src"), F.col("x").alias("dst"), F.lit(f"{b}<>{a}").alias("pair")))
        made = both if made is None else made.unionByName(both)
    return made.withColumn("rel_type", F.lit("CANONICAL_OF"))


def unite_flavors(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes that links join (src, pair), with the union of their `flavors` and both labels in the attributes, and a hash that tells the change."""
    labels = links.select(F.col("src").alias("qname"), F.split("pair", "<>").alias("labels")).distinct().groupBy("qname").agg(F.flatten(F.collect_list("labels")).alias("labels"))
    d = nodes.join(labels, "qname")
    old = F.from_json(F.get_json_object("attributes", "$.flavors"), "array<string>")
    d = d.withColumn("next", F.array_sort(F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), "labels"))))
    without = F.regexp_replace(F.regexp_replace("attributes", r'"flavors"\s*:\s*\[[^\]]*\]\s*,?\s*', ""), r",\s*\}$", "}")
    d = d.withColumns({"attributes": json_with(without, {"flavors": F.col("next")}), "source_hash": F.concat(F.col("source_hash"), F.lit("+canonical:"), F.array_join("next", ","))})
    return d.select(nodes.columns)


def signature_token(qname: Column) -> Column:
    """What an edge's target counts as: the two labels of a flavour as one, others by their label in lower case."""
    out = F.lower(F.substring_index(qname, ":", 1))
    for pair, token in zip(FLAVOR_PAIRS, FLAVOR_TOKENS):
        out = F.when(qname.rlike("(?i)^(" + "|".join(pair) + "):"), token).otherwise(out)
    return out


def compare_flavors(edges: DataFrame) -> DataFrame:
    """For each CANONICAL_OF pair (x the older flavour, y the newer): status (matched, diverged, empty) and the points in which their outgoing
    edges differ, as `relation|token: n vs m` in order of the keys. Relations count by their names."""
    older = F.substring_index("src", ":", 1).isin([a for a, _ in FLAVOR_PAIRS])
    pairs = edges.filter((F.col("rel_type") == "CANONICAL_OF") & older).select(F.col("src").alias("x"), F.col("dst").alias("y")).distinct()
    signs = edges.filter("rel_type <> 'CANONICAL_OF'").select(F.col("src").alias("q"), F.concat_ws("|", "rel_type", signature_token(F.col("dst"))).alias("k")).groupBy("q", "k").agg(F.count("*").alias("n"))
    sides = []
    for end in ("x", "y"):
        sides.append(pairs.join(signs.withColumnRenamed("q", end), end).select("x", "y", "k", F.col("n").alias("n" + end)))
    d = sides[0].join(sides[1], ["x", "y", "k"], "full_outer").na.fill(0, ["nx", "ny"])
    point = F.when(F.col("nx") != F.col("ny"), F.struct("k", F.concat(F.col("k"), F.lit(": "), F.col("nx").cast("string"), F.lit(" vs "), F.col("ny").cast("string")).alias("text")))
    per = d.groupBy("x", "y").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["text"]).alias("points"))
    out = pairs.join(per, ["x", "y"], "left")
    return out.select("x", "y", F.when(F.col("points").isNull(), "empty").when(F.size("points") == 0, "matched").otherwise("diverged").alias("status"), F.coalesce("points", F.array().cast("array<string>")).alias("points"))


def annotate_flavors(edges: DataFrame, compared: DataFrame, at: int) -> DataFrame:
    """The CANONICAL_OF edges of compared pairs, both ways, with signaturesMatch, divergencePoints and overlapEvaluatedAt (ms) in their attributes."""
    both = compared.select(F.col("x").alias("src"), F.col("y").alias("dst"), "points").unionByName(compared.select(F.col("y").alias("src"), F.col("x").alias("dst"), "points"))
    d = edges.filter("rel_type = 'CANONICAL_OF'").join(both, ["src", "dst"])
    return d.select("src", "dst", "rel_type", json_with(F.col("attributes"), {"signaturesMatch": F.size("points") == 0, "divergencePoints": F.col("points"), "overlapEvaluatedAt": F.lit(at)}).alias("attributes"))


#: Words that are never names of nodes. Fixed values.
RESERVED = ["true", "false", "null", "undefined", "this", "self", "string", "number", "boolean", "object", "array", "any", "void", "id", "name", "type", "value", "default", "none", "yes", "no"]


def infer_references(nodes: DataFrame, scope: list[str] | None = None, per_source: int = 200, min_length: int = 4) -> Resolved:
    """REFERENCES edges to nodes whose bare name stands as a string anywhere in a node's attributes: as it is, else in lower case.

    Strings that are short, reserved, numeric or have white space don't count. `via_key`: the nearest key above the string. `ambiguous` if
    several nodes have the name; at most per_source edges of a source, in order of target and path. No source needs more than the first
    per_source + 1 nodes of a name, so a name has no more rows than that; a value counts once a source before the join.
    """
    d = nodes.filter(F.col("label").isin(scope)) if scope else nodes
    leaf = json_leaves(d.select("qname", "attributes")).select(F.col("qname").alias("src"), "path", "key", F.col("value").alias("v"))
    leaf = leaf.filter((F.length("v") >= min_length) & ~F.lower("v").isin(RESERVED) & ~F.col("v").rlike(r"\s") & ~F.col("v").rlike("^[0-9-]+$"))
    leaf = materialize(leaf.groupBy("src", "v").agg(F.min(F.struct("path", "key")).alias("at")))  # read for exact names and for the others
    names = d.select(F.col("qname").alias("dst"), F.regexp_replace("qname", "^[^:]*:", "").alias("name")).filter("name <> ''")

    def candidates(key: Column) -> DataFrame:
        keyed = names.select(key.alias("v"), "dst")
        many = keyed.groupBy("v").agg((F.count("*") > 1).alias("ambiguous"))
        first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("dst"))).filter(F.col("n") <= per_source + 1)
        return first.groupBy("v").agg(F.collect_list("dst").alias("found")).join(many, "v")

    exact = leaf.join(candidates(F.col("name")), "v", "left")
    rest = exact.filter("found is null").select(F.lower("v").alias("v"), "src", "at")
    hit = exact.filter("found is not null").select("src", "at", "found", "ambiguous").unionByName(rest.join(candidates(F.lower("name")), "v").select("src", "at", "found", "ambiguous"))
    found = hit.select("src", "at", "ambiguous", F.explode("found").alias("dst")).filter("src <> dst")
    first = found.groupBy("src", "dst").agg(F.min(F.struct("at.path", "at.key", "ambiguous")).alias("f")).select("src", "dst", F.col("f.path").alias("path"), F.col("f.key").alias("via_key"), F.col("f.ambiguous").alias("ambiguous"))
    ranked = materialize(first.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst", "path"))))  # read for the edges and for the counters
    counters = ranked.agg(F.count_if(F.col("n") <= per_source).alias("edges"), F.count_distinct(F.when(F.col("n") > per_source, F.col("src"))).alias("truncated_sources"))
    return Resolved(ranked.filter(F.col("n") <= per_source).select("src", "dst", F.lit("REFERENCES").alias("rel_type"), "via_key", "ambiguous"), counters)
