"""Differences between snapshots, orgs and working trees, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def diff_nodes(before: DataFrame, after: DataFrame, by: str = "source_hash") -> DataFrame:
    """qname, label, change. One full outer join on qname."""
    a = before.select("qname", F.col("label").alias("la"), F.col(by).alias("a"), F.lit(1).alias("ina"))
    b = after.select("qname", F.col("label").alias("lb"), F.col(by).alias("b"), F.lit(1).alias("inb"))
    d = a.join(b, "qname", "full_outer")
    change = F.when(F.col("ina").isNull(), ADDED).when(F.col("inb").isNull(), REMOVED).when(~F.col("a").eqNullSafe(F.col("b")), CHANGED)
    return d.select("qname", F.coalesce("lb", "la").alias("label"), change.alias("change")).filter(F.col("change").isNotNull())


def diff_edges(before: DataFrame, after: DataFrame, include_changed: bool = False) -> DataFrame:
    """rel_type, src, dst, change: added and removed, and with include_changed those whose attributes differ."""
    key = ["rel_type", "src", "dst"]
    extra = ["attributes"] if include_changed else []
    a = before.select(*key, *extra).withColumn("ina", F.lit(1)).withColumnsRenamed({"attributes": "a"})
    b = after.select(*key, *extra).withColumn("inb", F.lit(1)).withColumnsRenamed({"attributes": "b"})
    change = F.when(F.col("ina").isNull(), ADDED).when(F.col("inb").isNull(), REMOVED)
    if include_changed:
        change = change.when(~F.col("a").eqNullSafe(F.col("b")), CHANGED)
    return a.join(b, key, "full_outer").select(*key, change.alias("change")).filter(F.col("change").isNotNull())


def diff_orgs(a: DataFrame, b: DataFrame, by: str = "source_hash") -> DataFrame:
    """qname, side: only_in_a, only_in_b or changed."""
    side = {ADDED: "only_in_b", REMOVED: "only_in_a", CHANGED: CHANGED}
    d = diff_nodes(a, b, by)
    name = F.lit(None).cast("string")
    for change, s in side.items():
        name = F.when(F.col("change") == change, s).otherwise(name)
    return d.select("qname", "label", name.alias("side"))


def diff_working_tree(local: DataFrame, stored: DataFrame, walked_labels: list[str] | None = None) -> DataFrame:
    """qname, change of a working tree against what is stored; removals only within the labels that were walked."""
    d = diff_nodes(stored, local)
    return d if walked_labels is None else d.filter((F.col("change") != REMOVED) | F.col("label").isin(walked_labels))


#: Labels that a deployment manifest has members of, by the type they have there: first those of the same name, then the others. Fixed values.
SAME_TYPES = """
ApexClass ApexTrigger ApexPage ApexComponent LightningComponentBundle AuraDefinitionBundle Flow CustomObject CustomField Profile
PermissionSet PermissionSetGroup NamedCredential ExternalServiceRegistration PlatformEventChannel StaticResource Layout RecordType
ValidationRule Workflow WorkflowRule ApprovalProcess Queue Group Role ConnectedApp RemoteSiteSetting EmailTemplate Report Dashboard
FlexiPage DuplicateRule Network GenAiPlanner GenAiPlugin
""".split()
OTHER_TYPES = {"SharingRule": "SharingRules", "CustomLabel": "CustomLabels", "CustomMetadataType": "CustomObject", "CustomMetadataRecord": "CustomMetadata", "MatchingRule": "MatchingRules"}
API_VERSION = "59.0"


def member_name(label: Column, qname: Column) -> Column:
    """What follows the prefix; of a sharing rule the object's name only."""
    name = F.substring(qname, F.instr(qname, ":") + 1, F.length(qname))
    return F.when(label == "SharingRule", F.substring_index(name, ".", 1)).otherwise(name)


def _typed(diff: DataFrame) -> DataFrame:
    """destructive, type and member of what a manifest names."""
    kind = F.when(F.col("label").isin(SAME_TYPES), F.col("label"))
    for label, name in OTHER_TYPES.items():
        kind = kind.when(F.col("label") == label, name)
    d = diff.select((F.col("side") == "only_in_b").alias("destructive"), kind.alias("type"), member_name(F.col("label"), F.col("qname")).alias("member"))
    return d.filter(F.col("type").isNotNull() & (F.col("member") != ""))


def manifest_members(diff: DataFrame) -> DataFrame:
    """diff: qname, label, side. destructive, type, the sorted distinct members and the number of nodes: adds are what only A has or what
    changed, removals what only B has. Labels that no manifest has members of are left out. A type is one row: manifest_lines has a row a member."""
    return _typed(diff).groupBy("destructive", "type").agg(F.array_sort(F.collect_set("member")).alias("members"), F.count("*").alias("n"))


def manifest_counts(diff: DataFrame) -> DataFrame:
    return _typed(diff).groupBy("destructive", "type").agg(F.count("*").alias("n"))


def escape_xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def manifest_xml(members: DataFrame, destructive: bool, version: str = API_VERSION) -> str:
    """The manifest as XML: types and members in order. All of it reaches the driver; write_manifest is for those of many members."""
    d = members.filter(F.col("destructive") == destructive).withColumn("members", F.transform("members", lambda m: F.concat(F.lit("    <members>"), escape_xml(m), F.lit("</members>\n"))))
    types = "".join(f"  <types>\n{''.join(r.members)}    <name>{r.type}</name>\n  </types>\n" for r in d.orderBy("type").collect())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<Package xmlns="http://soap.sforce.com/2006/04/metadata">\n{types}  <version>{version}</version>\n</Package>\n'


def manifest_lines(diff: DataFrame, destructive: bool, version: str = API_VERSION) -> DataFrame:
    """The lines of a manifest as rows, of any number of members; place, type, part and member are their order."""
    d = _typed(diff).filter(F.col("destructive") == destructive).select("type", "member").distinct()
    row = lambda place, type_, part, member, line: F.struct(F.lit(place).alias("place"), type_.alias("type"), F.lit(part).alias("part"), member.alias("member"), line.alias("line"))
    none, kind = F.lit(""), F.col("type")
    member = d.select(F.inline(F.array(row(1, kind, 1, F.col("member"), F.concat(F.lit("    <members>"), escape_xml(F.col("member")), F.lit("</members>"))))))
    frame = d.select("type").distinct().select(F.inline(F.array(row(1, kind, 0, none, F.lit("  <types>")), row(1, kind, 2, none, F.concat(F.lit("    <name>"), kind, F.lit("</name>"))), row(1, kind, 3, none, F.lit("  </types>")))))
    ends = [(0, 0, '<?xml version="1.0" encoding="UTF-8"?>'), (0, 1, '<Package xmlns="http://soap.sforce.com/2006/04/metadata">'), (2, 0, f"  <version>{version}</version>"), (2, 1, "</Package>")]
    around = diff.sparkSession.range(1).select(F.inline(F.array(*[row(place, none, part, none, F.lit(line)) for place, part, line in ends])))
    return member.unionByName(frame).unionByName(around)


def write_manifest(diff: DataFrame, path: str, destructive: bool, version: str = API_VERSION) -> None:
    """Writes a manifest's lines as text files, in order of name: one after another they are the manifest. No member passes the driver."""
    manifest_lines(diff, destructive, version).orderBy("place", "type", "part", "member").select("line").write.text(path)


#: Numbers of lines whose headings are ordered together.
DIFF_SPAN = 100_000


def parse_diff(text: DataFrame) -> DataFrame:
    """text: n (order) and line of a unified diff. path and status (added, modified, deleted); the last entry of a path wins.

    A `+++` heading ends an entry, whose old name is that of a `---` heading just before it among the headings; without one the file is new. Headings are
    ordered in spans of line numbers, each of which hears the last heading before it: one row a span is all that is ordered at once.
    """
    head = text.select("n", F.rtrim("line").alias("line"), F.floor(F.col("n") / DIFF_SPAN).alias("span")).filter(F.col("line").rlike(r"^(---|\+\+\+) "))
    near = head.withColumn("before", F.lag("line").over(Window.partitionBy("span").orderBy("n"))).filter(F.col("line").startswith("+++ "))
    last = head.groupBy("span").agg(F.max_by("line", "n").alias("last"))
    far = last.select("span", F.lag("last").over(Window.orderBy("span")).alias("far"))  # a row for each span
    d = near.join(far, "span", "left").withColumn("before", F.coalesce("before", "far"))

    def name(line: Column, start: str) -> Column:
        found = F.regexp_replace(F.trim(F.regexp_extract(line, r"^(?:---|\+\+\+) ([^\t]*)", 1)), f"^{start}/", "")
        return F.when(F.substring_index(F.trim(F.substring(line, 5, 10)), "\t", 1) != "/dev/null", found)

    old, new = name(F.when(F.col("before").startswith("--- "), F.col("before")), "a"), name(F.col("line"), "b")
    d = d.select("n", F.coalesce(new, old).alias("path"), F.when(old.isNull(), ADDED).when(new.isNull(), "deleted").otherwise("modified").alias("status"))
    return d.filter(F.coalesce("path", F.lit("")) != "").groupBy("path").agg(F.max_by("status", "n").alias("status"))


#: Where files of a project belong: pattern, and the qname its groups make. Fixed values, tried in order.
PATH_RULES = [
    (r"classes/([^/]+)\.cls(?:-meta\.xml)?$", "ApexClass:$1"),
    (r"triggers/([^/]+)\.trigger(?:-meta\.xml)?$", "ApexTrigger:$1"),
    (r"lwc/([^/]+)/.*$", "LWC:$1"),
    (r"flows/([^/]+)\.flow(?:-meta\.xml)?$", "Flow:$1"),
    (r"objects/([^/]+)/fields/([^/]+)\.field-meta\.xml$", "CustomField:$1.$2"),
    (r"objects/([^/]+)/\1\.object-meta\.xml$", "CustomObject:$1"),
    (r"objects/([^/]+)\.object$", "CustomObject:$1"),
]


def path_to_qname(path: Column) -> Column:
    """The qname a project file stands for, whichever way its slashes lean; null for other files."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.lit(None).cast("string")
    for pattern, name in reversed(PATH_RULES):
        made = F.regexp_replace(F.regexp_extract(path, pattern, 0), pattern, name)
        out = F.when(path.rlike(pattern), made).otherwise(out)
    return out
