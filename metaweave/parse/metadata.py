"""Members of declarative metadata: what nodes and edges each type of record gives, as columns.

A reader for each type asks a member for its elements and returns arrays of facts. Labels, relations, and the names of elements and
attributes are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Member, Reader, View, json_text, texts_under

#: Root element and reader of each type.
READERS: dict[str, tuple[str, Reader]] = {}


def reads(type_: str, root: str = "") -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        READERS[type_] = (root or type_, f)
        return f

    return add


def named(label: str, *parts: str | Column) -> Column:
    return F.concat(F.lit(f"{label}:"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def main_node(m: Member, label: str, attributes: dict[str, Column] | None = None, key: str = "name") -> tuple[Column, Column]:
    """The qualified name of the member itself, and its node."""
    q = named(label, m.name(key))
    return q, F.array(m.node(label, q, {key: json_text(m.name(key))} | (attributes or {})))


def attribute_of(markup: Column, name: str) -> Column:
    """The value of the first attribute of that name (in any case, in double quotes) that has one in a page's markup; empty without one."""
    return F.coalesce(F.regexp_extract(markup, rf'(?i){name}\s*=\s*"([^"]+)"', 1), F.lit(""))


def page_markup(m: Member, label: str) -> tuple[Column, list[Column]]:
    q, node = main_node(m, label, m.values("apiVersion", "label"))
    body = F.col("__body")
    others = F.filter(F.transform(F.split(attribute_of(body, "extensions"), ","), lambda x: F.trim(x)), lambda x: x != "")
    controller = F.array(m.to("CONTROLLED_BY", q, "ApexClass", m.local(attribute_of(body, "controller"))))
    return q, [node, controller, m.each_name(others, lambda x: m.to("EXTENDS_CONTROLLER", q, "ApexClass", x))]


@reads("ApexComponent")
def apex_component(m: Member) -> list[Column]:
    return page_markup(m, "ApexComponent")[1]


@reads("ApexPage")
def apex_page(m: Member) -> list[Column]:
    q, parts = page_markup(m, "ApexPage")
    return [*parts, m.each_name(m.nodes("controller").texts(), lambda x: m.to("CONTROLLED_BY", q, "ApexClass", x))]


@reads("ApprovalProcess")
def approval_process(m: Member) -> list[Column]:
    """A formula's words that are names of custom fields, each time they stand there."""
    q, node = main_node(m, "ApprovalProcess", m.flags("active"))
    formula = m.text("entryCriteria", "formula")
    fields = F.regexp_extract_all(F.coalesce(formula, F.lit("")), F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*__c)(?![A-Za-z0-9_])"), F.lit(1))
    return [node, m.each_name(fields, lambda x: m.to("APPROVAL_USES_FORMULA", q, "CustomField", x, {"formula": json_text(formula)}))]


@reads("CustomLabels")
def custom_labels(m: Member) -> list[Column]:
    def label(x: View) -> list[Column]:
        name = x.first("fullName", "name")
        return [m.node("CustomLabel", named("CustomLabel", name), {"name": json_text(name)} | x.values("value", "language"), name != "")]

    return [m.each(m.nodes("labels"), label)]


@reads("CustomMetadata")
def custom_metadata(m: Member) -> list[Column]:
    """A record is named Type.Record (or says that it is one); what isn't, is a type."""
    name = m.name("name")
    kind, dot = F.substring_index(name, ".", 1), F.instr(name, ".") > 0
    record = (dot & ~name.rlike(r"^[^.]*\.$")) | F.coalesce(m.text("kind") == "record", F.lit(False))
    q = named("CustomMetadataRecord", name)
    own = {"name": json_text(name)}
    type_ = m.node("CustomMetadataType", named("CustomMetadataType", name), own | m.values("label"), ~record)
    return [F.array(type_, m.node("CustomMetadataRecord", q, own, record), m.edge("INSTANCE_OF", q, named("CustomMetadataType", kind), when=record & (kind != "")))]


def uses(type_: str, relation: str, target: str, path: str, keys: tuple[str, ...], plain: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> None:
    """A type whose node has an edge for each element that names a target."""

    def read(m: Member) -> list[Column]:
        q, node = main_node(m, type_, m.values(*plain) | m.flags(*flags))
        return [node, m.each(m.nodes(path), lambda x: [m.to(relation, q, target, x.first(*keys))])] if path else [node]

    READERS[type_] = (type_, read)


uses("Dashboard", "DASHBOARD_USES_REPORT", "Report", "components", ("report",), plain=("title",))
uses("DuplicateRule", "REFERENCES", "MatchingRule", "duplicateRuleMatchRules", ("matchingRule",), flags=("isActive",))
uses("GenAiPlanner", "PLANNER_USES_PLUGIN", "GenAiPlugin", "genAiPlugins", ("genAiPluginName", "name"))
uses("GenAiPlugin", "PLUGIN_INVOKES_FUNCTION", "GenAiFunction", "genAiFunctions", ("functionName", "name"))
uses("NamedCredential", "", "", "", (), plain=("endpoint", "principalType", "protocol"))


@reads("ExternalServiceRegistration")
def external_service(m: Member) -> list[Column]:
    q, node = main_node(m, "ExternalServiceRegistration", m.values("status", "schemaType"))
    return [node, F.array(m.to("ESR_USES_NAMED_CREDENTIAL", q, "NamedCredential", m.first("namedCredential", "namedCredentialReference")))]


@reads("Layout")
def layout(m: Member) -> list[Column]:
    """A layout is named Object-Layout."""
    shown = F.substring_index(m.name("name"), "-", 1)
    q, node = main_node(m, "Layout", {"object": json_text(shown)})
    return [node, m.each(m.nodes("layoutSections", "layoutColumns", "layoutItems"), lambda x: [m.edge("RENDERS_FIELD", q, named("CustomField", shown, ".", x.name("field")), when=x.name("field") != "")])]


@reads("FlexiPage")
def flexi_page(m: Member) -> list[Column]:
    """Components stand at any depth of a page's regions."""
    q, node = main_node(m, "FlexiPage", m.values("type", "sobjectType"))
    names = F.flatten(F.transform(m.nodes("flexiPageRegions").texts(), lambda x: texts_under(x, "componentName")))
    return [node, F.transform(names, lambda x: m.to("EMBEDS_LWC", q, "LightningComponentBundle", m.local(F.regexp_replace(x, "^c:", ""))))]


@reads("Network")
def network(m: Member) -> list[Column]:
    q, node = main_node(m, "Network", m.values("status"))
    bundle = lambda name: m.to("NETWORK_USES_BUNDLE", q, "LightningComponentBundle", name)
    return [node, m.each(m.nodes("networkPageOverrides"), lambda x: [bundle(x.name("lightningCommunityBundle"))]), m.each_name(m.nodes("communityBundles").texts(), bundle)]


@reads("PermissionSetGroup")
def permission_set_group(m: Member) -> list[Column]:
    q, node = main_node(m, "PermissionSetGroup", m.values("label"))
    return [node, m.each_name(m.nodes("permissionSets").texts(), lambda x: m.to("GRANTS_USER_PERMISSION", q, "PermissionSet", x))]


OBJECT_RIGHTS = ["allowRead", "allowEdit", "allowCreate", "allowDelete"]


def grants(m: Member, q: Column, rights: list[str]) -> list[Column]:
    """Edges to what a profile or permission set gives access to: objects, fields (Object.Field), classes."""

    def field(x: View) -> list[Column]:
        parts = F.split(F.coalesce(x.text("field"), F.lit("")), r"\.")
        return [m.edge("GRANTS_FIELD_ACCESS", q, named("CustomField", x.local(F.get(parts, F.lit(0))), ".", x.local(F.get(parts, F.lit(1)))), x.flags("readable", "editable"), F.get(parts, F.lit(0)) != "")]

    return [
        m.each(m.nodes("objectPermissions"), lambda x: [m.to("GRANTS_OBJECT_ACCESS", q, "CustomObject", x.name("object"), x.flags(*rights))]),
        m.each(m.nodes("fieldPermissions"), field),
        m.each(m.nodes("classAccesses"), lambda x: [m.to("GRANTS_APEX_ACCESS", q, "ApexClass", x.name("apexClass"), x.flags("enabled"))]),
    ]


@reads("PermissionSet")
def permission_set(m: Member) -> list[Column]:
    q, node = main_node(m, "PermissionSet", m.values("label"))
    return [node, *grants(m, q, OBJECT_RIGHTS)]


@reads("Profile")
def profile(m: Member) -> list[Column]:
    q, node = main_node(m, "Profile")
    pages = m.each(m.nodes("pageAccesses"), lambda x: [m.to("GRANTS_PAGE_ACCESS", q, "ApexPage", x.name("apexPage"), x.flags("enabled"))])
    tabs = m.each(m.nodes("tabVisibilities"), lambda x: [m.to("GRANTS_TAB_ACCESS", q, "CustomTab", x.name("tab"), x.values("visibility"))])
    return [node, *grants(m, q, [*OBJECT_RIGHTS, "modifyAllRecords", "viewAllRecords"]), pages, tabs]


@reads("PlatformEvent", "CustomObject")
def platform_event(m: Member) -> list[Column]:
    return [main_node(m, "PlatformEvent", m.values("label", "eventType", "publishBehavior"), "apiName")[1]]


@reads("Report")
def report(m: Member) -> list[Column]:
    q, node = main_node(m, "Report", {"reportType": json_text(F.coalesce(m.text("reportType"), F.lit("")))})
    columns = m.each(m.nodes("columns"), lambda x: [m.to("READS_FIELD", q, "CustomField", x.name("field"))])
    return [node, F.array(m.to("REPORTS_ON", q, "CustomObject", m.name("reportType"))), columns]


@reads("SharingRules")
def sharing_rules(m: Member) -> list[Column]:
    """An object's rules; each says who gets which access, by owner or by criteria."""
    obj = m.name("object")

    def rules(kind: str) -> Callable[[View], list[Column]]:
        def facts(x: View) -> list[Column]:
            name, access = x.first("fullName", "name"), F.coalesce(x.text("accessLevel"), F.lit(""))
            level = {"accessLevel": json_text(access), "audit": (access == "All").cast("string")}
            q = named("SharingRule", obj, ".", name)
            below = x.name("sharedTo", "roleAndSubordinates")
            role = F.coalesce(F.nullif(x.name("sharedTo", "role"), F.lit("")), below)
            out = [
                m.node("SharingRule", q, {"ruleName": json_text(name), "object": json_text(obj), "kind": json_text(F.lit(kind))} | level),
                m.edge("SHARING_GRANTS", q, named("CustomObject", obj), level),
                m.to("SHARING_TO_GROUP", q, "Group", x.name("sharedTo", "group")),
                m.to("SHARING_TO_ROLE", q, "Role", role, {"includesSubordinates": (below != "").cast("string")}),
            ]
            return [*out, m.to("SHARING_FROM_OWNER_GROUP", q, "Group", x.name("sharedFrom", "group"))] if kind == "owner" else out

        return facts

    return [m.each(m.nodes(key), rules(kind)) for kind, key in (("owner", "sharingOwnerRules"), ("criteria", "sharingCriteriaRules"))]


@reads("Workflow")
def workflow(m: Member) -> list[Column]:
    obj = m.name("object")
    q, node = main_node(m, "Workflow", key="object")

    def rule(x: View) -> list[Column]:
        name = x.first("fullName", "name")
        own = named("WorkflowRule", obj, ".", name)
        about = {"name": json_text(name), "object": json_text(obj)} | x.flags("active")
        return [m.node("WorkflowRule", own, about), m.edge("WORKFLOW_TRIGGERS", q, own), m.edge("TRIGGER_FIRES_ON", own, named("CustomObject", obj))]

    updates = m.each(m.nodes("fieldUpdates"), lambda x: [m.edge("WORKFLOW_UPDATES_FIELD", q, named("CustomField", obj, ".", x.name("field")), when=x.name("field") != "")])
    return [node, m.each(m.nodes("rules"), rule), updates]
