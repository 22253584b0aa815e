"""Flows, objects and what has a node only."""

from __future__ import annotations

from typing import Any

from .base import Context, Facts, as_dict, field_refs, local, many, parse_xml


def parse_flow(name: str, xml: str, context: Context) -> Facts:
    """A flow with its version, and what the version fires on, invokes and works on (each kind and object once)."""
    out = Facts(context)
    ns = context.namespace
    own = local(name, ns)
    try:
        flow = as_dict(parse_xml(xml)[1])
    except ValueError as error:
        return out.error("Flow", own, str(error))
    version = str(flow.get("apiVersion", "") or "")
    q = out.node("Flow", f"Flow:{own}", {"name": own, "processType": flow.get("processType"), "status": flow.get("status")}, xml)
    v = out.node("FlowVersion", f"FlowVersion:{own}.v{version or '0'}", {"name": own, "apiVersion": version or None, "status": flow.get("status")}, xml)
    out.edge("CONTAINS", q, v)
    start = as_dict(flow.get("start"))
    if start.get("object"):
        out.edge("TRIGGER_FIRES_ON", v, f"CustomObject:{local(start['object'], ns)}", {k: start.get(k) for k in ("triggerType", "recordTriggerType")})
    for call in map(as_dict, many(flow.get("actionCalls"))):
        kind, action = str(call.get("actionType", "")), local(call.get("actionName"), ns)
        if kind == "apex":
            out.edge("FLOW_INVOKES_APEX", v, f"ApexClass:{action}", {"actionName": action})
        else:
            out.edge("FLOW_INVOKES_ACTION", v, f"FlowAction:{kind}:{action}", {"actionType": kind})
    for sub in map(as_dict, many(flow.get("subflows"))):
        target = local(sub.get("flowName"), ns)
        out.edge("FLOW_INVOKES_SUBFLOW", v, f"Flow:{target}", {"flowName": target})
    for kind in ("recordCreates", "recordUpdates", "recordDeletes", "recordLookups"):
        for target in dict.fromkeys(local(as_dict(r).get("object"), ns) for r in many(flow.get(kind))):
            if target:
                out.edge("REFERENCES_OBJECT", v, f"CustomObject:{target}", {"kind": kind})
    return out


def _body(xml: str | None) -> dict:
    try:
        return as_dict(parse_xml(xml)[1]) if xml else {}
    except ValueError:
        return {}


def _formula(out: Facts, src: str, obj: str, formula: Any) -> None:
    for ref in field_refs(str(formula)):
        if f"CustomField:{ref}" != src:
            out.edge("READS_FIELD", src, f"CustomField:{ref}", {"via": "formula"})


def parse_object(name: str, xml: str, context: Context, fields: dict[str, str] | None = None, record_types: dict[str, str] | None = None, rules: dict[str, str] | None = None) -> Facts:
    """An object, its fields (those in its own file before those in theirs), record types and validation rules."""
    out, ns = Facts(context), context.namespace
    own = local(name, ns)
    try:
        obj = as_dict(parse_xml(xml)[1]) if xml else {}
    except ValueError as error:
        obj = {}
        out.error("CustomObject", own, str(error))
    event = own.endswith("__e")
    q = out.node("PlatformEvent" if event else "CustomObject", f"CustomObject:{own}", {"apiName": own, "label": obj.get("label"), "sharingModel": obj.get("sharingModel"), "isPlatformEvent": event}, xml)
    if event:
        out.node("PlatformEvent", f"PlatformEvent:{own}", {"apiName": own, "label": obj.get("label")}, xml)
    bodies = {local(as_dict(f).get("fullName"), ns): as_dict(f) for f in many(obj.get("fields")) if as_dict(f).get("fullName")}
    for file, text in (fields or {}).items():
        f = _body(text)
        bodies.setdefault(local(f.get("fullName", file), ns), f)
    for api, f in bodies.items():
        fq = out.node("CustomField", f"CustomField:{own}.{api}", {"apiName": api, "object": own, "type": f.get("type"), "label": f.get("label"), "required": f.get("required") is True, "formula": f.get("formula")}, xml)
        out.edge("DEFINES_FIELD", q, fq)
        for target in many(f.get("referenceTo")):
            out.edge("REFERENCES_OBJECT", fq, f"CustomObject:{local(target, ns)}", {"relationshipType": f.get("type")})
        values = as_dict(f.get("valueSet"))
        if values.get("valueSetName"):
            out.edge("USES_GLOBAL_VALUE_SET", fq, f"GlobalValueSet:{local(values['valueSetName'], ns)}")
        controls = values.get("controllingField") or f.get("controllingField")
        if controls:
            out.edge("DEPENDS_ON_FIELD", fq, f"CustomField:{own}.{local(controls, ns)}")
        if f.get("formula"):
            _formula(out, fq, own, f["formula"])
    for part, files, label, rel in (("recordTypes", record_types, "RecordType", "HAS_RECORD_TYPE"), ("validationRules", rules, "ValidationRule", "HAS_VALIDATION_RULE")):
        found = {str(as_dict(x).get("fullName")): as_dict(x) for x in many(obj.get(part)) if as_dict(x).get("fullName")}
        for file, text in (files or {}).items():
            x = _body(text)
            found.setdefault(str(x.get("fullName", file)), x)
        for api, x in found.items():
            extra = {"errorConditionFormula": x.get("errorConditionFormula"), "errorMessage": x.get("errorMessage")} if label == "ValidationRule" else {"label": x.get("label")}
            xq = out.node(label, f"{label}:{own}.{local(api, ns)}", {"apiName": local(api, ns), "object": own, "active": x.get("active") is True, **extra}, xml)
            out.edge(rel, q, xq)
            if x.get("errorConditionFormula"):
                _formula(out, xq, own, x["errorConditionFormula"])
    return out


def parse_matching_rule(name: str, xml: str, context: Context) -> Facts:
    out = Facts(context)
    out.node("MatchingRule", f"MatchingRule:{local(name, context.namespace)}", {"name": local(name, context.namespace)}, xml)
    return out


def parse_opaque(kind: str, name: str, raw: str, context: Context) -> Facts:
    """A node for what no parser knows: its type, name and size."""
    out = Facts(context)
    own = local(name, context.namespace)
    out.node(kind, f"{kind}:{own}", {"name": own, "metadataType": kind, "rawSize": len(raw or "")}, raw or "")
    return out
