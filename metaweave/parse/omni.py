"""Vlocity and OmniStudio members: elements of a JSON tree, told by their type."""

from __future__ import annotations

import json
import re
from typing import Any

from .base import Context, Facts, each_object, field_refs, local, parse_json

#: For each label: the flavour, whether a type is compared without spaces and signs, and what element types point at, in order:
#: words in the type, relation, target label, property keys of the target's name. Fixed values.
ELEMENTS: dict[str, tuple[str, bool, list[tuple]]] = {
    "IntegrationProcedure": ("IP", True, [
        (("dataraptor",), "IP_CALLS_DR", "DataRaptor", ("bundle", "integrationProcedureKey", "remoteClass", "dataRaptorBundleName")),
        (("integrationprocedure", "=ipaction", "=ip"), "IP_CALLS_IP", "IntegrationProcedure", ("bundle", "integrationProcedureKey", "remoteClass", "dataRaptorBundleName")),
        (("remote", "rest", "http"), "IP_INVOKES_REMOTE", "Remote", ("bundle", "integrationProcedureKey", "remoteClass", "dataRaptorBundleName", "endpointURL")),
    ]),
    "OmniScript": ("OS", False, [
        (("dataraptor",), "OS_USES_DR", "DataRaptor", ("dataRaptorBundleName", "bundle")),
        (("integrationprocedure",), "OS_CALLS_IP", "IntegrationProcedure", ("integrationProcedureKey",)),
        (("card",), "OS_EMBEDS_VC", "VlocityCard", ("cardName", "bundle")),
        (("remote", "rest"), "OS_INVOKES_REMOTE", "Remote", ("remoteClass", "endpointURL")),
    ]),
    "VlocityCard": ("VC", False, [
        (("dataraptor",), "VC_USES_DR", "DataRaptor", ("dataRaptorBundleName",)),
        (("integrationprocedure",), "VC_CALLS_IP", "IntegrationProcedure", ("integrationProcedureKey",)),
        (("lwc", "lightning"), "VC_EMBEDS_LWC", "LWC", ("componentName", "bundle")),
        (("card",), "EMBEDS_VC", "VlocityCard", ("cardName",)),
        (("remote", "rest"), "VC_INVOKES_REMOTE", "Remote", ("remoteClass", "endpointURL")),
    ]),
    "OmniProcess": ("OMNI", True, [
        (("datatransform", "dataraptor"), "OMNI_CALLS_DATA_TRANSFORM", "OmniDataTransform", ("dataTransformName", "dataRaptorBundleName", "bundle")),
        (("integrationprocedure",), "OMNI_CALLS_INTEGRATION_PROCEDURE", "OmniIntegrationProcedure", ("integrationProcedureKey",)),
        (("uicard",), "OMNI_EMBEDS_UI_CARD", "OmniUiCard", ("cardName",)),
        (("remote", "rest"), "OMNI_INVOKES_REMOTE", "Remote", ()),
    ]),
    "OmniIntegrationProcedure": ("OMNI", True, [
        (("datatransform", "dataraptor"), "OMNI_CALLS_DATA_TRANSFORM", "OmniDataTransform", ("dataTransformName", "dataRaptorBundleName", "bundle")),
        (("integrationprocedure",), "OMNI_CALLS_INTEGRATION_PROCEDURE", "OmniIntegrationProcedure", ("integrationProcedureKey",)),
        (("remote", "rest"), "OMNI_INVOKES_REMOTE", "Remote", ()),
    ]),
    "OmniUiCard": ("OMNI", True, [
        (("integrationprocedure",), "OMNI_CALLS_INTEGRATION_PROCEDURE", "OmniIntegrationProcedure", ("integrationProcedureKey",)),
        (("datatransform", "dataraptor"), "OMNI_CALLS_DATA_TRANSFORM", "OmniDataTransform", ("dataTransformName",)),
        (("remote", "rest"), "OMNI_INVOKES_REMOTE", "Remote", ()),
    ]),
}


def parse_elements(label: str, name: str, tree: Any, context: Context) -> Facts:
    """A node for the member, and an edge for each element whose explicit type tells what it points at."""
    out, tree = Facts(context), parse_json(tree)
    flavour, squeezed, kinds = ELEMENTS[label]
    own = local(name, context.namespace)
    q = out.node(label, f"{label}:{own}", {"name": own, "flavor": flavour}, json.dumps(tree))
    for e in each_object(tree):
        kind = e.get("Type", e.get("type"))
        if not isinstance(kind, str) or not kind:
            continue
        kind = re.sub("[^a-z0-9]" if squeezed else r"\s", "", kind.lower())
        props = e.get("propertySet") if isinstance(e.get("propertySet"), dict) else e
        for words, rel, target, keys in kinds:
            if any(kind == w[1:] if w[0] == "=" else w in kind for w in words):
                found = next((str(props[k]) for k in keys if props.get(k) is not None), "")
                if target == "Remote":
                    out.edge(rel, q, f"Remote:{found or 'unknown'}")
                elif found:
                    out.edge(rel, q, f"{target}:{local(found, context.namespace)}")
                break
    return out


def parse_data_raptor(name: str, tree: Any, context: Context) -> Facts:
    """Fields it reads (Extract and Turbo, or with an input object) or writes (Load); a Transform points at itself as one."""
    out, tree = Facts(context), parse_json(tree)
    own = local(name, context.namespace)
    q = out.node("DataRaptor", f"DataRaptor:{own}", {"name": own, "flavor": "DR"}, json.dumps(tree))
    kind = str(tree.get("Type", tree.get("type", "")))
    reads = kind in ("Extract", "Turbo") or kind != "Load" and bool(tree.get("InputSObjectType", tree.get("inputSObjectType")))
    for ref in field_refs(json.dumps(tree)):
        if reads:
            out.edge("DR_READS_FIELD", q, f"CustomField:{ref}")
        if kind == "Load":
            out.edge("DR_WRITES_FIELD", q, f"CustomField:{ref}")
    if kind == "Transform":
        out.edge("DR_TRANSFORMS", q, f"Transform:{name}")
    return out


def parse_data_transform(name: str, tree: Any, context: Context) -> Facts:
    out, tree = Facts(context), parse_json(tree)
    own = local(name, context.namespace)
    q = out.node("OmniDataTransform", f"OmniDataTransform:{own}", {"name": own, "flavor": "OMNI"}, json.dumps(tree))
    for ref in field_refs(json.dumps(tree)):
        out.edge("OMNI_USES_DATA_TRANSFORM", q, f"CustomField:{ref}")
    return out
